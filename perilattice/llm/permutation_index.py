"""Approximate nearest neighbours by a permutation index: pivot inverted files, footrule ranking, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize_counted, partitions

#: Query blocks that a data block meets in one task, and rows of a block that are offered at least.
GROUP, LEAST = 64, 64
#: Rows whose gains are added up at a time, and results of blocks that a task holds before it cuts them to the nearest.
ROWS, HELD = 4096, 4


def pick_pivots(vectors: DataFrame, n_pivots: int, sample: int, id_col: str, vec_col: str) -> dict[int, np.ndarray]:
    """By width, pivots from a sample of at most `sample` rows, chosen by a hash of the id: each next one far from those before (k-centres)."""
    by = F.xxhash64(F.col(id_col).cast("string"))
    first = lambda df: df.orderBy(by, id_col).select(vec_col).limit(sample).toArrow().column(0).to_pylist()
    # the smallest hashes lie below a bound, so few rows of each partition reach the task that picks them
    part = 4 * sample / max(1, vectors.count())
    rows = first(vectors.where(by < F.lit(int(part * 2**64) - 2**63))) if part < 1 else []
    rows = rows if len(rows) == sample else first(vectors)
    out = {}
    for width in sorted({len(r) for r in rows}):
        x = np.array([r for r in rows if len(r) == width], dtype=np.float64)
        x = np.unique(x / np.linalg.norm(x, axis=1, keepdims=True), axis=0)
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(n_pivots, len(x)):
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        out[width] = x[chosen]
    return out


def orders(x: np.ndarray, pivots: np.ndarray, depth: int) -> np.ndarray:
    """The `depth` nearest pivots of each row, nearest first."""
    depth = min(depth, len(pivots))
    out = np.empty((len(x), depth), np.int32)
    for k in range(0, len(x), 1024):
        part = x[k : k + 1024]
        far = -((part / np.linalg.norm(part, axis=1, keepdims=True)) @ pivots.T)
        top = np.sort(np.argpartition(far, depth - 1, axis=1)[:, :depth], axis=1)
        by = np.argsort(np.take_along_axis(far, top, 1), axis=1, kind="stable")
        out[k : k + 1024] = np.take_along_axis(top, by, 1)
    return out


class Inverted(NamedTuple):
    """For each pivot p, rows cut[p]:cut[p + 1] of the block's rows that have it among their nearest, and its place there."""

    cut: np.ndarray
    row: np.ndarray
    place: np.ndarray


def invert(order: np.ndarray, n_pivots: int) -> Inverted:
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    cut = np.searchsorted(flat[by], np.arange(n_pivots + 1))
    return Inverted(cut.astype("<i8"), (by // order.shape[1]).astype("<i4"), (by % order.shape[1]).astype("<i4"))


def footrules(orders: np.ndarray, posts: Inverted, n: int, depth: int) -> np.ndarray:
    """By order and row, how far the row's footrule distance to the order is below that of a row without a common pivot.

    A pivot that one of two orders hasn't got counts as at place `depth` there, so each shared pivot is a gain: twice what
    the later of its two places is before `depth`. The lists of ROWS rows at a time are laid out by row, 0 where a row isn't in one.
    """
    small, wide = np.min_scalar_type(depth), np.min_scalar_type(2 * depth * depth)
    out = np.empty((len(orders), n), wide)
    pivot = np.repeat(np.arange(len(posts.cut) - 1), np.diff(posts.cut))
    most = (depth - np.arange(orders.shape[1])).astype(small)[:, None]
    for k in range(0, n, ROWS):
        own = (posts.row >= k) & (posts.row < k + ROWS)
        laid = np.zeros((len(posts.cut) - 1, min(ROWS, n - k)), small)
        laid[pivot[own], posts.row[own] - k] = depth - posts.place[own]
        for i, order in enumerate(orders):
            out[i, k : k + ROWS] = np.minimum(laid[order], most).sum(axis=0, dtype=wide)
    return out * wide.type(2)


def footrule(own: np.ndarray, posts: Inverted, n: int, depth: int) -> np.ndarray:
    """The gains of one order."""
    return footrules(own[None], posts, n, depth)[0].astype(np.int64)


def offered(gain: np.ndarray, many: int) -> np.ndarray:
    """The `many` rows of the largest gain; all that tie with the last of them, unless it has none."""
    if many >= len(gain):
        return np.arange(len(gain))
    least = np.partition(gain, len(gain) - many)[len(gain) - many]
    return np.flatnonzero(gain >= least) if least > 0 else np.argpartition(gain, len(gain) - many)[len(gain) - many :]


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def cosine(q: np.ndarray, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Cosines in double precision, the same for equal rows wherever they stand; size: the lengths of x."""
    return (x * q).sum(axis=1) / (size * np.sqrt((q * q).sum()))


def packed(x: np.ndarray) -> bytes:
    """Vectors in single precision where that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype("<f4")
    return (single if (single == x).all() else x.astype("<f8")).tobytes()


def unpacked(vecs: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(vecs, "<f4" if len(vecs) == 4 * n * width else "<f8").reshape(n, width).astype(np.float64)


def best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest by query of (query, id, score); ties to the smaller id."""
    q, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((i, -s, q))
    q, i, s = q[by], i[by], s[by]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], i[keep], s[keep]


_INDEX = "block long, width long, ids binary, vecs binary, cut binary, row binary, place binary"
_ASKED = "block long, width long, ids binary, vecs binary, orders binary"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", n_pivots: int = 1024, depth: int = 64, sample: int = 4096, share: float = 0.08, block: int = 4096, query_block: int = 256) -> DataFrame:
    """The k nearest rows of each query by cosine: query_id, rank, vec_id, score; a query's own id is no candidate.

    Vectors that are null, zero, empty or hold null or non-finite components take no part, nor do rows without an id; vectors
    of different widths never meet. Ties go to the smaller id; repeated rows each count as
    candidates, and as one query. Fewer candidates give fewer rows, an
    empty table none. Other columns are not read.

    Pivots come from a bounded sample, by width; every row is indexed: it is represented by its `depth` nearest pivots in
    order, and posted in their inverted files. These are kept by block of at most `block` rows, and built and written
    once. Blocks of at most query_block queries meet each of them: a group of GROUP query blocks goes to each slot, a share of
    the data blocks, and a slot goes to a task once for each group. A block ranks its rows by the footrule distance of
    the orders, with partial sums over the query's pivots, and offers `share` of them (LEAST at least) for reranking on the original
    vectors, so recall doesn't fall as blocks are added. A width that the sample hasn't got is compared in full.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("v")
        out = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
        return out.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))

    data, asked = clean(vectors), clean(queries).dropDuplicates(["id", "v"])
    pivots = pick_pivots(data, n_pivots, sample, "id", "v")
    if not pivots:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(pivots)  # at most `sample` vectors

    def pack(size: int, finish):
        """Rows of up to `size` vectors of one width."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, n, held = TaskContext.get().partitionId(), 0, {}

            def row(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
                own = {"block": part << 32 | n, "width": x.shape[1], "ids": ids.astype("<i8").tobytes(), "vecs": packed(x)} | finish(x, shared.value.get(x.shape[1]))
                return pa.RecordBatch.from_pydict({c: [v] for c, v in own.items()})

            for batch in batches:
                every, values = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False)
                widths = pc.list_value_length(batch.column(1)).to_numpy().astype(np.int64)
                starts = np.cumsum(widths) - widths
                for w in np.unique(widths).tolist():
                    at = np.flatnonzero(widths == w)
                    ids, x = every[at], values[starts[at, None] + np.arange(w)]
                    if w in held:
                        ids, x = np.concatenate((held[w][0], ids)), np.concatenate((held[w][1], x))
                    full = len(ids) // size * size
                    for k in range(0, full, size):
                        yield row(ids[k : k + size], x[k : k + size])
                        n += 1
                    held[w] = ids[full:].copy(), x[full:].copy()
            for ids, x in held.values():
                if len(ids):
                    yield row(ids, x)
                    n += 1

        return run

    def index(x: np.ndarray, own: np.ndarray | None) -> dict:
        return {c: a.tobytes() for c, a in invert(orders(x, own, depth), len(own))._asdict().items()} if own is not None else {"cut": b"", "row": b"", "place": b""}

    def ask(x: np.ndarray, own: np.ndarray | None) -> dict:
        return {"orders": orders(x, own, depth).astype("<i4").tobytes() if own is not None else b""}

    n = partitions(spark)
    facts = (F.count(F.lit(1)).alias("n"), (F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 8).cast("long").alias("rows"))
    left, few = materialize_counted(asked.repartition(max(1, n // 8)).mapInArrow(pack(query_block, ask), _ASKED), "ann-queries", *facts)
    right, all_ = materialize_counted(data.mapInArrow(pack(block, index), _INDEX), "ann-index", *facts)
    # a stated query set meets all rows in blocks; blocks of a slot follow the queries of one group, which go to each slot once.
    # copies are dealt by their keys alone: a join could choose to broadcast them
    groups = max(1, -(-few["n"] // GROUP))
    # the queries' copies stay about as many rows as the data's
    slots = max(1, min(-(-2 * n // groups), all_["n"], max(16, groups * all_["rows"] // max(1, few["rows"]))))
    spread = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    dealt = lambda many: F.pmod(F.xxhash64("block"), F.lit(many)).cast("int")
    none = F.lit(None).cast("binary")
    side = left.select(spread(slots).alias("b"), dealt(groups).alias("g"), F.lit(0).alias("kind"), "width", "ids", "vecs", "orders", none.alias("cut"), none.alias("row"), none.alias("place"))
    base = right.select(dealt(slots).alias("b"), spread(groups).alias("g"), F.lit(1).alias("kind"), "width", "ids", "vecs", none.alias("orders"), "cut", "row", "place")
    rows = base.union(side).repartition(max(1, min(2 * n, slots * groups)), "b", "g").sortWithinPartitions("b", "g", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, asking, found = None, {}, []

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best(found, k)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for at in range(len(batch)):
                r = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                if here != (r["b"], r["g"]):
                    if found:
                        yield result()
                    here, asking, found = (r["b"], r["g"]), {}, []
                own = np.frombuffer(r["ids"], "<i8")
                x = unpacked(r["vecs"], len(own), r["width"])
                if not r["kind"]:
                    asking.setdefault(r["width"], []).append((own, x, np.frombuffer(r["orders"], "<i4").reshape(len(own), -1) if r["orders"] else None))
                    continue
                posts = Inverted(np.frombuffer(r["cut"], "<i8"), np.frombuffer(r["row"], "<i4"), np.frombuffer(r["place"], "<i4")) if r["cut"] else None
                size, many = lengths(x), max(LEAST, int(share * len(x)))
                for qids, vecs, perms in asking.get(r["width"], []):
                    gains = footrules(perms, posts, len(x), perms.shape[1]) if posts is not None else None
                    for j, (qid, v) in enumerate(zip(qids, vecs, strict=True)):
                        some = offered(gains[j], many) if gains is not None else np.arange(len(x))
                        some = some[own[some] != qid]
                        s = cosine(v, x[some], size[some])
                        top = np.lexsort((own[some], -s))[:k]
                        found.append((np.full(len(top), qid), own[some][top], s[top]))
                if len(found) > HELD * GROUP * query_block:
                    found = [best(found, k)]
        if found:
            yield result()

    hits = rows.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
