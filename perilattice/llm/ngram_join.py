"""N-gram Jaccard self-join: prefix filters choose candidates, a prefix tree over ordered sets verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hand_back, materialize, materialize_counted, mix, partitions, release, shingle_hashes, text_bytes, tidy, word_hashes
from .graph import components

UID = "__x6_uid"
#: Postings that a task holds before it hands them on, and sets in a block of verification.
HELD, BLOCK = 500_000, 256
#: Centres of a group in the second round, and how they grow from round to round.
CENTRES, GROWTH = 8, 8
#: Columns of a set's signature.
SIGNS = [f"s{i}" for i in range(8)]
#: First posted shingles that go with each posting, rows of a shingle that meet its centres in one task, and bytes of text by range.
HEAD, SALTED, RANGE_BYTES = 8, 4096, 1 << 25


def slack(n, percent: int):
    """Shingles that both prefixes of a linked pair share at least, for the smaller set's size n; never falls as n grows."""
    return 1 + n // 5


def ceil_part(n, percent: int):
    return (n * percent + 99) // 100


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - ceil_part(n, percent) + slack(n, percent))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; that order is the global one."""
    return np.unique(shingle_hashes(word_hashes(text), words))


def set_class(s: np.ndarray) -> int:
    """Names a set: equal sets have equal names."""
    h = mix(s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(s)))
    return int(mix(h.sum(dtype=np.uint64, keepdims=True) ^ np.bitwise_xor.reduce(mix(h + np.uint64(1)), keepdims=True)).view(np.int64)[0])


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers with their low bytes first, then the next ones: small numbers leave runs of zeros, which shuffles compress."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data: bytes, m: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * m, at).reshape(4, m).T).view("<u4").ravel()


_ROW = pa.schema([("kind", pa.int32()), ("r", pa.int32()), (UID, pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("data", pa.binary())])
_SHARED = pa.schema([("kind", pa.int32()), (UID, pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("token", pa.int64()), ("shared", pa.int64())])


def extract(words: int, percent: int, ranges: int):
    """Rows of kind 0, one a document, and of kind 1, the prefix postings of one hash range, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            classes = np.array([c for _, c, _ in held], "<i8")
            sizes = np.array([n for _, _, n in held], "<u4")
            tokens = np.concatenate([t for t, _, _ in held])
            who = np.repeat(np.arange(len(held), dtype="<u4"), [len(t) for t, _, _ in held])
            key = mix(tokens + np.uint64(0x51))  # the prefix has the smallest hashes, so ranges come from another one
            r = (key % np.uint64(ranges)).astype(np.int64)
            tail = (key >> np.uint64(32)).astype("<u4")
            by = np.argsort(r, kind="stable")
            cut = np.searchsorted(r[by], np.arange(ranges + 1))
            rows = []
            for k in range(ranges):
                own = by[cut[k] : cut[k + 1]]
                if len(own):
                    docs, count = np.unique(who[own], return_counts=True)  # own is in order of documents
                    head = np.array([len(docs), len(own)], "<i8").tobytes()
                    rows.append((k, head + classes[docs].tobytes() + planes(sizes[docs]) + planes(count) + tail[own].tobytes()))
            held.clear()
            m = len(rows)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array([k for k, _ in rows], pa.int32()), none, none, none, none, pa.array([d for _, d in rows], pa.binary())], schema=_ROW)

        for batch in batches:
            info = []
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), words)
                n = len(s)
                cls = set_class(s) if n else None
                info.append((0, uid % ranges, uid, doc_id, n, cls, None))
                if n and cls not in seen:
                    seen.add(cls)
                    held.append((s[: prefix_length(n, percent)], cls, n))
                    size += len(held[-1][0])
                    if size > HELD:
                        yield flush()
                        size = 0
            if info:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*info, strict=True), _ROW, strict=True)], schema=_ROW)
        if held:
            yield flush()

    return run


def reduce_range(group: pa.Table) -> pa.Table:
    """Passes documents on and keeps of a range's postings the tokens that two sets share, each with how many share it."""
    kind = group.column("kind").to_numpy()
    docs = group.filter(pa.array(kind == 0))
    tokens, classes, sizes = [], [], []
    for chunk in group.column("data").to_pylist():
        if chunk is None:
            continue
        m, k = np.frombuffer(chunk, "<i8", 2)
        count = from_planes(chunk, m, 16 + 12 * m)
        classes.append(np.repeat(np.frombuffer(chunk, "<i8", m, 16), count))
        sizes.append(np.repeat(from_planes(chunk, m, 16 + 8 * m).astype("<i8"), count))
        tokens.append(np.frombuffer(chunk, "<u4", k, 16 + 16 * m))
    out = {"kind": docs.column("kind").to_pylist(), UID: docs.column(UID), "doc_id": docs.column("doc_id"), "n": docs.column("n"), "cls": docs.column("cls")}
    none = pa.nulls(len(docs), pa.int64())
    first = pa.table([pa.array(out["kind"], pa.int32()), out[UID], out["doc_id"], out["n"], out["cls"], none, none], schema=_SHARED)
    if not tokens:
        return first
    t, c, n = np.concatenate(tokens), np.concatenate(classes), np.concatenate(sizes)
    by = np.lexsort((c, t))
    t, c, n = t[by], c[by], n[by]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
    t, c, n = t[new], c[new], n[new]
    start = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    many = np.repeat(np.diff(np.concatenate((start, [len(t)]))), np.diff(np.concatenate((start, [len(t)]))))
    keep = many > 1
    r = int(group.column("r")[0].as_py())
    k = int(keep.sum())
    none = pa.nulls(k, pa.int64())
    second = pa.table([pa.array(np.ones(k, np.int32)), none, none, pa.array(n[keep]), pa.array(c[keep]), pa.array((np.int64(r) << 32) | t[keep].astype(np.int64)), pa.array(many[keep].astype(np.int64))], schema=_SHARED)
    return pa.concat_tables([first, second])


def reduced(group: pa.Table) -> pa.Table:
    out = reduce_range(group)
    hand_back()
    return out


def linked(size_a: int, size_b: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (size_a + size_b - overlap)


def tree_search(probe: np.ndarray, sets: list[np.ndarray], percent: int, step: int = 64) -> list[bool]:
    """Which of the ordered sets link with the probe.

    Sets in lexical order are a depth-first walk of their prefix tree; the length of the prefix that a set has in common with
    the one before says at which node it leaves that path. The overlap with the probe at each node of the path is kept, so
    what sets share is counted once. A walk ends where its overlap and what remains of the probe or of the set can't reach the
    bound; where the probe's rest can't reach the bound of the smallest set, the whole subtree below that node is left out.
    """
    out = [False] * len(sets)
    if not sets:
        return out
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes()) if len(sets) > 1 else [0]
    bound = lambda n: -(-percent * (n + len(probe)) // (100 + percent))
    least = bound(min(len(x) for x in sets))
    path = np.zeros(1, np.int64)  # overlaps at the nodes from the root on
    last, dead = np.zeros(0, np.uint64), None  # dead: depth of the node whose subtree is left out
    for i in order:
        s = sets[i]
        m = min(len(s), len(last))
        differ = np.flatnonzero(s[:m] != last[:m])
        same = int(differ[0]) if len(differ) else m
        last = s
        if dead is not None and same >= dead:
            continue
        dead = None
        path = path[: same + 1]
        need, depth, overlap, pieces = bound(len(s)), len(path) - 1, int(path[-1]), [path]
        while depth < len(s):
            rest = len(probe) - int(np.searchsorted(probe, s[depth]))
            if overlap + rest < least:
                dead = depth + 1
                break
            if overlap + min(len(s) - depth, rest) < need:
                break
            part = s[depth : depth + step]
            at = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
            pieces.append(overlap + np.cumsum(probe[at] == part))
            overlap = int(pieces[-1][-1])
            depth += len(part)
        else:
            out[i] = linked(len(s), len(probe), overlap, percent)
        path = np.concatenate(pieces)
    return out


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose sets link. A centre's partners are cut into blocks of about BLOCK sets."""
    many = pairs.groupBy("a").count()
    blocks = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / BLOCK)).alias("salt"))
    named = sets.select(F.col("cls").alias("b"), "data")
    centres = blocks.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("b"), F.lit(0).alias("member"))
    wanted = blocks.select("a", "salt", "b", F.lit(1).alias("member")).union(centres)  # one join, so the sets are dealt once
    rows = wanted.join(named, "b").select("a", "salt", "b", "data", "member").repartition(partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, names, held = None, None, [], []
        found: list[tuple[int, int]] = []

        def close() -> None:
            if held:
                found.extend((key[0], b) for b, hit in zip(names, tree_search(probe, held, percent), strict=True) if hit)

        for batch in batches:
            for a, salt, b, data, member in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                s = np.frombuffer(data, "<u8")
                if (a, salt) != key:
                    close()
                    key, names, held = (a, salt), [], []
                if member:
                    names.append(b)
                    held.append(s)
                else:
                    probe = s
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])
                found = []
        close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def signature(s: np.ndarray) -> np.ndarray:
    """64 * len(SIGNS) bits; each is the parity of the shingles that fall on it, so two signatures differ in no more bits than the sets in shingles."""
    bits = np.bincount((mix(s + np.uint64(0x77)) % np.uint64(64 * len(SIGNS))).astype(np.int64), minlength=64 * len(SIGNS)) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def near(n_a: Column, n_b: Column, signs_a: list[Column], signs_b: list[Column], percent: int) -> Column:
    """Sets that can link by their sizes and signatures: linked ones differ in (100 - percent) / (100 + percent) of their sizes' sum at most."""
    differ = reduce(add, [F.bit_count(a.bitwiseXOR(b)) for a, b in zip(signs_a, signs_b, strict=True)])
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (differ * (100 + percent) <= (n_a + n_b) * (100 - percent))


def fresh(order: Column, head_a: Column, head_b: Column) -> Column:
    """Whether a pair has no shingle before this one in both heads; where it has one, the pair comes from that shingle."""
    return F.coalesce(F.array_min(F.array_intersect(head_a, head_b)) >= order, F.lit(True))


def only_rows(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose UID is among the wanted ones, without dealing rows out: a bit for each row, in blocks of 4096, goes to all tasks."""
    words = wanted.groupBy(F.shiftright(UID, 6).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast({UID} & 63 as int)))").alias("bits"))
    held = words.groupBy(F.shiftright("w", 6).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(63).cast("int"), "bits"))).alias("m"))
    marks = materialize(held.select("block", F.expr("transform(sequence(0, 63), i -> coalesce(m[i], 0L))").alias("marks")), "jaccard-marks")
    bit = F.expr(f"(shiftright(marks[cast(shiftright({UID}, 6) & 63 as int)], cast({UID} & 63 as int)) & 1L) = 1L")
    return rows.join(F.broadcast(marks), (F.shiftright(UID, 12) == F.col("block")) & bit, "left_semi")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of docs: uid, doc_id, n_shingles, component_id.

    Two rows link when 100 * intersection >= percent * union of their sets of distinct word shingles (A-Z lower-cased); a text
    of fewer words is one shingle; a null text or one without words has an empty set and links with nothing. component_id is
    the smallest doc_id that links reach; null ids are passed over, and a component of null ids has a null id. Repeated rows
    are in one component. An empty table gives an empty result. Other columns are not read.

    Rows with equal sets form a class; links are sought between classes, so copies cost nothing. Candidates: (1) each class
    posts a prefix of its set in hash order, extended so that a linked pair shares at least 1 + n/5 of the posted shingles,
    n being the smaller size; (2) classes whose prefix holds fewer shared shingles drop out; the others keep their rarest
    shared ones by exact count, by the same argument; of shingles that the same classes post, one is enough. (3) Within the classes that share such a shingle, pairs with the smallest
    class come first; then, in rounds, the pairs of about CENTRES members, and GROWTH times as many each round, with members of other
    components, until no shingle joins two components that weren't compared. So every link is found or spanned, while a
    group of near copies costs its size. Pairs whose sizes or signatures (parities of hashed shingles) rule a link out aren't
    verified. Each posting carries the first HEAD of its set's posted shingles, and a pair comes from the first shingle
    that both heads show, so many shared shingles don't repeat a pair. A frequent shingle's rows are salted. Centres go
    by a hash of the class, so a group's shingles choose alike, and no pair
    is verified twice. Verification walks a prefix tree over each centre's partners, in bounded blocks.
    Texts are never dealt out: those whose sets are compared are picked where they are read, by a bit for each row, and
    what goes through shuffles is their postings and, by pair, sets.
    Classes are named by 64-bit hashes of their sets. docs is read twice and must give its rows in the same order.
    """
    spark = docs.sparkSession
    ranges = max(partitions(spark), text_bytes(docs, text_col) // RANGE_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.mapInArrow(tidy(extract(words, percent, ranges)), f"kind int, r int, {UID} long, doc_id long, n long, cls long, data binary")
    both = materialize(packed.groupBy("r").applyInArrow(reduced, f"kind int, {UID} long, doc_id long, n long, cls long, token long, shared long"), "jaccard-postings")
    info = materialize(both.where("kind = 0").select(UID, "doc_id", "n", "cls"), "jaccard-rows")
    shared = both.where("kind = 1").select("n", "cls", "token", "shared")

    least = F.lit(1) + F.expr(f"((n * {percent} + 99) div 100) div 5")
    kept = shared.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("shared", "token"))).alias("t")).withColumn("least", least).where(F.size("t") >= F.col("least"))
    posts = kept.select("cls", "n", F.explode(F.slice("t", F.lit(1), (F.size("t") - F.col("least") + 1).cast("int"))).alias("t")).select("cls", "n", F.col("t.token").alias("token"))
    posts = materialize(posts, "jaccard-posts")
    release(both)
    # tokens that the same classes post propose the same pairs: one of them stands for all
    whose = posts.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("f"), F.sum(F.pmod(F.xxhash64("cls", F.lit(5)), F.lit(1 << 31))).alias("g"))
    alive = whose.where("m > 1").groupBy("m", "f", "g").agg(F.min("token").alias("token")).select("token")
    posted = posts
    posts, some = materialize_counted(posts.join(alive, "token", "left_semi"), "jaccard-alive")
    release(posted)

    comps = None
    if some["n"]:
        wanted = info.join(posts.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min(UID).alias(UID)).select(UID)

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [shingle_set(t.as_py(), words).astype("<u8") for t in batch.column(0)]
                signs = np.array([signature(s) for s in found], "<i8").reshape(-1, len(SIGNS))
                yield pa.RecordBatch.from_arrays([pa.array(map(set_class, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), *map(pa.array, signs.T.copy())], names=["cls", "data", *SIGNS])

        sets = materialize(only_rows(rows, wanted).select("text").mapInArrow(tidy(sets_of), "cls long, data binary, " + ", ".join(f"{c} long" for c in SIGNS)), "jaccard-sets")
        own, theirs = [F.col(c) for c in SIGNS], [F.col(f"a{c}") for c in SIGNS]
        heads = posts.groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.xxhash64("token"))), 1, HEAD).alias("head"))
        posted = posts
        posts = materialize(posts.join(sets.select("cls", *SIGNS), "cls").join(heads, "cls"), "jaccard-signed")
        release(posted)
        signs = [*SIGNS, "head"]
        first = posts.groupBy("token").agg(F.min(F.struct("cls", "n", *SIGNS)).alias("c"))
        can_link = near(F.col("n"), F.col("c.n"), own, [F.col(f"c.{c}") for c in SIGNS], percent)
        pairs = posts.join(first, "token").where((F.col("cls") != F.col("c.cls")) & can_link).select(F.col("c.cls").alias("a"), F.col("cls").alias("b")).distinct()
        pairs = checked = materialize(pairs, "jaccard-pairs")
        met_before = [pairs]
        comps = components(verify(pairs, sets, percent))
        centres, held = CENTRES, posts
        while True:
            now = posts.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            open_ = now.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("token", "m")
            now, some = materialize_counted(now.join(open_, "token"), "jaccard-open")
            release(held)
            held = now
            if not some["n"]:
                break
            chosen = F.pmod(F.xxhash64("cls", F.lit(17)), F.lit(1 << 30)) * F.col("m") < F.lit(centres << 30)
            salts = F.ceil(F.col("m") / SALTED).cast("int")
            mid = now.where(chosen).select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), "token", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *[F.col(c).alias(f"a{c}") for c in signs])
            met = now.withColumn("salt", F.pmod(F.xxhash64("cls", F.lit(29)), salts).cast("int")).join(mid, ["token", "salt"])
            pairs = met.where((F.col("root") != F.col("ra")) & near(F.col("n"), F.col("na"), own, theirs, percent) & fresh(F.xxhash64("token"), F.col("head"), F.col("ahead")))
            pairs = pairs.select(F.least("a", "cls").alias("a"), F.greatest("a", "cls").alias("b")).distinct()
            pairs, some = materialize_counted(pairs.join(checked, ["a", "b"], "left_anti"), "jaccard-pairs")
            if some["n"]:
                met_before.append(pairs)
                checked, last = checked.union(pairs), comps
                comps = components(verify(pairs, sets, percent).union(comps.select(F.col("node").alias("a"), F.col("root").alias("b"))))
                release(last)
            posts = now.where(~chosen).select("cls", "n", "token", *signs)
            centres *= GROWTH
        release(held, sets, *met_before)

    named = info.withColumn("key", F.col("cls"))
    if comps is not None:
        named = info.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("key", F.coalesce("root", "cls"))
    least_id = named.where("cls is not null").groupBy("key").agg(F.min("doc_id").alias("component_id"))
    with_set = named.where("cls is not null").join(least_id, "key")
    alone = named.where("cls is null").withColumn("component_id", F.col("doc_id"))
    columns = [F.col(UID).alias("uid"), "doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return with_set.select(*columns).union(alone.select(*columns))
