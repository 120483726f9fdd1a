"""A hashed maximum-entropy language model with class-factored softmax, trained and scored in numpy batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_words, hash_cut, materialize, mix, release

UID = "__x8_uid"
END = np.uint64(0xE4D)  # the end token
#: Classes of words, leaves of a class, and how many of the leaves (the last ones) are for words outside the dictionary.
CLASSES, LEAVES, TAIL = 32, 32, 64
ALL = CLASSES * LEAVES
START = ALL  # the leaf that stands before a text
#: Rows of the features: leaf of the word before, of the one before that (skip), and hashed pairs of both (n-gram); the last row is the bias.
NGRAMS = 2048
ROWS = 2 * (ALL + 1) + NGRAMS + 1
#: Rows of a class's features of its leaves: leaf of the word before, and the bias.
OWN = ALL + 2
BATCH = 8192
BLOCKS = 16
RATE = 0.5
#: Steps of a doubling of counts by which the dictionary is cut.
STEPS = 64


def tokens(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of a column's texts in runs of rows: first row, end row, where each row starts, hashes, tail leaves.

    The tail leaf is a hash of a word's last two bytes: where a word stands that the dictionary hasn't got, seen or not.
    """
    for first, last, b, start, end, before in column_words(texts):
        row = before + np.arange(last - first + 1)
        word = np.ones(row[-1], bool)
        word[row[1:] - 1] = False
        h, tail = np.full(row[-1], END), np.zeros(row[-1], np.int64)
        h[word] = hash_cut(b, start, end)
        if len(start):
            two = b[end - 1].astype(np.uint64) * np.uint64(256) + np.where(end - start > 1, b[end - 2], 0)
            tail[word] = (mix(two + np.uint64(77)) % np.uint64(TAIL)).astype(np.int64)
        yield first, last, row, h, tail


class Dictionary:
    """The most frequent words with their counts and leaves: leaves are runs of words of about equal mass in order of frequency.

    norm has log10 of a leaf's count of tokens, smoothed; a tail leaf keeps a share for a word never seen.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, tail_tokens: np.ndarray, tail_words: np.ndarray):
        by = np.lexsort((words, -counts))
        before = np.cumsum(counts[by]) - counts[by]
        leaf = np.minimum(before * (ALL - TAIL) // max(int(counts.sum()), 1), ALL - TAIL - 1)
        order = np.argsort(words[by], kind="stable")
        self.words, self.leaf, self.counts = words[by][order], leaf[order].astype(np.int64), counts[by][order]
        n, v = np.zeros(ALL), np.zeros(ALL)
        np.add.at(n, self.leaf, self.counts)
        np.add.at(v, self.leaf, 1)
        n[ALL - TAIL :], v[ALL - TAIL :] = tail_tokens, tail_words + 1
        self.norm = np.log10(np.maximum(n + 0.5 * v, 0.5))

    def find(self, h: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, place in the dictionary, whether it is there) of each token."""
        word = h.view(np.int64)
        if not len(self.words):
            return ALL - TAIL + tail, np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        known = self.words[at] == word
        return np.where(known, self.leaf[at], ALL - TAIL + tail), at, known


def contexts(leaf: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Rows of the features of each token."""
    one, two = np.roll(leaf, 1), np.roll(leaf, 2)
    one[row[:-1]] = START
    two[row[:-1]] = START
    second = np.minimum(row[:-1] + 1, len(leaf) - 1)[np.diff(row) > 1]
    two[second] = START
    pair = (mix((one * (ALL + 1) + two).astype(np.uint64)) % np.uint64(NGRAMS)).astype(np.int64)
    return [one, ALL + 1 + two, 2 * (ALL + 1) + pair]


def softmax(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities by token and outcome from the sum of the weights' rows; the last of rows may be one number for all."""
    z = w[rows[0]]
    for r in rows[1:]:
        z += w[r]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def update(w: np.ndarray, seen: np.ndarray, rows: list[np.ndarray], y: np.ndarray) -> None:
    """One gradient step on a batch; a row's step falls with the tokens that it has met."""
    g = softmax(w, rows)
    g[np.arange(len(y)), y] -= 1
    for r in rows:
        if np.ndim(r) == 0:
            seen[r] += len(y)
            w[r] -= np.float32(RATE / np.sqrt(seen[r] + 8.0)) * g.sum(axis=0)
            continue
        by = np.argsort(r.astype(np.uint16), kind="stable")
        own, first = np.unique(r[by], return_index=True)
        seen[own] += np.diff(np.append(first, len(r)))
        w[own] -= np.add.reduceat(g[by], first, axis=0) * (RATE / np.sqrt(seen[own] + 8.0)).astype(np.float32)[:, None]


def leaf_rows(cls: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
    return [cls * OWN + one, cls * OWN + OWN - 1]


def count_words(batches: Iterator[pa.RecordBatch], held: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(word, tail, count) of the tokens, a row for each word every `held` tokens."""
    words, tails, size = [], [], 0

    def counts() -> pa.RecordBatch:
        h, at, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.concatenate(tails)[at].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "tail", "count"])

    for batch in batches:
        for _, _, _, h, tail in tokens(batch.column(0)):
            words.append(h)
            tails.append(tail)
            size += len(h)
            if size >= held:
                yield counts()
                words, tails, size = [], [], 0
    if words:
        yield counts()


Weights = tuple[np.ndarray, np.ndarray]


def empty_weights() -> Weights:
    return np.zeros((ROWS, CLASSES), np.float32), np.zeros((CLASSES * OWN, LEAVES), np.float32)


def learn(shared):
    """A task's weights after gradient steps on its rows from the common ones, in blocks with the number of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (w1, w2) = shared.value
        w1, w2 = w1.copy(), w2.copy()
        seen1, seen2, total = np.zeros(len(w1)), np.zeros(len(w2)), 0
        for batch in batches:
            for _, _, row, h, tail in tokens(batch.column(0)):
                leaf, _, _ = words.find(h, tail)
                f, cls, own = contexts(leaf, row), leaf // LEAVES, leaf % LEAVES
                for k in range(0, len(leaf), BATCH):
                    part = slice(k, k + BATCH)
                    update(w1, seen1, [*(x[part] for x in f), ROWS - 1], cls[part])
                    update(w2, seen2, leaf_rows(cls[part], f[0][part]), own[part])
                total += len(h)
        if total:
            cut = np.array_split(np.concatenate((w1.ravel(), w2.ravel())).astype("<f2"), BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int64()), pa.array([total] * BLOCKS, pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary()), pa.array([False] * BLOCKS)], names=["block", "count", "data", "wide"])

    return run


def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token-weighted means of weight blocks: (block, tokens, float32 bytes); input is float16 or float32 by column wide."""
    sums: dict[int, list] = {}
    for batch in batches:
        for k in range(len(batch)):
            block, n, data, wide = (c[k].as_py() for c in batch.columns)
            x = np.frombuffer(data, "<f4" if wide else "<f2").astype(np.float64)
            own = sums.setdefault(block, [0, np.zeros(len(x))])
            own[0] += n
            own[1] += x * n
    for block, (n, x) in sums.items():
        yield pa.RecordBatch.from_pydict({"block": [block], "count": [n], "data": [(x / n).astype("<f4").tobytes()], "wide": [True]})


_SCORED = pa.schema([("kind", pa.int32()), (UID, pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("model", pa.float64()), ("word", pa.int64())])


def token_scores(words: Dictionary, weights: Weights, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
    """log10 of P(class | context) P(leaf | class, context) and of the leaf's smoothed count, that a word's count is yet to be put over."""
    f, cls, own = contexts(leaf, row), leaf // LEAVES, leaf % LEAVES
    p = np.empty(len(leaf))
    for k in range(0, len(leaf), BATCH):
        part = slice(k, k + BATCH)
        at = np.arange(len(cls[part]))
        one = softmax(weights[0], [*(x[part] for x in f), ROWS - 1])[at, cls[part]].astype(np.float64)
        p[part] = one * softmax(weights[1], leaf_rows(cls[part], f[0][part]))[at, own[part]]
    return np.log10(np.maximum(p, 1e-30)) - words.norm[leaf]


def score_texts(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, dictionary: int = 1 << 18) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows where held_out is false and scores every row. Tokens are words (A-Z lower-cased) and one end. A
    null text is the end alone; where held_out is null (as for a null id) the row is not learned from and counts as not held
    out. Repeated rows each count. Without training rows N is 0 and words have their leaf's share only; an empty
    table gives an empty result. Other columns are not read.

    base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))). score sums log10 P(class | context) P(leaf | class, context)
    P(word | leaf): the first two are softmaxes with hashed n-gram and skip features; a word's share of its leaf is by smoothed
    counts. Leaves are runs of words of equal mass, so frequent words have leaves of their own; words outside the
    dictionary are spread over TAIL leaves, each with a share for words not seen. Training: in each of `rounds` rounds
    every task takes gradient steps on its own rows from the common weights, and the token-weighted mean of all tasks'
    weights is the next common model. Counts come from every training token. The words whose count reaches a bound go to
    all tasks: the least bound, on a scale of STEPS by doubling, that not more than `dictionary` words reach; the counts of
    all others meet the texts in a join. docs is read rounds + 2 times and must give its rows in the same order.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(~held_out, F.lit(False)).alias("learns"), F.col(text_col).cast("string").alias("text"))
    train = rows.where("learns").select("text")

    parts = train.mapInArrow(count_words, "word long, tail int, count long").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("count").alias("count"))
    counts = materialize(parts.withColumn("level", F.floor(F.log2("count") * STEPS).cast("int")), "lm-counts")
    levels = counts.groupBy("level").agg(F.count("*").alias("words"), F.sum("count").alias("tokens")).orderBy(F.desc("level")).collect()  # STEPS rows by doubling
    n_all, v_all = sum(r.tokens for r in levels), sum(r.words for r in levels)
    reach = np.cumsum([r.words for r in levels])
    within = int(np.searchsorted(reach, dictionary, "right"))
    bound = levels[within - 1].level if within else 1 << 30
    common = counts.where(F.col("level") >= bound).select("word", "count").toArrow()  # at most `dictionary` rows
    rest = counts.where(F.col("level") < bound)
    by_tail = {r.tail: r for r in rest.groupBy("tail").agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()}  # TAIL rows
    tail = np.array([(by_tail[k].n, by_tail[k].v) if k in by_tail else (0, 0) for k in range(TAIL)], np.int64)
    words = Dictionary(common["word"].to_numpy().astype(np.int64), common["count"].to_numpy().astype(np.int64), tail[:, 0], tail[:, 1])

    weights = empty_weights()
    sizes = [w.size for w in weights]
    mean = "block long, count long, data binary, wide boolean"
    for _ in range(max(1, rounds)):
        shared = spark.sparkContext.broadcast((words, weights))
        out = materialize(train.mapInArrow(learn(shared), mean), "lm-learnt")
        got = {r.block: r.data for r in out.mapInArrow(average, mean).repartition(BLOCKS, "block").mapInArrow(average, mean).select("block", "data").collect()}  # the size of the model
        if got:
            flat = np.concatenate([np.frombuffer(got[k], "<f4") for k in range(BLOCKS)])
            weights = flat[: sizes[0]].reshape(weights[0].shape).copy(), flat[sizes[0] :].reshape(weights[1].shape).copy()
        release(out)
    shared = spark.sparkContext.broadcast((words, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        logs = np.append(np.log10(words.counts + 0.5), 0.0)
        for batch in batches:
            uid, doc, out = batch.column(0).to_numpy(), batch.column(1), batch.column(2)
            for first, last, row, h, tail in tokens(batch.column(3)):
                leaf, at, known = words.find(h, tail)
                model = token_scores(words, weights, row, leaf)
                start, sizes = row[:-1], np.diff(row)
                add = lambda x: np.add.reduceat(x, start)
                m, span = last - first, slice(first, last)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), pa.array(uid[span]), doc[span], out[span], pa.array(np.array(sizes, np.int64)), pa.array(add(known.astype(np.int64))), pa.array(add(np.where(known, logs[np.where(known, at, -1)], 0.0))), pa.array(add(model)), pa.nulls(m, pa.int64())], schema=_SCORED)
                rare = ~known
                if rare.any():
                    own, word = np.repeat(uid[span], sizes)[rare], h.view(np.int64)[rare]
                    by = np.lexsort((word, own))
                    own, word = own[by], word[by]
                    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (word[1:] != word[:-1]))))
                    k = len(new)
                    none = pa.nulls(k, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(own[new]), none, pa.nulls(k, pa.bool_()), pa.array(np.diff(np.append(new, len(own)))), none, pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(word[new])], schema=_SCORED)

    both = materialize(rows.select(UID, "doc_id", "held_out", "text").mapInArrow(score, f"kind int, {UID} long, doc_id long, held_out boolean, n long, known long, logs double, model double, word long"), "lm-scored")
    rare = both.where("kind = 1").select(UID, "word", "n").join(rest.select("word", "count"), "word", "left")
    rare = rare.groupBy(UID).agg(F.sum(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + F.lit(0.5))).alias("more_logs"), F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"))
    out = both.where("kind = 0").join(rare, UID, "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (logs - F.col("n") * F.lit(float(np.log10(n_all + 0.5 * (v_all + 1))))).alias("base_score"), (logs + F.col("model")).alias("score"),
    )
