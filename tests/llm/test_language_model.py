"""The language model against plain Python: counts, base score, probabilities that sum to one, and text that context explains."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from perilattice.llm import language_model as lm


def toks(t):
    return [*(t or "").lower().split(), None]


def test_every_row_equals_plain_counts_with_and_without_a_dictionary(spark):
    rng = np.random.default_rng(51)
    rows = [(i, " ".join(f"Ab{x}" for x in rng.zipf(1.4, int(rng.integers(0, 60))) % 500), "c") for i in range(120)]
    rows += [(None, "ab1 ab2", None), (200, None, None), (201, "", None), (7, rows[7][1], "again"), (202, "new " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3).cache()
    train = Counter(w for i, t, _ in rows if i is not None and i % 5 != 1 for w in toks(t))
    n, v = sum(train.values()), len(train)
    for size in (1 << 18, 20, 0):
        got = lm.score_texts(docs, F.col("doc_id") % 5 == 1, dictionary=size).collect()
        assert len(got) == len(rows)
        want = {}
        for i, t, _ in rows:
            w = toks(t)
            base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
            want.setdefault(i, (i is not None and i % 5 == 1, len(w), sum(train[x] > 0 for x in w), n, base))
        for r in got:
            held, tokens, known, total, base = want[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, tokens, known, total) and abs(r.base_score - base) < 1e-6
            assert math.isfinite(r.score) and r.score < 0


def test_probabilities_sum_to_one_over_the_vocabulary():
    rng = np.random.default_rng(52)
    words, counts = np.sort(rng.integers(-(2**62), 2**62, 3000)), rng.zipf(1.3, 3000).astype(np.int64) % 10_000 + 1
    tail_words, tail_tokens = rng.integers(0, 9, lm.TAIL), rng.integers(0, 50, lm.TAIL)
    tail_tokens[tail_words == 0] = 0
    d = lm.Dictionary(words, counts, tail_tokens, tail_words)
    w1, w2 = lm.empty_weights()
    w1[:], w2[:] = rng.normal(size=w1.shape) * 0.3, rng.normal(size=w2.shape) * 0.3
    # one text "a b x" for each leaf x: the context is the same, so the last token's probabilities over all leaves add up
    leaf = np.concatenate([[3, 70, x] for x in range(lm.ALL)])
    row = np.arange(0, 3 * lm.ALL + 1, 3)
    p = 10 ** (lm.token_scores(d, (w1, w2), row, leaf)[2::3] + d.norm)
    assert abs(p.sum() - 1) < 1e-4
    # and within a leaf the words' shares do, with what a tail leaf keeps for a word never seen
    for x in range(0, lm.ALL, 37):
        own = d.counts[d.leaf == x] + 0.5
        if x >= lm.ALL - lm.TAIL:
            k = x - (lm.ALL - lm.TAIL)
            assert abs((tail_tokens[k] + 0.5 * tail_words[k] + 0.5) / 10 ** d.norm[x] - 1) < 1e-9
        elif len(own):
            assert abs(own.sum() / 10 ** d.norm[x] - 1) < 1e-9


def test_softmax_and_features_equal_a_loop():
    rng = np.random.default_rng(53)
    w1, _ = lm.empty_weights()
    w1[:] = rng.normal(size=w1.shape)
    leaf, row = rng.integers(0, lm.ALL, 40), np.array([0, 1, 9, 40])
    f = lm.contexts(leaf, row)
    p = lm.softmax(w1, [*f, lm.ROWS - 1])
    for i in range(40):
        start = max(x for x in row if x <= i)
        one = leaf[i - 1] if i > start else lm.START
        two = leaf[i - 2] if i > start + 1 else lm.START
        assert f[0][i] == one and f[1][i] == lm.ALL + 1 + two and 2 * (lm.ALL + 1) <= f[2][i] < lm.ROWS - 1
        z = np.exp(sum(w1[x[i]] for x in f).astype(float) + w1[-1])
        assert np.allclose(p[i], z / z.sum(), atol=1e-4)


def test_words_of_a_column_equal_words_of_each_text():
    texts = ["A b", None, "", " c  A\tb\n", "x" * 50]
    got = [(row.tolist(), h.tolist(), tail.tolist()) for _, _, row, h, tail in lm.tokens(pa.array(texts))]
    row, h, tail = got[0]
    assert row == [0, 3, 4, 5, 9, 11] and h[0] == h[6] and h[1] == h[7] and h[2] == h[3] == h[4] == int(lm.END) and tail[2] == 0


def test_context_that_explains_a_word_raises_the_score(spark):
    rng = np.random.default_rng(54)
    # after a marker only the marker's own words follow
    sets = [[f"{c}{i}" for i in range(30)] for c in "pqrs"]
    texts = [" ".join(x for _ in range(25) for k in [rng.integers(4)] for x in [f"go{k}", *rng.choice(sets[k], 3)]) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    r = lm.score_texts(docs, F.col("doc_id") % 5 == 1).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (r[0] - r[1]) / r[2] > 0.3
    assert lm.score_texts(docs.where("false"), F.lit(False)).count() == 0
    alone = lm.score_texts(docs.limit(3), F.lit(True)).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and math.isfinite(x.score) for x in alone)
