"""The n-gram join on groups that share shingles without linking, on long near copies and on awkward rows, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from perilattice.llm import ngram_join


def brute(texts):
    """(set size, smallest reachable index) by text, from an inverted index of five-word shingles."""
    sets, post = [], {}
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for s in sets[-1]:
            post.setdefault(s, []).append(i)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        near = {j for x in s for j in post[x] if j < i and min(len(s), len(sets[j])) * 100 >= 75 * max(len(s), len(sets[j]))} if len(s) < 10**6 else set()
        for j in near:
            if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}


def test_many_sets_that_share_one_shingle_and_none_linked(spark):
    rng = np.random.default_rng(31)
    line = "one line in all of them"
    texts = [f"{line} " + " ".join(f"w{x}" for x in rng.integers(10**9, size=12)) for _ in range(5000)]
    assert found(spark, texts) == {i: (14, i) for i in range(5000)}


def test_families_of_near_copies_long_and_short(spark):
    rng = np.random.default_rng(32)
    texts = []
    for size, copies, edits in ((30, 60, 2), (200, 80, 12), (1500, 60, 90), (1500, 40, 60), (6000, 12, 300)):
        base = [f"w{x}" for x in rng.integers(10**9, size=size)]
        for _ in range(copies):
            w = list(base)
            for k in rng.integers(0, size, rng.integers(1, edits)):
                w[k] = f"z{rng.integers(10**9)}"
            texts.append(" ".join(w))
    assert found(spark, texts) == brute(texts)


def test_a_third_of_all_rows_in_one_family_and_awkward_rows(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:40], f"x{i}", *base[41:]]), "c", "u") for i in range(120)]
    rows += [(None, " ".join(base), None, None), (500, None, None, None), (501, "", None, None), (502, " ".join(base), None, None), (502, " ".join(base), None, None), (None, "alone here", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, uid string").repartition(3).cache()
    got = ngram_join.jaccard_components(docs)
    assert got.count() == len(rows) and got.where("component_id = 0").count() == 123
    assert sorted((r.doc_id, r.component_id) for r in got.where(F.col("doc_id").isin(500, 501)).collect()) == [(500, 500), (501, 501)]
    assert [r.component_id for r in got.where("n_shingles = 1").collect()] == [None]


def test_texts_are_not_shuffled_and_postings_take_few_bytes(spark, tmp_path):
    """Near copies among many others, joins by shuffle only: less is written to shuffles than half of the texts' bytes."""
    rng = np.random.default_rng(33)
    texts = [" ".join(f"w{x}" for x in rng.integers(10**9, size=400)) for _ in range(1500)]
    texts += [f"{t} once more" for t in texts[:20]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store = spark.sparkContext._jsc.sc().statusStore()
        nothing = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, nothing, spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before, least = shuffled(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.read.parquet(f"{tmp_path}/docs")).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert got == {i: i - 1500 if i >= 1500 else i for i in range(1520)}
    written = sum(n for k, n in shuffled().items() if k not in before)
    assert written < sum(map(len, texts)) / 2


def test_rows_are_picked_across_blocks_and_partitions(spark):
    rows = spark.range(0, 20000, 1, 3).select(F.monotonically_increasing_id().alias(ngram_join.UID), "id")
    wanted = [r[0] for r in rows.where("id % 63 = 0 or id between 4090 and 4230 or id = 19999").select(ngram_join.UID).collect()]
    picked = ngram_join.only_rows(rows, spark.createDataFrame([(x,) for x in wanted], f"{ngram_join.UID} long"))
    assert sorted(r[0] for r in picked.select(ngram_join.UID).collect()) == sorted(wanted)
    assert ngram_join.only_rows(rows, rows.where("id < 0").select(ngram_join.UID)).count() == 0
