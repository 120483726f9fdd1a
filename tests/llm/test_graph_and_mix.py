"""Components of links, the copies that a mix emits, and what the near-copy stage keeps, against plain Python."""

from collections import Counter

import numpy as np

import corpus_pipeline
from perilattice.llm import graph, mixing
from perilattice.llm.common import materialize, release


def test_components_of_random_links_a_long_path_and_a_hub(spark):
    rng = np.random.default_rng(71)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (180, 2))]
    links += [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(300)] + [(7, 7), (-4, -9), (-9, -4)]
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(4))
    rows = [(r.node, r.root) for r in got.collect()]
    assert dict(rows) == want and len(rows) == len(want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_mix_emits_each_row_as_often_as_it_is_taken(spark):
    rng = np.random.default_rng(72)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 40))), ["a", "b", "c", None][i % 4], "clash", i) for i in range(400)] + [(None, "x y", "a", None, 1), (3, "", "b", None, 2), (4, None, "c", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string, copies int").repartition(3).cache()
    took = mixing.mix_sources(docs).collect()
    out = mixing.emit_mix(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({k: v for k, v in Counter(x for r in took for x in [r.id] * r.copies).items() if v})
    size = {}
    for r in took:
        size.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 40 * 2 for taken, target in size.values())
    assert len(took) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in took)


def test_one_document_of_each_near_copy_group_stays(spark):
    rng = np.random.default_rng(73)
    base = [[f"w{x}" for x in rng.integers(10**9, size=60)] for _ in range(6)]
    rows = []
    for k, w in enumerate(base):
        for c in range(k + 1):
            v = list(w)
            v[10 * c % 60] = f"z{k}{c}"
            rows.append((100 * k + c, " ".join(v), "en", "s", 1))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, " ".join(base[3]), "en", None, 1), (None, "no id alone", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).cache()
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == [-1, 0, 100, 200, 300, 400, 500, 900, 901]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").count() == 0


def test_released_tables_are_deleted(spark):
    kept, gone = materialize(spark.range(5), "kept"), materialize(spark.range(5), "gone")
    path = spark._jvm.org.apache.hadoop.fs.Path
    exists = lambda df: path(df.written_at).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(df.written_at))
    release(gone, None)
    assert exists(kept) and not exists(gone) and kept.count() == 5
