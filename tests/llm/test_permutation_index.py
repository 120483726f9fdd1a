"""The permutation index against brute force, where the footrule ranking decides what is looked at."""

import numpy as np
import pytest

from perilattice.llm import permutation_index as pi


def frame(spark, rows, parts=1):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank int" if len(rows[0]) == 4 else "vec_id long, embedding array<float>").coalesce(parts)


def check(got, x, step, k=5):
    """Recall over the queries; scores and order of what was found are exact."""
    y = x.astype(float)
    size = np.sqrt((y * y).sum(axis=1))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    hits = []
    for q in range(0, len(x), step):
        s = (y * y[q]).sum(axis=1) / (size * size[q])
        own = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, k + 1)) and all(r.vec_id != q for r in own)
        assert all(r.score == s[r.vec_id] for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        s[q] = -9
        best = np.lexsort((np.arange(len(x)), -s))[:k]
        hits.append(len({*best.tolist()} & {r.vec_id for r in own}) / k)
    return hits


@pytest.mark.parametrize("block", [900, 4096])
def test_recall_on_random_vectors_in_several_and_in_one_block(spark, block):
    x = np.random.default_rng(2).normal(size=(4000, 32)).astype(np.float32)
    x[5] = x[3]
    data = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = check(pi.nearest(data, data.where("vec_id % 50 = 0"), block=block).collect(), x, 50)
    assert len(hits) == 80 and np.mean(hits) >= 0.9


def test_recall_in_a_cluster_of_near_copies_larger_than_what_a_block_offers(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    x[4000:] = x[0] + 0.05 * rng.normal(size=(2000, 32)).astype(np.float32)
    data = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    hits = check(pi.nearest(data, data.where("vec_id % 60 = 0"), block=6000).collect(), x, 60)
    assert np.mean(hits[:67]) >= 0.9 and np.mean(hits[67:]) >= 0.9


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, v.tolist(), "c", 1) for i, v in enumerate(x)] + [(1, x[1].tolist(), None, None), (0, x[0].tolist(), None, None)]
    rows += [(50, None, "c", 1), (51, [0.0] * 8, "c", 1), (52, [float("nan")] * 8, "c", 1), (53, [1.0, None] * 4, "c", 1), (54, [float("inf")] * 8, "c", 1), (None, [1.0] * 8, "c", 1), (55, [], "c", 1)]
    rows += [(100, [1.0, 2.0], "c", 1), (150, [2.0, 1.0], "c", 1), (151, [2.0, 4.0], "c", 1), (200, [1.0, 1.0, 1.0], "c", 1)]
    data = frame(spark, rows)
    got = pi.nearest(data, data.where("vec_id % 50 = 0")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert sorted(by) == [0, 100, 150] and len(by[0]) == 5
    assert sorted(by[100]) == [(1, 151), (2, 150)]
    y = x.astype(float)
    s = {i: float((y[i] * y[0]).sum() / np.sqrt((y[i] ** 2).sum() * (y[0] ** 2).sum())) for i in range(1, 40)}
    want = sorted([*s, 1], key=lambda i: (-s[i], i))[:5]
    assert [i for _, i in sorted(by[0])] == want
    assert pi.nearest(data.where("false"), data).count() == 0 and pi.nearest(data, data.where("false")).count() == 0


def test_footrule_gain_is_the_distance_from_the_farthest_order():
    rng = np.random.default_rng(8)
    pivots = rng.normal(size=(20, 4))
    o = pi.orders(rng.normal(size=(30, 4)), pivots, 6)
    posts = pi.invert(o, 20)
    for q in o[:5]:
        gain = pi.footrule(q, posts, 30, 6)
        place = lambda order, p: list(order).index(p) if p in order else 6
        for i, row in enumerate(o):
            far = sum(6 - a for a in range(6)) * 2
            assert far - gain[i] == sum(abs(place(q, p) - place(row, p)) for p in range(20))


def test_no_vectors_are_broadcast_and_many_query_groups_meet_all_blocks(spark, monkeypatch):
    """Tables below Spark's own threshold, copied for each slot, once went to the driver to be broadcast."""
    monkeypatch.setattr(pi, "GROUP", 2)
    x = np.random.default_rng(9).normal(size=(900, 16)).astype(np.float32)
    data = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], 3)
    out = pi.nearest(data, data.where("vec_id % 5 = 0"), block=60, query_block=8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    hits = check(out.collect(), x, 5)
    assert len(hits) == 180 and np.mean(hits) >= 0.9


def test_pivots_are_those_of_the_smallest_hashes_whatever_the_bound(spark):
    x = np.random.default_rng(10).normal(size=(3000, 6)).astype(np.float32)
    data = frame(spark, [(i % 1000, v.tolist()) for i, v in enumerate(x)], 3)
    same = frame(spark, [(7, v.tolist()) for v in x[:500]])
    few = pi.pick_pivots(data, 8, 40, "vec_id", "embedding")
    from pyspark.sql import functions as F

    rows = data.orderBy(F.xxhash64(F.col("vec_id").cast("string")), "vec_id").limit(42).collect()  # ids come three times
    held = {tuple(v / np.linalg.norm(v)) for v in np.array([r.embedding for r in rows], float)}
    assert len(few[6]) == 8 and {tuple(v) for v in few[6]} <= held
    assert len(pi.pick_pivots(same, 8, 40, "vec_id", "embedding")[6]) == 8
