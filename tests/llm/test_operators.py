"""Small fixtures against brute force: nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import io
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilattice.llm import exact_dedup, language_model, mixing, ngram_join, packing, substring_dedup, token_files, tokens, toxicity, warc
from perilattice.llm.common import word_hashes

DOCS = "doc_id long, text string, source string, kept string, uid string"
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, "Same text", "a", "x", "y"), (2, "same TEXT", "a", None, None), (2, "same TEXT", "a", None, None), (3, None, None, None, None), (4, "", "b", None, None),
    (None, "same text", "b", None, None), (None, None, "b", None, None), (5, LONG, "b", None, None), (6, LONG.replace("w60 ", "changed "), "b", None, None), (7, "x" * 200_000, "c", None, None), (8, "É é", "c", None, None),
]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


def test_exact_dedup(docs):
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for r in ROWS:
        groups.setdefault(low(r[1]), []).append(r[0])
    for r in got:
        ids = groups[low(r.text)]
        assert r.group_size == len(ids) and r.keep_id == max((x for x in ids if x is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_dedup(docs.where("false")).count() == 0


def test_warc_round_trip_and_salvage(spark):
    rows = [(3, "u 1", "a"), (1, None, "a"), (1, None, "a"), (2, "v", None), (None, "w", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_warc(warc.write_warc(pages)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (1, "response", 0), (1, "revisit", 1), (2, "response", 0), (3, "revisit", 1)]
    assert all(r.payload_bytes == 1 for r in got if r.page_id in (1, 3))
    for pack in (warc.member, bytes):
        data = [pack(warc.record(k, None, bytes([65 + k]) * 3000, None, False)) for k in range(5)]
        broken = bytearray(data[2])
        broken[len(broken) // 2] ^= 0xFF
        out = list(warc.salvage(io.BytesIO(b"".join([b"junk", data[0], data[1], bytes(broken), data[3], data[4][:-9]]))))
        assert [r["page_id"] for r in out if not r["gap"]] == [0, 1, 3]
        assert sum(r["length"] for r in out) == 4 + sum(map(len, data)) - 9 and [r["offset"] for r in out if r["gap"]][0] == 0
    assert warc.read_warc(warc.write_warc(pages.where("false"))).count() == 0


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        bad = i % 5 == 0
        w = [f"word{rng.integers(300)}" for _ in range(30)] + (["grumblor", "snarfle"] if bad else [])
        rows.append((i, " ".join(w), int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(data, data.where("doc_id < 400").select("doc_id", "toxic"))
    got = toxicity.score(data.where("doc_id >= 400").drop("toxic").withColumn("score", F.lit("clash")), model).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got)
    hidden = spark.createDataFrame([(1, "so GRUMBL0R and ѕnarfle here"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.predicted for r in toxicity.score(hidden, model).orderBy("doc_id").collect()] == [1, 0, 0]
    seed = toxicity.fit(data, data.where("false"))
    out = toxicity.score(spark.createDataFrame([(1, "idiot moron"), (2, "pond scum")], "doc_id long, text string"), seed).orderBy("doc_id").collect()
    assert [r.hits for r in out] == [2, 0]
    odd = spark.createDataFrame([(1, "pond  scum"), (2, "pond, scum"), (3, "scum")], "doc_id long, text string")
    assert [r.hits for r in toxicity.score(odd, seed).orderBy("doc_id").collect()] == [0, 0, 1]


def test_tokens_packing_and_files(spark, docs):
    enc = tokens.Encoder(tokens.tokenizer_path())
    texts = [r[1] for r in ROWS] + ["don't  stop,\tnow\n12.5 <|endoftext|> a<|startoftext|>b \x1c ΑΣ İI é ́x", "日本 語", "l'été\xa0où"]
    for t in texts:
        assert enc.encode(t).tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids
    want = sorted((r[0] or -1, zlib.crc32(np.append(enc.encode(r[1]), 2).astype("<u4").tobytes())) for r in ROWS)
    pieces = packing.pack_documents(docs.where("doc_id is null or doc_id <> 2"), longest=64).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.length & (p.length - 1) == 0 and p.length <= 64 for p in pieces)
    by = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by.setdefault((p.doc_id, p.doc_tokens), b"")
        by[p.doc_id, p.doc_tokens] += p.ids
    assert all(len(v) == 4 * k[1] for k, v in by.items())
    assert {(k[0] or -1, zlib.crc32(v)) for k, v in by.items()} <= set(want)
    got = token_files.read_token_files(token_files.write_token_files(docs)).orderBy("start").collect()
    assert len(got) == len(ROWS) and [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    ids = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert ids == sorted(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.where("false"))).count() == 0


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(ROWS) and all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in got)
    assert abs(sum({(r.source, r.target) for r in got} and {r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert all(r.target <= 3 * r.source_size + 1e-9 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs).collect()))
    assert mixing.emit_mix(docs).columns == docs.columns and mixing.mix_sources(docs.where("false")).count() == 0


def test_ngram_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [[f"v{x}" for x in rng.integers(0, 400, n)] for n in (6, 20, 60, 150, 150)]
    texts = [None, "", "one two", "One TWO", "three"]
    for w in base:
        for _ in range(14):
            v = list(w)
            for k in rng.integers(0, len(v), rng.integers(0, 1 + len(v) // 15)):
                v[k] = f"z{rng.integers(50)}"
            texts.append(" ".join(v))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()}
    want = {i: (len(s), comp[i]) for i, s in enumerate(sets)}
    assert not {k: (texts[k], got[k], want[k]) for k in want if got[k] != want[k]}
    assert ngram_join.jaccard_components(docs.where("false")).count() == 0


def test_tree_search_is_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 260)).astype(np.uint64)) for _ in range(80)]
    for p in sets[:10]:
        want = [100 * len(np.intersect1d(p, s)) >= 75 * len(np.union1d(p, s)) for s in sets]
        assert ngram_join.tree_search(p, sets, 75) == want


def test_language_model(spark, docs):
    got = language_model.score_texts(docs, F.col("doc_id") == 5).collect()
    train = [w for r in ROWS if r[0] is not None and r[0] != 5 for w in [*words(r[1]), None]]
    n, v = len(train), len(set(train))
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id == 5:
            own = [*words(LONG), None]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, len(own), sum(w in train for w in own), n)
            assert abs(r.base_score - sum(np.log10((train.count(w) + 0.5) / (n + 0.5 * (v + 1))) for w in own)) < 1e-9
        assert np.isfinite(r.score) and r.score < 0
    assert language_model.score_texts(docs.where("false"), F.lit(False)).count() == 0


def test_repeated_passages(spark):
    shared = [f"s{i}" for i in range(52)]
    own = lambda k, n: [f"o{k}x{i}" for i in range(n)]
    texts = [" ".join(own(0, 30) + shared + own(1, 7)), " ".join(own(2, 3) + shared + own(3, 90)), " ".join(own(4, 200)), " ".join(own(5, 80) + shared[:20] + own(6, 80)), None, "short", LONG, LONG.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(docs).collect()}
    assert [k for k in sorted(got) if got[k].repeated_words] == [0, 1, 6, 7]
    assert got[0].spans[0]["ref"] == 1 and got[6].spans[0]["ref"] == 7
    assert 30 <= got[0].spans[0]["start"] <= 34 and 78 <= got[0].spans[0]["end"] <= 82
    assert substring_dedup.repeated_passages(docs.where("false")).count() == 0


def test_compact_windows_cover_each_run_once():
    v = np.array([5, 3, 3, 9, 1, 7, 2, 8], np.uint64)
    w = substring_dedup.compact_windows(v, 3)
    for i in range(len(v)):
        for j in range(i + 2, len(v)):
            p = i + int(v[i : j + 1].argmin())
            assert sum(a <= i and j <= b and c == p for a, c, b in w) == 1


def test_word_hashes_agree_between_texts():
    a = word_hashes("The quick\tTHE \n" + "y" * 3_000_000 + " quick")
    assert len(a) == 5 and a[0] == a[2] and a[1] == a[4] and len({*a.tolist()}) == 3


def passages(spark, texts, **args):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: r for r in substring_dedup.repeated_passages(docs, **args).collect()}


def linked(got):
    return {frozenset((k, x["ref"])) for k, r in got.items() for s in r.spans for x in s["refs"]}


def test_repeated_passages_keep_all_links(spark):
    rng = np.random.default_rng(14)
    own = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    p, q, r = own(60), own(60), own(60)
    x, z = own(50) + p + own(50), own(70) + p + own(10)
    texts = [x, x, z, z, own(30) + q + r + own(30), own(50) + q + own(5), own(9) + r + own(50)]
    got = passages(spark, texts)
    found = linked(got)
    assert {frozenset((0, 1)), frozenset((2, 3)), frozenset((0, 2)), frozenset((4, 5)), frozenset((4, 6))} <= found
    assert {x["ref"] for s in got[4].spans for x in s["refs"]} == {5, 6}
    assert [got[k].repeated_words for k in (0, 2)] == [160, 140] and not found & {frozenset((5, 6)), frozenset((0, 4))}


def test_repeated_passages_meet_beside_texts_that_hold_parts(spark):
    rng = np.random.default_rng(13)
    own = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    texts, want = [], set()
    for _ in range(150):
        p, k = own(52), len(texts)
        texts += [own(40) + p[:36] + own(40), own(40) + p[16:] + own(40), own(40) + p + own(40), own(40) + p + own(40)]
        want.add(frozenset((k + 2, k + 3)))
    assert linked(passages(spark, texts)) == want


def test_repeated_passages_with_a_word_more_or_less(spark):
    rng = np.random.default_rng(11)
    own = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    texts, want = [], set()
    for size in (52, 55, 60, 70, 80, 120):
        for _ in range(20):
            for less, more in ((0, 1), (1, 0), (1, 1)):
                p, m = own(size), size // 2
                want.add(frozenset((len(texts), len(texts) + 1)))
                texts += [own(40) + p + own(33), own(21) + p[:m] + own(more) + p[m + less :] + own(60)]
    # a shared line of 30 words is no passage
    line = own(30)
    texts += [own(90) + line + own(80) for _ in range(3)]
    got = passages(spark, texts)
    assert linked(got) == want
    assert all(abs(r.spans[0]["start"] - (21 if k % 2 else 40)) < 8 for k, r in got.items() if r.spans)


def test_repeated_passages_in_a_large_group(spark):
    rng = np.random.default_rng(12)
    own = lambda n: [f"w{x}" for x in rng.integers(10**9, size=n)]
    p = own(70)
    texts = [own(40) + p + own(40) for _ in range(80)] + [own(40) + p[:35] + own(1) + p[35:] + own(40) for _ in range(20)] + [own(100) + p[20:50] + own(100) for _ in range(60)]
    got = passages(spark, texts)
    assert [k for k in sorted(got) if got[k].repeated_words] == list(range(100))
