"""WARC, tokens, packing, token files and toxicity against plain Python."""

import io
import re
import zlib

import numpy as np
import pytest

from perilattice.llm import packing, token_files, tokens, toxicity, warc

DOCS = "doc_id long, text string, ids string, start string"
LONG = " ".join(f"Word{i}, it's number {i % 17}!" for i in range(3000))
ROWS = [(3, "one Two three", "x", "y"), (1, None, None, None), (2, "", "x", None), (2, "", "x", None), (None, "no id", None, None), (9, LONG, None, None), (7, "x" * 30_000, None, None), (7, "é ü ß 日本", None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3).cache()


def ids_of(enc, text, end):
    return np.append(enc.tokenizer.encode(text or "", add_special_tokens=False).ids, end).astype("<u4").tobytes()


def test_packing_loses_and_repeats_no_id(docs):
    enc = tokens.Encoder(tokens.tokenizer_path())
    want = sorted(((r[0] if r[0] is not None else -1), ids_of(enc, r[1], 2)) for r in ROWS)
    for longest in (64, 4096):
        pieces = packing.pack_documents(docs, longest=longest).collect()
        assert len({p.sequence_id for p in pieces}) == len(pieces) and all(p.offset == 0 for p in pieces)
        assert all(p.length & (p.length - 1) == 0 and 0 < p.length <= longest and len(p.ids) == 4 * p.length for p in pieces)
        # pieces of a document follow each other; repeated rows are told apart by where the next one starts
        got, held = [], {}
        for p in sorted(pieces, key=lambda p: (p.doc_id if p.doc_id is not None else -1, p.doc_tokens, p.start)):
            held.setdefault((p.doc_id, p.doc_tokens), {}).setdefault(p.start, []).append(p)
        for (doc, n), at in held.items():
            copies = len(at[0])
            assert sum(p.length for ps in at.values() for p in ps) == copies * n
            for c in range(copies):
                body, k = b"", 0
                while k < n:
                    p = at[k][c]
                    body += p.ids
                    k += p.length
                got.append((doc if doc is not None else -1, body))
        assert sorted(got) == want
    assert packing.pack_documents(docs.where("false")).count() == 0


@pytest.mark.parametrize("size", [1 << 28, 500])
def test_token_files_give_back_every_id(docs, size, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", size)
    enc = tokens.Encoder(tokens.tokenizer_path())
    got = token_files.read_token_files(token_files.write_token_files(docs)).orderBy("start").collect()
    want = sorted(((r[0] if r[0] is not None else -1), zlib.crc32(ids_of(enc, r[1], 1))) for r in ROWS)
    assert sorted(((r.doc_id if r.doc_id is not None else -1), zlib.crc32(r.ids)) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([len(r.ids) // 4 for r in got])[:-1].tolist()] and all(r.n_tokens == len(r.ids) // 4 for r in got)
    seen = [r.doc_id if r.doc_id is not None else -1 for r in got]
    assert seen == sorted(seen)


def test_remote_numbers_are_read_by_slice(tmp_path):
    import pyarrow.fs as fs

    np.arange(1000, dtype="<u2").tofile(tmp_path / "a.bin")
    view = token_files.Remote(fs.LocalFileSystem().open_input_file(str(tmp_path / "a.bin")), "<u2")
    assert len(view) == 1000 and view[10:13].tolist() == [10, 11, 12] and view[990:2000].tolist() == list(range(990, 1000))


def test_another_tokenizer_gets_whole_texts():
    enc = tokens.Encoder(tokens.tokenizer_path("byte_bpe_50k.json"))
    for text in ("hello world again", " two  spaces\n\nlines", "", None):
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_the_memo_is_bounded_in_bytes():
    enc = tokens.Encoder(tokens.tokenizer_path(), memo=10)
    for i in range(400):
        enc.encode(f"word{i} " + "y" * 5000)
    assert enc.held < 4000 and max(map(len, enc), default=0) <= tokens.LONGEST


def test_long_headers_and_long_bodies_are_recovered():
    url = "http://a/" + "u" * 70_000
    for pack in (bytes, warc.member):
        data = b"".join(pack(warc.record(i, url, bytes([65 + i]) * 3_000_000, None, False)) for i in range(3))
        out = list(warc.salvage(io.BytesIO(data)))
        assert [(r["page_id"], r["gap"], r["payload_bytes"]) for r in out] == [(i, False, 3_000_000) for i in range(3)] and out[1]["url"] == url


def test_a_record_inside_a_damaged_payload_is_no_record():
    inner = warc.record(99, None, b"inside", None, False)
    outer = bytearray(warc.record(1, None, b"start " + inner + b" end", None, False))
    outer[outer.index(b"start")] ^= 1
    out = list(warc.salvage(io.BytesIO(warc.record(0, None, b"a", None, False) + bytes(outer) + warc.record(2, None, b"c", None, False))))
    assert [(r.get("page_id"), r["gap"]) for r in out] == [(0, False), (None, True), (2, False)] and out[1]["length"] == len(outer)


def test_damage_anywhere_costs_only_the_records_that_it_touches():
    rng = np.random.default_rng(61)
    for pack in (bytes, warc.member):
        data = [pack(warc.record(i, f"u{i}", rng.bytes(int(rng.integers(0, 400))), None, False)) for i in range(12)]
        ends = np.cumsum([0, *map(len, data)])
        for _ in range(60):
            whole = bytearray(b"".join(data))
            a = int(rng.integers(0, len(whole)))
            n = int(rng.integers(1, 30))
            whole[a : a + n] = bytes(x ^ 0x55 for x in whole[a : a + n])
            out = list(warc.salvage(io.BytesIO(bytes(whole))))
            touched = {i for i in range(12) if ends[i] < min(a + n, len(whole)) and a < ends[i + 1]}
            assert {r["page_id"] for r in out if not r["gap"]} >= set(range(12)) - touched
            cover = sorted((r["offset"], r["offset"] + r["length"]) for r in out)
            assert cover[0][0] == 0 and cover[-1][1] == len(whole) and all(x[1] == y[0] for x, y in zip(cover, cover[1:], strict=False))


def test_a_manifest_that_lies_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "abc" * i, "clash") for i in range(5)], "page_id long, url string, html string, payload string").coalesce(1)
    manifest = warc.write_warc(pages, f"file://{tmp_path}")
    assert warc.read_warc(manifest, strict=True).count() == 5
    with pytest.raises(Exception, match="records"):
        warc.read_warc(manifest.selectExpr("path", "n_records + 1 as n_records"), strict=True).count()


def plain_features(text, weights, exceptions):
    """Entries by plain search in the folded words."""
    s = toxicity.fold(text)
    best = {}
    for entry, w in weights.items():
        for m in re.finditer(f"(?={re.escape(entry)})", s):
            best[m.start()] = max(w, best.get(m.start(), w))
    for phrase in exceptions:
        entry = f" {' '.join(toxicity.fold(phrase).split())} "
        for m in re.finditer(f"(?={re.escape(entry)})", s):
            best = {k: w for k, w in best.items() if not m.start() <= k < m.start() + len(entry) - 1}
    return sum(best.values()), float(len(best)), max(best.values(), default=0.0), float(len(s.split()))


def test_matching_equals_plain_search_in_folded_text():
    rng = np.random.default_rng(62)
    words = ["idi0t", "idiotic", "m0ron", "pond", "scum", "loser", "sore", "SC​UM", "ѕcum", "tr4sh", "can", "a", "b"]
    weights = {" idiot ": 2.0, " idio": 1.0, " moron ": 3.0, " scum ": 1.5, " loser ": 1.0, " trash ": 0.5}
    weights = {toxicity.fold(k.strip()) if k.endswith(" ") else " " + toxicity.fold(k.strip()).strip(): w for k, w in weights.items()}
    a = toxicity.Model(weights, []).automaton()
    for _ in range(300):
        text = "".join(w + str(rng.choice([" ", ", ", "\n", " - "])) for w in rng.choice(words, int(rng.integers(0, 14))))
        assert toxicity.features(text, a) == pytest.approx(plain_features(text, weights, toxicity.EXCEPTIONS))


def test_toxicity_learns_harmless_phrases_and_takes_awkward_rows(spark):
    rng = np.random.default_rng(63)
    rows = []
    for i in range(900):
        w = [f"word{rng.integers(200)}" for _ in range(25)]
        bad = i % 3 == 0
        rows.append((i, " ".join([*w, "vile", "grunk"] if bad else [*w, "green", "grunk"] if i % 3 == 1 and i % 2 else w), int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = data.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None), (0, 0), (0, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(data, labels)
    assert "green grunk" in {" ".join(p.split()) for p in model.exceptions} or " grunk " not in model.weights
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "vile  GRUNK", None), (3, "vile  GRUNK", None), (None, "green, grunk " * 3 + "word1 " * 4000, 0.1)], "doc_id long, text string, score double")
    got = toxicity.score(odd, model).collect()
    assert [r.predicted for r in got] == [0, 0, 1, 1, 0] and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert toxicity.score(odd.where("false"), model).count() == 0
