"""The pipeline's stages and its whole run over a small folder, against plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from perilattice.llm import tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(10**6, size=n))
    plain = [own(n) for n in rng.integers(20, 60, 60)]
    near = [t.replace(t.split(" ")[0], "changed") for t in plain[:10]]
    toxic = [f"{own(20)} idiot moron scum {own(5)} idiot moron" for _ in range(40)]
    texts = [*plain, *[t.upper() for t in plain[5:15]], *near, *toxic, "", None]
    rows = [(i, t, "en", "abc"[i % 3], len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{d}/documents.parquet")
    bad = lambda i: int("idiot" in (texts[i] or ""))
    spark.createDataFrame([(i, 1 - bad(i), bad(i)) for i in range(len(texts))], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    return d, rows


def copies(rows):
    best = {}
    for r in rows:
        best[low(r[1])] = max(best.get(low(r[1]), r), r, key=lambda r: r[0])
    return sorted(r[0] for r in best.values())


def near_copies(rows):
    sets = []
    for r in rows:
        w = low(r[1]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        before = list(comp)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    groups = defaultdict(list)
    for r, c in zip(rows, comp, strict=True):
        groups[c].append(r[0])
    return sorted(min(g) for g in groups.values())


def test_stages_and_run(spark, folder):
    d, rows = folder
    frame = lambda x: spark.createDataFrame(x, COLUMNS).coalesce(1)
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    pick = lambda keep: [r for r in rows if r[0] in set(keep)]
    clean = [r[0] for r in rows if "idiot" not in (r[1] or "")]
    assert ids(stage["toxicity"](spark, frame(rows), d)) == clean
    once = copies(pick(clean))
    assert ids(stage["exact_dedup"](spark, frame(pick(clean)), d)) == once
    apart = near_copies(pick(once))
    assert ids(stage["ngram_jaccard_join"](spark, frame(pick(once)), d)) == apart and len(apart) < len(once) < len(clean)
    mixed = Counter(ids(stage["mixing"](spark, frame(pick(apart)), d)))
    assert set(mixed) <= set(apart) and max(mixed.values()) <= 3
    enc = tokens.Encoder(tokens.tokenizer_path())
    text = {r[0]: r[1] for r in rows}
    joined = defaultdict(bytes)
    for p in sorted(stage["packing"](spark, frame(pick(apart)), d).collect(), key=lambda p: p.start):
        joined[p.doc_id] += p.ids
    want = {i: np.append(enc.tokenizer.encode(text[i] or "", add_special_tokens=False).ids, 2).astype("<u4").tobytes() for i in apart}
    assert joined == want
    out = corpus_pipeline.run(spark, d).collect()
    assert {p.doc_id for p in out} == set(mixed)
    for i in set(mixed):
        assert sum(len(p.ids) for p in out if p.doc_id == i) == mixed[i] * len(want[i])
