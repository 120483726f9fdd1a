"""What the packing operator's encoder holds while it runs, and what a Python worker still holds after it."""

import numpy as np
import pyarrow as pa

from perilattice.llm import packing, tokens


def test_the_memo_is_bounded_within_one_text():
    enc = tokens.Encoder(tokens.tokenizer_path(), memo=1000)
    text = " ".join(f"It's Word{i}, {'common ' * (i % 3)}" for i in range(20_000))
    for _ in range(2):
        assert enc.encode(text).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
        held = sum(120 + len(k) + len(v) for d in (enc, getattr(enc, "old", {})) for k, v in d.items())
        assert 0 < held < 1.01 * 1000 * tokens.ENTRY
    assert "common" in enc or "common" in enc.old


def test_workers_keep_no_chunks_after_packing(spark):
    rows = [(i, " ".join(f"w{x}" for x in np.random.default_rng(i).integers(10**6, size=200))) for i in range(40)]
    pieces = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    enc = tokens.Encoder(tokens.tokenizer_path())
    assert sum(p.length for p in pieces) == sum(len(enc.encode(t)) + 1 for _, t in rows)

    def look(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(len(e) for (_, memo), e in tokens._STATE.items() if memo == tokens.MEMO)]}, schema=pa.schema([("n", pa.int64())]))

    assert [r.n for r in spark.range(4, numPartitions=4).mapInArrow(look, "n long").collect()] == [0] * 4
