"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .tokens import encoder, tokenizer_path

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Lengths of a document's pieces: as many of the longest as fit, then the binary digits of the rest, largest first."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 2, longest: int = 4096) -> DataFrame:
    """Cut each document's ids, with end_id last, into pieces of power-of-two lengths; each piece is a sequence of its own.

    One row per piece: doc_id, start (ids of its document before it), length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset (always 0). longest must be a power of two. Sequences of a length form a bucket: their ids share
    the bits from 56 on, so a reader takes whole batches of one shape by a range of sequence_id, and nothing is padded.
    Bits 34 to 55 hold the task's partition and the others a running number, so ids are unique without a shuffle and stay
    the same when a task is repeated. A null text is empty and gives the end id alone; a null id stays null; repeated
    rows are packed each. An empty table gives an empty result. Other columns are not read.
    """
    if longest & (longest - 1) or longest <= 0:
        raise ValueError("longest must be a power of two")
    path = path or tokenizer_path()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part, count = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py()).tobytes() + end
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, longest):
                    bucket = length.bit_length() - 1
                    k = count[bucket] = count.get(bucket, -1) + 1
                    rows.append((doc_id, at, length, ids[4 * at : 4 * (at + length)], n, bucket << 56 | part << 34 | k, 0))
                    at += length
                size += len(ids)
                if size > 8 << 20:
                    yield to_batch(rows)
                    rows, size = [], 0
        enc.forget()
        if rows:
            yield to_batch(rows)

    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return out.mapInArrow(tidy(pack), SCHEMA)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
