"""Helpers shared by the training-data operators: shared folders, written tables, file access, text hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Word characters: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir.

    Where that setting is absent, a single machine (tests, notebooks) sets and uses a local folder; a cluster is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/perilattice-shared"
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and pins nondeterministic columns."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def release(*written: DataFrame | None) -> None:
    """Delete what materialize wrote for these; nothing that is still to be computed may read it."""
    for df in written:
        path = getattr(df, "written_at", None) if df is not None else None
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of a column's texts in UTF-8, by which ranges of postings are sized."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0


def materialize_counted(df: DataFrame, name: str, *what: Column) -> tuple[DataFrame, dict]:
    """As materialize, with aggregates of the rows (their count as n, if none are given) taken while they are written."""
    seen = Observation()
    out = materialize(df.observe(seen, *(what or (F.count(F.lit(1)).alias("n"),))), name)
    return out, seen.get


def hand_back() -> None:
    """Return freed memory to the system; a Python worker outlives its task and would keep it beside the next operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands freed memory back before and after its task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return tidied


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI, so that executors can reach file:, hdfs:, s3: and similar stores."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(c: Column) -> Column:
    """Number of runs of characters that aren't ASCII white space (0 for an empty text)."""
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


# --- hashing of words with numpy -------------------------------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64, up to n - 1."""
    both = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        out = np.ones(n, np.uint64)
        np.multiply.accumulate(np.full(n - 1, x, np.uint64), out=out[1:])
        both.append(out)
    return both[0], both[1]


_TABLE: list[tuple[np.ndarray, np.ndarray]] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def cut_words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's UTF-8 bytes with A-Z lower-cased, and where its words start and end in them."""
    b = _LOW[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _SEP[b], [True])).view(np.int8)))
    return b, edge[::2], edge[1::2]


def hash_cut(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that cut_words found; words may have any length.

    A word's polynomial hash is a difference of running sums of byte times power of its position, set back to position 0 by
    the inverse power; long texts go in spans of _CHUNK bytes, or of a word where one is longer.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    if not _TABLE:
        _TABLE.append(_powers(_CHUNK))
    out, k = [], 0
    while k < len(start):
        j = max(k + 1, int(np.searchsorted(end, start[k] + _CHUNK, "right")))
        low, size = int(start[k]), int(end[j - 1] - start[k])
        power, inverse = _TABLE[0] if size <= _CHUNK else _powers(size)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((b[low : low + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
        s, e = start[k:j] - low, end[k:j] - low
        out.append((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = j
    return mix(out[0] if len(out) == 1 else np.concatenate(out))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of a text's words after lower-casing A-Z, in order."""
    return hash_cut(*cut_words(text))


def column_words(texts: pa.Array, span: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of a string column, in runs of rows of about `span` bytes.

    Yields (first row, end row, bytes with A-Z lower-cased, word starts, word ends, words before each row and in all); nulls are empty.
    """
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    if texts.null_count:
        texts = texts.fill_null("")
        yield from column_words(texts, span)
        return
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + span, "right")) - 1)
        own = at[first : last + 1] - at[first]
        b = _LOW[data[at[first] : at[last]]]
        inside = ~_SEP[b]
        before, after = np.concatenate(([False], inside))[: len(b)], np.concatenate((inside, [False]))[1:]
        cut = own[:-1][own[:-1] < len(b)]
        before[cut] = False
        after[cut[cut > 0] - 1] = False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        yield first, last, b, start, end, np.searchsorted(start, own)
        first = last


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of the n-word shingles in order; a shorter sequence is one shingle, an empty one none."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    g = words[:m].copy()
    for i in range(1, n):
        g = mix(g * np.uint64(0x9E3779B97F4A7C15) + words[i : m + i])
    return g
