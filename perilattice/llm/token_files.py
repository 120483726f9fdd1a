"""Token files: flat unsigned integers with 64-bit document offsets, written and read by partition."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, materialize, partitions, shared_dir
from .tokens import encoder, tokenizer_path

#: Chunks that a worker remembers here, beside the sort of whole texts.
MEMO = 600_000
#: Bytes of ids after which a task goes on in another file.
FILE_BYTES = 1 << 28
#: Stands for a null id in the index.
NO_ID = np.iinfo(np.int64).min
MANIFEST = "part long, stem string, width int, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode docs in ascending id order and write <stem>.bin (ids) and <stem>.idx (ids of documents, then offsets).

    Returns the manifest, one row per file: part, stem, width (bytes an id: 2 where the vocabulary allows, else 4), n_docs,
    n_tokens and base, the ids in all files before it (a prefix sum over files). Rows are dealt into id ranges, each task
    writes its files under a name of its own, and only names that the written manifest holds count, so repeated tasks do
    no harm. Null ids come first; equal ids follow one another in order of a hash of their text; a null text is empty and gives the end id alone.
    An empty table gives an empty manifest. Other columns are not read.
    """
    spark = docs.sparkSession
    folder, path = folder or shared_dir(spark, "token-files"), path or tokenizer_path()
    n = partitions(spark)
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(path, MEMO)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        end = np.array([end_id], f"<u{width}").tobytes()
        ids, ends, total, out, stem, n = [], [], 0, None, "", 0

        def close() -> pa.RecordBatch:
            out.close()
            with store.open_output_stream(f"{root}/{stem}.idx") as f:
                f.write(np.array(ids, "<i8").tobytes() + np.array([0, *ends], "<i8").tobytes())
            row = {"part": part << 24 | n, "stem": f"{folder}/{stem}", "width": width, "n_docs": len(ids), "n_tokens": total}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int64()), ("stem", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not out:
                    stem = f"{part:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(f"{root}/{stem}.bin")
                tokens = enc.encode(text.as_py())
                out.write(tokens.astype(f"<u{width}").tobytes() + end)
                total += len(tokens) + 1
                ids.append(NO_ID if doc_id is None else doc_id)
                ends.append(total)
                if total * width >= FILE_BYTES:
                    yield close()
                    ids, ends, total, out, n = [], [], 0, None, n + 1
        if out:
            yield close()

    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Remote:
    """Numbers of a file that can't be mapped, read by slice."""

    def __init__(self, file, kind: str):
        self.file, self.kind, self.width = file, kind, np.dtype(kind).itemsize

    def __len__(self) -> int:
        return self.file.size() // self.width

    def __getitem__(self, part: slice) -> np.ndarray:
        first, last, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at((last - first) * self.width, first * self.width), self.kind)


def open_tokens(stem: str, width: int, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | Remote]:
    """(document ids, offsets, token ids) of a file; memory-mapped where the store is local, else token ids are read by slice."""
    store, root = filesystem(stem)

    def view(name: str, kind: str):
        return np.memmap(name, kind, "r") if store.type_name == "local" else Remote(store.open_input_file(name), kind)

    index = view(f"{root}.idx", "<i8")
    return index[:n_docs], index[n_docs:], view(f"{root}.bin", f"<u{width}")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        for batch in batches:
            for row in batch.to_pylist():
                docs, offsets, tokens = open_tokens(row["stem"], row["width"], row["n_docs"])
                if len(tokens) != row["n_tokens"] or offsets[-1] != row["n_tokens"]:
                    raise ValueError(f"{row['stem']} is incomplete")
                first = 0
                while first < len(docs):
                    last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (2 << 20), "right")) - 1)
                    part = tokens[int(offsets[first]) : int(offsets[last])].astype("<u4")
                    cuts = ((offsets[first : last + 1] - offsets[first]) * 4).astype(np.int64)
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(part.tobytes())]).cast(pa.binary())
                    doc = np.array(docs[first:last])
                    yield pa.RecordBatch.from_arrays([pa.array(doc, mask=doc == NO_ID), pa.array(offsets[first:last] + row["base"]), pa.array(np.diff(offsets[first : last + 1])), ids], names=names)
                    first = last

    n = partitions(manifest.sparkSession)
    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
