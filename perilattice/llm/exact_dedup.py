"""Exact deduplication by progressive refinement, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, text_or_empty

UID, LEN, HEAD, FULL = "__x1_uid", "__x1_len", "__x1_head", "__x1_full"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head_chars: int = 256) -> DataFrame:
    """Mark the copies of each text: docs' columns with keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the row with the
    largest id stays. A null id counts as smaller than any other; among rows with the same id and text exactly one stays.
    An empty table gives an empty result. Input columns named keep_id, group_size or kept are replaced; others pass through.

    Refinement: byte length, then a hash of the first head_chars characters, then SHA-256 of the whole text, each only for
    rows that still share a group. Each group is reduced by partial aggregates, so a group may hold any share of the rows;
    the joins back are plain equi-joins, which adaptive execution splits when skewed. docs is read three times and must
    give the same rows in the same order each time, as file scans and written tables do.
    """
    rows = docs.withColumn(UID, F.monotonically_increasing_id())
    text = text_or_empty(text_col)
    sig = materialize(
        rows.select(UID, F.octet_length(text).alias(LEN), F.xxhash64(ascii_lower(F.substring(text, 1, head_chars))).alias(HEAD)),
        "exact-sig",
    )
    by_len = sig.groupBy(LEN).count().filter("count > 1").select(LEN)
    same_len = sig.join(by_len, LEN, "left_semi")
    by_head = same_len.groupBy(LEN, HEAD).count().filter("count > 1").select(LEN, HEAD)
    alive = same_len.join(by_head, [LEN, HEAD], "left_semi").select(UID)

    full = materialize(
        rows.select(UID, F.col(id_col).alias("id"), text.alias("text"))
        .join(alive, UID, "left_semi")
        .select(UID, "id", F.sha2(ascii_lower(F.col("text")), 256).alias(FULL)),
        "exact-full",
    )
    groups = full.groupBy(FULL).agg(F.max(F.struct("id", UID)).alias("best"), F.count("*").alias("n"))
    decided = full.join(groups, FULL).select(UID, F.struct(F.col("best.id").alias("id"), "n", (F.col(UID) == F.col(f"best.{UID}")).alias("kept")).alias("__x1_d"))

    out = rows.join(decided, UID, "left")
    return out.select(
        *[c for c in docs.columns if c not in ("keep_id", "group_size", "kept")],
        F.when(F.col("__x1_d").isNull(), F.col(id_col)).otherwise(F.col("__x1_d.id")).alias("keep_id"),
        F.coalesce(F.col("__x1_d.n"), F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__x1_d.kept"), F.lit(True)).alias("kept"),
    )
