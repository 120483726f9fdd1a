"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_counted, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of links (a, b): root is the smallest node of the component; a root has a row of its own.

    Alternates the large-star and small-star steps (Kiveris et al., 2014) until the edges stay the same. Minima are partial
    aggregates and the joins are plain equi-joins, so a node may have any number of links; nothing goes to the driver but
    a count and a checksum, taken while a round is written. Both steps of a round are one job; rows that the large step
    repeats, twice the edges at most, go with the small step's distinct.
    """
    edges, mark = _written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    while mark["n"]:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last = edges
        edges, now = _written(small.where("a <> b").distinct(), "cc-stars")
        release(last)
        if now == mark:
            break
        mark = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.written_at = edges.written_at
    return out


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, dict]:
    return materialize_counted(edges, name, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"))
