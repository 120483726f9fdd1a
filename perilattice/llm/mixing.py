"""Mixing of sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, text_or_empty, word_count

UID, AT, PART = "__x5_uid", "__x5_at", "__x5_part"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """Water filling over (source, source_size): adds weight and target.

    Sources in code-point order, null last, get the weights in turn and share the whole size; a target stops at limit times
    its source's size and the excess is shared again by weight until none is above. sizes has one row a source.
    """
    w_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(w_order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", cycle).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level of the first source that its cap doesn't stop holds for all that follow
    s = s.withColumn("open", F.col("cap") > F.col("level") * F.col("weight"))
    s = s.withColumn("final", F.min(F.when(F.col("open"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "source", "level"))).over(everything))
    ratio = F.col("cap") / F.col("weight")
    return s.select("source", "source_size", "weight", F.when(F.col("final").isNull() | (ratio < F.col("final.r")), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final.level") * F.col("weight"))).alias("target"))


def offset(source: Column) -> Column:
    """The source's pseudo-random offset in [0, 1): the first 32 bits of MD5 of its name, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), limit: int = 3) -> DataFrame:
    """Copies of each row that the mix takes: uid, id, source, size, source_size, target, copies, taken, one row per row of docs.

    size counts words (null text: 0). Systematic sampling within a source: rows by size from the largest, then id; each has
    target / source_size expected copies; their running sum plus one offset gives a copy for each integer crossed. As the
    expected copies of a source's rows are equal, the running sum is a rank: rows are dealt into ordered ranges, ranked
    in their range, and ranges get bases from a prefix sum over (range, source) counts. No source has to fit a task.
    Null sources form one source, last. Empty texts have size 0 and take nothing. Repeated rows count each. Empty input gives
    an empty result. uid is the row's monotonically_increasing_id in docs, which must be re-readable in the same order.
    """
    rows = docs.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    rows = materialize(rows, "mix-sizes")
    n = partitions(docs.sparkSession)
    order = [F.col("source").asc_nulls_last(), F.col("size").desc(), F.col("id").asc_nulls_last(), F.col(UID)]
    placed = materialize(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id()), "mix-ranges")
    placed = placed.withColumn(PART, F.shiftright(AT, 33))
    ranges = placed.groupBy(PART, "source").agg(F.count("*").alias("n"), F.min(AT).alias("first"), F.sum("size").alias("words"))
    base = Window.partitionBy("source").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(PART, "source", "first", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranges x sources: as many rows as ranges plus sources
    plan = ranges.alias("r").join(targets(sizes, weights, limit).alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select(PART, F.col("r.source").alias("source"), "first", "base", "source_size", "target")
    out = placed.alias("p").join(plan.alias("q"), (F.col(f"p.{PART}") == F.col(f"q.{PART}")) & F.col("p.source").eqNullSafe(F.col("q.source")))
    rank = F.col("base") + F.col(AT) - F.col("first")
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0)), F.lit(0.0))
    u = offset(F.col("p.source"))
    crossed = lambda k: F.floor(u + ratio * k.cast("double"))
    return out.select(
        UID, "id", F.col("p.source").alias("source"), "size", "source_size", "target",
        (crossed(rank + 1) - crossed(rank)).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def emit_mix(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: docs' rows, each as often as mix_sources takes it."""
    plan = mix_sources(docs, **kwargs).where("copies > 0").select(UID, F.col("copies").alias(AT))
    out = docs.withColumn(UID, F.monotonically_increasing_id()).join(plan, UID)
    return out.withColumn(AT, F.explode(F.sequence(F.lit(1), F.col(AT).cast("int")))).select(*docs.columns)
