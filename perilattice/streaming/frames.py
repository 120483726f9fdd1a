"""Statistics of a stream of frames: what needs no other frame is counted as rows arrive, in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compositions(atoms: DataFrame) -> DataFrame:
    """file, frame, element, n of a batch or a stream of atoms."""
    return atoms.groupBy("file", "frame", "element").agg(F.count("*").alias("n"))


def voxel_counts(atoms: DataFrame, edges: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """file, ix, iy, iz, count of a batch or a stream of atoms in a fixed box with these edges; empty voxels have no row."""
    at = {}
    for x, edge, n in zip("xyz", edges, shape, strict=True):
        f = F.col(x) / edge
        at[f"i{x}"] = F.pmod(F.floor((f - F.floor(f)) * n), F.lit(n)).cast("long")
    return atoms.groupBy("file", *[c.alias(name) for name, c in at.items()]).agg(F.count("*").alias("count"))


def run_once(counts: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All that a stream holds by now, as a table in memory: for tests and small jobs."""
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return counts.sparkSession.table(name)
