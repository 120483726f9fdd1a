"""Bader volumes of a charge grid by steepest ascent on its points, with pointer jumping instead of walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CELL, cartesian, nearest_image, once, with_inverse
from .graph import checkpointed

SHAPE, AT = ["n0", "n1", "n2"], ["i0", "i1", "i2"]
#: Neighbours in scan order; of equal ascents the first holds.
STEPS = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if (a, b, c) != (0, 0, 0)]


def _index(at: list[Column]) -> Column:
    """A point's place with the first index fastest."""
    return at[0] + F.col("n0") * (at[1] + F.col("n1") * at[2])


def ascent(grid: DataFrame) -> DataFrame:
    """file, idx, to: for each point the one of its 26 neighbours with the steepest ascent, itself where none is higher.

    grid: file, n0 .. n2, cell (nine numbers), i0 .. i2, value; periodic. An ascent is the difference over the distance.
    """
    g = grid.withColumn("idx", _index([F.col(c) for c in AT]))
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("o"), *[F.lit(v).alias(f"s{i}") for i, v in enumerate(s)]) for k, s in enumerate(STEPS)]))
    near = g.select("file", *SHAPE, "cell", *AT, "idx", F.col("value").alias("here"), steps.alias("s"))
    to = [F.pmod(F.col(f"i{k}") + F.col(f"s.s{k}"), F.col(f"n{k}")) for k in range(3)]
    apart = [sum((F.col(f"s.s{i}") * F.col("cell")[3 * i + k] / F.col(f"n{i}") for i in range(3)), F.lit(0.0)) for k in range(3)]
    near = near.select("file", "idx", "here", F.col("s.o").alias("o"), _index(to).alias("to"), (1.0 / F.sqrt(apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2])).alias("inverse"))
    both = near.join(g.select("file", F.col("idx").alias("to"), F.col("value").alias("there")), ["file", "to"])
    both = once(both, up=F.col("here") + (F.col("there") - F.col("here")) * F.col("inverse")).where("up > here")
    best = both.groupBy("file", "idx").agg(F.max(F.struct("up", (-F.col("o")).alias("o"), "to")).alias("b")).select("file", "idx", F.col("b.to").alias("to"))
    return g.select("file", "idx").join(best, ["file", "idx"], "left").select("file", "idx", F.coalesce("to", "idx").alias("to"))


def volumes(grid: DataFrame) -> DataFrame:
    """file, idx, peak (the maximum that a point climbs to) and volume, numbered from 1 by the first point that climbs there.

    Each round every pointer takes the place of what it points to, so a path of n steps takes log2(n) rounds; rounds are
    written to the checkpoint folder.
    """
    p = checkpointed(ascent(grid))
    while True:
        q = p.select("file", F.col("idx").alias("to"), F.col("to").alias("next"))
        p = checkpointed(p.join(q, ["file", "to"]).select("file", "idx", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        if p.where("moved").isEmpty():
            break
        p = p.select("file", "idx", "to")
    first = p.groupBy("file", "to").agg(F.min("idx").alias("first"))
    first = first.withColumn("volume", F.row_number().over(Window.partitionBy("file").orderBy("first")))
    return p.join(first, ["file", "to"]).select("file", "idx", F.col("to").alias("peak"), F.col("volume").cast("long").alias("volume"))


def volume_charges(grid: DataFrame, atoms: DataFrame, vacuum: float = 1e-3) -> DataFrame:
    """file, volume, peak, charge (sum of values over all points' number), points, size (Angstrom^3), aid and distance of the nearest atom.

    Values are density times cell volume. Points of a density of at most `vacuum` belong to no volume: they make row 0, without
    peak, charge and atom. atoms: file, aid, x, y, z; of equally near ones the first holds.
    """
    cells = grid.select("file", *SHAPE, *[F.col("cell")[k].alias(c) for k, c in enumerate(CELL)]).distinct()
    cells = with_inverse(cells).withColumnRenamed("volume", "v").withColumn("points_all", F.col("n0") * F.col("n1") * F.col("n2"))
    g = grid.select("file", _index([F.col(c) for c in AT]).alias("idx"), "value").join(volumes(grid), ["file", "idx"]).join(cells.select("file", "v", "points_all"), "file")
    g = g.withColumn("empty", F.abs("value") / F.col("v") <= vacuum)
    peaks = g.select("file", "volume", "peak").distinct()
    kept = g.where("not empty").groupBy("file", "volume").agg(F.sum("value").alias("sum"), F.count("*").alias("points"))
    own = peaks.join(kept, ["file", "volume"], "left").join(cells, "file")
    place = {0: F.col("peak") % F.col("n0"), 1: F.floor(F.col("peak") / F.col("n0")) % F.col("n1"), 2: F.floor(F.col("peak") / (F.col("n0") * F.col("n1")))}
    own = own.select("file", "volume", "peak", (F.coalesce("sum", F.lit(0.0)) / F.col("points_all")).alias("charge"), F.coalesce("points", F.lit(0)).alias("points"), (F.coalesce("points", F.lit(0)) * F.col("v") / F.col("points_all")).alias("size"), *CELL, *[f"w{i}{j}" for i in range(3) for j in range(3)], *[(place[k] / F.col(f"n{k}")).alias(f"p{k}") for k in range(3)])
    met = own.join(atoms.select("file", "aid", "x", "y", "z"), "file", "left")
    frac = {k: nearest_image(F.col(f"p{k}") - (F.col("x") * F.col(f"w0{k}") + F.col("y") * F.col(f"w1{k}") + F.col("z") * F.col(f"w2{k}"))) for k in range(3)}
    met = once(met, **{f"h{k}": frac[k] for k in range(3)})
    d = [cartesian(k, "h0", "h1", "h2") for k in range(3)]
    met = once(met, distance=F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    keys = ["file", "volume", "peak", "charge", "points", "size"]
    near = met.groupBy(*keys).agg(F.min(F.struct("distance", "aid")).alias("a")).select(*keys, F.col("a.aid").alias("aid"), F.col("a.distance").alias("distance"))
    null = F.lit(None)
    void = g.where("empty").groupBy("file").agg(F.count("*").alias("points"), F.first(F.col("v") / F.col("points_all")).alias("one"))
    void = void.select("file", F.lit(0).cast("long"), null.cast("long"), null.cast("double"), "points", (F.col("points") * F.col("one")), null.cast("long"), null.cast("double"))
    return near.select("file", "volume", F.col("peak").cast("long").alias("peak"), "charge", "points", "size", "aid", "distance").union(void)


def atom_charges(charges: DataFrame, atoms: DataFrame) -> DataFrame:
    """file, aid, charge, size and least distance of each atom's volumes; an atom without one has 0 and no distance."""
    own = charges.where("volume > 0").groupBy("file", "aid").agg(F.sum("charge").alias("charge"), F.sum("size").alias("size"), F.min("distance").alias("distance"))
    return atoms.select("file", "aid").distinct().join(own, ["file", "aid"], "left").select("file", "aid", F.coalesce("charge", F.lit(0.0)).alias("charge"), F.coalesce("size", F.lit(0.0)).alias("size"), "distance")
