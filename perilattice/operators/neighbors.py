"""Periodic pairs within a cut-off, as an equi-join on linked cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import CELL, KEY, cartesian, fractional, nearest_image, once, wrap

#: A cell and its neighbours; and the cell with one of each two opposite neighbours, so that every two cells meet once.
FULL = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
HALF = [(i, j, k) for i, j, k in FULL if (k, j, i) >= (0, 0, 0)]

Sides = tuple[list[str], list[str]]


def pairs(atoms: DataFrame, frames: DataFrame, rcut: float, ordered: bool = False, extra: list[str] | None = None, sides: Sides | None = None) -> DataFrame:
    """Pairs at nearest-image distance below rcut: file, frame, a, b, el_a, el_b, d2, dx, dy, dz, volume; d goes from a to b.

    Unordered pairs have a < b; distance 0 counts. Where rcut is at most half of a frame's smallest spacing, only one image of
    an atom can be near: each atom lies in one of floor(spacing / rcut) cells an axis, and its images meet the atoms of the
    cells around, one of each two opposite ones. Rows carry Cartesian positions only, so a candidate costs three differences,
    and a frame's pairs spread over its cells. Other frames compare all atoms by the rounded fractional difference.
    extra: more columns of atoms, given for both ends as a_<name> and b_<name>. sides: elements of a and of b; then each a is
    paired with each near b, and no other atoms are looked at.
    """
    extra = extra or []
    if sides:
        atoms = atoms.where(F.col("element").isin(*sides[0], *sides[1]))
    f = fractional(atoms, frames).withColumn("small", F.least("d0", "d1", "d2") < 2 * rcut)
    out = _near(f.where("not small"), rcut, extra, sides).unionByName(_all(f.where("small"), rcut, extra, sides))
    if ordered and not sides:
        back = {"a": F.col("b"), "b": F.col("a"), "el_a": F.col("el_b"), "el_b": F.col("el_a"), **{f"d{x}": -F.col(f"d{x}") for x in "xyz"}}
        back |= {f"{s}_{c}": F.col(f"{o}_{c}") for c in extra for s, o in (("a", "b"), ("b", "a"))}
        names = out.columns
        two = F.array(F.struct(*names), F.struct(*[back.get(c, F.col(c)).alias(c) for c in names]))
        out = out.select(F.explode(two).alias("p")).select("p.*")
    return out


def _cell(at: list[Column]) -> Column:
    return (at[2] * F.col("ny") + at[1]) * F.col("nx") + at[0]


def _of(rows: DataFrame, element: str, wanted: list[str] | None) -> DataFrame:
    return rows if wanted is None else rows.where(F.col(element).isin(wanted))


def _near(f: DataFrame, rcut: float, extra: list[str], sides: Sides | None) -> DataFrame:
    f = once(f, **{f"n{x}": F.floor(F.col(f"d{k}") / rcut) for k, x in enumerate("xyz")}, **{f"f{x}": wrap(F.col(f"f{x}")) for x in "xyz"})
    f = once(f, **{f"b{x}": F.least(F.floor(F.col(f"f{x}") * F.col(f"n{x}")), F.col(f"n{x}") - 1) for x in "xyz"})
    left, right = (_of(f, "element", x) for x in sides or (None, None))
    own = right.select(*KEY, _cell([F.col(f"b{x}") for x in "xyz"]).alias("c"), F.col("aid").alias("b"), F.col("element").alias("el_b"), "volume", *[cartesian(k, "fx", "fy", "fz").alias(f"{x}2") for k, x in enumerate("xyz")], *[F.col(e).alias(f"b_{e}") for e in extra])
    step = left.withColumn("s", F.explode(F.array(*[F.struct(*[F.lit(v).alias(x) for v, x in zip(o, "xyz", strict=True)]) for o in (FULL if sides else HALF)])))
    to = {x: F.col(f"b{x}") + F.col(f"s.{x}") for x in "xyz"}
    step = step.withColumns({f"t{x}": F.pmod(to[x], F.col(f"n{x}")) for x in "xyz"}).withColumns({f"g{x}": F.col(f"f{x}") - F.floor(to[x] / F.col(f"n{x}")) for x in "xyz"})
    home = (F.col("s.x") == 0) & (F.col("s.y") == 0) & (F.col("s.z") == 0)
    image = step.select(*KEY, _cell([F.col(f"t{x}") for x in "xyz"]).alias("c"), F.col("aid").alias("a"), F.col("element").alias("el_a"), home.alias("home"), *[cartesian(k, "gx", "gy", "gz").alias(f"{x}1") for k, x in enumerate("xyz")], *[F.col(e).alias(f"a_{e}") for e in extra])
    both = image.join(own, [*KEY, "c"])
    d = {x: F.col(f"{x}2") - F.col(f"{x}1") for x in "xyz"}
    d2 = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    once_only = F.lit(True) if sides else ~F.col("home") | (F.col("a") < F.col("b"))
    both = both.where(once_only & (F.col("a") != F.col("b")) & (d2 < rcut * rcut))
    turn = F.lit(False) if sides else F.col("a") > F.col("b")
    pick = lambda one, two: F.when(turn, F.col(two)).otherwise(F.col(one))
    ends = [pick(f"{s}{c}", f"{o}{c}").alias(f"{s}{c}") for c in ("", *[f"_{e}" for e in extra]) for s, o in (("a", "b"), ("b", "a"))]
    return both.select(*KEY, *ends, pick("el_a", "el_b").alias("el_a"), pick("el_b", "el_a").alias("el_b"), "volume", *[F.when(turn, -d[x]).otherwise(d[x]).alias(f"d{x}") for x in "xyz"], d2.alias("d2"))


def _all(f: DataFrame, rcut: float, extra: list[str], sides: Sides | None) -> DataFrame:
    left, right = (_of(f, "element", x) for x in sides or (None, None))
    one = left.select(*KEY, F.col("aid").alias("a"), F.col("element").alias("el_a"), "fx", "fy", "fz", *CELL, "volume", *[F.col(e).alias(f"a_{e}") for e in extra])
    two = right.select(*KEY, F.col("aid").alias("b"), F.col("element").alias("el_b"), *[F.col(f"f{x}").alias(f"g{x}") for x in "xyz"], *[F.col(e).alias(f"b_{e}") for e in extra])
    both = once(one.join(two, KEY).where("a <> b" if sides else "a < b"), **{f"h{x}": nearest_image(F.col(f"g{x}") - F.col(f"f{x}")) for x in "xyz"})
    both = once(both, **{f"d{x}": cartesian(k, "hx", "hy", "hz") for k, x in enumerate("xyz")})
    both = both.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")).where(F.col("d2") < rcut * rcut)
    return both.select(*KEY, "a", "b", *[f"{s}_{e}" for e in extra for s in "ab"], "el_a", "el_b", "volume", "dx", "dy", "dz", "d2")
