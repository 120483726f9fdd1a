"""Column expressions for periodic cells; a cell's rows a, b, c are the columns m00 .. m22 of a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["file", "frame"]
CELL = [f"m{i}{j}" for i in range(3) for j in range(3)]


def _m(i: int, j: int) -> Column:
    return F.col(f"m{i % 3}{j % 3}")


def determinant() -> Column:
    return sum((_m(0, j) * (_m(1, j + 1) * _m(2, j + 2) - _m(1, j + 2) * _m(2, j + 1)) for j in range(3)), F.lit(0.0))


def with_inverse(frames: DataFrame) -> DataFrame:
    """Adds volume, the inverse w00 .. w22 and the interplanar spacings d0 .. d2; a cell without volume gets nulls."""
    out = once(frames, det=determinant()).withColumn("volume", F.abs("det"))
    for i in range(3):
        for j in range(3):
            cof = _m(j + 1, i + 1) * _m(j + 2, i + 2) - _m(j + 1, i + 2) * _m(j + 2, i + 1)
            out = out.withColumn(f"w{i}{j}", cof / F.nullif(F.col("det"), F.lit(0.0)))
    for k in range(3):
        out = out.withColumn(f"d{k}", 1.0 / F.sqrt(sum((F.col(f"w{i}{k}") * F.col(f"w{i}{k}") for i in range(3)), F.lit(0.0))))
    return out.drop("det")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns that are computed once a row: a one-row generator keeps the optimiser from repeating them in each use."""
    inner = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.explode(F.array(inner)).alias("__once")).select(*kept, *[F.col(f"__once.{name}").alias(name) for name in columns])


def fractional(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """atoms with fx, fy, fz and their frame's cell; atoms of frames without a cell drop out."""
    out = atoms.join(with_inverse(frames).where("volume > 0"), KEY)
    return once(out, **{f"f{x}": F.col("x") * F.col(f"w0{k}") + F.col("y") * F.col(f"w1{k}") + F.col("z") * F.col(f"w2{k}") for k, x in enumerate("xyz")})


def wrap(c: Column) -> Column:
    return c - F.floor(c)


def nearest_image(d: Column) -> Column:
    return d - F.floor(d + 0.5)


def cartesian(k: int, fx: str, fy: str, fz: str) -> Column:
    return F.col(fx) * F.col(f"m0{k}") + F.col(fy) * F.col(f"m1{k}") + F.col(fz) * F.col(f"m2{k}")
