"""Choosing frames and atoms, replicating and merging cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import SYMBOLS
from ..functions.geometry import CELL, cartesian, fractional, wrap


def select_frames(rows: DataFrame, start: int = 0, end: int | None = None, stride: int = 1) -> DataFrame:
    """Frames from start to end, both included; a stride of 0 is 1."""
    out = rows.where((F.col("frame") >= start) & ((F.col("frame") - start) % max(1, stride) == 0))
    return out if end is None else out.where(F.col("frame") <= end)


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n frames of each file."""
    last = rows.groupBy("file").agg(F.max("frame").alias("last"))
    return rows.join(last, "file").where(F.col("frame") > F.col("last") - n).drop("last")


def spread(n_frames: int, count: int) -> list[int]:
    """count frame numbers from the first to the last, evenly; all if there are no more."""
    if count >= n_frames:
        return list(range(n_frames))
    return [0] if count == 1 else [int(i * (n_frames - 1) / (count - 1) + 0.5) for i in range(count)]


def of_elements(atoms: DataFrame, elements: list[str]) -> DataFrame:
    """Atoms whose element in frame 0 is wanted, in all frames."""
    return atoms.join(atoms.where((F.col("frame") == 0) & F.col("element").isin(elements)).select("file", "aid"), ["file", "aid"], "left_semi")


def split_label(label: str = "label") -> tuple:
    """(element part, site part) of a label cut at its first underscore; the site part is null without one."""
    c = F.col(label)
    return F.substring_index(c, "_", 1), F.when(F.instr(c, "_") > 0, F.expr(f"substring({label}, instr({label}, '_') + 1)"))


def supercell(atoms: DataFrame, frames: DataFrame, nx: int, ny: int, nz: int) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) replicated; replica numbers go with x fastest, aid = replica * n + aid."""
    n = atoms.groupBy("file", "frame").agg(F.count("*").alias("n"))
    out = atoms.join(n, ["file", "frame"]).join(frames.select("file", "frame", *CELL), ["file", "frame"])
    out = out.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1))))
    i, j, k = F.col("r") % nx, F.floor(F.col("r") / nx) % ny, F.floor(F.col("r") / (nx * ny))
    for c, x in enumerate("xyz"):
        out = out.withColumn(x, F.col(x) + i * F.col(f"m0{c}") + j * F.col(f"m1{c}") + k * F.col(f"m2{c}"))
    out = out.withColumn("aid", F.col("r") * F.col("n") + F.col("aid"))
    grown = frames
    for row, times in enumerate((nx, ny, nz)):
        for c in range(3):
            grown = grown.withColumn(f"m{row}{c}", F.col(f"m{row}{c}") * times)
    return out.select(*atoms.columns), grown


def vacuum(frames: DataFrame, axis: int, thickness: float) -> DataFrame:
    """Lengthens one cell vector by thickness along itself."""
    length = F.sqrt(sum((F.col(f"m{axis}{c}") * F.col(f"m{axis}{c}") for c in range(3)), F.lit(0.0)))
    out = frames.withColumn("scale", (length + thickness) / length)
    for c in range(3):
        out = out.withColumn(f"m{axis}{c}", F.col(f"m{axis}{c}") * F.col("scale"))
    return out.drop("scale")


def centered(atoms: DataFrame, masses: DataFrame) -> DataFrame:
    """Atoms with their frame's centre of mass at the origin; masses: element, mass (1 if unknown)."""
    m = atoms.join(masses, "element", "left").withColumn("__m", F.coalesce("mass", F.lit(1.0))).drop("mass")
    com = m.groupBy("file", "frame").agg(*[(F.sum(F.col("__m") * F.col(x)) / F.sum("__m")).alias(f"__{x}") for x in "xyz"])
    return atoms.join(com, ["file", "frame"]).withColumns({x: F.col(x) - F.col(f"__{x}") for x in "xyz"}).select(*atoms.columns)


def translated(atoms: DataFrame, by: tuple[float, float, float]) -> DataFrame:
    return atoms.withColumns({x: F.col(x) + d for x, d in zip("xyz", by, strict=True)})


def wrapped(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """Atoms folded into their frame's cell; those of a frame without a cell drop out."""
    f = fractional(atoms, frames).withColumns({f"f{x}": wrap(F.col(f"f{x}")) for x in "xyz"})
    return f.withColumns({x: cartesian(k, "fx", "fy", "fz") for k, x in enumerate("xyz")}).select(*atoms.columns)


def typed_labels(names: DataFrame, name: str = "name") -> DataFrame:
    """names with kind, element and label: a name cut at its first underscore is split if an element stands before it, else unknown; others are plain."""
    head = F.substring_index(F.col(name), "_", 1)
    cut = F.instr(F.col(name), "_") > 0
    known = head.isin(SYMBOLS)
    kind = F.when(~cut, "plain").when(known, "split").otherwise("unknown")
    return names.withColumns({"kind": kind, "element": F.when(cut & known, head).otherwise(F.col(name)), "label": F.when(cut & known, F.col(name))})


def fold_labels(atoms: DataFrame) -> DataFrame:
    """Labels in place of elements, where they start with the element and an underscore (as a dump has no other place for them)."""
    fits = F.col("label").startswith(F.concat("element", F.lit("_")))
    return atoms.withColumn("element", F.when(fits, F.col("label")).otherwise(F.col("element")))
