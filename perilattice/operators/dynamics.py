"""Time correlations: unwrapping, displacement, velocity and orientation statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import CELL, fractional, nearest_image, once, wrap
from .neighbors import pairs


def unwrap(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """Fractional coordinates followed across the cell's faces: ux, uy, uz, with the frame's cell."""
    w = Window.partitionBy("file", "aid").orderBy("frame")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = fractional(atoms, frames)
    for x in "xyz":
        out = out.withColumn(f"s{x}", F.coalesce(nearest_image(F.col(f"f{x}") - F.lag(f"f{x}").over(w)), F.lit(0.0)))
    for x in "xyz":
        out = out.withColumn(f"u{x}", F.first(f"f{x}").over(run) + F.sum(f"s{x}").over(run))
    return out


def lagged(rows: DataFrame, columns: list[str], lags: int, shift: int = 1, n: DataFrame | None = None) -> DataFrame:
    """Origins o_* (frame divisible by shift, followed by `lags` frames) beside later frames e_* of the same atom, by lag 0 .. lags - 1.

    Frames are cut into spans of `lags`; an origin meets its own span and the next, so a row is written twice, not once a lag.
    n: file and its number of frames, where rows leave frames out.
    """
    last = n if n is not None else rows.groupBy("file").agg((F.max("frame") + 1).alias("n"))
    span = F.floor(F.col("frame") / lags)
    o = rows.join(last, "file").where((F.col("frame") % shift == 0) & (F.col("frame") + lags <= F.col("n")))
    o = o.select("file", "aid", F.col("frame").alias("o_frame"), *[F.col(c).alias(f"o_{c}") for c in columns], F.explode(F.array(span, span + 1)).alias("span"))
    e = rows.select("file", "aid", F.col("frame").alias("e_frame"), *[F.col(c).alias(f"e_{c}") for c in columns], span.alias("span"))
    both = o.join(e, ["file", "aid", "span"]).withColumn("lag", (F.col("e_frame") - F.col("o_frame")).cast("int"))
    return both.where((F.col("lag") >= 0) & (F.col("lag") < lags))


def mean_squared_displacement(atoms: DataFrame, frames: DataFrame | None, lags: int, shift: int = 1, dt: float = 1.0) -> DataFrame:
    """file, lag, time, msd, msd_a, msd_b, msd_c: unwrapped displacement by the mean of both frames' cells, over atoms and origins.

    The directional parts are along the cell's vectors, by their length in the later frame. Without frames the positions are
    not periodic: plain differences, and the directions are x, y, z.
    """
    if frames is None:
        both = lagged(atoms, ["x", "y", "z"], lags, shift)
        parts = along = [(F.col(f"e_{x}") - F.col(f"o_{x}")) * (F.col(f"e_{x}") - F.col(f"o_{x}")) for x in "xyz"]
    else:
        both = lagged(unwrap(atoms, frames), ["ux", "uy", "uz", *CELL], lags, shift)
        both = once(both, **{f"g{x}": F.col(f"e_u{x}") - F.col(f"o_u{x}") for x in "xyz"})
        parts = []
        for k in range(3):
            c = sum((F.col(f"g{x}") * (F.col(f"o_m{i}{k}") + F.col(f"e_m{i}{k}")) * 0.5 for i, x in enumerate("xyz")), F.lit(0.0))
            parts.append(c * c)
        along = [F.col(f"g{x}") * F.col(f"g{x}") * sum((F.col(f"e_m{i}{k}") * F.col(f"e_m{i}{k}") for k in range(3)), F.lit(0.0)) for i, x in enumerate("xyz")]
    out = both.groupBy("file", "lag").agg(F.avg(parts[0] + parts[1] + parts[2]).alias("msd"), *[F.avg(c).alias(f"msd_{x}") for c, x in zip(along, "abc", strict=True)])
    return out.select("file", "lag", (F.col("lag") * dt).alias("time"), "msd", "msd_a", "msd_b", "msd_c")


def all_lags_displacement(atoms: DataFrame) -> DataFrame:
    """file, lag, msd over every lag and origin, without periodicity."""
    o = atoms.select("file", "aid", F.col("frame").alias("f0"), *[F.col(x).alias(f"{x}0") for x in "xyz"])
    d2 = sum(((F.col(x) - F.col(f"{x}0")) * (F.col(x) - F.col(f"{x}0")) for x in "xyz"), F.lit(0.0))
    both = atoms.join(o, ["file", "aid"]).where("frame >= f0")
    return both.groupBy("file", (F.col("frame") - F.col("f0")).alias("lag")).agg(F.avg(d2).alias("msd"))


def diffusion(msd: DataFrame, first: float, last: float) -> DataFrame:
    """Least squares over the lags from first to last (fractions of the range): file, d = slope / 6, intercept, r2, n.

    A flat curve has an r2 of 1. A range outside 0 <= first < last <= 1 is an error, and so are fewer than two points.
    """
    if not 0.0 <= first < last <= 1.0:
        raise ValueError("the range must be 0 <= first < last <= 1")
    size = msd.groupBy("file").agg(F.count("*").alias("size"))
    edge = lambda f: F.floor(f * (F.col("size") - 1) + 0.5)
    used = msd.join(size, "file").where((F.col("lag") >= edge(first)) & (F.col("lag") <= edge(last)))
    fit = used.groupBy("file").agg(F.regr_slope("msd", "time").alias("slope"), F.regr_intercept("msd", "time").alias("intercept"), F.regr_r2("msd", "time").alias("r2"), F.regr_syy("msd", "time").alias("syy"), F.count("*").alias("n"))
    slope = F.when(F.col("n") < 2, F.raise_error(F.lit("a fit needs two points")).cast("double")).otherwise(F.col("slope"))
    return fit.select("file", (slope / 6).alias("d"), "intercept", F.when(F.col("syy") < 2.220446049250313e-16, 1.0).otherwise(F.col("r2")).alias("r2"), "n")


def velocity_autocorrelation(atoms: DataFrame, lags: int, shift: int = 1, dt: float = 1.0) -> DataFrame:
    """file, lag, vacf with its parts vacf_x, vacf_y, vacf_z, and the running diffusion sum(vacf) dt / 3."""
    both = lagged(atoms, ["vx", "vy", "vz"], lags, shift)
    own = [F.avg(F.col(f"o_v{x}") * F.col(f"e_v{x}")).alias(f"vacf_{x}") for x in "xyz"]
    v = both.groupBy("file", "lag").agg(F.avg(sum((F.col(f"o_v{x}") * F.col(f"e_v{x}") for x in "xyz"), F.lit(0.0))).alias("vacf"), *own)
    run = Window.partitionBy("file").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumn("diffusion", F.sum("vacf").over(run) * dt / 3)


def _squared(names: list[str]) -> Column:
    return sum((F.col(n) * F.col(n) for n in names), F.lit(0.0))


def van_hove(atoms: DataFrame, frames: DataFrame, tau: int, r_max: float, dr: float, r_min: float = 0.0, shift: int = 1, elements: list[str] | None = None) -> DataFrame:
    """Self part at a fixed lag: file, bin, r, count and gs = count / (origins * atoms), for every bin from r_min to r_max.

    Positions are the unwrapped ones in each frame's own cell. There are ceil((r_max - r_min) / dr) bins; displacements outside
    r_min <= r < r_max drop out. Origins are the frames divisible by shift that a frame at tau follows. elements are those of the
    first frame.
    """
    if elements:
        atoms = atoms.join(atoms.where(F.col("element").isin(elements) & (F.col("frame") == 0)).select("file", "aid"), ["file", "aid"], "left_semi")
    w = Window.partitionBy("file", "aid").orderBy("frame")
    out = unwrap(atoms, frames)
    out = once(out, **{f"c{x}": sum((F.col(f"u{y}") * F.col(f"m{i}{k}") for i, y in enumerate("xyz")), F.lit(0.0)) for k, x in enumerate("xyz")})
    for x in "xyz":
        out = out.withColumn(f"r{x}", F.lead(f"c{x}", tau).over(w) - F.col(f"c{x}"))
    moved = once(out.where(F.col("rx").isNotNull() & (F.col("frame") % shift == 0)), r=F.sqrt(_squared(["rx", "ry", "rz"])))
    total = moved.groupBy("file").agg(F.count("*").alias("total"))
    bins = math.ceil((r_max - r_min) / dr)
    inside = moved.where((F.col("r") >= r_min) & (F.col("r") < r_max)).withColumn("bin", F.floor((F.col("r") - r_min) / dr))
    h = inside.groupBy("file", "bin").agg(F.count("*").alias("count"))
    grid = total.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")))
    out = grid.join(h, ["file", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("file", "bin", (r_min + (F.col("bin") + 0.5) * dr).alias("r"), "count", (F.col("count") / F.col("total")).alias("gs"))


def jumps(atoms: DataFrame, frames: DataFrame, tau: int, threshold: float, shape: int | tuple[int, int, int], record_at: str = "start") -> DataFrame:
    """Displacements of at least threshold at lag tau by the mean of both frames' cells, counted in the voxel of the wrapped start, end or midpoint."""
    n = (shape,) * 3 if isinstance(shape, int) else shape
    w = Window.partitionBy("file", "aid").orderBy("frame")
    out = unwrap(atoms, frames)
    ahead = out.withColumns({f"e_{c}": F.lead(c, tau).over(w) for c in ("ux", "uy", "uz", *CELL)}).where("e_ux is not null")
    moved = [sum(((F.col(f"e_u{y}") - F.col(f"u{y}")) * (F.col(f"m{i}{k}") + F.col(f"e_m{i}{k}")) * 0.5 for i, y in enumerate("xyz")), F.lit(0.0)) for k in range(3)]
    hit = once(ahead, d2=moved[0] * moved[0] + moved[1] * moved[1] + moved[2] * moved[2]).where(F.col("d2") >= threshold * threshold)
    at = {"start": lambda x: F.col(f"u{x}"), "end": lambda x: F.col(f"e_u{x}"), "midpoint": lambda x: (F.col(f"u{x}") + F.col(f"e_u{x}")) * 0.5}[record_at]
    return hit.groupBy("file", *[F.pmod(F.floor(wrap(at(x)) * k), F.lit(k)).alias(f"i{x}") for x, k in zip("xyz", n, strict=True)]).agg(F.count("*").alias("count"))


def rotational_correlation(atoms: DataFrame, frames: DataFrame, center: str, neighbor: str, rcut: float, lags: int, shift: int = 1, dt: float = 1.0) -> DataFrame:
    """file, lag, c2 = <(3 cos^2 - 1) / 2> of the summed bond vectors of each centre, and its running integral.

    Means are over the centres that have bonds in both frames, then over all origins; an origin without any counts 0.
    """
    u = pairs(atoms, frames, rcut, sides=([center], [neighbor]))
    u = u.groupBy("file", "frame", F.col("a").alias("aid")).agg(*[F.sum(f"d{x}").alias(f"u{x}") for x in "xyz"])
    u = once(u, n2=_squared(["ux", "uy", "uz"])).where("n2 >= 1e-30")
    n = atoms.groupBy("file").agg((F.max("frame") + 1).alias("n"))
    both = lagged(u, ["ux", "uy", "uz", "n2"], lags, shift, n)
    dot = sum((F.col(f"o_u{x}") * F.col(f"e_u{x}") for x in "xyz"), F.lit(0.0))
    own = both.groupBy("file", "o_frame", "lag").agg(F.avg(1.5 * dot * dot / (F.col("o_n2") * F.col("e_n2")) - 0.5).alias("c")).groupBy("file", "lag").agg(F.sum("c").alias("s"))
    grid = n.withColumn("origins", F.floor((F.col("n") - lags) / shift) + 1).where("origins > 0").withColumn("lag", F.explode(F.sequence(F.lit(0), F.lit(lags - 1))))
    out = grid.join(own, ["file", "lag"], "left").select("file", "lag", (F.coalesce("s", F.lit(0.0)) / F.col("origins")).alias("c2"))
    run = Window.partitionBy("file").orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("integral", F.sum("c2").over(run) * dt)


def shape(atoms: DataFrame, masses: DataFrame) -> DataFrame:
    """Per frame: mass, centre of mass, radius of gyration and box of the atoms; masses: element, mass (1 if unknown)."""
    m = atoms.join(masses, "element", "left").withColumn("mass", F.coalesce("mass", F.lit(1.0)))
    w = m.groupBy("file", "frame").agg(
        F.sum("mass").alias("mass"), *[(F.sum(F.col("mass") * F.col(x)) / F.sum("mass")).alias(f"com_{x}") for x in "xyz"],
        (F.sum(F.col("mass") * _squared(["x", "y", "z"])) / F.sum("mass")).alias("second"),
        *[(F.max(x) - F.min(x)).alias(f"size_{x}") for x in "xyz"],
    )
    return w.withColumn("rg", F.sqrt(F.greatest(F.lit(0.0), F.col("second") - _squared(["com_x", "com_y", "com_z"])))).drop("second")


def rmsd(atoms: DataFrame) -> DataFrame:
    """Root mean square distance of each frame to frame 0, without alignment or periodicity."""
    first = atoms.where("frame = 0").select("file", "aid", *[F.col(x).alias(f"{x}0") for x in "xyz"])
    d2 = sum(((F.col(x) - F.col(f"{x}0")) * (F.col(x) - F.col(f"{x}0")) for x in "xyz"), F.lit(0.0))
    return atoms.join(first, ["file", "aid"]).groupBy("file", "frame").agg(F.sqrt(F.avg(d2)).alias("rmsd"))


def internal_coordinates(atoms: DataFrame, i: int, j: int, k: int, m: int) -> DataFrame:
    """file, frame, distance i-j, angle i-j-k and dihedral i-j-k-m in degrees, without periodicity; null where atoms lack or fall together."""
    at = lambda a, x: F.max(F.when(F.col("aid") == a, F.col(x)))
    p = atoms.where(F.col("aid").isin(i, j, k, m)).groupBy("file", "frame").agg(*[at(a, x).alias(f"p{n}{x}") for n, a in enumerate((i, j, k, m)) for x in "xyz"])
    diff = lambda a, b: [F.col(f"p{b}{x}") - F.col(f"p{a}{x}") for x in "xyz"]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    b1, b2, b3 = diff(0, 1), diff(1, 2), diff(2, 3)
    back = diff(1, 0)
    cos = dot(back, b2) / F.nullif(F.sqrt(dot(back, back) * dot(b2, b2)), F.lit(0.0))
    n1, n2 = cross(b1, b2), cross(b2, b3)
    m1 = cross(n1, b2)
    turn = F.atan2(dot(m1, n2) / F.nullif(F.sqrt(dot(b2, b2)), F.lit(0.0)), dot(n1, n2))
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))
    return p.select("file", "frame", F.sqrt(dot(b1, b1)).alias("distance"), F.when(cos.isNotNull(), angle).alias("angle"), F.degrees(turn).alias("dihedral"))
