"""Pair, angle, scattering and voxel statistics of single frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.elements import before, group_key
from ..functions.geometry import KEY, fractional, once, with_inverse, wrap
from .neighbors import pairs


def _steps(low: float, high: float, step: float) -> int:
    return int((high - low) / step)


def largest_radius(frames: DataFrame) -> DataFrame:
    """Half the smallest interplanar spacing by file: up to there, only one image of a neighbour is near."""
    return with_inverse(frames).groupBy("file").agg((F.min(F.least("d0", "d1", "d2")) / 2).alias("r_max"))


def conserved_counts(atoms: DataFrame, frames: DataFrame, by: str = "element") -> DataFrame:
    """file, type, n, n_all, n_frames; an error where a type's count changes between frames or a frame has no cell."""
    n_frames = with_inverse(frames).groupBy("file").agg(F.count("*").alias("n_frames"), F.count_if(F.coalesce(F.col("volume") > 0, F.lit(False))).alias("cells"))
    per = atoms.groupBy("file", "frame", group_key(by).alias("type")).agg(F.count("*").alias("k"))
    own = per.groupBy("file", "type").agg(F.min("k").alias("low"), F.max("k").alias("n"), F.count("*").alias("seen")).join(n_frames, "file")
    own = own.withColumn("n_all", F.sum("n").over(Window.partitionBy("file")))
    bad = (F.col("low") != F.col("n")) | (F.col("seen") != F.col("n_frames"))
    n = F.when(F.col("cells") < F.col("n_frames"), F.raise_error(F.lit("all frames must have a cell")).cast("long"))
    n = n.when(bad, F.raise_error(F.lit("the number of atoms of a type changes between frames")).cast("long")).otherwise(F.col("n"))
    return once(own, n=n).select("file", "type", "n", "n_all", "n_frames")


def radial_distribution(atoms: DataFrame, frames: DataFrame, r_min: float, r_max: float, dr: float, by: str = "element") -> DataFrame:
    """r, center, neighbor, count, gr, cn, rho_g per ordered pair of types and bin, over the frames of each file.

    g = ni * sum(count * V) / (4 pi r^2 dr N' N_A frames); cn is the running directed coordination number; rho_g is the mean of
    density times g, in which the volume cancels. r_max is cut to half the smallest interplanar spacing of a file's frames;
    a range without a bin, changing numbers of atoms and frames without a cell are errors.
    """
    n = conserved_counts(atoms, frames, by)
    limit = largest_radius(frames).select("file", F.floor((F.least(F.lit(r_max), "r_max") - r_min) / dr).alias("bins"))
    bins = F.when(F.col("bins") < 1, F.raise_error(F.lit("the range of r has no bin")).cast("long")).otherwise(F.col("bins"))
    limit = limit.select("file", bins.alias("bins"))
    typed = atoms.withColumn("element", group_key(by))
    p = pairs(typed, frames, r_max).withColumn("bin", F.floor((F.sqrt("d2") - r_min) / dr)).where("bin >= 0")
    lo, hi = F.least("el_a", "el_b"), F.greatest("el_a", "el_b")
    hist = p.groupBy("file", lo.alias("e1"), hi.alias("e2"), "bin").agg(F.count("*").alias("count"), F.sum("volume").alias("vsum"))
    grid = n.select("file", F.col("type").alias("center"), F.col("n").alias("na"), "n_all", "n_frames").join(n.select("file", F.col("type").alias("neighbor"), F.col("n").alias("nb")), "file").join(limit, "file")
    grid = grid.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1).cast("array<bigint>")))
    grid = grid.withColumn("e1", F.least("center", "neighbor")).withColumn("e2", F.greatest("center", "neighbor"))
    out = grid.join(hist, ["file", "e1", "e2", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0))).withColumn("vsum", F.coalesce("vsum", F.lit(0.0)))
    same = F.col("center") == F.col("neighbor")
    ni, npr = F.when(same, 2.0).otherwise(1.0), F.when(same, F.col("nb") - 1).otherwise(F.col("nb"))
    out = out.withColumn("r", F.lit(r_min) + (F.col("bin") + 0.5) * dr)
    shell = 4.0 * math.pi * F.col("r") * F.col("r") * dr * npr * F.col("na") * F.col("n_frames")
    over = lambda x: F.coalesce(x / F.nullif(shell, F.lit(0.0)), F.lit(0.0))
    out = out.withColumn("gr", over(ni * F.col("vsum"))).withColumn("rho_g", over(ni * F.col("n_all") * F.col("count")))
    run = Window.partitionBy("file", "center", "neighbor").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cn", F.sum(ni * F.col("count") / (F.col("na") * F.col("n_frames"))).over(run)).select("file", "bin", "r", "center", "neighbor", "count", "gr", "cn", "rho_g")


def number_density(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """file, n, rho = n <1/V>, v_mean, v_sd (population)."""
    n = atoms.groupBy("file", "frame").count().groupBy("file").agg(F.max("count").alias("n"))
    v = with_inverse(frames).groupBy("file").agg(F.avg(1.0 / F.col("volume")).alias("inv"), F.avg("volume").alias("v_mean"), F.stddev_pop("volume").alias("v_sd"))
    return n.join(v, "file").select("file", "n", (F.col("n") * F.col("inv")).alias("rho"), "v_mean", "v_sd")


def structure_factor(gr: DataFrame, density: DataFrame, dr: float, q_min: float, q_max: float, dq: float) -> DataFrame:
    """Partial S(q) = 1 + 4 pi / q * sum r (<rho g> - rho) sin(q r) dr, each pair of types once, by atomic number; density: file, rho."""
    n = _steps(q_min, q_max, dq) + 1
    half = gr.where(before(F.col("center"), F.col("neighbor"))).join(density.select("file", "rho"), "file")
    half = half.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("q", q_min + F.col("k") * dq)
    term = F.col("r") * (F.col("rho_g") - F.col("rho")) * F.sin(F.col("q") * F.col("r")) * dr
    s = half.groupBy("file", "center", "neighbor", "k", "q").agg(F.sum(term).alias("s"))
    return s.select("file", "center", "neighbor", "k", "q", F.when(F.abs("q") < 1e-10, 1.0).otherwise(1.0 + 4.0 * math.pi / F.col("q") * F.col("s")).alias("sq"))


def weighted_structure_factor(sq: DataFrame, counts: DataFrame, factors: DataFrame) -> DataFrame:
    """sq with part = w * sq and total = the parts' sum by q, for Faber-Ziman weights w = (2 - same) c_i c_j f_i f_j / <f>^2.

    counts: file, type, n, n_all (conserved_counts). factors: type and either b, a scattering length that doesn't depend on q, or
    a (array), s (array) and c of f(q) = sum a exp(-s (q / 4 pi)^2) + c. A type without factors counts 0; where <f> is 0, all
    weights are.
    """
    q = sq.select("file", "k", "q").distinct()
    own = counts.select("file", "type", (F.col("n") / F.col("n_all")).alias("conc")).join(factors, "type", "left")
    if "b" in factors.columns:
        f: Column = F.coalesce("b", F.lit(0.0))
    else:
        s2 = (F.col("q") / (4.0 * math.pi)) * (F.col("q") / (4.0 * math.pi))
        terms = F.zip_with("a", "s", lambda a, s: a * F.exp(-s * s2))
        f = F.coalesce(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) + F.col("c"), F.lit(0.0))
    each = q.join(own, "file").select("file", "k", "type", "conc", f.alias("f"))
    mean = each.groupBy("file", "k").agg(F.sum(F.col("conc") * F.col("f")).alias("mean"))
    side = lambda x, name: each.select("file", "k", F.col("type").alias(name), (F.col("conc") * F.col("f")).alias(x))
    out = sq.join(side("p", "center"), ["file", "k", "center"]).join(side("p2", "neighbor"), ["file", "k", "neighbor"]).join(mean, ["file", "k"])
    twice = F.when(F.col("center") == F.col("neighbor"), 1.0).otherwise(2.0)
    w = F.when(F.col("mean") * F.col("mean") < 1e-30, 0.0).otherwise(twice * F.col("p") * F.col("p2") / (F.col("mean") * F.col("mean")))
    out = out.withColumn("part", w * F.col("sq"))
    return out.withColumn("total", F.sum("part").over(Window.partitionBy("file", "k"))).select("file", "center", "neighbor", "k", "q", "sq", "part", "total")


def bond_angles(atoms: DataFrame, frames: DataFrame, r_ab: float, r_bc: float | None = None, width: float = 0.1, low: float = 0.0, high: float = 180.0, by: str = "element", ends: tuple[str, str] | None = None) -> DataFrame:
    """Counts of angles at each centre between two neighbours: file, end_a, center, end_c, bin, angle, count, p.

    Ends go by atomic number, then text. r_ab holds for the first end and r_bc for the other (ends may name them the other way
    round); ends of one type take the smaller. Angles beyond low or high drop out; high itself is in the last bin. p is the share
    among the triplet's angles.
    """
    r_bc = r_ab if r_bc is None else r_bc
    typed = atoms.withColumn("element", group_key(by))
    near = pairs(typed, frames, max(r_ab, r_bc), ordered=True).where("d2 > 0")
    arms = near.groupBy(*KEY, F.col("a").alias("c"), F.col("el_a").alias("center")).agg(F.collect_list(F.struct(F.col("b").alias("id"), F.col("el_b").alias("el"), "dx", "dy", "dz", "d2")).alias("arms"))
    both = arms.select("file", "center", F.explode("arms").alias("i"), "arms").select("file", "center", "i", F.explode("arms").alias("j")).where("i.id < j.id")
    first = before(F.col("i.el"), F.col("j.el"))
    both = once(both, lo=F.when(first, F.col("i")).otherwise(F.col("j")), hi=F.when(first, F.col("j")).otherwise(F.col("i")))
    least = min(r_ab, r_bc)
    same = F.col("lo.el") == F.col("hi.el")
    turned = (F.col("hi.el") == ends[0]) & (F.col("lo.el") == ends[1]) if ends else F.lit(False)
    cut_lo = F.when(same, least).when(turned, r_bc).otherwise(r_ab)
    cut_hi = F.when(same, least).when(turned, r_ab).otherwise(r_bc)
    both = both.where((F.col("lo.d2") < cut_lo * cut_lo) & (F.col("hi.d2") < cut_hi * cut_hi))
    dot = sum((F.col(f"lo.d{x}") * F.col(f"hi.d{x}") for x in "xyz"), F.lit(0.0))
    cos = dot / F.sqrt(F.col("lo.d2") * F.col("hi.d2"))
    both = once(both, at=F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))).where(F.col("at").between(low, high))
    last = math.ceil((high - low) / width) - 1
    out = both.groupBy("file", F.col("lo.el").alias("end_a"), "center", F.col("hi.el").alias("end_c"), F.least(F.floor((F.col("at") - low) / width), F.lit(last)).alias("bin")).agg(F.count("*").alias("count"))
    total = F.sum("count").over(Window.partitionBy("file", "end_a", "center", "end_c"))
    return out.select("file", "end_a", "center", "end_c", "bin", (low + (F.col("bin") + 0.5) * width).alias("angle"), "count", (F.col("count") / total).alias("p"))


def angle_statistics(angles: DataFrame) -> DataFrame:
    """Count, mean and population sd of each triplet's binned angles."""
    n = F.sum("count")
    own = angles.groupBy("file", "end_a", "center", "end_c").agg(n.alias("count"), (F.sum(F.col("angle") * F.col("count")) / n).alias("mean"))
    dev = angles.join(own.select("file", "end_a", "center", "end_c", "mean"), ["file", "end_a", "center", "end_c"]).groupBy("file", "end_a", "center", "end_c").agg(F.sqrt(F.sum((F.col("angle") - F.col("mean")) * (F.col("angle") - F.col("mean")) * F.col("count")) / n).alias("sd"))
    return own.join(dev, ["file", "end_a", "center", "end_c"])


def voxels(atoms: DataFrame, frames: DataFrame, shape: int | tuple[int, int, int]) -> DataFrame:
    """Atoms with their voxel ix, iy, iz."""
    n = (shape,) * 3 if isinstance(shape, int) else shape
    return fractional(atoms, frames).withColumns({f"i{x}": F.pmod(F.floor(wrap(F.col(f"f{x}")) * k), F.lit(k)) for x, k in zip("xyz", n, strict=True)})


def every_voxel(files: DataFrame, shape: int | tuple[int, int, int]) -> DataFrame:
    """files with a row for each voxel."""
    n = (shape,) * 3 if isinstance(shape, int) else shape
    for x, k in zip("xyz", n, strict=True):
        files = files.withColumn(f"i{x}", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    return files


def voxel_density(atoms: DataFrame, frames: DataFrame, shape: int | tuple[int, int, int], elements: list[str] | None = None) -> DataFrame:
    """All voxels: count, density = count / (frames * voxel volume of the first frame), mean speed and, with fx, fy, fz, mean force.

    Empty voxels count 0; so do mean speed and force where no atom there has them.
    """
    n = (shape,) * 3 if isinstance(shape, int) else shape
    if elements:
        atoms = atoms.where(F.col("element").isin(elements))
    forces = {"force_x", "force_y", "force_z"} <= set(atoms.columns)
    v0 = with_inverse(frames).groupBy("file").agg(F.min_by("volume", "frame").alias("v0"), F.countDistinct("frame").alias("nf"))
    size = lambda p: F.sqrt(sum((F.col(f"{p}{x}") * F.col(f"{p}{x}") for x in "xyz"), F.lit(0.0)))
    means = {"speed": size("v")} | ({"force": size("force_")} if forces else {})
    hits = voxels(atoms, frames, n).groupBy("file", "ix", "iy", "iz").agg(F.count("*").alias("count"), *[F.avg(c).alias(name) for name, c in means.items()])
    out = every_voxel(v0, n).join(hits, ["file", "ix", "iy", "iz"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    density = F.col("count") / (F.col("nf") * F.col("v0") / float(n[0] * n[1] * n[2]))
    return out.select("file", "ix", "iy", "iz", "count", density.alias("density"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in means])


def sphere_occupancy(atoms: DataFrame, frames: DataFrame, shape: int | tuple[int, int, int], radius: float, elements: list[str] | None = None) -> DataFrame:
    """Voxels whose centre lies within radius of an atom's nearest image: file, ix, iy, iz, count over atoms and frames.

    Each atom meets only the voxels of the box around its sphere; voxels without an atom count 0.
    """
    n = (shape,) * 3 if isinstance(shape, int) else shape
    if elements:
        atoms = atoms.where(F.col("element").isin(elements))
    f = fractional(atoms, frames)
    for k, x in enumerate("xyz"):
        reach = F.least(F.ceil(radius / F.col(f"d{k}") * n[k]) + 1, F.lit((n[k] + 1) // 2)).cast("int")
        f = once(f, **{f"i{x}": F.floor(wrap(F.col(f"f{x}")) * n[k])}).withColumn(f"o{x}", F.explode(F.sequence(-reach, reach)))
        f = f.withColumn(f"h{x}", (F.col(f"i{x}") + F.col(f"o{x}") + 0.5) / n[k] - wrap(F.col(f"f{x}")))
        f = f.withColumn(f"h{x}", F.col(f"h{x}") - F.floor(F.col(f"h{x}") + 0.5)).withColumn(f"i{x}", F.pmod(F.col(f"i{x}") + F.col(f"o{x}"), F.lit(n[k])).cast("long"))
    d = [F.col("hx") * F.col(f"m0{k}") + F.col("hy") * F.col(f"m1{k}") + F.col("hz") * F.col(f"m2{k}") for k in range(3)]
    f = once(f, d2=d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).where(F.col("d2") < radius * radius)
    hits = f.select("file", "frame", "aid", "ix", "iy", "iz").distinct().groupBy("file", "ix", "iy", "iz").agg(F.count("*").alias("count"))
    grid = every_voxel(frames.select("file").distinct(), n)
    return grid.join(hits, ["file", "ix", "iy", "iz"], "left").select("file", "ix", "iy", "iz", F.coalesce("count", F.lit(0)).alias("count"))


def mean_positions(atoms: DataFrame) -> DataFrame:
    """Each atom's raw position, averaged over the frames that have as many atoms as the first."""
    n = atoms.groupBy("file", "frame").agg(F.count("*").alias("k"))
    first = n.groupBy("file").agg(F.min_by("k", "frame").alias("k"))
    same = n.join(first, ["file", "k"]).select("file", "frame")
    return atoms.join(same, KEY).groupBy("file", "aid").agg(F.min_by("element", "frame").alias("element"), *[F.avg(x).alias(x) for x in "xyz"])
