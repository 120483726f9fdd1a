"""Making cells: sizes of supercells, joining two structures, formulas and box lengths; spin from electron counts."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.elements import NUMBER, WEIGHTS, atomic_number, mass_of
from ..functions.geometry import CELL, KEY, once, with_inverse

#: Atomic mass units per cubic Angstrom as g/cm3, and Avogadro's number.
AVOGADRO = 6.02214076e23
DENSITY = 1e24 / AVOGADRO


def row_length(i: int, prefix: str = "m"):
    return F.sqrt(sum((F.col(f"{prefix}{i}{j}") * F.col(f"{prefix}{i}{j}") for j in range(3)), F.lit(0.0)))


def supercell_size(lengths: tuple[float, float, float], n_atoms: int, min_length: float = 0.0, min_atoms: int = 0) -> tuple[int, int, int]:
    """Repeats along each axis: enough for min_length, then one more along the shortest (the first of equals) until there are min_atoms."""
    n = [max(1, math.ceil(min_length / x)) if min_length > 0 else 1 for x in lengths]
    while math.prod(n) * max(n_atoms, 1) < min_atoms:
        n[min(range(3), key=lambda i: n[i] * lengths[i])] += 1
    return n[0], n[1], n[2]


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame], axis: int, gap: float) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) with b put behind a along an axis (0 to 2), frame by frame of equal file and frame; frames in one only drop out.

    The cell is a's, lengthened along the axis to both and the gap and elsewhere to the longer one; b is centred across the
    other axes, along its own cell's directions. b's atoms are numbered after a's. A negative gap is an error.
    """
    if axis not in (0, 1, 2) or gap < 0:
        raise ValueError("axis is 0 to 2 and the gap 0 or more")
    (atoms_a, frames_a), (atoms_b, frames_b) = a, b
    other = frames_b.select(*KEY, *[F.col(c).alias(f"o{c[1:]}") for c in CELL])
    both = once(frames_a.join(other, KEY), **{f"la{i}": row_length(i) for i in range(3)}, **{f"lb{i}": row_length(i, "o") for i in range(3)})
    size = {i: F.col(f"la{i}") + gap + F.col(f"lb{i}") if i == axis else F.greatest(f"la{i}", f"lb{i}") for i in range(3)}
    by = [F.col(f"la{i}") + gap if i == axis else (size[i] - F.col(f"lb{i}")) / 2 for i in range(3)]
    both = once(both, **{f"t{j}": sum((F.col(f"o{i}{j}") / F.col(f"lb{i}") * by[i] for i in range(3)), F.lit(0.0)) for j in range(3)})
    n = atoms_a.groupBy(*KEY).agg(F.count("*").alias("__n"))
    moved = atoms_b.join(both.select(*KEY, "t0", "t1", "t2").join(n, KEY), KEY)
    moved = moved.withColumns({x: F.col(x) + F.col(f"t{j}") for j, x in enumerate("xyz")} | {"aid": F.col("aid") + F.col("__n")}).select(*atoms_b.columns)
    frames = both.withColumns({f"m{i}{j}": F.col(f"m{i}{j}") * (size[i] / F.col(f"la{i}")) for i in range(3) for j in range(3)})
    return atoms_a.join(both.select(*KEY), KEY, "left_semi").unionByName(moved, allowMissingColumns=True), frames.select(*frames_a.columns)


def parse_formula(formula: str) -> dict[str, int]:
    """Atoms by element of a formula with nested round or square brackets; a malformed one or a count of 0 is an error."""
    layers: list[tuple[str, dict[str, int]]] = [("", {})]
    at = 0
    while at < len(formula):
        m = re.compile(r"([A-Z][a-z]*)(\d*)|([(\[])|([)\]])(\d*)").match(formula, at)
        if not m:
            raise ValueError(f"unexpected {formula[at]!r} in {formula!r}")
        times = int(m[2] or m[5] or 1)
        if times == 0:
            raise ValueError(f"a count of 0 in {formula!r}")
        if m[1]:
            layers[-1][1][m[1]] = layers[-1][1].get(m[1], 0) + times
        elif m[3]:
            layers.append((m[3], {}))
        else:
            if len(layers) == 1 or layers[-1][0] + m[4] not in ("()", "[]") or not layers[-1][1]:
                raise ValueError(f"unmatched or empty brackets in {formula!r}")
            for e, k in layers.pop()[1].items():
                layers[-1][1][e] = layers[-1][1].get(e, 0) + k * times
        at = m.end()
    if len(layers) > 1 or not layers[0][1]:
        raise ValueError(f"brackets left open or no element in {formula!r}")
    return layers[0][1]


def box_length(components: list[tuple[str, int]], density: float) -> float:
    """Edge in Angstrom of the cube that holds so many formula units at a density in g/cm3."""
    if density <= 0:
        raise ValueError("the density must be positive")
    mass = sum(n * sum(WEIGHTS[e] * k for e, k in parse_formula(f).items()) for f, n in components)
    if not mass:
        raise ValueError("no molecules")
    return (mass / (density * AVOGADRO) * 1e24) ** (1 / 3)


def frame_info(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """First and last frame of each file: n, composition, cell lengths and angles, volume, density in g/cm3 and atoms of unknown mass."""
    edge = atoms.groupBy("file").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    own = atoms.join(edge, "file").where("frame = lo or frame = hi")
    mass = mass_of(F.col("element"))
    per = own.groupBy(*KEY, "element").agg(F.count("*").alias("k"), F.sum(mass).alias("mass"))
    unknown = F.when(~F.col("element").isin(list(WEIGHTS)), F.col("k")).otherwise(F.lit(0))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("element", "k"))), lambda x: F.concat(x["element"], F.lit(": "), x["k"].cast("string"))), ", ")
    per = per.groupBy(*KEY).agg(F.sum("k").alias("n"), parts.alias("composition"), F.sum("mass").alias("mass"), F.sum(unknown).alias("unknown"))
    cell = once(with_inverse(frames), **{f"l{i}": row_length(i) for i in range(3)})
    dot = lambda i, j: sum((F.col(f"m{i}{k}") * F.col(f"m{j}{k}") for k in range(3)), F.lit(0.0)) / F.nullif(F.col(f"l{i}") * F.col(f"l{j}"), F.lit(0.0))
    angle = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(i, j)))))
    cell = cell.select(*KEY, F.col("l0").alias("a"), F.col("l1").alias("b"), F.col("l2").alias("c"), angle(1, 2).alias("alpha"), angle(0, 2).alias("beta"), angle(0, 1).alias("gamma"), "volume")
    return per.join(cell, KEY, "left").select(*KEY, "n", "composition", "a", "b", "c", "alpha", "beta", "gamma", "volume", (F.col("mass") / F.nullif(F.col("volume"), F.lit(0.0)) * DENSITY).alias("density"), "unknown")


def electron_counts(atoms: DataFrame, charge: int = 0) -> DataFrame:
    """file, frame, electrons (sum of Z less the charge) and multiplicity: 2 for an odd number, else 1. An unknown element counts 0."""
    z = atomic_number(F.col("element"))
    per = atoms.groupBy(*KEY).agg((F.sum(F.when(z < 255, z).otherwise(F.lit(0))) - charge).alias("electrons"))
    return per.withColumn("multiplicity", F.when(F.pmod("electrons", F.lit(2)) == 1, 2).otherwise(1))


def oxidation_states(counts: DataFrame, states: DataFrame, charge: int = 0) -> DataFrame:
    """file, element, state: the anion is the most electronegative element with a negative state and takes its lowest; the others' positive states must balance it.

    counts: file, element, n. states: element, electronegativity, state, one row a state. Of several solutions the one with the
    largest sum, then the smallest states in order of the elements, holds; a file without a solution or with one element has no
    rows. Choices are spread by one join per distinct element, on the file.
    """
    own = counts.join(states, "element")
    low = own.groupBy("file", "element", "n", "electronegativity").agg(F.min("state").alias("state")).where("state < 0 and electronegativity is not null")
    anion = low.groupBy("file").agg(F.max_by(F.struct("element", "n", "state"), F.struct("electronegativity", "element")).alias("an"))
    kinds = counts.groupBy("file").agg(F.count("*").alias("kinds")).where("kinds > 1")
    rest = own.join(anion, "file").where(F.col("element") != F.col("an.element")).where("state > 0").groupBy("file", "element", "n").agg(F.sort_array(F.collect_set("state")).alias("choices"))
    rest = rest.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("element", "n", "choices"))).alias("cations")).join(anion, "file").join(kinds, "file").where(F.size("cations") == F.col("kinds") - 1)
    # each cation in turn multiplies the list of assignments (sum of charges so far, states chosen)
    start = F.array(F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("chosen")))
    step = lambda acc, c: F.flatten(F.transform(acc, lambda a: F.transform(c["choices"], lambda s: F.struct((a["sum"] + s * c["n"]).cast("long").alias("sum"), F.concat(a["chosen"], F.array(s.cast("int"))).alias("chosen")))))
    found = rest.withColumn("all", F.aggregate("cations", start, step))
    target = F.lit(charge) - F.col("an.n") * F.col("an.state")
    found = found.withColumn("one", F.array_min(F.filter("all", lambda a: a["sum"] == target))).where("one is not null")
    cations = F.zip_with("cations", "one.chosen", lambda c, s: F.struct(c["element"].alias("element"), s.alias("state")))
    return found.select("file", F.explode(F.concat(cations, F.array(F.struct(F.col("an.element").alias("element"), F.col("an.state").cast("int").alias("state"))))).alias("x")).select("file", "x.element", "x.state")


#: The atomic numbers that close a period.
NOBLE = (2, 10, 18, 36, 54, 86)


def group_of(z: int) -> int | None:
    """Group 1 to 18 of the periodic table; lanthanum is in group 3, the other lanthanides and what follows radon in none."""
    if z == 2 or not 1 <= z <= NOBLE[-1]:
        return 18 if z == 2 else None
    last = max((n for n in NOBLE if n < z), default=0)
    place, size = z - last, next(n for n in NOBLE if n >= z) - last
    if place <= 2 or size == 18:
        return place
    if size == 32:
        return 3 if place == 3 else place - 14 if place > 17 else None
    return place + 10


def unpaired_electrons(z: int, state: int) -> int:
    """Unpaired electrons of an ion by Hund's rule: d electrons of a transition metal at high spin, s and p electrons of the others."""
    group = group_of(z)
    if group is None:
        valence = 0
    else:
        valence = group - 10 if group >= 13 else group
    if group is not None and 3 <= group <= 12 and z >= 21:
        electrons, orbitals = min(max(group - state, 0), 10), 5
    else:
        left = (valence - state) % 8
        if left <= 2:
            return left % 2
        electrons, orbitals = left - 2, 3
    return electrons if electrons <= orbitals else 2 * orbitals - electrons


def spin_guess(atoms: DataFrame, states: DataFrame, charge: int = 0) -> DataFrame:
    """file, n_unpaired, multiplicity and method of each file's first frame: from magmom where atoms have it, else from oxidation states, else by parity.

    A number that doesn't fit the parity of the electrons gives way to the least that does. states: see oxidation_states.
    """
    first = atoms.groupBy("file").agg(F.min("frame").alias("frame"))
    own = atoms.join(first, KEY)
    electrons = electron_counts(own, charge).select("file", F.pmod("electrons", F.lit(2)).alias("odd"))
    counts = own.groupBy("file", "element").agg(F.count("*").alias("n"))
    known = oxidation_states(counts, states, charge).join(counts, ["file", "element"])
    kinds = [(e, int(s)) for e, s in states.select("element", "state").distinct().collect()]  # a row for each element and state
    hund = F.coalesce(*[F.when((F.col("element") == e) & (F.col("state") == s), F.lit(unpaired_electrons(NUMBER.get(e, 0), s))) for e, s in kinds], F.lit(0))
    by_state = known.groupBy("file").agg(F.sum(hund * F.col("n")).alias("by_state"))
    moment = F.abs(F.sum("magmom")) if "magmom" in atoms.columns else F.lit(None).cast("double")
    by_moment = own.groupBy("file").agg(F.round(moment).cast("long").alias("by_moment"))
    out = electrons.join(by_state, "file", "left").join(by_moment, "file", "left").withColumn("n", F.coalesce("by_moment", "by_state", "odd"))
    method = F.when(F.col("by_moment").isNotNull(), "magmom").when(F.col("by_state").isNotNull(), "oxidation").otherwise("parity")
    n = F.when(F.col("n") % 2 == F.col("odd"), F.col("n")).otherwise(F.col("odd"))
    return out.select("file", n.cast("long").alias("n_unpaired"), (n + 1).cast("long").alias("multiplicity"), method.alias("method"))
