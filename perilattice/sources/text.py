"""Readers of text structures and trajectories.

A reader gives one row per atom: file, frame, aid, element, label, x, y, z, velocities, forces, charge, the frame's cell m00 .. m22 (null
without one), energy and comment; `trajectory` parts them into atoms and frames. LAMMPS dumps are cut into frames by Spark's own text
reader, so that a long file goes to many tasks, and parsed by column expressions. The other formats are read line by line, a task for
each file, and handed on in batches, so that no file has to fit in memory.
"""

from __future__ import annotations

import glob
import math
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.elements import NUMBER, WEIGHTS
from ..functions.geometry import CELL
from ..functions.units import UNITS, factor

COLUMNS = ["file", "frame", "aid", "element", "label", "x", "y", "z", "vx", "vy", "vz", "force_x", "force_y", "force_z", "charge", *CELL, "energy", "comment"]
_TEXT, _LONG = {"file", "element", "label", "comment"}, {"frame", "aid"}
SCHEMA = ", ".join(f"{c} {'string' if c in _TEXT else 'long' if c in _LONG else 'double'}" for c in COLUMNS)
_ARROW = pa.schema([(c, pa.string() if c in _TEXT else pa.int64() if c in _LONG else pa.float64()) for c in COLUMNS])
BATCH = 20_000
BOHR = UNITS["length"]["bohr"]


def trajectory(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms, frames) of a reader's rows; frames without a cell are left out."""
    frames = rows.where("m00 is not null").select("file", "frame", *CELL).distinct()
    return rows.drop(*CELL, "energy", "comment"), frames


def expand(patterns: list[str]) -> list[str]:
    """Paths of glob patterns in order, each file once; a pattern without a match is an error. Paths with a scheme are left to Spark."""
    out: dict[str, str] = {}
    for p in patterns:
        found = [p] if "://" in p else sorted(glob.glob(p)) if glob.has_magic(p) else [p] if os.path.exists(p) else []
        if not found:
            raise FileNotFoundError(p)
        for f in found:
            out.setdefault(f if "://" in f else os.path.realpath(f), f)
    return list(out.values())


def load(spark: SparkSession, patterns: str | list[str], units: str = "real") -> DataFrame:
    """Rows of files by the format that their names tell."""
    paths = expand([patterns] if isinstance(patterns, str) else patterns)
    by: dict[str, list[str]] = {}
    for p in paths:
        by.setdefault(format_of(p), []).append(p)
    parts = [read_lammps_dump(spark, ps, units) if f == "dump" else read_lines(spark, ps, PARSERS[f]) for f, ps in by.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def format_of(path: str) -> str:
    """Format by file name: POSCAR and CONTCAR by prefix in any case, others by extension."""
    name = path.rsplit("/", 1)[-1]
    if name.upper().startswith(("POSCAR", "CONTCAR")):
        return "poscar"
    known = {"xyz": "extxyz", "extxyz": "extxyz", "pdb": "pdb", "cif": "cif", "vasp": "poscar", "poscar": "poscar", "data": "lammps_data", "lmp": "lammps_data", "dump": "dump", "lammpstrj": "dump", "inp": "cp2k", "restart": "cp2k", "in": "qe", "pwi": "qe"}
    end = name.rsplit(".", 1)[-1] if "." in name else ""
    if end not in known:
        raise ValueError(f"no reader for {path}")
    return known[end]


def read_lines(spark: SparkSession, paths: str | list[str], parse: Callable[[Iterator[str]], Iterator[dict]]) -> DataFrame:
    """Rows of files by a parser of lines, a task for each file."""
    names = spark.read.format("binaryFile").load(paths).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^(\w+):/*", r"\1:///", path))
                held: list[dict] = []
                with store.open_input_stream(inner) as f:
                    for row in parse(_lines(f)):
                        held.append(row | {"file": path})
                        if len(held) >= BATCH:
                            yield _batch(held)
                            held = []
                if held:
                    yield _batch(held)

    return names.repartition(max(1, len(paths) if isinstance(paths, list) else 1)).mapInArrow(run, SCHEMA)


def _lines(f: pa.NativeFile) -> Iterator[str]:
    rest = b""
    while chunk := f.read(1 << 20):
        *full, rest = (rest + chunk).split(b"\n")
        yield from (x.decode("utf-8", "replace").rstrip("\r") for x in full)
    if rest:
        yield rest.decode("utf-8", "replace")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _cell(m: list[float] | None) -> dict:
    return dict(zip(CELL, m, strict=True)) if m else {}


def cell_of(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> list[float]:
    """Rows of the cell with these lengths and angles in degrees: a along x, b in the xy plane."""
    ca, cb, cg = (math.cos(math.radians(x)) if x != 90 else 0.0 for x in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma)) if gamma != 90 else 1.0
    cy = (ca - cb * cg) / sg
    return [a, 0.0, 0.0, b * cg, b * sg, 0.0, c * cb, c * cy, c * math.sqrt(max(0.0, 1 - cb * cb - cy * cy))]


def cartesian(f: list[float], m: list[float]) -> list[float]:
    return [sum(f[i] * m[3 * i + k] for i in range(3)) for k in range(3)]


def _element(name: str) -> str:
    """The element that a site's letters name: all of them, the first two or the first one."""
    return next((c.capitalize() for c in (name, name[:2], name[:1]) if c.capitalize() in NUMBER), name)


# --- XYZ and extended XYZ ----------------------------------------------------------------------------------------------

_PAIR = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|\S+)")
#: Names of extended XYZ columns, and how many columns of ours each fills.
_FIELDS = {
    "species": ["element"], "element": ["element"], "pos": ["x", "y", "z"], "velocities": ["vx", "vy", "vz"], "momenta": ["px", "py", "pz"], "velo": ["vx", "vy", "vz"],
    "forces": ["force_x", "force_y", "force_z"], "force": ["force_x", "force_y", "force_z"], "charges": ["charge"], "charge": ["charge"], "label": ["label"],
}


def parse_extxyz(lines: Iterator[str]) -> Iterator[dict]:
    """Blocks of a count, a comment and as many atoms; Lattice, Properties and energy in the comment, if it has them."""
    frame = 0
    for head in lines:
        if not head.strip():
            continue
        n, comment = int(head), next(lines, "")
        keys = {k.lower(): v.strip('"') for k, v in _PAIR.findall(comment)}
        cell = [float(x) for x in keys["lattice"].split()] if "lattice" in keys else None
        spec = keys.get("properties", "species:S:1:pos:R:3").split(":")
        names: list[str] = []
        for name, many in zip(spec[::3], spec[2::3], strict=True):
            names += _FIELDS.get(name.lower(), [f"_{name}{i}" for i in range(int(many))])
        common = _cell(cell) | {"frame": frame, "comment": comment} | ({"energy": float(keys["energy"])} if "energy" in keys else {})
        for aid in range(n):
            line = next(lines, None)
            if line is None:
                raise ValueError(f"frame {frame} has {aid} of {n} atoms")
            row: dict = dict(zip(names, line.split(), strict=False))
            row = {k: v if k in ("element", "label") else float(v) for k, v in row.items() if not k.startswith("_")}
            if "px" in row:
                row |= {f"v{x}": row.pop(f"p{x}") / WEIGHTS.get(row["element"], 1.0) for x in "xyz"}
            yield common | row | {"aid": aid}
        frame += 1


# --- PDB ---------------------------------------------------------------------------------------------------------------


def parse_pdb(lines: Iterator[str]) -> Iterator[dict]:
    """ATOM and HETATM records by fixed columns, CRYST1 cells, a frame for each MODEL."""
    cell, frame, aid, seen = None, 0, 0, False
    for line in lines:
        kind = line[:6].strip()
        if kind == "CRYST1":
            cell = cell_of(*[float(line[a:b]) for a, b in ((6, 15), (15, 24), (24, 33), (33, 40), (40, 47), (47, 54))])
        elif kind == "MODEL" and seen:
            frame, aid, seen = frame + 1, 0, False
        elif kind in ("ATOM", "HETATM"):
            x, y, z = (float(line[a : a + 8]) for a in (30, 38, 46))
            element = line[76:78].strip().capitalize() or next((c for c in line[12:16] if c.isalpha()), "X")
            yield _cell(cell) | {"frame": frame, "aid": aid, "element": element, "x": x, "y": y, "z": z}
            aid, seen = aid + 1, True


# --- POSCAR ------------------------------------------------------------------------------------------------------------


def parse_poscar(lines: Iterator[str]) -> Iterator[dict]:
    """One frame: scale, cell, elements (X1, X2 .. without names), direct or Cartesian positions and, if they follow, velocities."""
    comment, scale = next(lines).strip(), float(next(lines))
    if scale <= 0:
        raise ValueError("a scaling factor must be positive")
    m = [float(x) * scale for _ in range(3) for x in next(lines).split()[:3]]
    names = next(lines).split()
    if all(x.isdigit() for x in names):
        counts, names = [int(x) for x in names], [f"X{i + 1}" for i in range(len(names))]
    else:
        counts = [int(x) for x in next(lines).split()]
        if len(counts) != len(names):
            raise ValueError("elements and counts differ in number")
    mode = next(lines).strip().lower()
    if mode.startswith("s"):
        mode = next(lines).strip().lower()
    elements = [e for e, n in zip(names, counts, strict=True) for _ in range(n)]
    rows = []
    for aid, e in enumerate(elements):
        v = [float(x) for x in next(lines).split()[:3]]
        p = cartesian(v, m) if mode.startswith("d") else [x * scale for x in v]
        rows.append(_cell(m) | {"frame": 0, "aid": aid, "element": e, "comment": comment, "x": p[0], "y": p[1], "z": p[2]})
    rest = [x.split() for x in lines if x.strip()]
    if len(rest) >= len(rows) and all(len(x) >= 3 for x in rest[: len(rows)]):
        for row, v in zip(rows, rest, strict=False):
            row |= {f"v{x}": float(c) for x, c in zip("xyz", v, strict=False)}
    yield from rows


# --- CIF ---------------------------------------------------------------------------------------------------------------

_CIF = re.compile(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(\S+)")


def _cif_tokens(lines: Iterator[str]) -> Iterator[tuple[str, bool]]:
    """(token, quoted) of a CIF: bare words, quoted strings and text fields between semicolons; comments drop out."""
    for line in lines:
        if line.startswith(";"):
            text = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                text.append(more)
            yield "\n".join(text), True
            continue
        for m in _CIF.finditer(line):
            if m[3] is not None and m[3].startswith("#"):
                break
            yield (m[3], False) if m[3] is not None else (m[1] if m[1] is not None else m[2], True)


def _number(text: str) -> float:
    """A CIF number without its uncertainty: 5.431(2) is 5.431."""
    return float(text.split("(")[0])


def symmetry(op: str) -> tuple[list[list[float]], list[float]]:
    """Matrix and shift of an operation such as -x+1/2, y, z."""
    rows, shifts = [], []
    for part in op.lower().replace(" ", "").split(","):
        row, shift = [0.0, 0.0, 0.0], 0.0
        for sign, axis, number in re.findall(r"([+-]?)(?:([xyz])|(\d+(?:\.\d*)?(?:/\d+)?))", part):
            s = -1.0 if sign == "-" else 1.0
            if axis:
                row["xyz".index(axis)] += s
            else:
                top, _, low = number.partition("/")
                shift += s * float(top) / float(low or 1)
        rows.append(row)
        shifts.append(shift)
    return rows, shifts


def parse_cif(lines: Iterator[str]) -> Iterator[dict]:
    """A frame for each data block with sites: symmetry operations are applied, and images within 0.01 of one another are one atom."""
    frame, tags, loops, tokens = 0, {}, [], list(_cif_tokens(lines))
    blocks, at = [], 0
    while at < len(tokens):
        t, quoted = tokens[at]
        low = t.lower()
        if not quoted and low.startswith("data_"):
            blocks.append((tags := {}, loops := []))
            at += 1
        elif not quoted and low == "loop_":
            at += 1
            heads = []
            while at < len(tokens) and not tokens[at][1] and tokens[at][0].startswith("_"):
                heads.append(tokens[at][0].lower())
                at += 1
            values = []
            while at < len(tokens) and (tokens[at][1] or not (tokens[at][0].startswith("_") or tokens[at][0].lower().startswith(("loop_", "data_")))):
                values.append(tokens[at][0])
                at += 1
            loops.append((heads, [values[i : i + len(heads)] for i in range(0, len(values), len(heads))]))
        elif not quoted and t.startswith("_") and at + 1 < len(tokens):
            tags[low] = tokens[at + 1][0]
            at += 2
        else:
            at += 1
    for tags, loops in blocks:
        table = lambda name: next(((h, r) for h, r in loops if any(x in h for x in name)), ([], []))
        heads, sites = table(["_atom_site_fract_x", "_atom_site_cartn_x"])
        if not sites or "_cell_length_a" not in tags:
            continue
        m = cell_of(*[_number(tags[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")])
        op_heads, op_rows = table(["_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz"])
        at_op = next((op_heads.index(x) for x in ("_space_group_symop_operation_xyz", "_symmetry_equiv_pos_as_xyz") if x in op_heads), None)
        ops = [symmetry(r[at_op]) for r in op_rows] if at_op is not None else [symmetry("x,y,z")]
        aid = 0
        for site in sites:
            row = dict(zip(heads, site, strict=False))
            name = row.get("_atom_site_type_symbol") or row.get("_atom_site_label", "X")
            element = _element(re.match(r"[A-Za-z]*", name)[0] or name)
            f = [_number(row[f"_atom_site_fract_{x}"]) for x in "xyz"]
            found: list[list[float]] = []
            for rows, shift in ops:
                g = [(sum(r * v for r, v in zip(rows[k], f, strict=True)) + shift[k]) for k in range(3)]
                g = [x - math.floor(x) for x in g]
                if all(any(abs((d := x - y) - round(d)) >= 0.01 for x, y in zip(g, h, strict=True)) for h in found):
                    found.append(g)
                    p = cartesian(g, m)
                    yield _cell(m) | {"frame": frame, "aid": aid, "element": element, "label": row.get("_atom_site_label"), "x": p[0], "y": p[1], "z": p[2]}
                    aid += 1
        frame += 1


# --- LAMMPS ------------------------------------------------------------------------------------------------------------


def parse_lammps_data(lines: Iterator[str]) -> Iterator[dict]:
    """One frame of a data file, style atomic, charge or full; elements from a mass line's comment, else the nearest mass within 0.5."""
    next(lines, None)
    box, tilt, masses, section, style = {}, [0.0, 0.0, 0.0], {}, None, "full"
    atoms: list[tuple[int, dict]] = []
    speeds: dict[int, list[float]] = {}
    for line in lines:
        body, _, note = line.partition("#")
        w = body.split()
        if not w:
            continue
        if m := re.match(r"\s*(\S+)\s+(\S+)\s+([xyz])lo\s+[xyz]hi", body):
            box[m[3]] = (float(m[1]), float(m[2]))
        elif w[-3:] == ["xy", "xz", "yz"]:
            tilt = [float(x) for x in w[:3]]
        elif w[0][0].isalpha():
            section = " ".join(w)
            style = note.strip() or style if section == "Atoms" else style
        elif section == "Masses":
            mass = float(w[1])
            near = min(WEIGHTS, key=lambda e: abs(WEIGHTS[e] - mass))
            masses[int(w[0])] = note.strip().split()[0] if note.strip() else near if abs(WEIGHTS[near] - mass) <= 0.5 else f"X{w[0]}"
        elif section == "Atoms":
            k = {"atomic": 2, "charge": 3, "full": 4}[style]
            kind = int(w[2] if style == "full" else w[1])
            row = {"element": masses.get(kind, f"X{kind}"), "xyz": [float(x) for x in w[k : k + 3]]} | ({} if style == "atomic" else {"charge": float(w[k - 1])})
            atoms.append((int(w[0]), row))
        elif section == "Velocities":
            speeds[int(w[0])] = [float(x) for x in w[1:4]]
    (xl, xh), (yl, yh), (zl, zh) = (box[x] for x in "xyz")
    m = [xh - xl, 0.0, 0.0, tilt[0], yh - yl, 0.0, tilt[1], tilt[2], zh - zl]
    for aid, (number, row) in enumerate(sorted(atoms, key=lambda a: a[0])):
        p = [v - o for v, o in zip(row.pop("xyz"), (xl, yl, zl), strict=True)]
        v = {f"v{x}": s for x, s in zip("xyz", speeds[number], strict=True)} if number in speeds else {}
        yield _cell(m) | row | v | {"frame": 0, "aid": aid, "x": p[0], "y": p[1], "z": p[2]}


def read_lammps_dump(spark: SparkSession, paths: str | list[str], units: str = "real") -> DataFrame:
    """Rows of LAMMPS dumps; frames go by their place in the file, atoms by id.

    Positions are x y z, else scaled xs ys zs, else unwrapped xu yu zu, less the box's origin. Velocities become Angstrom per fs
    and forces eV per Angstrom, from real or metal units. An element column is cut at its first underscore; without one the
    element is X and the type. Spark's reader cuts the file at each time step, so one file goes to many tasks.
    """
    if units not in ("real", "metal"):
        raise ValueError("units are real or metal")
    raw = spark.read.option("lineSep", "ITEM: TIMESTEP\n").text(paths)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value").where("length(trim(value)) > 0")
    order = raw.select("file", "block", "at").withColumn("frame", F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1)
    raw = raw.join(order.select("file", "at", "frame"), ["file", "at"])
    part = lambda name: F.regexp_extract("value", rf"ITEM: {name}([^\n]*)\n", 1)
    bounds = F.split(F.regexp_extract("value", r"ITEM: BOX BOUNDS[^\n]*\n([^\n]*\n[^\n]*\n[^\n]*)", 1), "\n")
    b = F.transform(bounds, lambda line: F.transform(F.split(F.trim(line), r"\s+"), lambda v: v.cast("double")))
    lines = F.split(F.trim(F.regexp_extract("value", r"(?s)ITEM: ATOMS[^\n]*\n(.*)$", 1)), "\n")
    f = raw.select("file", F.col("frame").cast("long").alias("frame"), F.split(F.trim(part("ATOMS")), r"\s+").alias("names"), b.alias("b"), lines.alias("lines"))
    tilt = [F.coalesce(F.get(F.col("b")[i], F.lit(2)), F.lit(0.0)) for i in range(3)]
    f = f.select("*", tilt[0].alias("xy"), tilt[1].alias("xz"), tilt[2].alias("yz"))
    zero = F.lit(0.0)
    lo = {"x": F.col("b")[0][0] - F.least(zero, F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")), "y": F.col("b")[1][0] - F.least(zero, F.col("yz")), "z": F.col("b")[2][0]}
    hi = {"x": F.col("b")[0][1] - F.greatest(zero, F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")), "y": F.col("b")[1][1] - F.greatest(zero, F.col("yz")), "z": F.col("b")[2][1]}
    m: dict[str, Column] = dict(zip(CELL, [hi["x"] - lo["x"], zero, zero, F.col("xy"), hi["y"] - lo["y"], zero, F.col("xz"), F.col("yz"), hi["z"] - lo["z"]], strict=True))
    f = f.select("file", "frame", "names", *[lo[x].alias(f"o{x}") for x in "xyz"], *[c.alias(n) for n, c in m.items()], F.explode("lines").alias("line"))
    f = f.where("length(trim(line)) > 0").withColumn("w", F.split(F.trim("line"), r"\s+"))
    has = lambda name: F.array_contains("names", name)
    text = lambda name: F.get(F.col("w"), F.array_position("names", F.lit(name)).cast("int") - 1)
    value = lambda name: F.when(has(name), text(name).cast("double"))
    scaled = {x: sum((value(f"{y}s") * F.col(f"m{i}{k}") for i, y in enumerate("xyz")), zero) for k, x in enumerate("xyz")}
    place = {x: F.when(has("x"), value(x) - F.col(f"o{x}")).when(has("xs"), scaled[x]).otherwise(value(f"{x}u") - F.col(f"o{x}")) for x in "xyz"}
    name = F.when(has("element"), text("element")).otherwise(F.concat(F.lit("X"), text("type")))
    speed = 1.0 if units == "real" else 1e-3
    force = factor("energy", "kcal/mol", "ev") if units == "real" else 1.0
    out = f.select("file", "frame", value("id").cast("long").alias("id"), name.alias("name"), *[c.alias(x) for x, c in place.items()], *[(value(f"v{x}") * speed).alias(f"v{x}") for x in "xyz"], *[(value(f"f{x}") * force).alias(f"force_{x}") for x in "xyz"], value("q").alias("charge"), *CELL)
    cut = F.instr("name", "_") > 0
    out = out.withColumns({"element": F.substring_index("name", "_", 1), "label": F.when(cut, F.col("name")), "energy": F.lit(None).cast("double"), "comment": F.lit(None).cast("string")})
    return out.withColumn("aid", (F.row_number().over(Window.partitionBy("file", "frame").orderBy("id")) - 1).cast("long")).select(*COLUMNS)


# --- inputs of plane-wave and Gaussian codes ----------------------------------------------------------------------------


def parse_qe(lines: Iterator[str]) -> Iterator[dict]:
    """One frame of a pw.x input with ibrav = 0: cell and positions in Angstrom, bohr or crystal units; a site's name is its label."""
    card, unit, cell, rows = "", "", [], []
    for line in lines:
        body = line.split("!")[0].strip()
        if m := re.search(r"(?i)\bibrav\s*=\s*(-?\d+)", body):
            if int(m[1]):
                raise ValueError("only ibrav = 0 can be read")
        if m := re.match(r"(?i)(CELL_PARAMETERS|ATOMIC_POSITIONS|ATOMIC_SPECIES|K_POINTS|CONSTRAINTS|OCCUPATIONS|ATOMIC_FORCES)\b\W*(\w*)", body):
            card, unit = m[1].upper(), m[2].lower()
            if (card, unit) == ("ATOMIC_POSITIONS", "alat"):
                raise ValueError("positions in units of alat can't be read")
        elif body.startswith(("&", "/")):
            card = ""
        elif card == "CELL_PARAMETERS" and len(w := body.split()) >= 3 and len(cell) < 9:
            cell += [float(x) * (BOHR if unit == "bohr" else 1.0) for x in w[:3]]
        elif card == "ATOMIC_POSITIONS" and len(w := body.split()) >= 4:
            rows.append((w[0], [float(x) for x in w[1:4]], unit))
    if len(cell) < 9:
        raise ValueError("CELL_PARAMETERS must have three vectors")
    for aid, (name, v, unit) in enumerate(rows):
        p = cartesian(v, cell) if unit == "crystal" else [x * (BOHR if unit == "bohr" else 1.0) for x in v]
        yield _cell(cell) | {"frame": 0, "aid": aid, "element": _element(re.match(r"[A-Za-z]*", name)[0]), "label": name, "x": p[0], "y": p[1], "z": p[2]}


def parse_cp2k(lines: Iterator[str]) -> Iterator[dict]:
    """One frame of a CP2K input or restart: &CELL as A, B, C or ABC with angles, &COORD with units and scaling, &KIND elements, velocities."""
    path: list[str] = []
    kinds: dict[str, str] = {}
    vectors: dict[str, list[float]] = {}
    lengths, angles, bohr, scaled, kind = None, [90.0, 90.0, 90.0], False, False, ""
    rows: list[tuple[str, list[float], list[float]]] = []
    for line in lines:
        w = re.split(r"[!#]", line)[0].split()
        if not w:
            continue
        head, section = w[0].upper(), path[-1] if path else ""
        if head.startswith("&END"):
            path.pop()
        elif head.startswith("&"):
            path.append(head[1:])
            kind = w[1] if head == "&KIND" and len(w) > 1 else kind
        elif section == "KIND" and head == "ELEMENT":
            kinds[kind.lower()] = w[1]
        elif section == "CELL":
            scale = BOHR if any(x.lower() == "[bohr]" for x in w) else 1.0
            v = [float(x) * scale for x in w[1:] if not x.startswith("[") and re.match(r"[-+.\d]", x)]
            if head in "ABC" and len(head) == 1:
                vectors[head] = v[:3]
            elif head == "ABC":
                lengths = v[:3]
            elif head == "ALPHA_BETA_GAMMA":
                angles = [float(x) for x in w[1:4]]
        elif section == "COORD":
            if head == "UNIT":
                bohr = "bohr" in line.lower()
            elif head == "SCALED":
                scaled = len(w) < 2 or w[1].strip(".").lower() in ("t", "true")
            elif len(w) >= 4:
                more = [float(x) for x in w[4:7]] if len(w) >= 7 and all(re.match(r"[-+.\d]", x) for x in w[4:7]) else []
                rows.append((w[0], [float(x) for x in w[1:4]], more))
    m = [x for k in "ABC" for x in vectors.get(k, [])] if len(vectors) == 3 else cell_of(*lengths, *angles) if lengths else None
    if m is None or not rows:
        raise ValueError("no &CELL or no &COORD")
    moving = all(v for _, _, v in rows)
    for aid, (name, v, speed) in enumerate(rows):
        p = cartesian(v, m) if scaled else [x * (BOHR if bohr else 1.0) for x in v]
        element = kinds.get(name.lower()) or _element(re.match(r"[A-Za-z]*", name)[0])
        fast = {f"v{x}": s * BOHR for x, s in zip("xyz", speed, strict=True)} if moving else {}
        yield _cell(m) | fast | {"frame": 0, "aid": aid, "element": element, "label": name, "x": p[0], "y": p[1], "z": p[2]}


PARSERS = {"qe": parse_qe, "cp2k": parse_cp2k, "extxyz": parse_extxyz, "pdb": parse_pdb, "poscar": parse_poscar, "cif": parse_cif, "lammps_data": parse_lammps_data}


def read_xyz(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of XYZ files with any number of blocks; a block cut short is an error."""
    return read_lines(spark, paths, parse_extxyz)
