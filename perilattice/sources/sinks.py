"""Writers of text structures: a frame's block by column expressions, and files with the blocks in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.elements import mass_of
from ..functions.geometry import CELL, cartesian, fractional, once
from ..functions.units import factor

KEY = ["file", "frame"]


def _num(c: Column | str, digits: int = 10) -> Column:
    return F.format_string(f"%.{digits}f", c)


def _row(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *parts)


def _lines(atoms: DataFrame, line: Column, *more: Column) -> DataFrame:
    """file, frame, n and the atoms' lines joined in order of aid, with more aggregates."""
    out = atoms.groupBy(*KEY).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("aid", line.alias("line")))).alias("l"), *more)
    return out.withColumn("lines", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).drop("l")


def xyz_blocks(atoms: DataFrame) -> DataFrame:
    """file, frame, block."""
    out = _lines(atoms, _row("element", *[_num(x) for x in "xyz"]))
    return out.select(*KEY, F.concat_ws("\n", F.col("n").cast("string"), F.lit(""), "lines").alias("block"))


def extxyz_blocks(atoms: DataFrame, frames: DataFrame, velocities: bool = False, labels: bool = False) -> DataFrame:
    """file, frame, block; an atom without a label has its element there. Frames without a cell have no Lattice."""
    parts = ["element", *[_num(x) for x in "xyz"]] + ([_num(F.coalesce(f"v{x}", F.lit(0.0))) for x in "xyz"] if velocities else [])
    parts += [F.coalesce("label", "element")] if labels else []
    spec = "Properties=species:S:1:pos:R:3" + ":velocities:R:3" * velocities + ":label:S:1" * labels
    out = _lines(atoms, _row(*parts)).join(frames.select(*KEY, *CELL), KEY, "left")
    lattice = F.when(F.col("m00").isNotNull(), F.concat(F.lit('Lattice="'), _row(*[_num(c) for c in CELL]), F.lit('" pbc="T T T"')))
    return out.select(*KEY, F.concat_ws("\n", F.col("n").cast("string"), F.concat_ws(" ", lattice, F.lit(spec)), "lines").alias("block"))


def dump_blocks(atoms: DataFrame, frames: DataFrame, units: str = "real", velocities: bool = False) -> DataFrame:
    """file, frame, block of a LAMMPS dump: the cell turned so that a lies along x and b in the xy plane, positions with it.

    Type numbers go by first appearance over the whole trajectory; the time step is the frame's number.
    """
    f, c = turned(atoms, frames)
    kind = _types(atoms)
    f = f.join(kind, "file")
    kind = F.array_position(F.transform("kinds", lambda k: k["element"]), F.col("element"))
    speed = 1.0 if units == "real" else 1000.0
    parts = [(F.col("aid") + 1).cast("string"), kind.cast("string"), "element", *[_num(cartesian(k, "fx", "fy", "fz")) for k in range(3)]]
    parts += [_num(F.coalesce(f"v{x}", F.lit(0.0)) * speed) for x in "xyz"] if velocities else []
    out = _lines(f, _row(*parts)).join(c, KEY)
    tilted = (F.col("xy") != 0) | (F.col("xz") != 0) | (F.col("yz") != 0)
    span = lambda low, high, tilt: F.concat_ws(" ", _num(low), _num(high), F.when(tilted, _num(tilt)))
    zero = F.lit(0.0)
    x_low, x_high = F.least(zero, F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz")), F.greatest(zero, F.col("xy"), F.col("xz"), F.col("xy") + F.col("xz"))
    rows = [span(x_low, F.col("lx") + x_high, F.col("xy")), span(F.least(zero, F.col("yz")), F.col("ly") + F.greatest(zero, F.col("yz")), F.col("xz")), span(zero, F.col("lz"), F.col("yz"))]
    head = F.when(tilted, F.lit("ITEM: BOX BOUNDS xy xz yz pp pp pp")).otherwise(F.lit("ITEM: BOX BOUNDS pp pp pp"))
    names = F.lit("ITEM: ATOMS id type element x y z" + " vx vy vz" * velocities)
    block = F.concat_ws("\n", F.lit("ITEM: TIMESTEP"), F.col("frame").cast("string"), F.lit("ITEM: NUMBER OF ATOMS"), F.col("n").cast("string"), head, *rows, names, "lines")
    return out.select(*KEY, block.alias("block"))


def _types(atoms: DataFrame) -> DataFrame:
    """file and kinds, its elements in order of first appearance."""
    first = atoms.groupBy("file", "element").agg(F.min(F.struct("frame", "aid")).alias("f"))
    return first.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("f", "element"))).alias("kinds"))


def turned(atoms: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(atoms with fx, fy, fz and the turned cell, file and frame with lx, ly, lz, xy, xz, yz): a along x, b in the xy plane."""
    length = lambda i: F.sqrt(sum((F.col(f"m{i}{k}") * F.col(f"m{i}{k}") for k in range(3)), F.lit(0.0)))
    dot = lambda i, j: sum((F.col(f"m{i}{k}") * F.col(f"m{j}{k}") for k in range(3)), F.lit(0.0))
    c = once(frames.select(*KEY, *CELL), lx=length(0), xy=dot(0, 1) / length(0), xz=dot(0, 2) / length(0), bb=dot(1, 1), bc=dot(1, 2), cc=dot(2, 2))
    c = once(c, ly=F.sqrt(F.greatest(F.lit(0.0), F.col("bb") - F.col("xy") * F.col("xy"))))
    c = once(c, yz=F.when(F.col("ly") > 1e-10, (F.col("bc") - F.col("xy") * F.col("xz")) / F.col("ly")).otherwise(0.0))
    c = once(c, lz=F.sqrt(F.greatest(F.lit(0.0), F.col("cc") - F.col("xz") * F.col("xz") - F.col("yz") * F.col("yz"))))
    c = c.select(*KEY, "lx", "ly", "lz", "xy", "xz", "yz")
    own = {"m00": "lx", "m10": "xy", "m11": "ly", "m20": "xz", "m21": "yz", "m22": "lz"}
    f = fractional(atoms, frames).drop(*CELL).join(c, KEY)
    return f.withColumns({name: F.col(own[name]) if name in own else F.lit(0.0) for name in CELL}), c


def lammps_data_blocks(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """file, frame, block of the first frame as a LAMMPS data file, style full, with the cell turned as in a dump."""
    first = atoms.groupBy("file").agg(F.min("frame").alias("frame"))
    own = atoms.join(first, KEY)
    f, c = turned(own, frames)
    kinds = _types(own)
    f = f.join(kinds, "file")
    kind = F.array_position(F.transform("kinds", lambda k: k["element"]), F.col("element"))
    charge = F.coalesce("charge", F.lit(0.0)) if "charge" in atoms.columns else F.lit(0.0)
    out = _lines(f, _row((F.col("aid") + 1).cast("string"), F.lit("1"), kind.cast("string"), _num(charge, 6), *[_num(cartesian(k, "fx", "fy", "fz")) for k in range(3)])).join(c, KEY).join(kinds, "file")
    masses = F.array_join(F.transform("kinds", lambda k, i: F.concat((i + 1).cast("string"), F.lit(" "), F.format_string("%.4f", mass_of(k["element"])), F.lit("  # "), k["element"])), "\n")
    box = [F.concat(_num(F.lit(0.0)), F.lit(" "), _num(f"l{x}"), F.lit(f" {x}lo {x}hi")) for x in "xyz"]
    tilt = F.when((F.col("xy") != 0) | (F.col("xz") != 0) | (F.col("yz") != 0), F.concat(_row(_num("xy"), _num("xz"), _num("yz")), F.lit(" xy xz yz")))
    count = [F.concat(F.col("n").cast("string"), F.lit(" atoms")), F.concat(F.size("kinds").cast("string"), F.lit(" atom types"))]
    empty = F.lit("")
    return out.select(*KEY, F.concat_ws("\n", F.lit("structure"), empty, *count, empty, *box, tilt, empty, F.lit("Masses"), empty, masses, empty, F.lit("Atoms # full"), empty, "lines").alias("block"))


def qe_blocks(atoms: DataFrame, frames: DataFrame, charge: int = 0, multiplicity: int = 1) -> DataFrame:
    """file, frame, block of the first frame as a pw.x input: cell and positions in Angstrom."""
    first = atoms.groupBy("file").agg(F.min("frame").alias("frame"))
    own = atoms.join(first, KEY)
    out = _lines(own, _row("element", *[_num(x) for x in "xyz"])).join(_types(own), "file").join(frames.select(*KEY, *CELL), KEY)
    species = F.array_join(F.transform("kinds", lambda k: F.concat(k["element"], F.lit("  "), F.format_string("%.4f", mass_of(k["element"])), F.lit("  "), k["element"], F.lit(".UPF"))), "\n")
    system = F.concat(F.lit("  ibrav = 0,\n  nat = "), F.col("n").cast("string"), F.lit(",\n  ntyp = "), F.size("kinds").cast("string"), F.lit("," + f"\n  tot_charge = {charge}," * bool(charge) + f"\n  tot_magnetization = {multiplicity - 1}," * (multiplicity != 1)))
    head = [F.lit("&CONTROL\n  calculation = 'scf',\n/\n&SYSTEM"), system, F.lit("/\n&ELECTRONS\n/\nATOMIC_SPECIES"), species, F.lit("CELL_PARAMETERS {angstrom}")]
    rows = [_row(*[_num(f"m{i}{k}") for k in range(3)]) for i in range(3)]
    return out.select(*KEY, F.concat_ws("\n", *head, *rows, F.lit("ATOMIC_POSITIONS {angstrom}"), "lines").alias("block"))


def cif_blocks(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """file, frame, block: a data block for each frame, its cell by lengths and angles, sites by fractions in P 1."""
    length = [F.sqrt(sum((F.col(f"m{i}{k}") * F.col(f"m{i}{k}") for k in range(3)), F.lit(0.0))) for i in range(3)]
    angle = lambda i, j: F.degrees(F.acos(sum((F.col(f"m{i}{k}") * F.col(f"m{j}{k}") for k in range(3)), F.lit(0.0)) / (length[i] * length[j])))
    values = {"length_a": length[0], "length_b": length[1], "length_c": length[2], "angle_alpha": angle(1, 2), "angle_beta": angle(0, 2), "angle_gamma": angle(0, 1)}
    cell = frames.select(*KEY, *[_num(c).alias(name) for name, c in values.items()])
    out = _lines(fractional(atoms, frames), _row(F.concat("element", (F.col("aid") + 1).cast("string")), "element", *[_num(f"f{x}") for x in "xyz"])).join(cell, KEY)
    head = [F.concat(F.lit(f"_cell_{name} "), name) for name in values]
    names = F.lit("loop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\nloop_\n_atom_site_label\n_atom_site_type_symbol\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z")
    return out.select(*KEY, F.concat_ws("\n", F.concat(F.lit("data_frame_"), F.col("frame").cast("string")), *head, names, "lines").alias("block"))


def output_name(mode: str, table: str = "", label: str = "", suffix: str = "") -> str:
    """<mode>[_<table>][_<label>][_<suffix>].csv; a table that is named as its mode isn't named twice."""
    return "_".join([mode, *[x for x in ("" if table == mode else table, label, suffix) if x]]) + ".csv"


def poscar_blocks(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """file, frame, block of the first frame: elements in order of first appearance, Cartesian positions."""
    first = atoms.groupBy("file").agg(F.min("frame").alias("frame"))
    own = atoms.join(first, KEY)
    kinds = own.groupBy(*KEY, "element").agg(F.min("aid").alias("first"), F.count("*").alias("k")).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "element", "k"))).alias("kinds"))
    f = own.join(kinds, KEY)
    f = f.withColumn("aid", F.struct(F.array_position(F.transform("kinds", lambda k: k["element"]), F.col("element")).alias("kind"), F.col("aid").alias("aid")))
    out = _lines(f, _row(*[_num(x) for x in "xyz"])).join(kinds, KEY).join(frames.select(*KEY, *CELL), KEY)
    rows = [_row(*[_num(f"m{i}{k}") for k in range(3)]) for i in range(3)]
    names = F.array_join(F.transform("kinds", lambda k: k["element"]), " ")
    counts = F.array_join(F.transform("kinds", lambda k: k["k"].cast("string")), " ")
    return out.select(*KEY, F.concat_ws("\n", F.lit("structure"), F.lit("1.0"), *rows, names, counts, F.lit("Cartesian"), "lines").alias("block"))


def pdb_blocks(atoms: DataFrame, frames: DataFrame) -> DataFrame:
    """file, frame, block: a MODEL for each frame, with its cell's lengths and angles."""
    serial = F.col("aid") + 1
    line = F.format_string("ATOM  %5d %-4s MOL A   1    %8.3f%8.3f%8.3f  1.00  0.00          %2s", serial % 100000, "element", "x", "y", "z", "element")
    length = [F.sqrt(sum((F.col(f"m{i}{k}") * F.col(f"m{i}{k}") for k in range(3)), F.lit(0.0))) for i in range(3)]
    angle = lambda i, j: F.degrees(F.acos(sum((F.col(f"m{i}{k}") * F.col(f"m{j}{k}") for k in range(3)), F.lit(0.0)) / (length[i] * length[j])))
    cell = F.format_string("CRYST1%9.3f%9.3f%9.3f%7.2f%7.2f%7.2f P 1           1", *length, angle(1, 2), angle(0, 2), angle(0, 1))
    out = _lines(atoms, line).join(frames.select(*KEY, cell.alias("cell")), KEY, "left")
    return out.select(*KEY, F.concat_ws("\n", "cell", F.format_string("MODEL     %4d", F.col("frame") + 1), "lines", F.lit("ENDMDL")).alias("block"))


def cube_blocks(grid: DataFrame) -> DataFrame:
    """file, block of a Gaussian cube without atoms, from file, n0 .. n2, cell (Angstrom), i0 .. i2, value; a file's voxels meet in one row."""
    bohr = factor("length", "angstrom", "bohr")
    rows = grid.groupBy("file", "n0", "n1", "n2", "cell", "i0", "i1").agg(F.sort_array(F.collect_list(F.struct("i2", F.format_string("%13.5E", "value").alias("v")))).alias("v"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("v") - 1) / 6).cast("int")), lambda k: F.array_join(F.transform(F.slice("v", k * 6 + 1, F.lit(6)), lambda x: x["v"]), ""))
    text = rows.groupBy("file", "n0", "n1", "n2", "cell").agg(F.sort_array(F.collect_list(F.struct("i0", "i1", F.array_join(cut, "\n").alias("t")))).alias("t"))
    axis = lambda i: F.concat(F.format_string("%5d", f"n{i}"), *[F.format_string("%12.6f", F.col("cell")[3 * i + k] * bohr / F.col(f"n{i}")) for k in range(3)])
    body = F.array_join(F.transform("t", lambda x: x["t"]), "\n")
    return text.select("file", F.concat_ws("\n", F.lit("grid"), F.lit("values"), F.lit("    0    0.000000    0.000000    0.000000"), axis(0), axis(1), axis(2), body).alias("block"))


def write_blocks(blocks: DataFrame, folder: str) -> None:
    """One text file below folder/file=<name> for each trajectory, its blocks in order of frame."""
    n = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartition(n, "file").sortWithinPartitions("file", "frame").select("file", "block").write.partitionBy("file").text(folder)


def csv_lines(table: DataFrame, order: list[str], meta: list[str] = ()) -> DataFrame:
    """at, line of a CSV table: # lines, a header, then rows in order; numbers as 1.234567e0, null and NaN empty, text quoted where it must be."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind in ("double", "float"):
            short = F.regexp_replace(F.regexp_replace(F.format_string("%.6e", c), r"e([+-])0*(\d)", "e$1$2"), r"e\+", "e")
            return F.when(c.isNull() | F.isnan(c), "").otherwise(short)
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    kinds = dict(table.dtypes)
    rows = table.select(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in order]).alias("at"), F.concat_ws(",", *[cell(c, kinds[c]) for c in table.columns]).alias("line"))
    head = [("", f"# {x}") for x in meta] + [("", ",".join(table.columns))]
    spark = table.sparkSession
    return spark.createDataFrame([(i, at, x) for i, (at, x) in enumerate(head)], "part int, at string, line string").union(rows.select(F.lit(len(head)), "at", "line"))
