"""Trajectories derived from the driver's part and nation tables, as SQL that Spark and DuckDB both run.

Each 200 parts are a file of 200 atoms, each nation is a frame. TRAJ fills a cube of edge 16, TILT a tilted cell that grows from
frame to frame, NET a lattice of formers with ligands near its edges. Fractional positions and velocities are dyadic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE, AID = "cast(floor(p_partkey / 200) as bigint) as file", "cast(p_partkey % 200 as bigint) as aid"
_STEPS = (("x", 37, 7), ("y", 1031, 11), ("z", 2753, 13))
_FRAC = ", ".join(f"(p_partkey * {a} % 4096) / 4096e0 + n_nationkey * ((p_partkey * {b}) % 127 - 63) / 1024e0 as a{x}" for x, a, b in _STEPS)
_SPEED = ", ".join(f"((p_partkey * {b}) % 127 - 63) / 64e0 as v{x}" for x, _, b in _STEPS)
_RAW = f"""select {FILE}, cast(n_nationkey as bigint) as frame, {AID}, case when p_partkey % 3 = 0 then 'Si' else 'O' end as element, {_FRAC},
 {_SPEED} from {{part}} cross join {{nation}}"""
TRAJ = f"""select file, frame, aid, element, {", ".join(f"(a{x} - floor(a{x})) * 16e0 as {x}" for x in "xyz")}, {", ".join(f"v{x}" for x in "xyz")}
 from ({_RAW}) t"""

#: Cell of a frame of TILT: its edge, and the off-diagonal elements.
EDGE = "(16e0 + frame / 8e0)"
CELL = {"m00": EDGE, "m01": "0e0", "m02": "0e0", "m10": "2e0", "m11": EDGE, "m12": "0e0", "m20": "1e0", "m21": "-1.5e0", "m22": EDGE}
_SHIFTED = ", ".join(f"a{x} + 1e0 / 16384e0 - floor(a{x} + 1e0 / 16384e0) as f{x}" for x in "xyz")
FRACTIONS = f"select file, frame, aid, element, {_SHIFTED} from ({_RAW}) t"
TILT = f"""select file, frame, aid, element, {", ".join(f"fx * {CELL[f'm0{k}']} + fy * {CELL[f'm1{k}']} + fz * {CELL[f'm2{k}']} as {x}" for k, x in enumerate("xyz"))}
 from ({FRACTIONS}) t2"""


def _site(axis: int, moved: int) -> str:
    """A coordinate of NET beyond its lattice site: ligands of kind h stand beside their edge's axis."""
    return f"""case when aid < 64 then 0e0 when aid >= 190 or h = 9 then 2e0 when h = 8 then case when ax = {moved} then 0e0 else 2e0 end
 when ax = {axis} then case when h < 6 then 2e0 else 1e0 end else 0e0 end"""


NET = f"""select file, frame, aid, element, x - floor(x / 16e0) * 16e0 as x, y - floor(y / 16e0) * 16e0 as y, z - floor(z / 16e0) * 16e0 as z from (
select file, frame, aid, case when aid < 64 then case when aid % 8 = 0 then 'Al' else 'P' end when aid < 190 then 'O' else 'Zn' end as element,
 sx * 4e0 + {_site(0, 2)} as x, sy * 4e0 + {_site(1, 0)} as y, sz * 4e0 + {_site(2, 1)} as z
from (select file, frame, aid, h, ax, site % 4 as sx, cast(floor(site / 4) as bigint) % 4 as sy, cast(floor(site / 16) as bigint) as sz from (
select file, frame, aid, (aid + frame + file) % 10 as h, case when aid < 64 then 0 else e % 3 end as ax,
 case when aid < 64 then aid else cast(floor(e / 3) as bigint) end as site from (
select {FILE}, cast(n_nationkey as bigint) as frame, {AID},
 ((p_partkey % 200 + 128) * 7 + n_nationkey * 5 + cast(floor(p_partkey / 200) as bigint)) % 192 as e from {{part}} cross join {{nation}}) t1) t2) t3) t4"""

#: A charge grid of 5 x 5 x 8 points for each 200 parts, with bumps and ties; its cell has edges 5, 5 and 8.
GRID = f"""select file, aid as k, aid % 5 as i0, cast(floor(aid / 5) as bigint) % 5 as i1, cast(floor(aid / 25) as bigint) as i2,
 ((aid * 37 + file * 11) % 16) / 2e0 + (2e0 - abs(aid % 5 - 2e0)) * 4e0 + (4e0 - abs(cast(floor(aid / 25) as bigint) - 4e0)) * 3e0 as value
 from (select {FILE}, {AID} from {{part}}) t"""


def charge_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(grid, atoms): the grid's points as sources.grid gives them, and eight atoms a file."""
    rows = spark.sql(GRID.format(part=f"parquet.`{sf_dir}/part.parquet`"))
    cell = F.array(*[F.lit(float(x)) for x in (5, 0, 0, 0, 5, 0, 0, 0, 8)])
    shape = [F.lit(n).cast("long").alias(f"n{i}") for i, n in enumerate((5, 5, 8))]
    atoms = rows.where("k % 25 = 7").select("file", F.col("k").alias("aid"), *[(F.col(f"i{i}") + 0.25).alias(x) for i, x in enumerate("xyz")])
    return rows.select("file", *shape, cell.alias("cell"), "i0", "i1", "i2", "value"), atoms


def _load(sql: str, cell: dict[str, str]):
    def run(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
        atoms = spark.sql(sql.format(part=f"parquet.`{sf_dir}/part.parquet`", nation=f"parquet.`{sf_dir}/nation.parquet`"))
        return atoms, atoms.select("file", "frame").distinct().select("file", "frame", *[F.expr(e).alias(c) for c, e in cell.items()])

    return run


_CUBE = {f"m{i}{j}": "16e0" if i == j else "0e0" for i in range(3) for j in range(3)}
cube, tilted, net = _load(TRAJ, _CUBE), _load(TILT, CELL), _load(NET, _CUBE)
