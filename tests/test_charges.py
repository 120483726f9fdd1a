import numpy as np
import pytest

from perilattice.operators import charges
from perilattice.sources import grid as grids
from perilattice.sources import sinks
from perilattice.streaming import frames

GRID = "file string, n0 long, n1 long, n2 long, cell array<double>, i0 long, i1 long, i2 long, value double"


def field(shape, peaks, cell):
    """A density that falls with the distance from the nearest peak, in a periodic box."""
    out = {}
    for i in np.ndindex(*shape):
        f = np.array(i) / shape
        d = [f - p for p in peaks]
        out[i] = float(100 - min(np.linalg.norm((x - np.round(x)) @ cell) for x in d))
    return out


@pytest.fixture(scope="module")
def two(spark):
    shape, cell = (6, 5, 8), np.array([[6.0, 0, 0], [1.0, 5.0, 0], [0, 0.5, 8.0]])
    values = field(shape, [np.array([0, 0, 0]), np.array([3 / 6, 2 / 5, 4 / 8])], cell)
    rows = [("t", *shape, cell.ravel().tolist(), *i, v) for i, v in values.items()]
    return spark.createDataFrame(rows, GRID).repartition(3), values, shape, cell


def test_ascent_equals_a_walk(two):
    grid, values, shape, cell = two
    index = lambda i: i[0] + shape[0] * (i[1] + shape[1] * i[2])
    to = {}
    for i, v in values.items():
        best, at = v, i
        for s in charges.STEPS:
            j = tuple((np.array(i) + s) % shape)
            up = v + (values[j] - v) / np.linalg.norm((np.array(s) / shape) @ cell)
            if up > best + 1e-12:
                best, at = up, j
        to[i] = at
    want = {}
    for i in values:
        j = i
        while to[j] != j:
            j = to[j]
        want[index(i)] = index(j)
    got = {r.idx: (r.peak, r.volume) for r in charges.volumes(grid).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert {v for _, v in got.values()} == set(range(1, len(set(want.values())) + 1)) and got[0][1] == 1


def test_charges_add_up_and_go_to_the_nearest_atom(spark, two):
    grid, values, shape, cell = two
    atoms = spark.createDataFrame([("t", 0, 0.1, 0.1, 0.1), ("t", 1, 3.4, 2.2, 4.0), ("t", 2, 3.4, 2.2, 4.0)], "file string, aid long, x double, y double, z double")
    v = charges.volume_charges(grid, atoms)
    assert abs(sum(r.charge or 0 for r in v.collect()) - sum(values.values()) / np.prod(shape)) < 1e-9
    own = {r.aid: r for r in charges.atom_charges(v, atoms).collect()}
    assert own[2].charge == 0.0 and own[2].distance is None and abs(sum(r.size for r in own.values()) - 240.0) < 1e-6
    empty = charges.volume_charges(grid.withColumn("value", grid.value * 0), atoms).collect()
    assert [r.points for r in empty if r.volume == 0] == [240] and all(not r.points for r in empty if r.volume)
    assert charges.volume_charges(grid.where("false"), atoms).count() == 0


def test_a_charge_density_file_and_a_cube_file(spark, tmp_path):
    (tmp_path / "CHGCAR").write_text("c\n1.0\n4 0 0\n0 4 0\n0 0 4\nSi\n1\nDirect\n0 0 0\n\n2 1 2\n1 2 3\n4\n2 1 2\n9 9 9 9\n")
    rows = {(r.i0, r.i1, r.i2): r.value for r in grids.read_grid(spark, str(tmp_path / "CHGCAR"), "charge").collect()}
    assert rows == {(0, 0, 0): 1.0, (1, 0, 0): 2.0, (0, 0, 1): 3.0, (1, 0, 1): 4.0}
    table = spark.createDataFrame([("g", 2, 1, 2, [2.0 if x % 4 == 0 else 0.0 for x in range(9)], *i, v) for i, v in rows.items()], GRID)
    (tmp_path / "a.cube").write_text(sinks.cube_blocks(table).first().block + "\n")
    back = grids.read_grid(spark, str(tmp_path / "a.cube")).collect()
    assert {(r.i0, r.i1, r.i2): r.value for r in back} == rows and abs(back[0].cell[0] - 2.0) < 1e-5
    (tmp_path / "b.cube").write_text(sinks.cube_blocks(table).first().block.rsplit("\n", 1)[0] + "\n")
    with pytest.raises(Exception, match="of 4 values"):
        grids.read_grid(spark, str(tmp_path / "b.cube")).collect()


def test_a_stream_counts_as_a_batch_does(spark, tmp_path):
    atoms = spark.createDataFrame([("t", k % 3, float(k), float(-k), 0.5 * k) for k in range(60)], "file string, frame long, x double, y double, z double").withColumnRenamed("frame", "aid")
    atoms.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(atoms.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    count = lambda df: frames.voxel_counts(df, (10.0, 10.0, 10.0), (3, 3, 3))
    got = frames.run_once(count(stream), "voxels_of_a_test", str(tmp_path / "state"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, count(atoms).collect()))
