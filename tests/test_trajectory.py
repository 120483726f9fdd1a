import math

import pytest
from pyspark.sql import functions as F

from perilattice.functions import elements, units
from perilattice.operators import building, dynamics, graph, network, neighbors, selection, structure
from perilattice.sources import sinks, text

CELL = ", ".join(f"m{i}{j} double" for i in range(3) for j in range(3))


def world(spark, rows, edge):
    """(atoms, frames) of rows (frame, aid, element, x, y, z) in a cubic box, or in the cells of a dict by frame."""
    atoms = spark.createDataFrame([("t", *r) for r in rows], "file string, frame long, aid long, element string, x double, y double, z double")
    cubic = [edge if i == j else 0.0 for i in range(3) for j in range(3)] if not isinstance(edge, dict) else None
    frames = spark.createDataFrame([("t", f, *(cubic or edge[f])) for f in sorted({r[0] for r in rows})], f"file string, frame long, {CELL}")
    return atoms, frames


def test_simple_cubic_has_six_neighbours(spark):
    rows = [(0, i * 9 + j * 3 + k, "Fe", 2.87 * i, 2.87 * j, 2.87 * k) for i in range(3) for j in range(3) for k in range(3)]
    gr = structure.radial_distribution(*world(spark, rows, 2.87 * 3), 0.1, 3.9, 0.01).orderBy("bin").collect()
    peak = max(gr, key=lambda r: r.gr)
    assert abs(peak.r - 2.87) < 0.02 and abs(gr[-1].cn - 6) < 1e-9


def test_radial_range_is_cut_and_changing_atoms_are_an_error(spark):
    rows = [(f, a, "A", 1.0 + 3 * a, 5.0, 5.0) for f in range(2) for a in range(3)]
    got = structure.radial_distribution(*world(spark, rows, 10.0), 0.0, 20.0, 0.5)
    assert got.agg(F.max("r")).first()[0] == 4.75
    for bad in (rows[:-1], [*rows[:-1], (1, 2, "B", 7.0, 5.0, 5.0)]):
        with pytest.raises(Exception, match="number of atoms"):
            structure.radial_distribution(*world(spark, bad, 10.0), 0.0, 4.0, 0.5).collect()
    with pytest.raises(Exception, match="no bin"):
        structure.radial_distribution(*world(spark, rows, 10.0), 6.0, 20.0, 0.5).collect()


@pytest.mark.parametrize("cut", [1.0, 3.0, 4.9, 7.0])
def test_pairs_equal_brute_force_in_a_tilted_cell(spark, cut):
    import numpy as np

    rng = np.random.default_rng(7)
    m = np.array([[10.0, 0, 0], [2.0, 9.0, 0], [-1.0, 1.5, 11.0]])
    f = rng.random((60, 3))
    x = f @ m + rng.integers(-2, 3, (60, 3)) @ m
    atoms, frames = world(spark, [(0, i, "A", *map(float, x[i])) for i in range(60)], {0: m.ravel().tolist()})
    got = {(r.a, r.b): r.d2 for r in neighbors.pairs(atoms, frames, cut).collect()}
    d = f[None] - f[:, None]
    d2 = (((d - np.floor(d + 0.5)) @ m) ** 2).sum(axis=2)
    want = {(i, j): d2[i, j] for i in range(60) for j in range(i + 1, 60) if d2[i, j] < cut * cut}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    both = {(r.a, r.b): (r.dx, r.dy, r.dz) for r in neighbors.pairs(atoms, frames, cut, ordered=True).collect()}
    some = atoms.withColumn("element", F.when(F.col("aid") % 3 == 0, "B").otherwise("A"))
    sided = {(r.a, r.b) for r in neighbors.pairs(some, frames, cut, sides=(["B"], ["A"])).collect()}
    assert sided == {k for k in [*want, *[x[::-1] for x in want]] if k[0] % 3 == 0 and k[1] % 3}
    assert len(both) == 2 * len(want) and all(abs(both[b, a][0] + v[0]) < 1e-12 for (a, b), v in both.items())


def test_msd_follows_atoms_across_faces(spark):
    atoms, frames = world(spark, [(f, 0, "Fe", (4.8 + 0.5 * f) % 5.0, 0.0, 0.0) for f in range(5)], 5.0)
    got = {r.lag: r for r in dynamics.mean_squared_displacement(atoms, frames, 5).collect()}
    assert all(abs(got[k].msd - (0.5 * k) ** 2) < 1e-8 and abs(got[k].msd_a - got[k].msd) < 1e-8 for k in range(5))
    with pytest.raises(ValueError):
        dynamics.diffusion(atoms, 0.8, 0.2)


def test_a_flat_curve_fits_with_an_r2_of_one(spark):
    msd = spark.createDataFrame([("t", k, float(k), 2.0) for k in range(5)], "file string, lag int, time double, msd double")
    assert dynamics.diffusion(msd, 0.0, 1.0).first().r2 == 1.0


def test_origins_without_a_neighbour_count_zero(spark):
    rows = [(f, a, e, x, 5.0, 5.0) for f in range(4) for a, e, x in ((0, "O", 5.0), (1, "H", 5.9 if f < 2 else 8.0))]
    got = {r.lag: r.c2 for r in dynamics.rotational_correlation(*world(spark, rows, 12.0), "O", "H", 1.2, 2).collect()}
    assert got == {0: pytest.approx(2 / 3), 1: pytest.approx(1 / 3)}


def test_the_last_bin_of_van_hove_is_kept(spark):
    atoms, frames = world(spark, [(0, 0, "A", 1.0, 1.0, 1.0), (1, 0, "A", 2.0, 1.0, 1.0)], 20.0)
    got = dynamics.van_hove(atoms, frames, 1, 1.05, 0.5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [0, 0, 1]


@pytest.mark.parametrize(("second", "bin_"), [((0.0, 1.6, 0.0), 90), ((-1.6, 0.0, 0.0), 179)])
def test_angles(spark, second, bin_):
    rows = [(0, 0, "Si", 5.0, 5.0, 5.0), (0, 1, "O", 6.6, 5.0, 5.0), (0, 2, "O", 5 + second[0], 5 + second[1], 5 + second[2])]
    angles = structure.bond_angles(*world(spark, rows, 20.0), 2.0, width=1.0)
    got = angles.collect()
    assert [(r.end_a, r.center, r.end_c, r["count"]) for r in got] == [("O", "Si", "O", 1)] and abs(got[0].bin - bin_) <= 1
    assert structure.angle_statistics(angles).first()["sd"] == 0.0


def test_cutoffs_follow_the_named_ends(spark):
    rows = [(0, 0, "Si", 5.0, 5.0, 5.0), (0, 1, "O", 6.6, 5.0, 5.0), (0, 2, "P", 5.0, 7.2, 5.0)]
    w = world(spark, rows, 20.0)
    count = lambda *a, **k: structure.bond_angles(*w, *a, **k).where("center = 'Si'").count()
    assert count(1.8, 2.4) == 1 and count(2.4, 1.8) == 0 and count(2.4, 1.8, ends=("P", "O")) == 1


def bridge(spark):
    return world(spark, [(0, i, e, x + 8.0, 0.0, 0.0) for i, (e, x) in enumerate([("P", 0.0), ("O", 1.6), ("P", 3.2), ("O", -1.6), ("O", 4.8)])], 20.0)


def test_network_of_a_bridge(spark):
    atoms, frames = bridge(spark)
    b = network.bonds(atoms, frames, [("P", "O", 2.3)])
    f = network.formers(atoms, b, ["P"])
    assert sorted((r.n, r.cn, r.n_bo, r.bridges) for r in f.collect()) == [(1, 2, 1, {"P": 1}), (1, 2, 1, {"P": 1})]
    lig = network.ligand_classes(atoms, b, ["O"])
    assert sorted(r.kind for r in lig.collect()) == ["b", "n", "n"]
    assert sorted(r.label for r in network.ligand_table(lig).collect()) == ["P-O_b-P", "P-O_n"]
    assert [(r.a, r.b, r.k, r["mean"]) for r in network.linkages(b).collect()] == [("P-1-2", "P-1-2", 2, 1.0)]
    assert [(r.cluster, r.formers, r.ligands, r.qn_max) for r in network.cluster_sites(b, f).collect()] == [(0, 2, 3, 1)]
    none = atoms.where("false")
    assert network.clusters(b.where("false"), network.formers(none, b.where("false"), ["P"])).count() == 0


def test_network_arguments():
    for bad in ([], [("P", "O", 0.0)], [("P", "O", 2.0), ("P", "O", 3.0)], [("P", "O", 2.0), ("O", "P", 2.0)]):
        with pytest.raises(ValueError):
            network.validate(bad)
    with pytest.raises(ValueError):
        network.validate([("P", "O", 2.0)], [("Zn", "F", 2.0)])


def test_components_of_a_ring_and_a_star(spark):
    links = [("t", 0, i, (i + 1) % 9) for i in range(9)] + [("t", 1, 3, k) for k in range(4, 40)]
    got = graph.components(spark.createDataFrame(links, "file string, frame long, a long, b long"), ["file", "frame"]).collect()
    assert {(r.frame, r.root) for r in got} == {(0, 0), (1, 3)} and len(got) == 9 + 37


def test_selection_and_supercell(spark):
    atoms, frames = world(spark, [(f, a, "A", 1.0, 2.0, 3.0) for f in range(6) for a in range(2)], 10.0)
    assert {r.frame for r in selection.select_frames(atoms, 1, 5, 2).collect()} == {1, 3, 5}
    assert {r.frame for r in selection.tail(atoms, 2).collect()} == {4, 5}
    assert selection.spread(10, 4) == [0, 3, 6, 9]
    big, cell = selection.supercell(atoms, frames, 2, 1, 1)
    assert big.count() == 24 and cell.first().m00 == 20.0
    assert selection.vacuum(frames, 2, 5.0).first().m22 == 15.0
    assert building.supercell_size((4.0, 5.0, 5.0), 3, 9.0, 40) == (3, 3, 2)


def test_every_frame_is_replicated(spark):
    from perilattice.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    parts, nations = (spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("part", "nation"))
    got = QUERIES["supercell"](spark, d)
    assert got.count() == parts * nations * 6 and got.select("frame").distinct().count() == nations


def test_formulas_boxes_and_units():
    assert building.parse_formula("Ca3(PO4)2") == {"Ca": 3, "P": 2, "O": 8} and building.parse_formula("K4[Fe(CN)6]")["N"] == 6
    for bad in ("", "H0", "(H2", "H)", "[H)", "()2", "h2", "CuSO4.5H2O"):
        with pytest.raises(ValueError):
            building.parse_formula(bad)
    assert building.box_length([("H2O", 33)], 1.0) == pytest.approx(9.957, abs=1e-2)
    assert units.factor("length", "bohr", "angstrom") == 0.5291772109 and units.factor("pressure", "kbar", "gpa") == 0.1
    assert len(elements.SYMBOLS) == 118


def test_oxidation_states_balance(spark):
    counts = spark.createDataFrame([("a", "Si", 1), ("a", "O", 2), ("b", "Fe", 2), ("b", "O", 3), ("c", "Fe", 4), ("d", "Si", 1), ("d", "O", 5)], "file string, element string, n long")
    known = [("O", 3.44, -2), ("Si", 1.9, 4), ("Si", 1.9, -4), ("Fe", 1.83, 2), ("Fe", 1.83, 3)]
    got = building.oxidation_states(counts, spark.createDataFrame(known, "element string, electronegativity double, state int")).collect()
    assert {(r.file, r.element, r.state) for r in got} == {("a", "O", -2), ("a", "Si", 4), ("b", "O", -2), ("b", "Fe", 3)}


def test_spins(spark):
    assert [building.group_of(z) for z in (1, 2, 6, 10, 14, 26, 57, 60, 72, 86, 100)] == [1, 18, 14, 18, 14, 8, 3, None, 4, 18, None]
    got = [building.unpaired_electrons(z, s) for z, s in ((26, 3), (26, 2), (30, 2), (8, -2), (8, 0), (14, 4), (29, 2), (3, 0))]
    assert got == [5, 4, 0, 0, 2, 0, 1, 1]
    rows = [("a", 0, i, "Fe", None) for i in range(2)] + [("a", 0, 2 + i, "O", None) for i in range(3)] + [("b", 0, 0, "H", None), ("c", 0, 0, "Fe", 3.8), ("d", 0, 0, "H", 2.0)]
    atoms = spark.createDataFrame(rows, "file string, frame long, aid long, element string, magmom double")
    states = spark.createDataFrame([("O", 3.44, -2), ("Fe", 1.83, 2), ("Fe", 1.83, 3)], "element string, electronegativity double, state int")
    got = {r.file: (r.n_unpaired, r.multiplicity, r.method) for r in building.spin_guess(atoms, states).collect()}
    assert got == {"a": (10, 11, "oxidation"), "b": (1, 2, "parity"), "c": (4, 5, "magmom"), "d": (1, 2, "magmom")}


def test_xyz_and_dump_files(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("2\nc\nFe 0 0 0\nO 1.5 0 0\n2\nc\nFe 0 0 1\nO 1.5 0 1\n")
    atoms = text.read_xyz(spark, str(tmp_path / "a.xyz"))
    assert atoms.count() == 4 and {r.comment for r in atoms.collect()} == {"c"} and text.trajectory(atoms)[1].count() == 0
    assert sinks.xyz_blocks(atoms).where("frame = 1").first().block.splitlines()[2] == "Fe 0.0000000000 0.0000000000 1.0000000000"
    (tmp_path / "b.xyz").write_text("2\nc\nFe 0 0 0\n")
    with pytest.raises(Exception, match="1 of 2 atoms"):
        text.read_xyz(spark, str(tmp_path / "b.xyz")).collect()
    body = "0\nITEM: NUMBER OF ATOMS\n2\nITEM: BOX BOUNDS pp pp pp\n1 11\n0 10\n0 10\nITEM: ATOMS id type element x y z vx vy vz q\n2 1 O_b 2 0 0 1 0 0 -0.5\n1 2 P_2 3 0 0 2 0 0 1.5\n"
    (tmp_path / "d.lammpstrj").write_text("".join("ITEM: TIMESTEP\n" + body for _ in range(3)))
    rows = text.load(spark, str(tmp_path / "d.lammpstrj"), "metal").orderBy("frame", "aid").collect()
    assert [(r.element, r.label, r.x, r.vx, r.charge, r.m00) for r in rows[:2]] == [("P", "P_2", 2.0, 0.002, 1.5, 10.0), ("O", "O_b", 1.0, 0.001, -0.5, 10.0)]
    assert [r.frame for r in rows] == [0, 0, 1, 1, 2, 2]
    (tmp_path / "s.dump").write_text("ITEM: TIMESTEP\n5\nITEM: NUMBER OF ATOMS\n1\nITEM: BOX BOUNDS xy xz yz pp pp pp\n0 12 2\n0 10 0\n0 10 0\nITEM: ATOMS id type xs ys zs\n1 3 0.5 0.5 0\n")
    one = text.load(spark, str(tmp_path / "s.dump")).first()
    assert (one.element, one.x, one.y, one.m00, one.m10) == ("X3", 6.0, 5.0, 10.0, 2.0)


def test_other_formats(spark, tmp_path):
    w = lambda name, body: (tmp_path / name).write_text(body) and str(tmp_path / name)
    extended = 'Lattice="4 0 0 0 4 0 0 0 4" Properties=species:S:1:pos:R:3:momenta:R:3:label:S:1 energy=-3.5'
    r = text.load(spark, w("a.extxyz", f"1\n{extended}\nO 1 2 3 15.999 0 0 O_b\n")).first()
    assert (r.element, r.label, r.z, r.vx, r.energy, r.m11) == ("O", "O_b", 3.0, 1.0, -3.5, 4.0)
    pdb = "CRYST1   10.000   10.000   10.000  90.00  90.00  90.00 P 1\nMODEL 1\nATOM      1  CA  ALA A   1       1.000   2.000   3.000  1.00  0.00           C\nENDMDL\nMODEL 2\nHETATM    1  O   HOH A   1       1.500   2.000   3.000\nENDMDL\n"
    got = text.load(spark, w("p.pdb", pdb)).orderBy("frame").collect()
    assert [(r.frame, r.element, r.x, r.m22) for r in got] == [(0, "C", 1.0, 10.0), (1, "O", 1.5, 10.0)]
    poscar = "c\n2.0\n1 0 0\n0 1 0\n0 0 1\nSi O\n1 1\nSelective dynamics\nDirect\n0 0 0 T T T\n0.5 0.5 0.5 T T F\n\n1 0 0\n0 1 0\n"
    got = text.load(spark, w("POSCAR_1", poscar)).orderBy("aid").collect()
    assert [(r.element, r.x, r.vx) for r in got] == [("Si", 0.0, 1.0), ("O", 1.0, 0.0)]
    cif = "data_x\n_cell_length_a 5.0(1)\n_cell_length_b 5\n_cell_length_c 5\n_cell_angle_alpha 90\n_cell_angle_beta 90\n_cell_angle_gamma 90\nloop_\n_symmetry_equiv_pos_as_xyz\n'x, y, z'\n'-x, -y, z+1/2'\nloop_\n_atom_site_label\n_atom_site_fract_x\n_atom_site_fract_y\n_atom_site_fract_z\nFe1 0.1 0.2(3) 0\nO2 0 0 0.25\n"
    got = text.load(spark, w("c.cif", cif)).orderBy("aid").collect()
    assert [(r.element, round(r.x, 6), round(r.z, 6)) for r in got] == [("Fe", 0.5, 0.0), ("Fe", 4.5, 2.5), ("O", 0.0, 1.25), ("O", 0.0, 3.75)]
    data = "LAMMPS\n\n2 atoms\n1 atom types\n0 10 xlo xhi\n0 10 ylo yhi\n1 11 zlo zhi\n\nMasses\n\n1 55.9\n2 1.0 # Hx\n\nAtoms # charge\n\n2 2 0.5 1 1 2\n1 1 -0.5 3 3 3\n\nVelocities\n\n1 1 0 0\n"
    got = text.load(spark, w("d.data", data)).orderBy("aid").collect()
    assert [(r.element, r.charge, r.x, r.z, r.vx) for r in got] == [("Fe", -0.5, 3.0, 2.0, 1.0), ("Hx", 0.5, 1.0, 1.0, None)]
    qe = "&SYSTEM\n ibrav = 0, nat = 2 ! two\n/\nATOMIC_SPECIES\n Fe1 55.8 Fe.UPF\nCELL_PARAMETERS {bohr}\n 10 0 0\n 0 10 0\n 0 0 10\nATOMIC_POSITIONS {crystal}\n Fe1 0.5 0 0\n O 0 0 0.25\nK_POINTS gamma\n"
    got = text.load(spark, w("a.in", qe)).orderBy("aid").collect()
    assert [(r.element, r.label, round(r.x, 6), round(r.z, 6)) for r in got] == [("Fe", "Fe1", 2.645886, 0.0), ("O", "O", 0.0, 1.322943)]
    cp2k = "&FORCE_EVAL\n&SUBSYS\n&CELL\nABC 10 10 12\n&END CELL\n&COORD\nUNIT bohr\nOw 1 0 0 ! here\nH1 0 2 0\n&END COORD\n&KIND Ow\nELEMENT O\n&END KIND\n&END SUBSYS\n&END FORCE_EVAL\n"
    got = text.load(spark, w("a.inp", cp2k)).orderBy("aid").collect()
    assert [(r.element, round(r.x, 6), round(r.y, 6), r.m22) for r in got] == [("O", 0.529177, 0.0, 12.0), ("H", 0.0, 1.058354, 12.0)]
    assert sinks.output_name("network", "qn", "", "late") == "network_qn_late.csv" and sinks.output_name("gr", "gr", "a") == "gr_a.csv"
    with pytest.raises(FileNotFoundError):
        text.load(spark, str(tmp_path / "none*.xyz"))
    with pytest.raises(ValueError):
        text.format_of("a.unknown")


def test_a_csv_line_quotes_and_leaves_empty(spark):
    rows = spark.createDataFrame([("a,b", 1.5, None), ('say "x"', float("nan"), 3)], "t string, v double, n long")
    got = [r.line for r in sinks.csv_lines(rows, ["t"], ["about"]).orderBy("part", "at").collect()]
    assert got == ["# about", "t,v,n", '"a,b",1.500000e0,', '"say ""x""",,3']


def test_internal_coordinates_of_a_square(spark):
    rows = [(0, 0, "A", 0.0, 0.0, 0.0), (0, 1, "A", 1.0, 0.0, 0.0), (0, 2, "A", 1.0, 1.0, 0.0), (0, 3, "A", 1.0, 1.0, 1.0)]
    got = dynamics.internal_coordinates(world(spark, rows, 9.0)[0], 0, 1, 2, 3).first()
    assert got.distance == 1.0 and math.isclose(got.angle, 90.0) and math.isclose(abs(got.dihedral), 90.0)
