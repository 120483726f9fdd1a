"""Queries over the derived trajectories, one or more for each operator; plans.oracles has the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cluster import shared_folder
from ..operators import building, charges, dynamics, network, selection, structure
from ..sources import grid, sinks, text
from .oracles import CUTOFFS, LENGTHS, MODIFIER, ORACLES, STATES, WEIGHTS, XRAY
from ..streaming import frames as streamed
from .trajectories import charge_grid, cube, net, tilted

__all__ = ["ORACLES", "QUERIES"]
GR = (0.01, 4.0, 0.23)
FORMERS, LIGANDS, QN = ["P", "Al"], ["O"], ["P"]


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def _gr(s: SparkSession, d: str) -> DataFrame:
    return _rounded(structure.radial_distribution(*cube(s, d), *GR), "r", "gr", "cn", "rho_g")


def _sq(s: SparkSession, d: str) -> DataFrame:
    traj = cube(s, d)
    return structure.structure_factor(structure.radial_distribution(*traj, *GR), structure.number_density(*traj), GR[2], 0.5, 5.0, 0.5)


def _weighted(s: SparkSession, d: str, factors: DataFrame) -> DataFrame:
    out = structure.weighted_structure_factor(_sq(s, d), structure.conserved_counts(*cube(s, d)), factors)
    return _rounded(out, "q", "sq", "part", "total")


def _neutron(s: SparkSession, d: str) -> DataFrame:
    return _weighted(s, d, s.createDataFrame(list(LENGTHS.items()), "type string, b double"))


def _xray(s: SparkSession, d: str) -> DataFrame:
    return _weighted(s, d, s.createDataFrame([(k, *v) for k, v in XRAY.items()], "type string, a array<double>, s array<double>, c double"))


def _masses(s: SparkSession) -> DataFrame:
    return s.createDataFrame(list(WEIGHTS.items()), "element string, mass double")


def _bonds(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    network.validate(CUTOFFS, MODIFIER, QN)
    atoms, frames = net(s, d)
    return atoms, frames, network.bonds(atoms, frames, CUTOFFS)


def _formers(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    atoms, frames, b = _bonds(s, d)
    return network.formers(atoms, b, FORMERS), frames


def _ligands(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    atoms, frames, b = _bonds(s, d)
    return network.ligand_classes(atoms, b, LIGANDS), frames


def _modifiers(s: SparkSession, d: str) -> DataFrame:
    return network.modifiers(*net(s, d), MODIFIER)


def _share(rows: DataFrame, by: list[str], frames: DataFrame) -> DataFrame:
    return _rounded(network.fractions(rows, ["element"], by, frames), "mean", "sd")


def _coordination(s: SparkSession, d: str) -> DataFrame:
    f, frames = _formers(s, d)
    return _share(f.select("file", "frame", "element", "cn").union(_modifiers(s, d).select("file", "frame", "element", "cn")), ["cn"], frames)


def _composition(s: SparkSession, d: str) -> DataFrame:
    atoms, frames, b = _bonds(s, d)
    f, lig = network.formers(atoms, b, FORMERS), network.ligand_classes(atoms, b, LIGANDS)
    return _rounded(network.composition_table(f, lig, _modifiers(s, d), QN, frames), "mean", "sd")


def _labels(s: SparkSession, d: str) -> DataFrame:
    atoms, _, b = _bonds(s, d)
    return network.labels(atoms, network.formers(atoms, b, FORMERS), network.ligand_classes(atoms, b, LIGANDS), _modifiers(s, d), QN)


def _clusters(s: SparkSession, d: str) -> DataFrame:
    atoms, _, b = _bonds(s, d)
    return network.cluster_sites(b, network.formers(atoms, b, FORMERS))


def _folder(s: SparkSession) -> str:
    return shared_folder(s, "round-trip")


def _back(rows: DataFrame, *names: str, digits: int = 6, shift: float = 0.0) -> DataFrame:
    """What a reader found in files that write_blocks wrote, by the number in the folder's name; shifted off the halves of the last digit."""
    out = rows.withColumn("file", F.regexp_extract("file", r"file=(\d+)", 1).cast("long"))
    return out.select("file", "frame", "aid", "element", *[F.round(F.col(c) + shift, digits).alias(c) for c in names])


def _files(s: SparkSession, folder: str) -> list[str]:
    return [r.path for r in s.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("path").collect()]


def _extxyz(s: SparkSession, d: str) -> DataFrame:
    folder, (atoms, frames) = _folder(s), tilted(s, d)
    sinks.write_blocks(sinks.extxyz_blocks(atoms, frames), folder)
    return _back(text.read_lines(s, _files(s, folder), text.parse_extxyz), "x", "y", "z", "m00", "m21")


def _dump(s: SparkSession, d: str) -> DataFrame:
    folder, (atoms, frames) = _folder(s), tilted(s, d)
    sinks.write_blocks(sinks.dump_blocks(atoms, frames), folder)
    return _back(text.read_lammps_dump(s, _files(s, folder)), "x", "y", "z", "m00", "m21")


def _poscar(s: SparkSession, d: str) -> DataFrame:
    folder, (atoms, frames) = _folder(s), tilted(s, d)
    sinks.write_blocks(sinks.poscar_blocks(atoms, frames), folder)
    return _back(text.read_lines(s, _files(s, folder), text.parse_poscar), "x", "y", "z", "m00", "m21").select("file", "element", "x", "y", "z", "m00", "m21")


def _first_frame(s: SparkSession, d: str, blocks, parse) -> DataFrame:
    folder = _folder(s)
    sinks.write_blocks(blocks(*tilted(s, d)), folder)
    return _back(text.read_lines(s, _files(s, folder), parse), "x", "y", "z", "m00", "m21").drop("frame")


def _cif(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    sinks.write_blocks(sinks.cif_blocks(*tilted(s, d)), folder)
    return _back(text.read_lines(s, _files(s, folder), text.parse_cif), "x", "y", "z", "m00", "m21", digits=4, shift=1.23e-5)


def _pdb(s: SparkSession, d: str) -> DataFrame:
    folder, (atoms, frames) = _folder(s), cube(s, d)
    sinks.write_blocks(sinks.pdb_blocks(atoms, frames), folder)
    return _back(text.read_lines(s, _files(s, folder), text.parse_pdb), "m00")


def _grid(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    v = structure.voxel_density(*cube(s, d), 5).where("file < 2")
    cell = F.array(*[F.lit(16.0 if i == j else 0.0) for i in range(3) for j in range(3)])
    rows = v.select("file", *[F.lit(5).cast("long").alias(f"n{i}") for i in range(3)], cell.alias("cell"), *[F.col(f"i{x}").alias(f"i{i}") for i, x in enumerate("xyz")], F.col("count").cast("double").alias("value"))
    sinks.write_blocks(sinks.cube_blocks(rows).withColumn("frame", F.lit(0)), folder)
    out = grid.read_grid(s, _files(s, folder), "cube")
    return out.select(F.regexp_extract("file", r"file=(\d+)", 1).cast("long").alias("file"), "i0", "i1", "i2", "value", F.round(F.element_at("cell", 1), 4).alias("m00"))


def _wrapped(s: SparkSession, d: str) -> DataFrame:
    """Positions come near exact halves of the last digit, so they are moved off them before they are rounded."""
    atoms, frames = tilted(s, d)
    out = selection.wrapped(selection.translated(atoms, (21.0, -3.0, 40.0)), frames)
    return out.select("file", "frame", "aid", *[F.round(F.col(x) + 1.23e-7, 6).alias(x) for x in "xyz"])


def _merged(s: SparkSession, d: str) -> DataFrame:
    atoms, frames = cube(s, d)
    both, cell = building.merge((atoms, frames), tilted(s, d), 2, 1.5)
    return _rounded(both.select("file", "frame", "aid", "element", "x", "y", "z").join(cell.select("file", "frame", "m00", "m22"), ["file", "frame"]), "x", "y", "z", "m00", "m22")


def _oxidation(s: SparkSession, d: str) -> DataFrame:
    counts = cube(s, d)[0].where("frame = 0 and aid < 12").groupBy("file", "element").agg(F.count("*").alias("n"))
    return building.oxidation_states(counts, s.createDataFrame(STATES, "element string, electronegativity double, state int"))


def _info(s: SparkSession, d: str) -> DataFrame:
    out = building.frame_info(*tilted(s, d))
    return _rounded(out, "a", "b", "c", "alpha", "beta", "gamma", "volume", "density").select("file", "frame", "n", "composition", "a", "b", "c", "alpha", "beta", "gamma", "volume", "density", "unknown")


def _typed(s: SparkSession, d: str) -> DataFrame:
    names = _labels(s, d).select(F.concat(F.col("label"), F.when(F.col("aid") % 7 == 0, "_x").otherwise("")).alias("name")).distinct()
    return selection.typed_labels(names.union(s.createDataFrame([("Xx_1",), ("plain",)], "name string")))


def _csv(s: SparkSession, d: str) -> DataFrame:
    table = _rounded(network.pooled_means(_formers(s, d)[0], _modifiers(s, d), QN), "mean_cn", "mean_qn", "mean_n_bo")
    return sinks.csv_lines(table, ["file", "element"], ["pooled means"]).select("part", "line")


def _volumes(s: SparkSession, d: str) -> DataFrame:
    points, atoms = charge_grid(s, d)
    return _rounded(charges.volume_charges(points, atoms, 0.02), "charge", "size", "distance").na.fill(-1, ["peak", "aid"])


def _atom_charges(s: SparkSession, d: str) -> DataFrame:
    points, atoms = charge_grid(s, d)
    return _rounded(charges.atom_charges(charges.volume_charges(points, atoms, 0.02), atoms), "charge", "size", "distance")


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """Voxel counts of atoms that arrive as files of a stream."""
    folder, name = _folder(s), f"voxels_{uuid.uuid4().hex}"
    cube(s, d)[0].select("file", "x", "y", "z").write.parquet(f"{folder}/atoms")
    stream = s.readStream.schema("file long, x double, y double, z double").option("maxFilesPerTrigger", 4).parquet(f"{folder}/atoms")
    return streamed.run_once(streamed.voxel_counts(stream, (16.0, 16.0, 16.0), (4, 4, 4)), name, f"{folder}/state")


_TILT_GR = ("r", "gr", "cn", "rho_g")
QUERIES = {
    "radial_distribution": _gr,
    "radial_distribution_tilted": lambda s, d: _rounded(structure.radial_distribution(*tilted(s, d), 0.01, 6.0, 0.37), *_TILT_GR),
    "radial_distribution_clamped": lambda s, d: _rounded(structure.radial_distribution(*cube(s, d), 5.01, 20.0, 0.53), *_TILT_GR),
    "number_density": lambda s, d: _rounded(structure.number_density(*tilted(s, d)), "rho", "v_mean", "v_sd"),
    "structure_factor": lambda s, d: _rounded(_sq(s, d), "q", "sq"),
    "neutron_structure_factor": _neutron,
    "xray_structure_factor": _xray,
    "mean_squared_displacement": lambda s, d: dynamics.mean_squared_displacement(*cube(s, d), 10).select("file", "lag", "time", "msd"),
    "mean_squared_displacement_tilted": lambda s, d: _rounded(dynamics.mean_squared_displacement(*tilted(s, d), 8, 2), "msd", "msd_a", "msd_b", "msd_c"),
    "displacement_without_cell": lambda s, d: _rounded(dynamics.mean_squared_displacement(cube(s, d)[0], None, 6, 3), "msd", "msd_a", "msd_b", "msd_c"),
    "displacement_all_lags": lambda s, d: dynamics.all_lags_displacement(cube(s, d)[0]),
    "diffusion": lambda s, d: _rounded(dynamics.diffusion(dynamics.mean_squared_displacement(*cube(s, d), 10), 0.2, 0.8), "d", "intercept", "r2"),
    "velocity_autocorrelation": lambda s, d: _rounded(dynamics.velocity_autocorrelation(cube(s, d)[0], 10), "vacf", "vacf_x", "vacf_y", "vacf_z", "diffusion"),
    "van_hove": lambda s, d: _rounded(dynamics.van_hove(*cube(s, d), 3, 6.0, 0.23), "r", "gs"),
    "van_hove_tilted": lambda s, d: _rounded(dynamics.van_hove(*tilted(s, d), 4, 5.0, 0.29, 0.3, 2, ["Si"]), "r", "gs"),
    "jumps": lambda s, d: dynamics.jumps(*cube(s, d), 2, 1.3, 8),
    "jumps_tilted": lambda s, d: dynamics.jumps(*tilted(s, d), 3, 1.7, (7, 6, 5), "midpoint"),
    "rotational_correlation": lambda s, d: _rounded(dynamics.rotational_correlation(*cube(s, d), "Si", "O", 3.0, 5), "c2", "integral"),
    "shape": lambda s, d: _rounded(dynamics.shape(cube(s, d)[0], _masses(s)), "com_x", "com_y", "com_z", "rg"),
    "rmsd": lambda s, d: _rounded(dynamics.rmsd(cube(s, d)[0]), "rmsd"),
    "internal_coordinates": lambda s, d: _rounded(dynamics.internal_coordinates(cube(s, d)[0], 3, 17, 41, 88), "distance", "angle", "dihedral"),
    "bond_angles": lambda s, d: _rounded(structure.bond_angles(*cube(s, d), 2.5, 2.1, 7.3, 12.0, 171.0), "angle", "p"),
    "angle_statistics": lambda s, d: _rounded(structure.angle_statistics(structure.bond_angles(*cube(s, d), 2.5, None, 7.3)), "mean", "sd"),
    "voxel_density": lambda s, d: _rounded(structure.voxel_density(*cube(s, d), 8), "density", "speed"),
    "voxel_force": lambda s, d: _rounded(structure.voxel_density(cube(s, d)[0].withColumns({f"force_{x}": F.col(f"v{x}") * 2 for x in "xyz"}), cube(s, d)[1], (4, 5, 6), ["Si"]), "density", "speed", "force"),
    "sphere_occupancy": lambda s, d: structure.sphere_occupancy(*cube(s, d), 6, 2.3, ["Si"]),
    "mean_positions": lambda s, d: structure.mean_positions(cube(s, d)[0]),
    "ligand_classes": lambda s, d: _share(_ligands(s, d)[0], ["kind"], net(s, d)[1]),
    "ligand_types": lambda s, d: _rounded(network.ligand_table(*_ligands(s, d)), "mean", "sd"),
    "qn_species": lambda s, d: _rounded(network.qn_table(_formers(s, d)[0], QN, net(s, d)[1]), "mean", "sd"),
    "qn_partners": lambda s, d: _rounded(network.qn_partner_table(_formers(s, d)[0], QN, net(s, d)[1]), "mean", "sd"),
    "coordination": _coordination,
    "composition": _composition,
    "pooled_means": lambda s, d: _rounded(network.pooled_means(_formers(s, d)[0], _modifiers(s, d), QN), "mean_cn", "mean_qn", "mean_n_bo"),
    "linkages": lambda s, d: _rounded(network.linkages(_bonds(s, d)[2], net(s, d)[1]), "mean", "sd"),
    "edge_sharing": lambda s, d: network.edge_sharing(*_bonds(s, d)[:0:-1]),
    "site_labels": _labels,
    "network_clusters": _clusters,
    "typed_labels": _typed,
    "select_tail": lambda s, d: selection.select_frames(selection.tail(cube(s, d)[0], 8), 0, None, 2).select("file", "frame", "aid", "element", "x", "y", "z"),
    "spread_frames": lambda s, d: cube(s, d)[0].where(F.col("frame").isin(selection.spread(25, 4))).groupBy("file", "frame").agg(F.count("*").alias("n")),
    "of_elements": lambda s, d: selection.of_elements(cube(s, d)[0], ["Si"]).groupBy("file", "frame").agg(F.count("*").alias("n")),
    "supercell": lambda s, d: selection.supercell(*cube(s, d), 2, 1, 3)[0].select("file", "frame", "aid", "element", "x", "y", "z"),
    "vacuum": lambda s, d: _rounded(selection.vacuum(tilted(s, d)[1], 2, 7.5), "m20", "m21", "m22").select("file", "frame", "m00", "m20", "m21", "m22"),
    "centered": lambda s, d: _rounded(selection.centered(cube(s, d)[0], _masses(s)), "x", "y", "z").select("file", "frame", "aid", "x", "y", "z"),
    "wrapped": _wrapped,
    "merged": _merged,
    "frame_info": _info,
    "electron_counts": lambda s, d: building.electron_counts(cube(s, d)[0], 1),
    "oxidation_states": _oxidation,
    "spin_guess": lambda s, d: building.spin_guess(cube(s, d)[0].where("aid < 12"), s.createDataFrame(STATES, "element string, electronegativity double, state int")),
    "extxyz_round_trip": _extxyz,
    "dump_round_trip": _dump,
    "poscar_round_trip": _poscar,
    "pdb_round_trip": _pdb,
    "data_round_trip": lambda s, d: _first_frame(s, d, sinks.lammps_data_blocks, text.parse_lammps_data),
    "qe_round_trip": lambda s, d: _first_frame(s, d, sinks.qe_blocks, text.parse_qe),
    "cif_round_trip": _cif,
    "cube_round_trip": _grid,
    "csv_table": _csv,
    "charge_volumes": _volumes,
    "atom_charges": _atom_charges,
    "streamed_voxels": _streamed,
}
