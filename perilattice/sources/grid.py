"""Readers of volumetric grids: Gaussian cube files and charge densities behind a POSCAR header; a row per voxel."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .text import BOHR, _lines

#: Voxels in a batch.
VOXELS = 1 << 17
SCHEMA = "file string, n0 long, n1 long, n2 long, cell array<double>, i0 long, i1 long, i2 long, value double"


def _values(lines: Iterator[str]) -> Iterator[float]:
    for line in lines:
        yield from map(float, line.split())


def cube_head(lines: Iterator[str]) -> tuple[list[int], list[float]]:
    """(shape, cell in Angstrom) of a cube file; leaves lines at the first value."""
    next(lines), next(lines)
    atoms = int(next(lines).split()[0])
    shape, cell = [], []
    for _ in range(3):
        n, *v = next(lines).split()
        shape.append(abs(int(n)))
        cell += [float(x) * abs(int(n)) * BOHR for x in v]
    for _ in range(abs(atoms) + (atoms < 0)):
        next(lines)
    return shape, cell


def charge_head(lines: Iterator[str]) -> tuple[list[int], list[float]]:
    next(lines)
    scale = float(next(lines))
    cell = [float(x) * scale for _ in range(3) for x in next(lines).split()]
    counts = next(lines).split()
    if not counts[0].isdigit():
        counts = next(lines).split()
    mode = next(lines)
    if mode.strip().lower().startswith("s"):
        next(lines)
    for _ in range(sum(map(int, counts))):
        next(lines)
    shape = next(x for x in lines if x.strip()).split()
    return [int(x) for x in shape[:3]], cell


def read_grid(spark: SparkSession, paths: str | list[str], kind: str = "cube") -> DataFrame:
    """file, n0 .. n2, cell, i0 .. i2 and value of each voxel. A cube's last index runs fastest, a charge density's first.

    Cube values are as they stand; those of a charge density (only its first grid) are density times cell volume. Files are read
    in batches, a task for each.
    """
    names = spark.read.format("binaryFile").load(paths).select("path")
    head = {"cube": cube_head, "charge": charge_head}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace(":/", ":///", 1))
                with store.open_input_stream(inner) as f:
                    lines = _lines(f)
                    (n0, n1, n2), cell = head(lines)
                    values, at, total = _values(lines), 0, n0 * n1 * n2
                    while at < total:
                        part = list(itertools.islice(values, min(VOXELS, total - at)))
                        if not part:
                            raise ValueError(f"{path} has {at} of {total} values")
                        k = range(at, at + len(part))
                        index = [(i // (n1 * n2), i // n2 % n1, i % n2) for i in k] if kind == "cube" else [(i % n0, i // n0 % n1, i // (n0 * n1)) for i in k]
                        m = len(part)
                        yield pa.RecordBatch.from_pydict({"file": [path] * m, "n0": [n0] * m, "n1": [n1] * m, "n2": [n2] * m, "cell": [cell] * m, "i0": [x[0] for x in index], "i1": [x[1] for x in index], "i2": [x[2] for x in index], "value": part})
                        at += m

    return names.mapInArrow(run, SCHEMA)
