"""Conversions of length, energy, pressure and time as factors."""

from __future__ import annotations

from pyspark.sql import Column

#: Each unit in the first one of its kind.
UNITS = {
    "length": {"angstrom": 1.0, "bohr": 0.5291772109, "nm": 10.0},
    "energy": {"ev": 1.0, "hartree": 27.211396132, "kcal/mol": 1.0 / 23.0605419, "kj/mol": 1.0 / 96.4853321, "cm-1": 1.0 / 8065.544},
    "pressure": {"gpa": 1.0, "ev/a3": 160.2176634, "kbar": 0.1},
    "time": {"fs": 1.0, "ps": 1000.0, "ns": 1e6},
}


def factor(kind: str, source: str, target: str) -> float:
    """What a value in source is multiplied by to be in target."""
    return UNITS[kind][source.lower()] / UNITS[kind][target.lower()]


def convert(c: Column, kind: str, source: str, target: str) -> Column:
    return c * factor(kind, source, target)
