"""Chemical elements by atomic number, and lookups of a symbol or a site label as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The symbols of the elements 1 to 118, in order.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd "
    "In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu "
    "Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()
NUMBER = {s: z for z, s in enumerate(SYMBOLS, 1)}
UNKNOWN = 255

#: Standard atomic weights (IUPAC, abridged) of the elements that the queries, the formula reader and its tests use.
WEIGHTS = {
    "H": 1.008, "Li": 6.94, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974,
    "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Ti": 47.867, "Fe": 55.845, "Cu": 63.546, "Zn": 65.38, "Sr": 87.62, "Zr": 91.224, "Ba": 137.327, "Pb": 207.2,
}


def atomic_number(symbol: Column) -> Column:
    """Z of a symbol or of a label that starts with one: the whole, its first two letters, its first letter; else 255."""
    table = F.create_map(*[F.lit(x) for s, z in NUMBER.items() for x in (s, z)])
    return F.coalesce(table[symbol], table[F.substring(symbol, 1, 2)], table[F.substring(symbol, 1, 1)], F.lit(UNKNOWN))


def before(a: Column, b: Column) -> Column:
    """Whether type a stands at or before type b: by atomic number, then as text."""
    za, zb = atomic_number(a), atomic_number(b)
    return (za < zb) | ((za == zb) & (a <= b))


def group_key(by: str) -> Column:
    """What an atom is grouped by: its element, or its label where it has one."""
    if by not in ("element", "label"):
        raise ValueError("by is element or label")
    return F.col("element") if by == "element" else F.coalesce("label", "element")


def mass_of(symbol: Column) -> Column:
    """Atomic weight; 1 for an element that isn't in WEIGHTS."""
    return F.coalesce(F.create_map(*[F.lit(x) for s, w in WEIGHTS.items() for x in (s, w)])[symbol], F.lit(1.0))
