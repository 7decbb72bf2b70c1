"""Quantities with dimensions: STRUCT<mag DOUBLE, unit STRING, si DOUBLE, dims ARRAY<INT>, factor DOUBLE> (metre, second, kilogram).

factor is the unit's, so that results keep the unit without a look-up.  Units
named in Python are looked up there; those of texts once for each text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import let

UNIT_ERROR = "#UNIT!"
#: Factor to SI base units and the exponents of metre, second and kilogram.
BASE = {
    "m": (1.0, (1, 0, 0)),
    "meter": (1.0, (1, 0, 0)),
    "meters": (1.0, (1, 0, 0)),
    "mi": (1609.344, (1, 0, 0)),
    "mile": (1609.344, (1, 0, 0)),
    "miles": (1609.344, (1, 0, 0)),
    "ft": (0.3048, (1, 0, 0)),
    "feet": (0.3048, (1, 0, 0)),
    "inch": (0.0254, (1, 0, 0)),
    "yd": (0.9144, (1, 0, 0)),
    "s": (1.0, (0, 1, 0)),
    "second": (1.0, (0, 1, 0)),
    "seconds": (1.0, (0, 1, 0)),
    "min": (60.0, (0, 1, 0)),
    "minutes": (60.0, (0, 1, 0)),
    "h": (3600.0, (0, 1, 0)),
    "hour": (3600.0, (0, 1, 0)),
    "hours": (3600.0, (0, 1, 0)),
    "day": (86400.0, (0, 1, 0)),
    "days": (86400.0, (0, 1, 0)),
    "g": (0.001, (0, 0, 1)),
    "lb": (0.45359237, (0, 0, 1)),
    "mph": (0.44704, (1, -1, 0)),
}
#: SI prefixes.
PREFIXES = {"n": 1e-9, "u": 1e-6, "m": 1e-3, "c": 1e-2, "k": 1e3, "M": 1e6, "G": 1e9}


def _names() -> dict[str, tuple[float, tuple[int, int, int]]]:
    known = dict(BASE)
    for name in ("m", "s", "g"):
        factor, dims = BASE[name]
        known |= {p + name: (f * factor, dims) for p, f in PREFIXES.items() if p + name not in known}
    return known


UNITS = _names()


def known(unit: str) -> tuple[float, tuple[int, ...]]:
    """Factor and dimensions of a unit or a quotient of two; an unknown name raises KeyError."""
    top, *low = [UNITS[x.strip()] for x in unit.split("/")]
    for factor, dims in low:
        top = (top[0] / factor, tuple(x - y for x, y in zip(top[1], dims)))
    return top


def _dims(dims: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(d) for d in dims])


def _table() -> Column:
    return F.create_map(*[x for name, (factor, dims) in UNITS.items() for x in (F.lit(name), F.struct(F.lit(factor).alias("factor"), _dims(dims).alias("dims")))])


def _unit(name: Column) -> Column:
    """struct<factor, dims> of a text's unit or quotient of two; NULL if one is unknown."""

    def of(found: Column) -> Column:
        a, b = found[0], F.get(found, F.lit(1))
        two = F.struct((a["factor"] / b["factor"]).alias("factor"), F.zip_with(a["dims"], b["dims"], lambda x, y: x - y).alias("dims"))
        return F.when(F.exists(found, lambda u: u.isNull()) | (F.size(found) > 2), None).when(F.size(found) == 1, a).otherwise(two)

    table = _table()
    return let(F.transform(F.split(name, "/"), lambda x: table[F.trim(x)]), of)


def _qty(si: Column, dims: Column, unit: Column, factor: Column) -> Column:
    return F.when(si.isNotNull() & dims.isNotNull(), F.struct((si / factor).alias("mag"), unit.alias("unit"), si.alias("si"), dims.alias("dims"), factor.alias("factor")))


def parse(text: Column) -> Column:
    """'100 km/h'; NULL without a known unit."""
    shape = r"^\s*([+-]?[0-9]+\.?[0-9]*)\s*([A-Za-z]+(?:\s*/\s*[A-Za-z]+)?)\s*$"
    name = F.regexp_replace(F.regexp_extract(text, shape, 2), r"\s", "")
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    found = let(_unit(name), lambda u: F.when(u.isNotNull(), _qty(number * u["factor"], u["dims"], name, u["factor"])))
    return F.when(text.rlike(shape), found)


def quantity(mag: Column, unit: str) -> Column:
    factor, dims = known(unit)
    return _qty(mag * factor, _dims(dims), F.lit(unit), F.lit(factor))


def plain(number: Column) -> Column:
    """A number as a quantity without dimensions."""
    return _qty(number.cast("double"), _dims((0, 0, 0)), F.lit(""), F.lit(1.0))


def _both(a: Column, b: Column, f) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: f(x["a"], x["b"]))


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """In the first one's unit; NULL (error() tells) if the dimensions differ."""
    return _both(a, b, lambda a, b: F.when(a["dims"] == b["dims"], _qty(a["si"] + b["si"] * sign, a["dims"], a["unit"], a["factor"])))


def error(a: Column, b: Column) -> Column:
    return F.when(a["dims"] != b["dims"], UNIT_ERROR)


def multiply(a: Column, b: Column) -> Column:
    """In SI base units; a factor without dimensions keeps the other's unit."""
    return _both(a, b, lambda a, b: F.when(b["unit"] == "", _qty(a["si"] * b["si"], a["dims"], a["unit"], a["factor"])).when(a["unit"] == "", _qty(a["si"] * b["si"], b["dims"], b["unit"], b["factor"])).otherwise(_qty(a["si"] * b["si"], F.zip_with(a["dims"], b["dims"], lambda x, y: x + y), F.lit("SI"), F.lit(1.0))))


def divide(a: Column, b: Column) -> Column:
    """NULL by 0."""
    return _both(a, b, lambda a, b: F.when(b["unit"] == "", _qty(a["si"] / F.nullif(b["si"], F.lit(0.0)), a["dims"], a["unit"], a["factor"])).otherwise(_qty(a["si"] / F.nullif(b["si"], F.lit(0.0)), F.zip_with(a["dims"], b["dims"], lambda x, y: x - y), F.lit("SI"), F.lit(1.0))))


def power(a: Column, n: int) -> Column:
    return let(a, lambda a: _qty(F.pow(a["si"], F.lit(n)), F.transform(a["dims"], lambda x: x * n), F.lit("SI"), F.lit(1.0)))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 in SI units; NULL if the dimensions differ."""
    return _both(a, b, lambda a, b: F.when(a["dims"] == b["dims"], F.signum(a["si"] - b["si"]).cast("int")))


def number(a: Column) -> Column:
    """What a sum takes: only a quantity without dimensions has a number."""
    return let(a, lambda a: F.when(F.forall(a["dims"], lambda x: x == 0), a["si"]))


def CONVERT(a: Column, unit: str) -> Column:
    """Magnitude in another unit; NULL if the dimensions differ."""
    factor, dims = known(unit)
    return let(a, lambda a: F.when(a["dims"] == _dims(dims), a["si"] / factor))
