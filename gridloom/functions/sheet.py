"""The sheet's functions by name, over Values: arguments of the kinds that each takes, failures as error values.

call("YEAR", v) gives a Value; its error column says #VALUE! where an argument
is of the wrong kind or empty, or where nothing comes out of it, and an error in
an argument is the result.  An unknown name raises KeyError (#NAME?).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import core, temporal, units, url
from .types import TYPES
from .values import VALUE, Value, bound, judged

DATES, CLOCKS, ANY = ("date", "datetime", "zoned"), ("time", "datetime", "zoned"), ("date", "time", "datetime", "zoned")


@dataclass
class Function:
    """f of the arguments' columns; takes: the kinds that each may have; gives: the result's kind, or the index of the argument that has it."""

    f: Callable[..., Column]
    takes: tuple[tuple[str, ...], ...]
    gives: str | int
    least: int
    #: Arguments that must be known when the formula is written: their places.
    fixed: tuple[int, ...] = ()
    #: f takes the kind of its first argument as `kind`.
    kinds: bool = False


def _civil(v: Value) -> Column:
    """The date-time of a date, date-time or zoned time."""
    return temporal.TO_DATETIME_OF(v.col) if v.handler.tag == "zoned" else v.col.cast(temporal.NTZ)


def _clock(v: Value) -> Column:
    return v.col if v.handler.tag == "time" else temporal.TO_TIME(_civil(v))


N, S, B = ("number",), ("text",), ("boolean",)
SPAN, ZONE, QTY = ("span",), ("zone", "text"), ("qty",)


def _table() -> dict[str, Function]:
    t = temporal
    out = {
        "DATE": Function(t.DATE, (N, N, N), "date", 3),
        "TODAY": Function(t.TODAY, (), "date", 0),
        "PARSE_DATE": Function(t.PARSE_DATE, (S, S), "date", 1, (1,)),
        "TIME": Function(t.TIME, (N, N, N, N), "time", 3),
        "PARSE_TIME": Function(t.PARSE_TIME, (S, S), "time", 1, (1,)),
        "DATETIME": Function(t.DATETIME, (N,) * 7, "datetime", 6),
        "PARSE_DATETIME": Function(t.PARSE_DATETIME, (S, S), "datetime", 1, (1,)),
        "TIMEZONE": Function(t.TIMEZONE, (S,), "zone", 1),
        "ZONED": Function(lambda d, z, mode="compatible": t.ZONED(d, t.TIMEZONE(z), mode), (("datetime",), ZONE, S), "zoned", 2, (2,)),
        "PARSE_ZONED": Function(t.PARSE_ZONED, (S, S), "zoned", 1, (1,)),
        "IN_TZ": Function(lambda z, tz: temporal.let(t.TIMEZONE(tz), lambda name: F.when(name.isNotNull(), t.IN_TZ(z, name))), (("zoned",), ZONE), "zoned", 2),
        "TO_UTC": Function(t.TO_UTC, (("zoned",),), "zoned", 1),
        "NOW": Function(t.NOW, (), "zoned", 0),
        "UTCNOW": Function(t.UTCNOW, (), "zoned", 0),
        "SPAN": Function(t.SPAN, (N,) * 7, "span", 7),
        "PARSE_SPAN": Function(t.PARSE_SPAN, (S,), "span", 1),
        "SPAN_TO_SECONDS": Function(t.SPAN_TO_SECONDS, (SPAN, ("date",)), "number", 1),
        "SPAN_TO_DAYS": Function(t.SPAN_TO_DAYS, (SPAN, ("date",)), "number", 1),
        "WEEKDAY": Function(lambda x, iso=None: t.WEEKDAY(x) if iso is None else F.when(iso, t.WEEKDAY(x)).otherwise(t.WEEKDAY(x, False)), (DATES, B), "number", 1),
        "IS_LEAP_YEAR": Function(t.IS_LEAP_YEAR, (DATES,), "boolean", 1),
        "TZ_NAME": Function(t.TZ_NAME, (("zoned",),), "text", 1),
        "TZ_OFFSET_SECONDS": Function(t.TZ_OFFSET_SECONDS, (("zoned",),), "number", 1),
        "IS_DST": Function(t.IS_DST, (("zoned",),), "boolean", 1),
        "TO_DATE": Function(t.TO_DATE, (DATES,), "date", 1),
        "TO_TIME": Function(lambda x: x, (CLOCKS,), "time", 1),
        "TO_DATETIME": Function(t.TO_DATETIME, (DATES, ("time",)), "datetime", 1),
        "FORMAT": Function(t.FORMAT, (ANY, S), "text", 2, (1,), True),
        "ISO": Function(t.ISO, (tuple(TYPES),), "text", 1, (), True),
        "DATEADD": Function(t.DATEADD, (ANY, SPAN), 0, 2, (), True),
        "DATESUB": Function(t.DATESUB, (ANY, SPAN), 0, 2, (), True),
        "CONVERT": Function(units.CONVERT, (QTY, S), "number", 2, (1,)),
        "URL_VALID": Function(url.URL_VALID, (S,), "boolean", 1),
        "URL_PORT": Function(url.URL_PORT, (S,), "number", 1),
        "URL_PATH_SEGMENT": Function(lambda u, n: url.URL_PATH_SEGMENT(u, int(n) if n == int(n) else 0), (S, N), "text", 2, (1,)),
        "URL_PARAM": Function(url.URL_PARAM, (S, S), "text", 2, (1,)),
        "URL_JOIN": Function(url.URL_JOIN, (S, S), "text", 2),
    }
    out["TO_ZONED"] = out["ZONED"]
    for name in ("SCHEME", "HOST", "PATH", "QUERY", "FRAGMENT", "ENCODE", "DECODE"):
        out[f"URL_{name}"] = Function(getattr(url, f"URL_{name}"), (S,), "text", 1)
    for name in ("YEARS", "MONTHS", "WEEKS", "DAYS", "HOURS", "MINUTES", "SECONDS"):
        out[name] = Function(getattr(t, name), (N,), "span", 1)
    for name in ("YEAR", "MONTH", "DAY", "DAYOFYEAR", "WEEKOFYEAR", "QUARTER"):
        out[name] = Function(t.DAY_ if name == "DAY" else getattr(t, name), (DATES,), "number", 1)
    for name in ("HOUR", "MINUTE", "SECOND", "NANOSECOND"):
        out[name] = Function(getattr(t, name), (CLOCKS,), "number", 1)
    for name in ("DAYS", "HOURS", "MINUTES", "SECONDS"):
        out[f"{name}_BETWEEN"] = Function(getattr(t, f"{name}_BETWEEN"), (ANY, ANY), "number", 2, (), True)
    return out


FUNCTIONS = _table()
#: Scalars of core.py: lenient, they take any value.
LENIENT: dict[str, Callable[..., Value]] = {"ABS": core.ABS, "ROUND": core.ROUND, "LEN": core.LEN, "UPPER": core.UPPER, "LOWER": core.LOWER, "IF": core.IF, "CONCAT": core.JOIN}


def _kind(v: Value) -> str:
    return v.handler.tag if v.handler is not None else v.kind


def call(name: str, *args: object) -> Value:
    """The function's value; fixed arguments (formats, modes, units, keys, segment numbers) are Python values."""
    key = name.upper()
    if key in LENIENT:
        return LENIENT[key](*args) if args else Value.of(None)
    if key not in FUNCTIONS:
        raise KeyError(f"#NAME? {name}")
    fn = FUNCTIONS[key]
    if not fn.least <= len(args) <= len(fn.takes):
        return _refused(fn, args)
    given = [None if i in fn.fixed else Value.of(x) for i, x in enumerate(args)]
    for i, (v, kinds) in enumerate(zip(given, fn.takes)):
        if v is not None and (_kind(v) not in kinds or (i and kinds == ANY and _kind(v) != _kind(given[0]))):
            return _refused(fn, args)
    made = lambda *values: _made(key, fn, args, list(values))
    values = [v for v in given if v is not None]
    return made(*values) if fn.f is temporal.IS_DST or not values else bound(values, made)


def _made(key: str, fn: Function, args: tuple, values: list[Value]) -> Value:
    """The value of checked arguments; values: those that are not fixed."""
    given, failed, rest = [], F.lit(False), list(values)
    for i, (x, kinds) in enumerate(zip(args, fn.takes)):
        if i in fn.fixed:
            given.append(x)
            continue
        v = rest.pop(0)
        failed = failed | v.col.isNull()
        if kinds == DATES and _kind(v) != "date":
            given.append(_civil(v))
        elif kinds == CLOCKS:
            given.append(_clock(v))
        else:
            given.append(v.number if kinds == N else v.col)
    out = fn.f(*given, **({"kind": _kind(values[0])} if fn.kinds else {}))
    before = [v.err for v in values if v.err is not None]

    def fail(out: Column) -> Column:
        err = F.when(failed | out.isNull(), units.UNIT_ERROR if key == "CONVERT" else VALUE)
        return F.coalesce(*before, err) if before else err

    gives = fn.gives if isinstance(fn.gives, str) else _kind(values[fn.gives])
    return judged(out, "custom" if gives in TYPES else gives, fail, TYPES.get(gives), bool(before) and fn.f is not temporal.IS_DST)


def _refused(fn: Function, args: tuple) -> Value:
    """#VALUE! in every row, or the error of an argument."""
    errors = [v.err for v in (Value.of(a) for a in args if not isinstance(a, Column)) if v.err is not None]
    return Value(F.lit(None).cast("string"), "text", F.coalesce(*errors, F.lit(VALUE)))
