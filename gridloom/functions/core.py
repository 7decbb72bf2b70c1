"""The sheet's scalar functions and aggregates over Values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Value

# ---- aggregates: every argument of any kind, what has no number is skipped


def SUM(*args: object) -> Column:
    """Sum of all numbers; 0 without any."""
    return reduce(lambda a, b: a + b, (F.coalesce(F.sum(Value.of(a).number), F.lit(0.0)) for a in args))


def COUNT(*args: object) -> Column:
    """How many values have a number."""
    return reduce(lambda a, b: a + b, (F.count(Value.of(a).number) for a in args)).cast("double")


def AVERAGE(*args: object) -> Column:
    """Mean of all numbers; empty without any."""
    return SUM(*args) / F.nullif(COUNT(*args), F.lit(0.0))


MEAN = AVG = AVERAGE


def _no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def MIN(*args: object) -> Column:
    """Least number, NaN aside; empty without any."""
    parts = [F.min(_no_nan(Value.of(a).number)) for a in args]
    return F.least(*parts) if len(parts) > 1 else parts[0]


def MAX(*args: object) -> Column:
    parts = [F.max(_no_nan(Value.of(a).number)) for a in args]
    return F.greatest(*parts) if len(parts) > 1 else parts[0]


def CONCAT(value: object, order: Column) -> Column:
    """All displayed texts in the order of `order`. Its size is that of the result, which one task holds."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("at"), Value.of(value).text.alias("text")))), lambda x: x["text"]), "")


# ---- elementwise


def ABS(x: object) -> Value:
    x = Value.of(x)
    return Value(F.abs(x.number), "number", x.err)


def ROUND(x: object, decimals: object = 0) -> Value:
    """Half away from zero of x * 10^d in doubles; what is no number is left out before places are taken, so ROUND("x", 2) is 2."""
    x, decimals = Value.of(x), Value.of(decimals)
    shift = F.pow(F.lit(10.0), F.when(decimals.number < 0, F.ceil(decimals.number)).otherwise(F.floor(decimals.number)).cast("double"))
    scaled = x.number * shift
    size = F.abs(scaled)
    low = F.floor(F.when(size < 2.0**52, size)).cast("double")
    near = F.when(size >= 2.0**52, scaled).otherwise(F.signum(scaled) * (low + F.when(size - low >= 0.5, 1.0).otherwise(0.0)))
    alone = Value(decimals.number, "number")
    return Value(F.coalesce(near / shift, alone.number) if decimals.kind != "empty" else near / shift, "number", x.err)


def LEN(x: object) -> Value:
    """Bytes (UTF-8) of the displayed text."""
    x = Value.of(x)
    return Value(F.octet_length(x.text).cast("double"), "number", x.err)


def UPPER(x: object) -> Value:
    x = Value.of(x)
    return Value(F.upper(x.text), "text", x.err)


def LOWER(x: object) -> Value:
    x = Value.of(x)
    return Value(F.lower(x.text), "text", x.err)


def JOIN(*args: object) -> Value:
    """CONCAT of single values."""
    vs = [Value.of(a) for a in args]
    return Value(F.concat(*[v.text for v in vs]), "text", vs[0].error(*vs[1:]))


def IF(condition: object, then: object = None, otherwise: object = None, eager: bool = True) -> Value:
    """Branches of one kind keep it, else the result is text. All arguments are evaluated first, so an error in either branch is the result; with eager off only the chosen branch's is."""
    c, a, b = Value.of(condition), Value.of(then), Value.of(otherwise)
    kinds = {(v.kind, v.handler.tag if v.handler else None) for v in (a, b) if v.kind != "empty"}
    handler = next((v.handler for v in (a, b) if v.handler is not None), None) if len(kinds) == 1 else None
    kind = kinds.pop()[0] if len(kinds) == 1 else "text" if kinds else "empty"

    def as_(v: Value) -> Column:
        if kind == "text":
            return v.text if v.kind != "text" else v.col
        if kind == "custom":
            return F.lit(None) if v.kind == "empty" else v.col
        return v.col.cast({"number": "double", "boolean": "boolean"}.get(kind, "double"))

    out = F.when(c.truth, as_(a)).otherwise(as_(b))
    err = c.error(a, b) if eager else None
    if not eager and (a.err is not None or b.err is not None or c.err is not None):
        none = F.lit(None).cast("string")
        err = F.coalesce(c.err if c.err is not None else none, F.when(c.truth, a.err if a.err is not None else none).otherwise(b.err if b.err is not None else none))
    return Value(out, kind, err, handler)
