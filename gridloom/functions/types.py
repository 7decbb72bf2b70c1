"""Dates, times, zones, spans and quantities as custom types of Values: what their operators, comparisons and numbers are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import temporal, units
from .custom import CustomType
from .values import DIV0, VALUE, Value, judged


def _failed(value: Column, *inputs: Value) -> Column:
    """#VALUE! where no input is empty and yet nothing comes out."""
    there = F.lit(True)
    for v in inputs:
        there = there & v.col.isNotNull()
    return F.when(there & value.isNull(), VALUE)


class Temporal(CustomType):
    """One kind of temporal.py."""

    def __init__(self, kind: str):
        self.tag = kind

    @property
    def numeric(self) -> bool:
        return self.tag not in ("span", "zone")

    def parse(self, text: Column) -> Column:
        return temporal.try_parse(self.tag, text)

    def parse_with(self, text: Column, fmt: str) -> Column:
        return temporal.try_parse(self.tag, text, fmt)

    def display(self, data: Column) -> Column:
        return temporal.friendly(data) if self.tag == "span" else temporal.ISO(data, self.tag)

    def edit_text(self, data: Column) -> Column:
        return temporal.ISO(data, self.tag)

    def number(self, data: Column) -> Column:
        return temporal.number(data, self.tag) if self.numeric else super().number(data)

    def binary(self, op: str, left: Value, right: Value) -> Value | None:
        a, b = (v.handler.tag if isinstance(v.handler, Temporal) else v.kind for v in (left, right))
        if op in "+-" and a in temporal.ADD and b == "span":
            return self._made(temporal.ADD[a](left.col, right.col, 1 if op == "+" else -1), TYPES[a], left, right)
        if op == "+" and a == "span" and b in temporal.ADD:
            return self._made(temporal.ADD[b](right.col, left.col), TYPES[b], left, right)
        if op == "-" and a == b and a in temporal.ADD:
            return self._made(temporal.difference(left.col, right.col, a), TYPES["span"], left, right)
        if op in "+-" and a == b == "span":
            return self._made(temporal.span_sum(left.col, right.col, 1 if op == "+" else -1), TYPES["span"], left, right)
        if op == "*" and "span" in (a, b):
            span, other = (left, right) if a == "span" else (right, left)
            if other.kind != "number":
                return Value(F.lit(None), "empty", F.when(span.col.isNotNull() & other.col.isNotNull(), VALUE))
            return self._made(temporal.span_times(span.col, other.number), TYPES["span"], span, other)
        return None

    @staticmethod
    def _made(out: Column, kind: Temporal, *inputs: Value) -> Value:
        if all(v.err is None for v in inputs):
            return Value(out, "custom", _failed(out, *inputs), kind)
        return judged(out, "custom", lambda o: _failed(o, *inputs), kind)

    def compare(self, left: Value, right: Value) -> Column | None:
        if isinstance(left.handler, Temporal) and isinstance(right.handler, Temporal) and left.handler.tag == right.handler.tag:
            return temporal.order(left.col, right.col, self.tag)
        return None


class Quantity(CustomType):
    """Quantities of units.py; numbers have no dimensions."""

    tag = "qty"

    def parse(self, text: Column) -> Column:
        return units.parse(text)

    def display(self, data: Column) -> Column:
        from .values import render_number

        return F.concat(render_number(data["mag"]), F.lit(" "), data["unit"])

    edit_text = display

    def number(self, data: Column) -> Column:
        return units.number(data)

    @staticmethod
    def _sides(left: Value, right: Value) -> list[Column] | None:
        """Both sides as quantities."""
        if any(v.kind != "number" and not isinstance(v.handler, Quantity) for v in (left, right)):
            return None
        return [units.plain(v.number) if v.kind == "number" else v.col for v in (left, right)]

    def binary(self, op: str, left: Value, right: Value) -> Value | None:
        sides = self._sides(left, right)
        if sides is None or op not in "+-*/^":
            return None
        if op == "^":
            # A power's dimensions depend on the exponent, which has none itself.
            n, (a, b) = right.number, sides
            whole = F.when(n == F.rint(n), n.cast("int"))
            out = units.let(F.struct(a.alias("a"), whole.alias("n")), lambda x: F.when(x["n"].isNotNull(), units._qty(F.pow(x["a"]["si"], x["n"]), F.transform(x["a"]["dims"], lambda d: d * x["n"]), F.lit("SI"), F.lit(1.0))))
            return Value(out, "custom", F.when(left.col.isNotNull() & right.col.isNotNull() & out.isNull(), units.UNIT_ERROR), self)
        if op in "+-":
            return Value(units.add(*sides, 1 if op == "+" else -1), "custom", units.error(*sides), self)
        out = units.multiply(*sides) if op == "*" else units.divide(*sides)
        return Value(out, "custom", F.when(sides[1]["si"] == 0, DIV0) if op == "/" else None, self)

    def compare(self, left: Value, right: Value) -> Column | None:
        sides = self._sides(left, right)
        return None if sides is None else units.compare(*sides)

    def mismatch(self, left: Value, right: Value) -> Column | None:
        sides = self._sides(left, right)
        return None if sides is None else units.error(*sides)


TYPES: dict[str, CustomType] = {k: Temporal(k) for k in ("zoned", "datetime", "date", "time", "span", "zone")} | {"qty": Quantity()}


def value(kind: str, col: Column, err: Column | None = None) -> Value:
    """A column of a kind of TYPES as a Value."""
    return Value(col, "custom", err, TYPES[kind])


def of_data_type(col: Column, data_type: T.DataType) -> Value:
    """A table's column of dates or times as a Value: DATE is a date, both timestamps are date-times (an instant by the session's zone)."""
    if isinstance(data_type, T.DateType):
        return value("date", col)
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return value("datetime", col.cast(temporal.NTZ))
    return Value(col, "custom")
