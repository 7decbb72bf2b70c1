"""Spreadsheet values on Spark columns: typed columns with the sheet's coercions.

A Value is a Column with a static kind (number, text, boolean, empty, custom) and,
once an operation can fail, an error column beside it.  NULL stands for the empty
cell.  All rules are Column expressions, so Catalyst sees the whole formula.

A custom value has a handler (a custom.CustomType; dates, spans and quantities
have theirs in types.py).  Handlers are asked first for operators and
comparisons, the left side's and then the right one's; what both decline goes by
the handlers' numbers, as for any other value.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:
    from .custom import CustomType

#: The texts of error values.
DIV0, NA, REF, NAME, VALUE, SIZE, SPILL, CIRCULAR, LOADING = "#DIV/0!", "#N/A", "#REF!", "#NAME?", "#VALUE!", "#SIZE!", "#SPILL!", "#CIRCULAR!", "#LOADING!"

FINITE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
ENDLESS = r"^[+-]?(?i:inf|infinity|nan)$"


def text_number(c: Column) -> Column:
    """The number that a text reads as, else NULL; no blanks, no type suffixes."""
    sign = F.when(c.startswith("-"), -1.0).otherwise(1.0)
    endless = F.when(F.lower(c).endswith("nan"), F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    return F.when(c.rlike(FINITE), c.try_cast("double")).when(c.rlike(ENDLESS), endless)


def literal(c: Column) -> Column:
    """Typed reading of a cell's text: struct(kind, num, str, bool). A formula (leading =) keeps its text."""
    number = F.when(c.rlike(FINITE), c.try_cast("double"))
    number = F.when(F.abs(number) < float("inf"), number)
    logical = F.when(F.upper(c) == "TRUE", True).when(F.upper(c) == "FALSE", False)
    kind = F.when(c.isNull() | (c == ""), "empty").when(c.startswith("="), "formula").when(number.isNotNull(), "number").when(logical.isNotNull(), "boolean").otherwise("text")
    plain = kind.isin("text", "formula")
    return F.struct(kind.alias("kind"), F.when(kind == "number", number).alias("num"), F.when(plain, c).alias("str"), F.when(kind == "boolean", logical).alias("bool"))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x evaluated once and standing once in the plan, however often f names it."""
    return F.transform(F.array(x), f)[0]


def render_number(x: Column) -> Column:
    """The double's shortest digits without an exponent."""
    named = F.when(F.isnan(x), "NaN").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    whole = (x == F.rint(x)) & (F.abs(x) < 2.0**53) & (x != 0)
    middle = (F.abs(x) >= 1e-3) & (F.abs(x) < 1e7)

    def shortest(v: Column) -> Column:
        """As 1.25e-07: with 15 digits, or 16, if these read back as the number; the JVM's own text can have more than are needed."""
        texts = [F.format_string(f"%.{n}e", v) for n in (14, 15, 16)]
        return F.when(texts[0].try_cast("double") == v, texts[0]).when(texts[1].try_cast("double") == v, texts[1]).otherwise(texts[2])

    def spread(t: Column) -> Column:
        """The digits with the point moved by the exponent."""
        shape = r"^(-?)([0-9])\.([0-9]+?)0*e([+-][0-9]+)$"
        sign, first, rest, power = (F.regexp_extract(t, shape, i) for i in (1, 2, 3, 4))
        digits, power = F.concat(first, F.when(rest == "0", "").otherwise(rest)), power.try_cast("int")
        small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        large = F.concat(sign, F.substring(F.rpad(digits, 400, "0"), F.lit(1), F.greatest(power + 1, F.lit(0))), F.when(F.length(digits) > power + 1, F.concat(F.lit("."), F.substring(digits, power + 2, F.lit(400)))).otherwise(""))
        return F.when(power < 0, small).otherwise(large)

    plain = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.coalesce(named, F.when(x.isNull(), None).when(whole, x.try_cast("long").cast("string")).when(middle | (x == 0), plain).otherwise(let(let(x, shortest), spread)))


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(data_type, T.NullType):
        return "empty"
    return "custom"


def _unlike(order: Column) -> Column:
    return order != 0


def bound(values: list[Value], f: Callable[..., Value | None]) -> Value | None:
    """f of the values. Where one of them can fail, each stands once in the plan, as a struct of value and error, and so does the result: formulas may nest to any depth. Constants stay literals, so that what depends on them alone is worked out once."""
    if all(v.err is None for v in values):
        return f(*values)
    none, found = F.lit(None).cast("string"), []
    packed = {i: v.both if v.both is not None else F.struct(v.col.alias("value"), (none if v.err is None else v.err).alias("error")) for i, v in enumerate(values) if not v.constant}

    def body(s: Column) -> Column:
        inner = [v if v.constant else Value(s[f"a{i}"]["value"], v.kind, None if v.err is None else s[f"a{i}"]["error"], v.handler) for i, v in enumerate(values)]
        found.append(f(*inner))
        out = found[-1]
        if out is None:
            return none
        return out.both if out.both is not None else F.struct(out.col.alias("value"), (none if out.err is None else out.err).alias("error"))

    both = let(F.struct(*[p.alias(f"a{i}") for i, p in packed.items()]), body)
    out = found[-1]
    return None if out is None else Value(both["value"], out.kind, both["error"], out.handler, both)


def held(df: DataFrame, name: str, value: Value) -> tuple[DataFrame, Value]:
    """df with value and error in a column of its own, and the Value that reads them there: outputs that share a formula work it out once a row."""
    both = value.both if value.both is not None else F.struct(value.col.alias("value"), (F.lit(None).cast("string") if value.err is None else value.err).alias("error"))
    return df.withColumn(name, both), Value(F.col(name)["value"], value.kind, None if value.err is None else F.col(name)["error"], value.handler, F.col(name))


def judged(out: Column, kind: str, fail: Callable[[Column], Column | None], handler: CustomType | None = None, inside: bool = True) -> Value:
    """out with its error, and no value where there is one. inside: within bound(), where nothing else keeps out from being evaluated anew for each time that it is named."""

    def split(o: Column) -> tuple[Column, Column | None]:
        err = fail(o)
        return (o if err is None else F.when(err.isNull(), o)), err

    if not inside:
        value, err = split(out)
        return Value(value, kind, err, handler)

    def body(o: Column) -> Column:
        value, err = split(o)
        return F.struct(value.alias("value"), (F.lit(None).cast("string") if err is None else err).alias("error"))

    both = let(out, body)
    return Value(both["value"], kind, both["error"], handler, both)


@dataclass(eq=False)
class Value:
    """A typed column of a sheet; operators follow the sheet's rules and keep to expressions."""

    col: Column
    kind: str
    err: Column | None = None
    handler: CustomType | None = None
    #: struct<value, error>, of which col and err are the fields, where they were worked out together.
    both: Column | None = None
    #: Whether col is a literal that cannot fail.
    constant: bool = False

    @staticmethod
    def of(x: object) -> Value:
        if isinstance(x, Value):
            return x
        if x is None:
            return Value(F.lit(None).cast("double"), "empty", constant=True)
        if isinstance(x, bool):
            return Value(F.lit(x), "boolean", constant=True)
        if isinstance(x, (int, float)):
            return Value(F.lit(float(x)), "number", constant=True)
        if isinstance(x, str):
            return Value(F.lit(x), "text", constant=True)
        if isinstance(x, (datetime.date, datetime.datetime)):
            from .types import of_data_type

            return of_data_type(F.lit(x), T.DateType() if type(x) is datetime.date else T.TimestampNTZType())
        raise TypeError(f"a formula cannot hold {type(x).__name__}")

    # ---- coercions

    @property
    def number(self) -> Column:
        """The coerced number; NULL where there is none."""
        if self.kind == "number":
            got = self.col.cast("double")
        elif self.kind == "boolean":
            got = self.col.cast("double")
        elif self.kind == "text":
            got = text_number(self.col)
        elif self.handler is not None:
            got = self.handler.number(self.col).cast("double")
        else:
            got = F.lit(None).cast("double")
        return got if self.err is None else F.when(self.err.isNull(), got)

    @property
    def numeric(self) -> bool:
        """Whether the kind has numbers at all; a text may."""
        return self.kind in ("number", "boolean", "text") or self.handler is not None and self.handler.numeric

    @property
    def truth(self) -> Column:
        """Number not 0 (NaN is true), text not empty, boolean; empty and errors are false."""
        if self.kind == "number":
            got = self.col.cast("double") != 0
        elif self.kind == "text":
            got = F.length(self.col) > 0
        elif self.kind == "boolean":
            got = self.col
        else:
            got = self.col.isNotNull() if self.kind == "custom" else F.lit(False)
        got = F.coalesce(got, F.lit(False))
        return got if self.err is None else got & self.err.isNull()

    @property
    def text(self) -> Column:
        """The displayed text; the empty cell shows as ''."""
        if self.kind == "number":
            got = render_number(self.col.cast("double"))
        elif self.kind == "boolean":
            got = F.when(self.col, "TRUE").when(~self.col, "FALSE")
        elif self.kind == "empty":
            got = F.lit("")
        elif self.handler is not None:
            got = self.handler.display(self.col)
        else:
            got = self.col.cast("string")
        got = F.coalesce(got, F.lit(""))
        return got if self.err is None else F.coalesce(self.err, got)

    def error(self, *others: Value) -> Column | None:
        found = [v.err for v in (self, *others) if v.err is not None]
        return F.coalesce(*found) if found else None

    # ---- arithmetic

    def _asked(self, op: str, other: Value) -> Value | None:
        """What the handlers make of self op other; None if there are none or they decline."""
        if self.handler is None and other.handler is None:
            return None

        def made(a: Value, b: Value) -> Value | None:
            for v in (a, b):
                if v.handler is not None and (out := v.handler.binary(op, a, b)) is not None:
                    out = out if isinstance(out, Value) else Value(out, "custom", None, v.handler)
                    if a.err is not None or b.err is not None:
                        return bound([out], lambda o: after(a, b, o)) if out.err is not None else judged(out.col, out.kind, lambda _: a.error(b), out.handler)
                    return after(a, b, out)
            return None

        def after(a: Value, b: Value, out: Value) -> Value:
            err = a.error(b, out)
            return Value(out.col if err is None else F.when(err.isNull(), out.col), out.kind, err, out.handler)

        return bound([self, other], made)

    def _arith(self, op: str, other: object, f, fail: Callable[[Value], Column] | None = None) -> Value:
        other = Value.of(other)
        if (out := self._asked(op, other)) is not None:
            return out
        if not (self.numeric and other.numeric):  # nothing to count with
            return Value(F.lit(None).cast("double"), "number", self.error(other))
        err = self.error(other)
        if fail is not None:
            err = fail(other) if err is None else F.coalesce(err, fail(other))
        out = f(self.number, other.number)
        return Value(out if err is None else F.when(err.isNull(), out), "number", err)

    def __add__(self, other: object) -> Value:
        """Sum of numbers; if a side can be text the result is text: the rendered sum, or both texts joined where a side is no number."""
        other = Value.of(other)
        if all(v.numeric and v.kind != "text" for v in (self, other)):
            return self._arith("+", other, lambda a, b: a + b)
        if (out := self._asked("+", other)) is not None:
            return out
        both = self.number + other.number
        return Value(F.when(both.isNotNull(), render_number(both)).otherwise(F.concat(self.text, other.text)), "text", self.error(other))

    def __radd__(self, other: object) -> Value:
        return Value.of(other) + self

    def __sub__(self, other: object) -> Value:
        return self._arith("-", other, lambda a, b: a - b)

    def __rsub__(self, other: object) -> Value:
        return Value.of(other) - self

    def __mul__(self, other: object) -> Value:
        return self._arith("*", other, lambda a, b: a * b)

    def __rmul__(self, other: object) -> Value:
        return Value.of(other) * self

    def __truediv__(self, other: object) -> Value:
        zero = lambda other: F.when(self.number.isNotNull() & (other.number == 0), DIV0)
        return self._arith("/", other, lambda a, b: a / F.nullif(b, F.lit(0.0)), zero)

    def __rtruediv__(self, other: object) -> Value:
        return Value.of(other) / self

    def __pow__(self, other: object) -> Value:
        return self._arith("^", other, F.pow)

    def __mod__(self, other: object) -> Value:
        """Sign of the dividend; modulo 0 is NaN."""
        return self._arith("%", other, lambda a, b: F.when(a.isNull(), None).when(b == 0, F.lit(float("nan"))).otherwise(a % F.nullif(b, F.lit(0.0))))

    def __neg__(self) -> Value:
        return Value(-self.number, "number", self.err)

    def __pos__(self) -> Value:
        return Value(self.number, "number", self.err)

    def join(self, other: object) -> Value:
        """The & operator: both displayed texts, one after the other."""
        other = Value.of(other)
        if (out := self._asked("&", other)) is not None:
            return out
        return Value(F.concat(self.text, other.text), "text", self.error(other))

    # ---- comparison

    def _order(self, other: Value) -> Column:
        """-1, 0 or 1; numbers and booleans come before texts, the empty cell equals 0, FALSE and ''; NaN equals all."""

        def of(a: Column, b: Column) -> Column:
            return F.when(a < b, -1).when(a > b, 1).otherwise(0)

        plain = {"number", "boolean"}
        a, b = self, other
        if a.kind == "empty" and b.kind == "empty":
            return F.lit(0)
        if "text" in (a.kind, b.kind) and {a.kind, b.kind} <= {"text", "empty"}:
            return of(F.coalesce(a.col.cast("string"), F.lit("")), F.coalesce(b.col.cast("string"), F.lit("")))
        if {a.kind, b.kind} <= plain | {"empty"}:
            x, y = F.coalesce(a.number, F.lit(0.0)), F.coalesce(b.number, F.lit(0.0))
            return F.when(F.isnan(x) | F.isnan(y), 0).otherwise(of(x, y))
        if a.kind in plain and b.kind == "text":
            # An empty cell on either side is compared with what stands opposite.
            blank = F.when(b.col.isNull(), of(F.coalesce(a.number, F.lit(0.0)), F.lit(0.0)))
            return F.coalesce(blank, F.when(a.col.isNull(), of(F.lit(""), b.col)), F.lit(-1))
        if a.kind == "text" and b.kind in plain:
            return -b._order(a)
        raise TypeError(f"no order between {a.kind} and {b.kind}")

    def _alike(self, other: Value) -> Column | None:
        """_order() of two values of which one is custom, NULL where neither comes first and they differ; both empty are alike."""
        for v in (self, other):
            if v.handler is not None and (out := v.handler.compare(self, other)) is not None:
                return F.when(self.col.isNull() & other.col.isNull(), 0).otherwise(out)
        same = self.handler is not None and other.handler is not None and self.handler.tag == other.handler.tag
        return F.when(self.col.eqNullSafe(other.col), 0) if same else F.when(self.col.isNull() & other.col.isNull(), 0)

    def _compare(self, other: object, test) -> Value:
        other = Value.of(other)
        if "custom" in (self.kind, other.kind):
            return bound([self, other], lambda a, b: Value._compared(a, b, test))
        return self._compared(other, test)

    def _compared(self, other: Value, test) -> Value:
        err = self.error(other)
        if "custom" in (self.kind, other.kind):
            failed = next((f for v in (self, other) if v.handler is not None and (f := v.handler.mismatch(self, other)) is not None), None)
            if failed is not None:
                err = failed if err is None else F.coalesce(err, failed)
            out = F.coalesce(test(self._alike(other)), F.lit(test is _unlike))
        else:
            out = test(self._order(other))
        return Value(out if err is None else F.when(err.isNull(), out), "boolean", err)

    def __eq__(self, other: object) -> Value:  # type: ignore[override]
        return self._compare(other, lambda o: o == 0)

    def __ne__(self, other: object) -> Value:  # type: ignore[override]
        return self._compare(other, _unlike)

    def __lt__(self, other: object) -> Value:
        return self._compare(other, lambda o: o < 0)

    def __le__(self, other: object) -> Value:
        return self._compare(other, lambda o: o <= 0)

    def __gt__(self, other: object) -> Value:
        return self._compare(other, lambda o: o > 0)

    def __ge__(self, other: object) -> Value:
        return self._compare(other, lambda o: o >= 0)

    __hash__ = None  # type: ignore[assignment]

    def out(self, name: str) -> Column:
        """For select(): the value, or the error's text in a text column if it can fail; a custom value's displayed text."""
        if self.err is None and self.handler is None:
            return self.col.alias(name)
        shown = self.text if self.kind != "text" else self.col
        return (shown if self.err is None else F.coalesce(self.err, shown)).alias(name)
