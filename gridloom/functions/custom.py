"""Types and functions that a user adds.

A custom type is a class that emits Column expressions; a custom function works
on pandas batches.  Both are found in a Registry, in the order of registration.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import VALUE, Value


class CustomType:
    """All methods are optional. None declines."""

    tag = "custom"

    @property
    def numeric(self) -> bool:
        """Whether number() can give one."""
        return type(self).number is not CustomType.number

    def parse(self, text: Column) -> Column | None:
        """The canonical data of a text that is a literal of this type, NULL for others."""

    def parse_with(self, text: Column, fmt: str) -> Column | None:
        """The data of a text by a format."""

    def display(self, data: Column) -> Column:
        return data.cast("string")

    def edit_text(self, data: Column) -> Column:
        """What an editor shows: a text that parse() reads as the same data."""
        return data.cast("string")

    def number(self, data: Column) -> Column:
        return F.lit(None).cast("double")

    def binary(self, op: str, left: Value, right: Value) -> Value | Column | None:
        """left op right: a Value, or a Column of this type's data."""

    def compare(self, left: Value, right: Value) -> Column | None:
        """-1, 0 or 1, NULL where neither comes first and they differ. Where all decline, two values are equal if their types and data are, and have no order."""

    def mismatch(self, left: Value, right: Value) -> Column | None:
        """The error text of a comparison that cannot be made, NULL where it can."""


class Registry:
    def __init__(self) -> None:
        self.types: dict[str, CustomType] = {}
        self.functions: dict[str, Callable[..., Column]] = {}

    def add_type(self, handler: CustomType) -> None:
        if handler.tag in self.types:
            raise ValueError(f"there is a type {handler.tag}")
        self.types[handler.tag] = handler

    def _name(self, name: str) -> str:
        if (key := name.upper()) in self.functions:
            raise ValueError(f"there is a function {name}")
        return key

    def add_function(self, name: str, f: Callable[..., pd.Series], returns: str) -> None:
        """A function of pandas Series, applied to whole Arrow batches. An exception gives the error text instead of failing the job."""

        def safe(*args: pd.Series) -> pd.DataFrame:
            try:
                return pd.DataFrame({"value": f(*args), "error": None})
            except Exception as e:  # the cell shows it
                return pd.DataFrame({"value": [None] * len(args[0]), "error": [f"{VALUE} {e}"] * len(args[0])})

        self.functions[self._name(name)] = F.pandas_udf(safe, f"value {returns}, error string")

    def call(self, name: str, *args: Value | Column) -> Column:
        """struct<value, error>; an unknown name raises KeyError (#NAME?)."""
        return self.functions[name.upper()](*[a.col if isinstance(a, Value) else a for a in args])

    def over(self, df: DataFrame, name: str, f: Callable[[pd.DataFrame], object], returns: str, *keys: str) -> DataFrame:
        """A function of whole ranges: f of the rows of each group of keys (which one task holds), as columns keys, `name` and error."""
        schema = ", ".join([*[f"{k} {dict(df.dtypes)[k]}" for k in keys], f"{name} {returns}", "error string"])

        def safe(rows: pd.DataFrame) -> pd.DataFrame:
            try:
                value, error = f(rows), None
            except Exception as e:  # the cell shows it
                value, error = None, f"{VALUE} {e}"
            return pd.DataFrame([[*rows[list(keys)].iloc[0], value, error]], columns=[*keys, name, "error"]).astype({k: rows[k].dtype for k in keys})

        return df.groupBy(*keys).applyInPandas(safe, schema)

    def literal(self, text: Column) -> Column:
        """struct<tag, data> by the first type that reads the text, NULL if none does."""
        out = F.lit(None).cast("struct<tag:string,data:string>")
        for handler in reversed(self.types.values()):
            data = handler.parse(text)
            if data is not None:
                out = F.when(data.isNotNull(), F.struct(F.lit(handler.tag).alias("tag"), data.alias("data"))).otherwise(out)
        return out

    def value(self, tag: str, data: Column) -> Value:
        """Data of a type as a value, whose operators ask its handler."""
        return Value(data, "custom", None, self.types[tag])

    def read(self, tag: str, text: Column, fmt: str | None = None) -> Value:
        """A text as a value of one type, by its literals or by a format; #VALUE! where it reads as none."""
        handler = self.types[tag]
        data = handler.parse(text) if fmt is None else handler.parse_with(text, fmt)
        if data is None:
            raise TypeError(f"{tag} reads no texts")
        return Value(data, "custom", F.when(text.isNotNull() & data.isNull(), VALUE), handler)


def aggregate(df: DataFrame, columns: list[str], partial: Callable[[pd.DataFrame], pd.DataFrame], merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A custom aggregate: partial on each batch, merge on each partition's partials and then on one row a partition."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [partial(b) for b in batches if len(b)]
        if parts:
            yield merge(pd.concat(parts))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            yield merge(pd.concat(parts))

    return df.select(*columns).mapInPandas(each, schema).repartition(1).mapInPandas(last, schema)
