"""Array formulas as DataFrame operations.

A frame is a DataFrame with a row position `_r` (from 1) where order matters,
or in long form (r, c, v) where both dimensions are data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import NA, VALUE, Value
from ..plans.scratch import stored


def numbered(df: DataFrame, *order: Column, name: str = "_r") -> DataFrame:
    """df with positions 1.. in a total order, without one task that sees all rows.

    The rows are range-partitioned and sorted once and stored; positions are the
    row's place in its partition after the counts of the partitions before,
    which are one row each.  order should be total, or ties are in any order.
    """
    ranged = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return ranged.join(counts, part == F.col("_part")).withColumn(name, F.col("_before") + place + 1).drop("_at", "_part", "_before")


def band(v: Value) -> Column:
    """Sort classes: numbers and booleans, texts, empty, errors."""
    plain = F.when(v.col.isNull(), 2).otherwise(0 if v.kind in ("number", "boolean") else 1)
    return plain if v.err is None else F.when(v.err.isNotNull(), 3).otherwise(plain)


def SORT(df: DataFrame, key: Value, ascending: bool = True, position: str = "_r", name: str = "rank") -> DataFrame:
    """Rows by one key, ties in their own order; descending turns the classes as well, so empty cells come first."""
    by = key.number if key.kind in ("number", "boolean") else key.col
    order = [band(key).asc(), by.asc_nulls_last()] if ascending else [band(key).desc(), by.desc_nulls_first()]
    return numbered(df, *order, F.col(position).asc(), name=name)


def FILTER(df: DataFrame, condition: Value) -> DataFrame:
    """Rows whose condition, a Value over the same frame and so of its height, is true."""
    return df.where(condition.truth)


def FILTER_or_na(df: DataFrame, condition: Value, column: str) -> DataFrame:
    """As a sheet shows it: one row #N/A where no row is left (column becomes text)."""
    left = df.where(condition.truth).select(F.col(column).cast("string").alias(column))
    none = df.select(F.max(condition.truth.cast("int")).alias("any")).where(F.coalesce("any", F.lit(0)) == 0)
    return left.union(none.select(F.lit(NA).alias(column)))


def FILTER_cells(long: DataFrame, condition: Column) -> DataFrame:
    """Single cells of a frame (r, c, v), in row-major order as one column: (r, v)."""
    return numbered(long.where(condition), F.col("r"), F.col("c"), name="_n").select(F.col("_n").alias("r"), "v")


def UNIQUE(df: DataFrame, *columns: str, position: str = "_r", name: str = "rank") -> DataFrame:
    """Distinct rows in the order they first occur."""
    first = df.groupBy(*columns).agg(F.min(position).alias("_first"))
    return numbered(first, F.col("_first"), name=name).drop("_first")


def TRANSPOSE(long: DataFrame) -> DataFrame:
    return long.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def SEQUENCE(spark: SparkSession, rows: int, cols: int = 1, start: float = 1.0, step: float = 1.0) -> DataFrame:
    """rows x cols numbers in row-major order."""
    if rows < 1 or cols < 1:
        raise ValueError("a sequence has a row and a column at least")
    at = F.col("id")
    return spark.range(rows * cols).select((F.floor(at / cols) + 1).cast("int").alias("r"), (at % cols + 1).cast("int").alias("c"), (F.lit(float(start)) + at * F.lit(float(step))).alias("v"))


def literal(spark: SparkSession, rows: list[list[object]]) -> DataFrame:
    """An array literal {a,b;c,d} of one kind, as a frame (r, c, v)."""
    if not rows or not rows[0] or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("an array literal has rows of one width")
    cells = [F.struct(F.lit(i).alias("r"), F.lit(j).alias("c"), Value.of(v).col.alias("v")) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1)]
    return spark.range(1).select(F.inline(F.array(*cells)))


def long_form(df: DataFrame, columns: list[str], position: str = "_r") -> DataFrame:
    """A wide frame as (r, c, v): whole-row reads are filters on r."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(columns, 1)])
    return df.select(F.col(position).cast("int").alias("r"), F.inline(cells))


#: Cells of a row that are sent together, and bytes of a row that may be broadcast.
ROW_BLOCK, FEW_BYTES = 10_000, 16 << 20


def shape(frame: DataFrame) -> tuple[int, int]:
    """Rows and columns of a frame (r, c, v)."""
    top = frame.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return top["r"] or 0, top["c"] or 0


def broadcast(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """(r, c, v, error): elementwise f of two frames; a side of one row or one column is repeated, and other unlike shapes are one row of #VALUE!."""
    (ra, ca), (rb, cb) = shape(a), shape(b)
    none = F.lit(None).cast("string").alias("error")
    if any(x != y and 1 not in (x, y) for x, y in ((ra, rb), (ca, cb))):
        kind = a.select(f(F.col("v"), F.col("v")).alias("v")).schema["v"].dataType
        return a.sparkSession.range(1).select(F.lit(1).alias("r"), F.lit(1).alias("c"), F.lit(None).cast(kind).alias("v"), F.lit(f"{VALUE} incompatible array shapes").alias("error"))
    if (rb, cb) == (1, ca) and ra == 1 or (ra, ca) == (rb, cb):
        out = _same(a, b, f)
    elif ca == 1 and rb == 1:
        out = outer(a, b, f)
    elif cb == 1 and ra == 1:
        out = outer(b, a, lambda y, x: f(x, y))
    else:
        # One side is a row or a column of the other, which keeps its cells.
        whole, line, g = (a, b, f) if ra * ca >= rb * cb else (b, a, lambda x, y: f(y, x))
        (rows, cols), key = shape(line), F.lit(1)
        if (rows, cols) != (1, 1):
            key = F.col("r" if cols == 1 else "c")
        at = F.lit(1) if (rows, cols) == (1, 1) else key
        out = whole.withColumn("_at", key).join(line.select(at.alias("_key"), F.col("v").alias("_w")), F.col("_at") == F.col("_key")).select("r", "c", g(F.col("v"), F.col("_w")).alias("v"))
    return out.select("r", "c", "v", none)


def _same(a: DataFrame, b: DataFrame, f) -> DataFrame:
    return a.join(b.select("r", "c", F.col("v").alias("_w")), ["r", "c"]).select("r", "c", f(F.col("v"), F.col("_w")).alias("v"))


def align(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """Elementwise f over two frames of one shape; ValueError (#VALUE!) for others."""
    if shape(a) != shape(b):
        raise ValueError(f"{VALUE} incompatible array shapes")
    return _same(a, b, f)


def outer(column: DataFrame, row: DataFrame, f) -> DataFrame:
    """A column (m x 1) against a row (1 x n). The row is gathered into arrays of ROW_BLOCK cells, which each cell of the column meets by the block's number; they are broadcast if all of them are few."""
    across = row.groupBy(F.floor((F.col("c") - 1) / ROW_BLOCK).alias("_k")).agg(F.collect_list(F.struct("c", "v")).alias("_row"))
    size = row.agg(F.max("c").alias("n"), F.sum(F.octet_length(F.col("v").cast("string")) + 16).alias("bytes")).first()
    blocks = F.sequence(F.lit(0).cast("long"), F.lit(((size["n"] or 1) - 1) // ROW_BLOCK).cast("long"))
    spread = column.select("r", F.col("v").alias("_v"), F.explode(blocks).alias("_k"))
    spread = spread.join(F.broadcast(across) if (size["bytes"] or 0) <= FEW_BYTES else across, "_k")
    return spread.select("r", "_v", F.explode("_row").alias("_x")).select("r", F.col("_x.c").alias("c"), f(F.col("_v"), F.col("_x.v")).alias("v"))


def stacked(*frames: DataFrame) -> DataFrame:
    """Arguments of any shape one after the other, as aggregates take them."""
    return reduce(DataFrame.unionByName, [f.withColumn("arg", F.lit(i)) for i, f in enumerate(frames)])
