"""Stored tables, prefix sums, joins on hot keys and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import folder as scratch
from ..plans.scratch import place as shared_path
from ..plans.scratch import scope, stored

__all__ = ["components", "hot_join", "if_few", "kept", "pick", "running", "scope", "scratch", "shared_path", "shielded"]

#: Bytes of rows that go to a Python worker at a time, unless the session says otherwise: a batch of long texts is as small as one of short ones.
#: Each task's batches are native memory of the executor, which it does not give back.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 20))


def kept(df: DataFrame, name: str) -> DataFrame:
    """df as a stored table."""
    if df.sparkSession.conf.get(BATCH[0], None) is None:
        df.sparkSession.conf.set(*BATCH)
    return stored(df, name)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever others there are (also such as differ in case alone)."""
    at = [df.columns.index(n) for n in names]
    return df.toDF(*[f"_in{i}" for i in range(len(df.columns))]).select(*[F.col(f"_in{i}").alias(n) for i, n in zip(at, names)])


def shielded(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """df with all columns but `names` renamed out of the way, and the function that gives back all names and their order, with `more` columns behind."""
    at = [names.index(c) if c in names and df.columns.index(c) == i else None for i, c in enumerate(df.columns)]
    inner = [f"_in{i}" if k is None else names[k] for i, k in enumerate(at)]
    columns = df.columns

    def restored(out: DataFrame, *more: str) -> DataFrame:
        return out.select(*[F.col(a).alias(f"_out{i}") for i, a in enumerate(inner)], *more).toDF(*columns, *more)

    return df.toDF(*inner), restored


#: Bytes of hot keys, and of a whole table, that may be broadcast; more are joined by a shuffle.
FEW_BYTES, MOST_BYTES = 16 << 20, 32 << 20


def row_bytes(df: DataFrame) -> Column:
    """The bytes of a row when it is broadcast."""
    if any(isinstance(f.dataType, (T.ArrayType, T.MapType)) for f in df.schema):
        raise ValueError("the size of an array is not known beforehand")
    size = F.lit(16 + 16 * len(df.columns)).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return size


def if_few(df: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows take at most `most` bytes; df should be cheap to read (a kept table)."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(df) if size <= most else df


def hot_join(left: DataFrame, right: DataFrame, key: str, own: str, weight: str, total: int, each: int | None = 64) -> DataFrame:
    """left joined with right on left[key] = right[own]; right has one row for each key, and in weight how many rows left has of it.

    total is the number of left's rows.  The keys of most rows are hot: as many
    as take FEW_BYTES, with `each` bytes a row of right (None: what they take is
    measured, so right should be a kept table).  They are broadcast, so no task
    gets all rows of a key; all others, which have about total / (FEW_BYTES /
    each) rows at most, meet by a shuffle.
    """
    if each is None:
        power = F.floor(F.log2(F.greatest(weight, F.lit(1)))).alias("power")
        sizes = {r["power"]: r["n"] for r in right.groupBy(power).agg(F.sum(row_bytes(right)).alias("n")).collect()}  # a row for each power of two
        powers, room = sorted(sizes, reverse=True), FEW_BYTES
        least = 1 << (max(powers, default=0) + 1)
        for p in powers:
            room -= sizes[p]
            if room < 0:
                break
            least = 1 << p
        everything = room >= 0
    else:
        least = total * each // FEW_BYTES + 1
        everything = least <= 1
    if everything:
        return left.join(F.broadcast(right), F.col(key) == F.col(own))
    hot, cold = right.where(F.col(weight) >= least), right.where(F.col(weight) < least)
    names = hot.select(F.col(own).alias("_hot"))
    rest = left.join(F.broadcast(names), F.col(key) == F.col("_hot"), "left_anti")
    return left.join(F.broadcast(hot), F.col(key) == F.col(own)).unionByName(rest.join(cold, F.col(key) == F.col(own)))


def running(df: DataFrame, key: str, order: list[Column], value: Column, bucket: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of value over the rows of the same key up to and with this one.

    bucket must not fall along order (it is the leading part of it).  Only the
    rows of one (key, bucket) meet in a task; the sums of the buckets, one row
    each, are added up apart.  A key that holds a third of all rows is spread
    over its buckets.
    """
    df = df.withColumn("_bucket", bucket).withColumn("_value", value)
    sums = df.groupBy(key, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum("_value").over(inside))
        .join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_bucket") == F.col("_of")))
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_bucket", "_value", "_inside", "_key", "_of", "_before")
    )


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id of edges(a, b), a table cheap to read anew: the smallest id that it reaches.

    Alternates large-star and small-star steps; each halves the distances, so a
    chain of a billion links takes some thirty rounds.  A star is built from
    one minimum per node, never from pairs of neighbours, and the links of a
    hub meet its minimum by hot_join().  In the end each id stands in one row,
    beside its component.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen, n = None, edges.count()
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "n")
        large = hot_join(both, least, "a", "u", "n", 2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))  # at most one row for each link
        down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumnRenamed("a", "u")
        small = hot_join(large, down, "a", "u", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("u", "m"))
        edges = kept(small.where("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
