"""The sheet queries over the driver's tables, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import core, temporal, units, url
from .functions.custom import CustomType, Registry, aggregate
from .functions.values import Value, literal, render_number, text_number
from .operators import arrays, references
from .plans import workbook
from .sources import sheets
from .sources.sheets import Sheet
from .streaming import pins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheet(spark: SparkSession, sf_dir: str, name: str) -> Sheet:
    return Sheet(table(spark, sf_dir, name))


# ---- aggregates


@query("SELECT round(sum(l_discount * l_extendedprice), 2) AS revenue FROM lineitem WHERE l_discount >= 0.05 AND l_quantity < 24")
def named_revenue(spark, sf_dir):
    """SUM((Discount >= 0.05) * (Quantity < 24) * Price * Discount) over named ranges: one aggregate."""
    s = sheet(spark, sf_dir, "lineitem")
    s = s.named(Discount=s["l_discount"], Quantity=s["l_quantity"], Price=s["l_extendedprice"])
    product = (s["Discount"] >= 0.05) * (s["Quantity"] < 24) * s["Price"] * s["Discount"]
    return s.df.agg(F.round(core.SUM(product), 2).alias("revenue"))


@query("SELECT round(sum(l_quantity), 2) AS total, round(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(l_tax)::DOUBLE AS n FROM lineitem")
def aggregate_ranges(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    q, p, t = s["l_quantity"], s["l_extendedprice"], s["l_tax"]
    return s.df.agg(F.round(core.SUM(q), 2).alias("total"), F.round(core.AVERAGE(q), 6).alias("mean"), core.MIN(p).alias("low"), core.MAX(p).alias("high"), core.COUNT(t).alias("n"))


@query("SELECT round(sum(l_quantity) + sum(l_tax), 2) AS total, (count(l_quantity) + count(l_tax))::DOUBLE AS n, least(min(l_quantity), min(l_tax)) AS low, greatest(max(l_quantity), max(l_tax)) AS high FROM lineitem")
def aggregate_many_arguments(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    a, b = s["l_quantity"], s["l_tax"]
    return s.df.agg(F.round(core.SUM(a, b), 2).alias("total"), core.COUNT(a, b).alias("n"), core.MIN(a, b).alias("low"), core.MAX(a, b).alias("high"))


@query("SELECT count(*) FILTER (WHERE k <> '')::DOUBLE AS n, sum(CASE WHEN k <> '' THEN k::DOUBLE END) AS total FROM (SELECT regexp_extract(props, '([0-9]+)', 1) AS k FROM events)")
def count_numeric_text(spark, sf_dir):
    """COUNT and SUM over a text column: what reads as a number counts."""
    df = table(spark, sf_dir, "events").select(F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    v = Sheet(df)["k"]
    return df.agg(core.COUNT(v).alias("n"), core.SUM(v).alias("total"))


@query("SELECT count(*) FILTER (WHERE l_quantity > 25)::DOUBLE AS over25, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END), 2) AS returned FROM lineitem")
def countif_sumif(spark, sf_dir):
    """SUM(A > 25) and SUM((flag = "R") * price)."""
    s = sheet(spark, sf_dir, "lineitem")
    return s.df.agg(core.SUM(s["l_quantity"] > 25).alias("over25"), F.round(core.SUM((s["l_returnflag"] == "R") * s["l_extendedprice"]), 2).alias("returned"))


@query("SELECT string_agg(n_name, '' ORDER BY n_nationkey) AS names FROM nation")
def concat_column(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation")
    return s.df.agg(core.CONCAT(s["n_name"], F.col("n_nationkey")).alias("names"))


@query("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*)::DOUBLE AS n FROM lineitem GROUP BY l_returnflag")
def grouped_sum(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    return s.df.groupBy("l_returnflag").agg(F.round(core.SUM(s["l_extendedprice"]), 2).alias("total"), core.COUNT(s["l_quantity"]).alias("n"))


@query("SELECT round(sum(v), 2) AS total, round(avg(v), 6) AS mean, min(v) AS low, max(v) AS high, count(v)::DOUBLE AS n FROM (SELECT c_acctbal AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def stacked_frames(spark, sf_dir):
    """Aggregates over arguments of two tables, one after the other."""
    a, b = (table(spark, sf_dir, t).select(F.col(c).alias("v")) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal")))
    both = Sheet(arrays.stacked(a, b))
    v = both["v"]
    return both.df.agg(F.round(core.SUM(v), 2).alias("total"), F.round(core.AVERAGE(v), 6).alias("mean"), core.MIN(v).alias("low"), core.MAX(v).alias("high"), core.COUNT(v).alias("n"))


# ---- arithmetic and comparison


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_extendedprice - l_quantity AS s, l_extendedprice * l_discount AS m, -l_tax AS neg, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS d FROM lineitem")
def arithmetic(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    q, t, p, d = (s[c] for c in ("l_quantity", "l_tax", "l_extendedprice", "l_discount"))
    return s.df.select("l_orderkey", "l_linenumber", (q + t).out("a"), (p - q).out("s"), (p * d).out("m"), (-t).out("neg"), (t / d).col.alias("d"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '#DIV/0!' ELSE 'ok' END AS state FROM lineitem")
def division_errors(spark, sf_dir):
    """Errors are values: each row has its own."""
    s = sheet(spark, sf_dir, "lineitem")
    d = s["l_tax"] / s["l_discount"]
    return s.df.select("l_orderkey", "l_linenumber", F.coalesce(d.err, F.lit("ok")).alias("state"))


@query("SELECT p_partkey, p_size::DOUBLE ^ 2 AS squared, CASE WHEN p_size % 7 = 0 THEN 0.0 ELSE (p_size % 7)::DOUBLE END AS rest, -((p_size % 5)::DOUBLE) AS signed FROM part")
def power_and_modulo(spark, sf_dir):
    s = sheet(spark, sf_dir, "part")
    z = s["p_size"]
    return s.df.select("p_partkey", (z**2).out("squared"), (z % 7).out("rest"), ((-z) % 5).out("signed"))


@query("SELECT n_nationkey, n_name || '-' || n_nationkey::VARCHAR AS label, n_name || '1' AS mixed, (n_nationkey + 1)::VARCHAR AS summed FROM nation")
def text_operators(spark, sf_dir):
    """& joins displayed texts; + joins where a side is no number and adds where both read as one."""
    s = sheet(spark, sf_dir, "nation")
    digits = Value(F.col("n_nationkey").cast("string"), "text")
    return s.df.select("n_nationkey", s["n_name"].join("-").join(s["n_nationkey"]).out("label"), (s["n_name"] + 1).out("mixed"), (digits + 1).out("summed"))


@query("SELECT p_partkey, p_size > 25 AS gt, p_size <= 25 AS le, p_size = 10 AS eq, p_size <> 10 AS ne, p_name < 'm' AS lt_text, true AS number_before_text FROM part")
def comparisons(spark, sf_dir):
    s = sheet(spark, sf_dir, "part")
    z, n = s["p_size"], s["p_name"]
    return s.df.select("p_partkey", (z > 25).out("gt"), (z <= 25).out("le"), (z == 10).out("eq"), (z != 10).out("ne"), (n < "m").out("lt_text"), (z < n).out("number_before_text"))


@query("SELECT c_custkey, coalesce(v, 0) = 0 AS is_zero, coalesce(t, '') = '' AS is_blank, coalesce(v, 0) < 100 AS below FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END AS t FROM customer)")
def compare_empty(spark, sf_dir):
    """The empty cell equals 0, FALSE and ''."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("v"), F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")).alias("t"))
    s = Sheet(df)
    return df.select("c_custkey", (s["v"] == 0).out("is_zero"), (s["t"] == "").out("is_blank"), (s["v"] < 100).out("below"))


@query("SELECT event_id, CASE WHEN k = '' THEN NULL ELSE k::DOUBLE END AS number, k <> '' AS truth, CASE WHEN k = '' THEN 'empty' ELSE 'number' END AS kind FROM (SELECT event_id, regexp_extract(props, '([0-9]+)', 1) AS k FROM events)")
def coerce_text(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.regexp_extract("props", "([0-9]+)", 1).alias("k"))
    v = Sheet(df)["k"]
    return df.select("event_id", v.number.alias("number"), v.truth.alias("truth"), literal(F.col("k"))["kind"].alias("kind"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'retail' END AS size, CASE WHEN l_returnflag = 'R' THEN -l_extendedprice WHEN l_returnflag = 'A' THEN 0.0 ELSE l_extendedprice END AS net FROM lineitem")
def if_nested(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    net = core.IF(s["l_returnflag"] == "R", -s["l_extendedprice"], core.IF(s["l_returnflag"] == "A", 0.0, s["l_extendedprice"]))
    return s.df.select("l_orderkey", "l_linenumber", core.IF(s["l_quantity"] > 25, "bulk", "retail").out("size"), net.out("net"))


# ---- scalar functions


@query("SELECT c_custkey, abs(c_acctbal) AS size, strlen(c_name)::DOUBLE AS n, upper(c_name) AS up, lower(c_name) AS low, sign(c_acctbal * 10) * floor(abs(c_acctbal * 10) + 0.5) / 10 AS near FROM customer")
def scalar_functions(spark, sf_dir):
    s = sheet(spark, sf_dir, "customer")
    b, n = s["c_acctbal"], s["c_name"]
    return s.df.select("c_custkey", core.ABS(b).out("size"), core.LEN(n).out("n"), core.UPPER(n).out("up"), core.LOWER(n).out("low"), core.ROUND(b, 1).out("near"))


@query("SELECT doc_id, strlen(text)::DOUBLE AS bytes FROM documents")
def length_in_bytes(spark, sf_dir):
    s = sheet(spark, sf_dir, "documents")
    return s.df.select("doc_id", core.LEN(s["text"]).out("bytes"))


@query("SELECT p_partkey, regexp_replace(p_retailprice::VARCHAR, '\\.0$', '') AS shown FROM part")
def render_numbers(spark, sf_dir):
    s = sheet(spark, sf_dir, "part")
    return s.df.select("p_partkey", s["p_retailprice"].text.alias("shown"))


# ---- array functions


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def filter_rows(spark, sf_dir):
    s = sheet(spark, sf_dir, "lineitem")
    return arrays.FILTER(s.df, (s["l_quantity"] > 45) * (s["l_discount"] < 0.02)).select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")


@query("SELECT '#N/A' AS n_name")
def filter_none(spark, sf_dir):
    s = sheet(spark, sf_dir, "nation")
    return arrays.FILTER_or_na(s.df, s["n_nationkey"] > 1000, "n_name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey, c) AS r, v FROM (SELECT n_nationkey, 1 AS c, n_nationkey::DOUBLE AS v FROM nation UNION ALL SELECT n_nationkey, 2, n_regionkey::DOUBLE FROM nation) WHERE v > 2")
def filter_cells(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("_r"), F.col("n_nationkey").cast("double").alias("a"), F.col("n_regionkey").cast("double").alias("b"))
    return arrays.FILTER_cells(arrays.long_form(df, ["a", "b"]), F.col("v") > 2)


@query("SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part")
def sort_by_column(spark, sf_dir):
    s = sheet(spark, sf_dir, "part")
    return arrays.SORT(s.df, s["p_size"], position="p_partkey").select("p_partkey", "p_size", "rank")


@query("SELECT c_custkey, row_number() OVER (ORDER BY v DESC NULLS FIRST, c_custkey) AS rank FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer)")
def sort_descending_empty_first(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("v"))
    return arrays.SORT(df, Sheet(df)["v"], ascending=False, position="c_custkey").select("c_custkey", "rank")


@query("SELECT p_brand, row_number() OVER (ORDER BY f) AS rank FROM (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY p_brand)")
def unique_column(spark, sf_dir):
    return arrays.UNIQUE(table(spark, sf_dir, "part"), "p_brand", position="p_partkey")


@query("SELECT p_brand, p_type, row_number() OVER (ORDER BY f) AS rank FROM (SELECT p_brand, p_type, min(p_partkey) AS f FROM part GROUP BY p_brand, p_type)")
def unique_rows(spark, sf_dir):
    return arrays.UNIQUE(table(spark, sf_dir, "part"), "p_brand", "p_type", position="p_partkey")


@query("SELECT 1 AS r, (n_nationkey + 1)::INT AS c, n_name AS v FROM nation UNION ALL SELECT 2, (n_nationkey + 1)::INT, n_regionkey::VARCHAR FROM nation")
def transpose_frame(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("_r"), "n_name", F.col("n_regionkey").cast("string").alias("k"))
    return arrays.TRANSPOSE(arrays.long_form(df, ["n_name", "k"]))


@query("SELECT (i // 7 + 1)::INT AS r, (i % 7 + 1)::INT AS c, 10 + i * 2.5::DOUBLE AS v FROM range(100 * 7) t(i)")
def sequence_grid(spark, sf_dir):
    return arrays.SEQUENCE(spark, 100, 7, 10, 2.5)


@query("SELECT * FROM (VALUES (1, 1, 1.0::DOUBLE), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 4.0)) t(r, c, v)")
def array_literal(spark, sf_dir):
    return arrays.literal(spark, [[1, 2], [3, 4]])


@query("SELECT (a.n_nationkey + 1)::INT AS r, (b.r_regionkey + 1)::INT AS c, a.n_nationkey::DOUBLE * b.r_regionkey AS v FROM nation a, region b")
def broadcast_outer(spark, sf_dir):
    """A column times a row."""
    column = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("r"), F.lit(1).alias("c"), F.col("n_nationkey").cast("double").alias("v"))
    row = table(spark, sf_dir, "region").select(F.lit(1).alias("r"), (F.col("r_regionkey") + 1).cast("int").alias("c"), F.col("r_regionkey").cast("double").alias("v"))
    return arrays.outer(column, row, lambda a, b: a * b)


@query("SELECT o_orderkey::INT AS r, 1 AS c, o_totalprice * 2 + o_custkey AS v FROM orders")
def broadcast_same_shape(spark, sf_dir):
    """Two frames of one shape meet by position, a scalar goes everywhere."""
    o = table(spark, sf_dir, "orders")
    place = [F.col("o_orderkey").cast("int").alias("r"), F.lit(1).alias("c")]
    a, b = o.select(*place, (F.col("o_totalprice") * 2).alias("v")), o.select(*place, F.col("o_custkey").cast("double").alias("v"))
    return arrays.align(a, b, lambda x, y: x + y)


# ---- ranges, cells, spills


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey + 1 BETWEEN 3 AND 9")
def range_scan(spark, sf_dir):
    """A3:B9."""
    df = table(spark, sf_dir, "nation").withColumn("_r", F.col("n_nationkey") + 1)
    return Sheet(df).range("B", "A", (9, 3)).drop("_r")


@query("SELECT c, v FROM (SELECT 1 AS c, o_orderkey::DOUBLE AS v, o_orderkey FROM orders UNION ALL SELECT 2, o_custkey::DOUBLE, o_orderkey FROM orders UNION ALL SELECT 3, o_totalprice, o_orderkey FROM orders) WHERE o_orderkey BETWEEN 5 AND 8")
def whole_rows(spark, sf_dir):
    """5:8, cell by cell."""
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_r"), *[F.col(c).cast("double") for c in ("o_orderkey", "o_custkey", "o_totalprice")])
    return arrays.long_form(df.where(F.col("_r").between(5, 8)), ["o_orderkey", "o_custkey", "o_totalprice"]).select("c", "v")


CELLS_SQL = "SELECT (o_orderkey % 500 + 1)::INT AS r, (o_custkey % 30 + 1)::INT AS c, o_orderkey AS seq, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS raw FROM orders"


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ids = F.concat(sheets.column_letters((F.col("o_custkey") % 30 + 1).cast("int")), (F.col("o_orderkey") % 500 + 1).cast("string"))
    return sheets.edits(o.select(ids.alias("cell_id"), F.when(F.col("o_orderkey") % 11 == 0, "").otherwise(F.col("o_orderpriority")).alias("raw"), F.col("o_orderkey").alias("seq")))


@query(f"SELECT r, c, raw FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY seq DESC) AS n FROM ({CELLS_SQL})) WHERE n = 1 AND raw <> ''")
def cells_upsert(spark, sf_dir):
    """Orders as cell edits: the last write of a cell wins, an empty text deletes."""
    cells = _cells(spark, sf_dir)
    return sheets.upsert(cells.where(F.col("seq") % 2 == 0), cells.where(F.col("seq") % 2 == 1)).select("r", "c", "raw")


LETTERS_SQL = "CASE WHEN c > 26 THEN 'A' || chr((38 + c)::INT) ELSE chr((64 + c)::INT) END"


@query(f"SELECT {LETTERS_SQL} || r || ': ' || raw AS value FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY seq DESC) AS n FROM ({CELLS_SQL})) WHERE n = 1 AND raw <> ''")
def sheet_text_lines(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return sheets.sheet_lines(sheets.upsert(cells.limit(0), cells))


@query(f"SELECT {LETTERS_SQL} || r AS cell, raw AS expected, raw || '!' AS shown FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY seq DESC) AS n FROM ({CELLS_SQL})) WHERE n = 1 AND raw <> '' AND r % 7 = 0")
def snapshot_verify(spark, sf_dir):
    """A snapshot against values that have changed in every seventh row."""
    cells = sheets.upsert(_cells(spark, sf_dir).limit(0), _cells(spark, sf_dir))
    lines = sheets.snapshot_lines(cells, cells.select("r", "c", F.col("raw").alias("shown")))
    now = cells.select("r", "c", F.when(F.col("r") % 7 == 0, F.concat("raw", F.lit("!"))).otherwise(F.col("raw")).alias("shown"))
    return sheets.verify_snapshot(lines, now)


@query(f"SELECT r, string_agg(coalesce(raw, ''), chr(9) ORDER BY c) AS line FROM (SELECT g.r, h.c, u.raw FROM (SELECT unnest(range(1, 41))::INT AS r) g, (SELECT unnest(range(1, 9))::INT AS c) h LEFT JOIN (SELECT r, c, raw FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY seq DESC) AS n FROM ({CELLS_SQL})) WHERE n = 1 AND raw <> '') u ON u.r = g.r AND u.c = h.c) GROUP BY r")
def clipboard_tsv(spark, sf_dir):
    cells = sheets.upsert(_cells(spark, sf_dir).limit(0), _cells(spark, sf_dir))
    return sheets.to_tsv(cells, 1, 1, 40, 8)


def _placed(spark):
    anchors = spark.range(1, 201).select((F.col("id") * 5).cast("int").alias("anchor_r"), F.lit(1).alias("anchor_c"), F.col("id").alias("seq"))
    one = anchors.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("seq") % 4 == 0, 7).otherwise(4))).alias("r")).select("anchor_r", "anchor_c", "seq", "r", F.lit(1).alias("c"), (F.col("r") * 10).cast("double").alias("v"))
    cells = spark.range(1, 201).where(F.col("id") % 3 == 0).select((F.col("id") * 5 + 2).cast("int").alias("r"), F.lit(1).alias("c"), F.lit("x").alias("raw"))
    return cells, one


SPILLS_SQL = "WITH a AS (SELECT i AS seq, 5 * i AS anchor, CASE WHEN i % 4 = 0 THEN 7 ELSE 4 END AS n FROM range(1, 201) t(i)), s AS (SELECT *, seq % 3 = 0 AS by_cell FROM a), t AS (SELECT s.*, by_cell OR (NOT by_cell AND seq % 4 = 1 AND seq > 1 AND (seq - 1) % 3 <> 0) AS blocked FROM s)"


@query(SPILLS_SQL + " SELECT (anchor + k - 1)::INT AS r, k * 10::DOUBLE AS v FROM t, range(1, 8) u(k) WHERE NOT blocked AND k <= n")
def spill_place(spark, sf_dir):
    cells, arrays_ = _placed(spark)
    return workbook.spill(cells, arrays_)[0].select("r", "v")


@query(SPILLS_SQL + " SELECT anchor::INT AS r, '#SPILL!' AS v FROM t WHERE blocked")
def spill_blocked(spark, sf_dir):
    cells, arrays_ = _placed(spark)
    return workbook.spill(cells, arrays_)[1].select("r", "v")


@query(SPILLS_SQL + " SELECT anchor::INT AS anchor_r, n::INT AS rows, 1 AS cols FROM t WHERE NOT blocked")
def spill_regions(spark, sf_dir):
    cells, arrays_ = _placed(spark)
    return workbook.regions(workbook.spill(cells, arrays_)[0]).select("anchor_r", "rows", "cols")


@query("SELECT (3 * i)::INT AS r, CASE WHEN i % 2 = 1 THEN 'placed' ELSE '#SPILL!' END AS v FROM range(1, 2001) t(i)")
def spill_chain(spark, sf_dir):
    """Arrays of four cells that each overlap the next: a blocked one blocks nothing."""
    cells, _ = _placed(spark)
    one = spark.range(1, 2001).select((F.col("id") * 3).cast("int").alias("anchor_r"), F.lit(1).alias("anchor_c"), F.col("id").alias("seq"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("r"), F.lit(1).alias("c"), F.lit(1.0).alias("v"))
    placed, blocked = workbook.spill(cells.limit(0), one)
    return workbook.regions(placed).select(F.col("anchor_r").alias("r"), F.lit("placed").alias("v")).union(blocked.select("r", "v"))


@query("SELECT 'B' || k AS cell FROM range(1, 1001) t(k)")
def circular_chain(spark, sf_dir):
    """A chain of 5,000 cells, and a cycle of 1,000."""
    n = F.col("id")
    chain = spark.range(1, 5001).select(F.concat(F.lit("A"), n + 1).alias("cell_id"), F.concat(F.lit("=A"), n, F.lit("+1")).alias("raw"))
    cycle = spark.range(1, 1001).select(F.concat(F.lit("B"), n).alias("cell_id"), F.concat(F.lit("=B"), n % 1000 + 1).alias("raw"))
    return workbook.circular(workbook.dependencies(chain.union(cycle)))


@query("SELECT k::INT AS r, k * 100::DOUBLE AS v FROM range(1, 4) t(k)")
def pin_override(spark, sf_dir):
    """A pinned array stands in for the formula's at its anchor; A1# reads it."""
    one = arrays.SEQUENCE(spark, 5).select(F.lit(1).alias("anchor_r"), F.lit(1).alias("anchor_c"), F.lit(1).cast("long").alias("seq"), "r", "c", "v")
    host = arrays.SEQUENCE(spark, 3, 1, 100, 100).select(F.lit(1).alias("anchor_r"), F.lit(1).alias("anchor_c"), F.lit(1).cast("long").alias("seq"), "r", "c", "v")
    none = spark.range(0).select(F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"), F.lit("").alias("raw"))
    return workbook.spill_array(workbook.spill(none, workbook.pin(one, host))[0], 1, 1).select("r", "v")


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 2) AS chain FROM orders")
def running_chain(spark, sf_dir):
    """A{n} = A{n-1} + price{n} for each customer."""
    o = workbook.running_chain(table(spark, sf_dir, "orders"), F.col("o_totalprice"), ["o_orderkey"], ["o_custkey"])
    return o.select("o_custkey", "o_orderkey", F.round("chain", 2).alias("chain"))


# ---- formula text


def _formulas(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    row = (F.col("p_partkey") % 90 + 1).cast("string")
    return p.select("p_partkey", F.concat(F.lit("=A"), row, F.lit("*$B$2+SUM(C"), row, F.lit(":D9)&\"A1\"")).alias("f"))


@query("SELECT p_partkey, '=C' || (k + 3) || '*$B$2+SUM(E' || (k + 3) || ':F12)&\"A1\"' AS shifted FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_shift(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.shift(F.col("f"), 3, 2).alias("shifted"))


@query("SELECT p_partkey, '=' || CASE WHEN k <= 4 THEN '#REF!' ELSE 'A' || (k - 4) END || '*$B$2+SUM(' || CASE WHEN k <= 4 THEN '#REF!' ELSE 'C' || (k - 4) || ':D5' END || ')&\"A1\"' AS shifted FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_shift_off_grid(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.shift(F.col("f"), -4, 0).alias("shifted"))


@query("SELECT p_partkey, ['A' || k, 'B2', 'C' || k, 'D9'] AS refs FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part) WHERE k <> 0")
def refs_extract(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.cell_refs(F.col("f")).alias("refs"))


ORACLE_SQL["refs_extract"] = "SELECT p_partkey, 'A' || k || ',B2,C' || k || ',D9' AS refs FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)"
QUERIES["refs_extract"] = lambda spark, sf_dir: _formulas(spark, sf_dir).select("p_partkey", F.array_join(references.cell_refs(F.col("f")), ",").alias("refs"))


@query("SELECT p_partkey, '=A' || k || '*$C$2+SUM(D' || k || ':E9)&\"A1\"' AS adjusted FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_adjust_insert(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.adjust_inserted(F.col("f"), cols=[1]).alias("adjusted"))


@query("SELECT p_partkey, '=' || CASE WHEN k = 5 THEN '#REF!' WHEN k > 5 THEN 'A' || (k - 1) ELSE 'A' || k END || '*$B$2+SUM(C' || CASE WHEN k = 5 THEN '5:D8' WHEN k < 5 THEN k || ':D8' WHEN k = 9 THEN '8:D8' WHEN k < 9 THEN (k - 1) || ':D8' ELSE '8:D' || (k - 1) END || ')&\"A1\"' AS adjusted FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_adjust_delete(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.adjust_deleted(F.col("f"), rows=[4]).alias("adjusted"))


@query("SELECT p_partkey, '=' || CASE WHEN k = 5 THEN '#REF!' ELSE 'A' || k END || '*$B$2+SUM(' || CASE WHEN k = 5 THEN '#REF!' ELSE 'C' || k END || ':D9)&\"A1\"' AS stamped FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_stamp_deleted(spark, sf_dir):
    return _formulas(spark, sf_dir).select("p_partkey", references.stamp_deleted(F.col("f"), [], [4]).alias("stamped"))


@query("SELECT p_partkey, '=B' || k || '*$C$2+SUM(C' || k || ':D9)&\"A1\"' AS moved FROM (SELECT p_partkey, p_partkey % 90 + 1 AS k FROM part)")
def refs_move_columns(spark, sf_dir):
    """Column C moved before A: A and B go right, the bounded range stays."""
    return _formulas(spark, sf_dir).select("p_partkey", references.move_columns(F.col("f"), 2, 1, 0).alias("moved"))


@query("SELECT p_partkey, 'SUM' AS used, '' AS unknown, (strlen(f) - strlen(f) + 16 - 3)::INT AS n FROM (SELECT p_partkey, 'x' AS f FROM part)")
def formula_tokens(spark, sf_dir):
    """Called names, a lint, and the number of tokens."""
    f = F.col("f")
    return _formulas(spark, sf_dir).select("p_partkey", F.array_join(references.functions_used(f), ",").alias("used"), F.array_join(references.unknown_functions(f, ["SUM", "AVERAGE"]), ",").alias("unknown"), F.size(references.classified(f)).alias("n"))


# ---- dates and times


@query("SELECT o_orderkey, year(d)::DOUBLE AS y, month(d)::DOUBLE AS m, day(d)::DOUBLE AS d, isodow(d)::DOUBLE AS wd, (dayofweek(d) + 1)::DOUBLE AS wd_sunday, dayofyear(d)::DOUBLE AS doy, week(d)::DOUBLE AS w, quarter(d)::DOUBLE AS q, (year(d) % 4 = 0 AND year(d) % 100 <> 0) OR year(d) % 400 = 0 AS leap FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.YEAR(d).alias("y"), temporal.MONTH(d).alias("m"), temporal.DAY_(d).alias("d"), temporal.WEEKDAY(d).alias("wd"), temporal.WEEKDAY(d, False).alias("wd_sunday"), temporal.DAYOFYEAR(d).alias("doy"), temporal.WEEKOFYEAR(d).alias("w"), temporal.QUARTER(d).alias("q"), temporal.IS_LEAP_YEAR(d).alias("leap"))


@query("SELECT event_id, hour(ts)::DOUBLE AS h, minute(ts)::DOUBLE AS mi, second(ts)::DOUBLE AS s, strftime(ts, '%Y-%m-%d') AS d, (epoch_us(ts) % 86400000000) * 1000 AS nanos FROM events")
def time_parts(spark, sf_dir):
    t = temporal.TO_TIME(F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", temporal.HOUR(t).alias("h"), temporal.MINUTE(t).alias("mi"), temporal.SECOND(t).alias("s"), temporal.ISO(temporal.TO_DATE(F.col("ts")), "date").alias("d"), t.alias("nanos"))


@query("SELECT o_orderkey, strftime(d + INTERVAL 1 MONTH, '%Y-%m-%d') AS plus_month, strftime(d + INTERVAL 1 YEAR - INTERVAL 10 DAY, '%Y-%m-%d') AS moved, strftime(d - INTERVAL 2 WEEK, '%Y-%m-%d') AS minus_weeks FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def date_arithmetic(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    moved = temporal.DATESUB(temporal.DATEADD(d, temporal.YEARS(1), "date"), temporal.DAYS(10), "date")
    iso = lambda x: temporal.ISO(x, "date")
    return table(spark, sf_dir, "orders").select("o_orderkey", iso(temporal.DATEADD(d, temporal.MONTHS(1), "date")).alias("plus_month"), iso(moved).alias("moved"), iso(temporal.DATESUB(d, temporal.WEEKS(2), "date")).alias("minus_weeks"))


@query("SELECT event_id, epoch_us(ts + INTERVAL 90 MINUTE) // 1000000 AS later, ((epoch_us(ts) % 86400000000 + 7200000000) % 86400000000) // 1000000 AS clock FROM events")
def datetime_arithmetic(spark, sf_dir):
    t = F.col("ts").cast("timestamp_ntz")
    later = temporal.DATEADD(t, temporal.SPAN(hours=1, minutes=30), "datetime")
    clock = temporal.DATEADD(temporal.TO_TIME(t), temporal.HOURS(2), "time")
    return table(spark, sf_dir, "events").select("event_id", F.floor(temporal.SECONDS_BETWEEN(F.lit("1970-01-01").cast("timestamp_ntz"), later)).alias("later"), F.floor(clock / 1_000_000_000).alias("clock"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS d, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0 AS h, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0 AS m, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0 AS s FROM events")
def differences(spark, sf_dir):
    a, b = F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", *[f(a, b).alias(n) for f, n in ((temporal.DAYS_BETWEEN, "d"), (temporal.HOURS_BETWEEN, "h"), (temporal.MINUTES_BETWEEN, "m"), (temporal.SECONDS_BETWEEN, "s"))])


@query("SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS long_form, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS full_form, strftime(o_orderdate, '%a %j') AS short_form FROM orders")
def format_dates(spark, sf_dir):
    t = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.FORMAT(t, "%B %d, %Y").alias("long_form"), temporal.FORMAT(t, "%Y/%m/%d %H:%M:%S").alias("full_form"), temporal.FORMAT(t, "%a %j").alias("short_form"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS by_format, o_orderkey % 28 + 1 AS day, CASE WHEN o_orderkey % 28 + 1 > 31 THEN NULL ELSE '2023-01-' || lpad((o_orderkey % 28 + 1)::VARCHAR, 2, '0') END AS made FROM orders")
def parse_and_make_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text, shown = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "dd/MM/yyyy")
    day = F.col("o_orderkey") % 28 + 1
    iso = lambda x: temporal.ISO(x, "date")
    return o.select("o_orderkey", iso(temporal.PARSE_DATE(text)).alias("iso"), iso(temporal.PARSE_DATE(shown, "%d/%m/%Y")).alias("by_format"), day.alias("day"), iso(temporal.DATE(2023, 1, day)).alias("made"))


@query("SELECT o_orderkey, (e - d)::BIGINT AS days, (e - d)::DOUBLE * 86400 AS seconds FROM (SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + to_months((o_orderkey % 14)::INT) + to_days((o_orderkey % 40)::INT))::DATE AS e FROM orders)")
def span_lengths(spark, sf_dir):
    """Months and days that differ by row, as texts."""
    d = F.col("o_orderdate").cast("date")
    span = temporal.PARSE_SPAN(F.concat(F.lit("P"), F.col("o_orderkey") % 14, F.lit("M"), F.col("o_orderkey") % 40, F.lit("D")))
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.SPAN_TO_DAYS(span, d).cast("long").alias("days"), temporal.SPAN_TO_SECONDS(span, d).alias("seconds"))


@query("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') AS local, epoch(timezone('America/New_York', timezone('UTC', ts))) - epoch(ts) AS shift FROM events")
def zones(spark, sf_dir):
    z = temporal.IN_TZ(temporal.ZONED(F.col("ts").cast("timestamp_ntz"), F.lit("UTC")), "America/New_York")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(temporal.TO_DATETIME_OF(z), "yyyy-MM-dd HH:mm:ss").alias("local"), temporal.TZ_OFFSET_SECONDS(z).alias("shift"))


def _berlin(t: str) -> str:
    """SQL: offset of Europe/Berlin in hours at a UTC time."""
    return f"CAST((epoch_us(timezone('Europe/Berlin', timezone('UTC', {t}))) - epoch_us({t})) // 3600000000 AS INT)"


#: Times of day on the days of both changes, and on others.
TURNS_SQL = "(SELECT event_id, date_trunc('second', CASE event_id % 3 WHEN 0 THEN TIMESTAMP '2024-03-31' + (ts - date_trunc('day', ts)) WHEN 1 THEN TIMESTAMP '2024-10-27' + (ts - date_trunc('day', ts)) ELSE ts END) AS t FROM events)"
#: t is a wall clock. It may be read with the offset of winter or of summer; one, both (fold) or none (gap) of the readings shows it again.
ZONE_RULES = f"""
WITH k AS (SELECT *, {_berlin("t - INTERVAL 1 HOUR")} = 1 AS w, {_berlin("t - INTERVAL 2 HOUR")} = 2 AS s FROM {TURNS_SQL}),
r AS (SELECT event_id, CASE WHEN s THEN t - INTERVAL 2 HOUR ELSE t - INTERVAL 1 HOUR END AS u, w <> s AS plain FROM k),
o AS (SELECT *, {_berlin("u")} AS ou FROM r),
n AS (SELECT *, u + to_hours(ou) + INTERVAL 1 DAY AS t2 FROM o),
q AS (SELECT *, CASE WHEN {_berlin("t2 - INTERVAL 2 HOUR")} = 2 THEN t2 - INTERVAL 2 HOUR ELSE t2 - INTERVAL 1 HOUR END AS v FROM n),
x AS (SELECT *, {_berlin("v")} AS ov, strftime(u + to_hours(ou), '%Y-%m-%dT%H:%M:%S') || '+0' || ou || ':00[Europe/Berlin]' AS zoned FROM q)
SELECT event_id, zoned, ou = 2 AS dst, CASE WHEN plain THEN zoned END AS strict,
       strftime(v + to_hours(ov), '%Y-%m-%dT%H:%M:%S') || '+0' || ov || ':00[Europe/Berlin]' AS next_day
FROM x"""


def _turns(spark, sf_dir):
    t = F.col("ts").cast("timestamp_ntz")
    clock = temporal.TO_TIME(t)
    on = lambda day: temporal.TO_DATETIME(F.lit(day).cast("date"), clock)
    k = F.col("event_id") % 3
    chosen = F.when(k == 0, on("2024-03-31")).when(k == 1, on("2024-10-27")).otherwise(t)
    return table(spark, sf_dir, "events").select("event_id", F.date_trunc("SECOND", chosen).cast("timestamp_ntz").alias("t"))


@query(ZONE_RULES)
def zone_rules(spark, sf_dir):
    """Gaps, folds and daylight saving."""
    rows = _turns(spark, sf_dir).withColumn("z", temporal.ZONED(F.col("t"), F.lit("Europe/Berlin")))
    z = F.col("z")
    return rows.select("event_id", temporal.ISO(z, "zoned").alias("zoned"), temporal.IS_DST(z).alias("dst"), temporal.ISO(temporal.DATEADD(z, temporal.DAYS(1), "zoned"), "zoned").alias("next_day"), temporal.ISO(temporal.ZONED(F.col("t"), F.lit("Europe/Berlin"), "reject"), "zoned").alias("strict"))


@query("SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE AS n FROM orders")
def date_numbers(spark, sf_dir):
    """What a sum takes of a date."""
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.number(F.col("o_orderdate").cast("date"), "date").alias("n"))


@query("SELECT count(*) FILTER (WHERE kind = 'date') AS dates, count(*) FILTER (WHERE kind = 'span') AS spans, count(*) FILTER (WHERE kind = 'zoned') AS zoned FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'date' WHEN 1 THEN 'span' ELSE 'zoned' END AS kind FROM orders)")
def temporal_literals(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, "5h 30m").otherwise("2024-06-15T12:00:00-04:00[America/New_York]")
    kind = temporal.temporal_literal(text)
    return table(spark, sf_dir, "orders").agg(*[F.sum((F.coalesce(kind, F.lit("")) == n).cast("int")).alias(a) for n, a in (("date", "dates"), ("span", "spans"), ("zoned", "zoned"))])


# ---- URLs and units


URL_PARTS = "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/:?#]*:([0-9]+)', 1), ''), '0')::DOUBLE AS port, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment, true AS valid FROM pages"


@query(URL_PARTS)
def url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.URL_SCHEME(u).alias("scheme"), url.URL_HOST(u).alias("host"), url.URL_PORT(u).alias("port"), url.URL_PATH(u).alias("path"), url.URL_QUERY(u).alias("query"), url.URL_FRAGMENT(u).alias("fragment"), url.URL_VALID(u).alias("valid"))


@query("SELECT page_id, coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1], '') AS first, coalesce(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[-1], '') AS last FROM pages")
def url_segments(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.URL_PATH_SEGMENT(u, 1).alias("first"), url.URL_PATH_SEGMENT(u, -1).alias("last"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url_encode(url), '-', '%2D'), '_', '%5F'), '.', '%2E'), '~', '%7E'), '*', '%2A') AS encoded, url AS back FROM pages")
def url_codes(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", url.URL_ENCODE(u).alias("encoded"), url.URL_DECODE(url.URL_ENCODE(u)).alias("back"))


@query("SELECT page_id, 'a b+' || page_id AS found, '' AS missing FROM pages")
def url_params(spark, sf_dir):
    u = F.concat(F.regexp_extract("url", r"^([a-z]+://[^?#]*)", 1), F.lit("?p=1&q=a+b%2B"), F.col("page_id").cast("string"), F.lit("&q=2&page=3"))
    return table(spark, sf_dir, "pages").select("page_id", url.URL_PARAM(u, "q").alias("found"), url.URL_PARAM(u, "none").alias("missing"))


URL_SITE, URL_FOLDER = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)", "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*/)', 1) END"


@query(f"SELECT page_id, {URL_SITE} || ({URL_FOLDER}) || 'n' || page_id || '/z?y=1' AS joined, {URL_SITE} || '/top' || page_id AS rooted, {URL_SITE} || CASE WHEN len(string_split({URL_FOLDER}, '/')) <= 2 THEN '/' ELSE regexp_replace({URL_FOLDER}, '[^/]+/$', '') END || 'up' AS up FROM pages")
def url_join(spark, sf_dir):
    """Names in the page's own folder, at its site's root, and one folder up."""
    base, n = F.col("url"), F.col("page_id").cast("string")
    joined = url.URL_JOIN(base, F.concat(F.lit("./n"), n, F.lit("/z?y=1")))
    return table(spark, sf_dir, "pages").select("page_id", joined.alias("joined"), url.URL_JOIN(base, F.concat(F.lit("/top"), n)).alias("rooted"), url.URL_JOIN(base, F.lit("../up")).alias("up"))


@query("SELECT p_partkey, p_size * 1000.0 AS metres, round(p_size * 1000 / 1609.344, 6) AS miles, p_size + 0.5 AS added, p_size > 10 AS far, '#UNIT!' AS mismatch FROM part")
def unit_arithmetic(spark, sf_dir):
    q, half, ten, time = (units.quantity(x, u) for x, u in ((F.col("p_size").cast("double"), "km"), (F.lit(500.0), "m"), (F.lit(10000.0), "m"), (F.lit(2.0), "seconds")))
    return table(spark, sf_dir, "part").select("p_partkey", units.CONVERT(q, "m").alias("metres"), F.round(units.CONVERT(q, "mi"), 6).alias("miles"), F.round(units.add(q, half)["mag"], 9).alias("added"), (units.compare(q, ten) > 0).alias("far"), units.error(q, time).alias("mismatch"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN round(p_size / 0.44704, 6) WHEN 1 THEN round(p_size / 3.6 / 0.44704, 6) WHEN 2 THEN p_size::DOUBLE END AS mph, CASE p_size % 4 WHEN 0 THEN 'm/s' WHEN 1 THEN 'km/h' WHEN 2 THEN 'mph' END AS unit FROM part")
def unit_texts(spark, sf_dir):
    """Texts in four units, one of them unknown."""
    rest = F.col("p_size") % 4
    text = F.concat(F.col("p_size").cast("string"), F.when(rest == 0, " m/s").when(rest == 1, "km / h").when(rest == 2, " mph").otherwise(" bananas"))
    rows = table(spark, sf_dir, "part").select("p_partkey", units.parse(text).alias("q"))
    return rows.select("p_partkey", F.round(units.CONVERT(F.col("q"), "mph"), 6).alias("mph"), F.col("q.unit").alias("unit"))


# ---- what users add


class Money(CustomType):
    """Texts such as '$12.50'; data is the amount in cents."""

    tag = "money"

    def parse(self, text):
        return F.when(text.rlike(r"^\$[0-9]+\.[0-9]{2}$"), F.regexp_replace(text, r"[$.]", ""))

    def number(self, data):
        return data.cast("double") / 100

    def display(self, data):
        return F.concat(F.lit("$"), F.format_string("%.2f", self.number(data)))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS y FROM lineitem")
def custom_function(spark, sf_dir):
    r = Registry()
    r.add_function("DOUBLE_PLUS", lambda x: x * 2 + 1, "double")
    s = sheet(spark, sf_dir, "lineitem")
    return s.df.select("l_orderkey", "l_linenumber", r.call("double_plus", s["l_quantity"])["value"].alias("y"))


@query("SELECT p_partkey, 'money' AS tag, round(p_retailprice * 100)::BIGINT::VARCHAR AS data FROM part")
def custom_type(spark, sf_dir):
    r = Registry()
    r.add_type(Money())
    v = r.literal(F.format_string("$%.2f", F.col("p_retailprice")))
    return table(spark, sf_dir, "part").select("p_partkey", v["tag"].alias("tag"), v["data"].alias("data"))


@query("SELECT round(sum(l_quantity * l_quantity), 2) AS squares, count(*) AS n FROM lineitem")
def custom_aggregate(spark, sf_dir):
    def partial(b):
        return b.assign(squares=b["l_quantity"] ** 2, n=1)[["squares", "n"]].sum().to_frame().T.astype({"n": "int64"})

    def merge(b):
        return b.sum().to_frame().T.astype({"n": "int64"})

    out = aggregate(table(spark, sf_dir, "lineitem"), ["l_quantity"], partial, merge, "squares double, n long")
    return out.select(F.round("squares", 2).alias("squares"), "n")


@query("SELECT round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 6) AS avg, min(o_totalprice) AS min, max(o_totalprice) AS max, count(o_totalprice)::DOUBLE AS count FROM orders")
def selection_statistics(spark, sf_dir):
    s = sheet(spark, sf_dir, "orders")
    v = s["o_totalprice"]
    return s.df.agg(F.round(core.SUM(v), 2).alias("sum"), F.round(core.AVERAGE(v), 6).alias("avg"), core.MIN(v).alias("min"), core.MAX(v).alias("max"), core.COUNT(v).alias("count"))


# ---- streams


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    stream = pins.stream_of(spark, f"{sf_dir}/events.parquet")
    out = pins.run_to_end(pins.windowed(stream.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour", "30 days", "event_type"), "windows")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT count(*)::DOUBLE AS n, round(sum(v), 4) AS total FROM (SELECT arg_max(value, event_id) AS v FROM events GROUP BY user_id)")
def stream_pin(spark, sf_dir):
    """The latest value of each user, pinned from a stream; formulas over the snapshot."""
    from .plans.scratch import place

    stream = pins.stream_of(spark, f"{sf_dir}/events.parquet").select("user_id", "event_id", "value")
    path = place(spark, "pin")

    def evaluate(snapshot):
        v = Sheet(snapshot)["value"]
        return snapshot.agg(core.COUNT(v).alias("n"), F.round(core.SUM(v), 4).alias("total"))

    pins.pinned(stream, evaluate, path, ["user_id"], "event_id").awaitTermination()
    last = max(int(r["result"]) for r in spark.read.parquet(path + "/result=*").select(F.regexp_extract(F.input_file_name(), r"result=(\d+)", 1).alias("result")).distinct().collect())
    return spark.read.parquet(f"{path}/result={last}")


from . import formula_queries, temporal_queries  # noqa: E402, F401  (they register themselves)
