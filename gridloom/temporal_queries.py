"""Queries over operators and comparisons of custom values, failures as values, and cells of any kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import core, sheet, temporal, types, units
from .functions.custom import CustomType, Registry
from .functions.values import Value, held
from .operators import arrays
from .plans import workbook
from .queries import TURNS_SQL, _turns, query, table
from .sources import sheets
from .sources.sheets import Sheet

DAY_SQL = "o_orderdate::DATE"


@query(f"SELECT o_orderkey, ({DAY_SQL} < DATE '1995-06-17') AS before, ({DAY_SQL} = (DATE '1995-06-17' + (o_orderkey % 3)::INT)) AS same, ({DAY_SQL} >= DATE '1995-06-17') AS since, false AS equals_number, false AS below_number, true AS unlike_number FROM orders")
def date_compare(spark, sf_dir):
    """Dates with dates by day; a date and a number are never equal and have no order."""
    s = Sheet(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")))
    d, other = s["o_orderdate"], types.value("date", F.date_add(F.lit("1995-06-17").cast("date"), (F.col("o_orderkey") % 3).cast("int")))
    mid = sheet.call("DATE", 1995, 6, 17)
    return s.df.select("o_orderkey", (d < mid).col.alias("before"), (d == other).col.alias("same"), (d >= mid).col.alias("since"), (d == 9298).col.alias("equals_number"), (d < 9298).col.alias("below_number"), (d != 9298).col.alias("unlike_number"))


@query(f"SELECT o_orderkey, ({DAY_SQL} - DATE '1970-01-01' + 7)::DOUBLE AS plus, ({DAY_SQL} - DATE '1970-01-01')::DOUBLE * 2 AS twice, (o_orderkey % 90) || 'd1' AS span_plus, CAST(NULL AS DOUBLE) AS span_minus FROM orders WHERE o_orderkey % 90 > 0")
def date_plus_number(spark, sf_dir):
    """A date's number goes on as a number; a span has none, so + joins texts and - gives nothing."""
    s = Sheet(table(spark, sf_dir, "orders").where("o_orderkey % 90 > 0").withColumn("o_orderdate", F.col("o_orderdate").cast("date")))
    d, span = s["o_orderdate"], sheet.call("DAYS", Value(F.col("o_orderkey") % 90, "number"))
    return s.df.select("o_orderkey", (d + 7).col.alias("plus"), (d * 2).col.alias("twice"), (span + 1).col.alias("span_plus"), (span - 1).col.alias("span_minus"))


@query(f"SELECT o_orderkey, strftime({DAY_SQL} + to_months((o_orderkey % 25)::INT), '%Y-%m-%d') AS later, strftime({DAY_SQL} - to_days((o_orderkey % 25)::INT), '%Y-%m-%d') AS earlier, CASE WHEN o_orderkey % 25 = 0 THEN 'PT0S' ELSE 'P' || (o_orderkey % 25) || 'D' END AS apart, CASE WHEN o_orderkey % 25 = 0 THEN 'PT0S' ELSE 'P' || 3 * (o_orderkey % 25) || 'D' END AS tripled FROM orders")
def date_operators(spark, sf_dir):
    """Dates and spans through + - *."""
    s = Sheet(table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")))
    d, n = s["o_orderdate"], Value(F.col("o_orderkey") % 25, "number")
    earlier = d - sheet.call("DAYS", n)
    return s.df.select("o_orderkey", (d + sheet.call("MONTHS", n)).out("later"), earlier.out("earlier"), sheet.call("ISO", d - earlier).out("apart"), sheet.call("ISO", 3 * sheet.call("DAYS", n)).out("tripled"))


@query("SELECT o_orderkey, 7 * (o_orderkey % 5) = o_orderkey % 30 AS same, 24 * (o_orderkey % 30) < 100 AS short, 7 * (o_orderkey % 5) >= o_orderkey % 30 AS longer FROM orders")
def span_compare(spark, sf_dir):
    """Spans by their length: seven days are a week."""
    k = F.col("o_orderkey")
    weeks, days = sheet.call("WEEKS", Value(k % 5, "number")), sheet.call("DAYS", Value(k % 30, "number"))
    return table(spark, sf_dir, "orders").select("o_orderkey", (weeks == days).col.alias("same"), (days < sheet.call("HOURS", 100)).col.alias("short"), (weeks >= days).col.alias("longer"))


@query(f"SELECT event_id, event_id % 2 = 0 AS same, event_id % 2 = 1 AS later, strftime(t, '%H:%M:%S') || ' UTC' AS utc, CASE event_id % 2 WHEN 0 THEN 'PT0S' ELSE 'PT1H' END AS apart FROM {TURNS_SQL}")
def zoned_compare(spark, sf_dir):
    """Zoned times by instant, whatever their zones; a difference is elapsed time."""
    rows = _turns(spark, sf_dir).withColumn("z", temporal.ZONED(F.col("t"), F.lit("UTC")))
    one = types.value("zoned", F.col("z"))
    other = sheet.call("IN_TZ", one + sheet.call("HOURS", Value(F.col("event_id") % 2, "number")), "Asia/Tokyo")
    rows, other = held(rows, "other", other)
    return rows.select("event_id", (one == other).col.alias("same"), (other > one).col.alias("later"), sheet.call("FORMAT", one, "%H:%M:%S %Q").col.alias("utc"), sheet.call("ISO", other - one).col.alias("apart"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:00') || '+09:00[Asia/Tokyo]' AS named, strftime(ts - INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:00') || '+00:00[UTC]' AS utc, strftime(ts, '%d.%m.%y %H-%M') || ' +0900' AS shown FROM events")
def zoned_texts(spark, sf_dir):
    """Zoned times read and shown by formats."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit(" Asia/Tokyo")).alias("text"))
    z = sheet.call("PARSE_ZONED", Value(F.col("text"), "text"), "%d/%m/%Y %H:%M %Q")
    rows = e.select("event_id", z.col.alias("z"), z.err.alias("err"))
    z = types.value("zoned", F.col("z"), F.col("err"))
    return rows.select("event_id", sheet.call("ISO", z).out("named"), sheet.call("ISO", sheet.call("TO_UTC", z)).out("utc"), sheet.call("FORMAT", z, "%d.%m.%y %H-%M %z").out("shown"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 31 + 1 > 29 THEN '#VALUE!' ELSE '2024-02-' || lpad((o_orderkey % 31 + 1)::VARCHAR, 2, '0') END AS day, CASE WHEN o_orderkey % 2 = 0 THEN '#VALUE!' ELSE '13:00:00' END AS clock, CASE o_orderkey % 3 WHEN 0 THEN 'UTC' WHEN 1 THEN '+05:30' ELSE '#VALUE!' END AS zone, '#VALUE!' AS year_of_text, CASE WHEN o_orderkey % 31 + 1 > 29 THEN '#VALUE!' ELSE '2' END AS month FROM orders")
def temporal_errors(spark, sf_dir):
    """Failures are error values, which go on through other functions; an empty cell is none."""
    k = F.col("o_orderkey")
    day = sheet.call("DATE", 2024, 2, Value(k % 31 + 1, "number"))
    span = types.value("span", F.when(k % 2 == 0, temporal.MONTHS(1)).otherwise(temporal.HOURS(1)))
    zone = sheet.call("TIMEZONE", Value(F.when(k % 3 == 0, "UTC").when(k % 3 == 1, "+0530").otherwise("Foo/Bar"), "text"))
    return table(spark, sf_dir, "orders").select("o_orderkey", day.out("day"), (sheet.call("TIME", 12, 0, 0) + span).out("clock"), zone.out("zone"), sheet.call("YEAR", Value(F.col("o_orderstatus"), "text")).out("year_of_text"), sheet.call("MONTH", day).out("month"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '#VALUE!' ELSE lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) END AS host, '#VALUE!' AS of_number, CASE WHEN page_id % 2 = 0 THEN 'failed' ELSE 'read' END AS state FROM pages")
def url_errors(spark, sf_dir):
    """What is no URL, or no text, is #VALUE!."""
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("not "), "url")).otherwise(F.col("url")).alias("u"))
    host = sheet.call("URL_HOST", Value(F.col("u"), "text"))
    return p.select("page_id", host.out("host"), sheet.call("URL_HOST", Value(F.col("page_id"), "number")).out("of_number"), F.when(host.err.isNull(), "read").otherwise("failed").alias("state"))


@query("SELECT p_partkey, round(p_size + 0.25, 6) || ' km' AS added, CASE WHEN p_partkey % 2 = 0 THEN '#UNIT!' ELSE round(p_size - 2, 6)::INT || ' km' END AS mixed, p_size * 1000 = 2000 AS same, p_size > 10 AS far, p_size * 3 || ' km' AS tripled, round(p_size / 3.6, 6) AS speed, '#DIV/0!' AS divided, p_size::DOUBLE ^ 2 * 1000000 AS area FROM part")
def qty_operators(spark, sf_dir):
    """Quantities through + - * / ^ and comparisons; unlike dimensions are #UNIT!."""
    rows = table(spark, sf_dir, "part").select("p_partkey", units.quantity(F.col("p_size").cast("double"), "km").alias("q"), units.parse(F.when(F.col("p_partkey") % 2 == 0, "2 seconds").otherwise("2 km")).alias("other"))
    q, other = types.value("qty", F.col("q")), types.value("qty", F.col("other"))
    metres = lambda n: types.value("qty", units.quantity(F.lit(float(n)), "m"))
    added = F.concat(F.regexp_replace(F.round((q + metres(250)).col["mag"], 6).cast("string"), r"\.0$", ""), F.lit(" km"))
    speed = F.round(sheet.call("CONVERT", q / types.value("qty", units.quantity(F.lit(1.0), "h")), "m/s").col, 6)
    return rows.select("p_partkey", added.alias("added"), (q - other).out("mixed"), (q == metres(2000)).col.alias("same"), (q > metres(10000)).col.alias("far"), (q * 3).out("tripled"), speed.alias("speed"), (q / 0).out("divided"), (q**2).col["si"].alias("area"))


class Cents(CustomType):
    """Amounts in cents: they add among themselves and scale by numbers, and have an order."""

    tag = "cents"

    def number(self, data):
        return data.cast("double") / 100

    def display(self, data):
        return F.format_string("$%.2f", self.number(data))

    def binary(self, op, left, right):
        if op == "+" and left.handler is right.handler:
            return left.col + right.col
        if op == "*" and right.kind == "number":
            return F.rint(left.col * right.number).cast("long")
        return None

    def compare(self, left, right):
        return F.signum(left.col - right.col).cast("int") if left.handler is right.handler else None


@query("SELECT p_partkey, printf('$%.2f', (c + 50) / 100.0) AS added, printf('$%.2f', c * 3 / 100.0) AS scaled, c > 100000 AS dear, false AS equals_number, round(c / 100.0 - 1, 2) AS less FROM (SELECT p_partkey, round(p_retailprice * 100)::BIGINT AS c FROM part)")
def custom_operators(spark, sf_dir):
    """A user's type: its own operators and order, and its number where it declines."""
    r = Registry()
    r.add_type(Cents())
    v = r.value("cents", F.round(F.col("p_retailprice") * 100).cast("long"))
    half, dear = r.value("cents", F.lit(50).cast("long")), r.value("cents", F.lit(100000).cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", (v + half).out("added"), (v * 3).out("scaled"), (v > dear).col.alias("dear"), (v == 5).col.alias("equals_number"), F.round((v - 1).col, 2).alias("less"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '#DIV/0!' ELSE 'ok' END AS eager, CASE WHEN l_discount = 0 AND l_quantity > 25 THEN '#DIV/0!' ELSE 'ok' END AS chosen FROM lineitem")
def if_eager(spark, sf_dir):
    """IF evaluates both branches first, so an error in the one not taken is the result."""
    s = Sheet(table(spark, sf_dir, "lineitem"))
    risky = s["l_tax"] / s["l_discount"]
    state = lambda v: F.when(v.err.isNull(), "ok").otherwise(v.err)
    return s.df.select("l_orderkey", "l_linenumber", state(core.IF(s["l_quantity"] > 25, risky, 1)).alias("eager"), state(core.IF(s["l_quantity"] > 25, risky, 1, eager=False)).alias("chosen"))


@query("SELECT (n_nationkey + 1)::INT AS r, c::INT AS c, n_nationkey::DOUBLE * 10 + c * n_regionkey AS v, CAST(NULL AS VARCHAR) AS error FROM nation, range(1, 4) t(c) UNION ALL SELECT 1, 1, NULL, '#VALUE! incompatible array shapes'")
def broadcast_shapes(spark, sf_dir):
    """A column against three columns of its height; and a column against one of another height."""
    n = table(spark, sf_dir, "nation")
    place = (F.col("n_nationkey") + 1).cast("int").alias("r")
    column = n.select(place, F.lit(1).alias("c"), (F.col("n_nationkey") * 10).cast("double").alias("v"))
    grid = n.select(place, F.col("n_regionkey"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("c")).select("r", "c", (F.col("c") * F.col("n_regionkey")).cast("double").alias("v"))
    add = lambda x, y: x + y
    return arrays.broadcast(column, grid, add).union(arrays.broadcast(column, column.where("r < 9"), add))


@query("SELECT (o_orderkey % 700 + 1)::INT AS r, kind, CASE WHEN kind = 'number' THEN o_custkey::DOUBLE END AS num, CASE WHEN kind = 'text' THEN o_custkey::VARCHAR END AS str FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN 'text' ELSE 'number' END AS kind, row_number() OVER (PARTITION BY o_orderkey % 700 ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderkey % 5 <> 0")
def typed_cells(spark, sf_dir):
    """Edits with kinds: a string of digits stays one until a raw edit comes."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("A"), k % 700 + 1).alias("cell_id"),
        F.when(k % 5 == 0, "empty").when(k % 3 == 0, "string").otherwise("raw").alias("kind"),
        F.col("o_custkey").cast("string").alias("value"),
        F.lit(None).cast("string").alias("tag"),
        k.alias("seq"),
    )
    cells = sheets.typed_edits(rows)
    return sheets.typed(sheets.upsert(cells.limit(0), cells)).select("r", "kind", "num", "str")


@query("SELECT 'C' || k AS cell FROM range(1, 501) t(k) WHERE k % 5 = 0")
def circular_ranges(spark, sf_dir):
    """Every fifth cell of C sums a range that holds itself; column F sums the whole of C, and is on no cycle."""
    n = F.col("id")
    fifth = F.concat(F.lit("=SUM(C"), n, F.lit(":D"), n, F.lit(")"))
    c = spark.range(1, 501).select(F.concat(F.lit("C"), n).alias("cell_id"), F.when(n % 5 == 0, fifth).otherwise(F.concat(F.lit("=B"), n)).alias("raw"))
    f = spark.range(1, 501).select(F.concat(F.lit("F"), n).alias("cell_id"), F.lit("=SUM(C:C)").alias("raw"))
    return workbook.circular(workbook.dependencies(c.union(f)))


@query("SELECT '#REF!' AS v")
def spill_of_no_array(spark, sf_dir):
    """B7# where no array is placed."""
    one = arrays.SEQUENCE(spark, 5).select(F.lit(1).alias("anchor_r"), F.lit(1).alias("anchor_c"), F.lit(1).cast("long").alias("seq"), "r", "c", "v")
    none = spark.range(0).select(F.col("id").cast("int").alias("r"), F.col("id").cast("int").alias("c"), F.lit("").alias("raw"))
    return workbook.spill_array(workbook.spill(none, one)[0], 7, 2, shown=True).select("v")


@query("SELECT 'A' || p_partkey AS cell_id, p_name AS raw FROM part WHERE p_partkey % 4 > 0")
def json_store(spark, sf_dir):
    """Cells saved as JSON, one an object a line, and read again."""
    from .plans.scratch import place

    rows = table(spark, sf_dir, "part").where("p_partkey % 4 > 0").select(F.concat(F.lit("A"), "p_partkey").alias("cell_id"), F.col("p_name").alias("raw"), F.lit(0).alias("seq"))
    path = place(spark, "json")
    sheets.to_json(sheets.edits(rows), path, lines=True)
    back = sheets.from_json(spark, path, lines=True)
    return back.select(F.concat(sheets.column_letters(F.col("c")), F.col("r").cast("string")).alias("cell_id"), "raw")
