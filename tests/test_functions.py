"""Temporal, URL, unit and formula-text functions on fixed cases."""

import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from gridloom.functions import temporal as t
from gridloom.functions import units, url
from gridloom.functions.custom import CustomType, Registry
from gridloom.operators import references as refs

NTZ = "timestamp_ntz"


def one(spark, col):
    return spark.range(1).select(col).first()[0]


def day(s):
    return F.lit(s).cast("date")


def ntz(s):
    return F.lit(s).cast(NTZ)


@pytest.mark.parametrize(
    ("col", "want"),
    [
        (lambda: t.ISO(t.DATEADD(t.DATE(2025, 4, 27), t.DAYS(10), "date"), "date"), "2025-05-07"),
        (lambda: t.ISO(t.DATEADD(t.DATE(2025, 1, 31), t.MONTHS(1), "date"), "date"), "2025-02-28"),
        (lambda: t.DATE(2025, 2, 30), None),
        (lambda: t.WEEKDAY(day("2025-04-27")), 7.0),
        (lambda: t.WEEKDAY(day("2025-04-27"), False), 1.0),
        (lambda: t.WEEKOFYEAR(day("2025-04-27")), 17.0),
        (lambda: t.ISO(t.DATEADD(t.TIME(23, 0, 0), t.HOURS(2), "time"), "time"), "01:00:00"),
        (lambda: t.DATEADD(t.TIME(1, 0, 0), t.DAYS(1), "time"), None),
        (lambda: t.SPAN_TO_DAYS(t.MONTHS(1)), 31.0),
        (lambda: t.SPAN_TO_DAYS(t.MONTHS(1), day("2025-02-01")), 28.0),
        (lambda: t.ISO(t.PARSE_SPAN(F.lit("P1Y2M3W4DT5H6M7.5S")), "span"), "P1Y2M3W4DT5H6M7.5S"),
        (lambda: t.ISO(t.PARSE_SPAN(F.lit("5h 30m")), "span"), "PT5H30M"),
        (lambda: t.PARSE_SPAN(F.lit("bananas")), None),
        (lambda: t.ISO(t.span_times(t.DAYS(3), -2), "span"), "-P6D"),
        (lambda: t.ISO(t.DAYS(0), "span"), "PT0S"),
        (lambda: t.ISO(t.PARSE_TIME(F.lit("14:30")), "time"), "14:30:00"),
        (lambda: t.TIMEZONE(F.lit("+0530")), "+05:30"),
        (lambda: t.TIMEZONE(F.lit("Foo/Bar")), None),
        (lambda: t.TIMEZONE(F.lit("+1930")), None),
        (lambda: t.TIMEZONE(F.lit("Z")), "UTC"),
        (lambda: t.friendly(t.span_times(t.SPAN(days=2, hours=3), -1)), "2d 3h ago"),
        (lambda: t.order(t.WEEKS(1), t.DAYS(7), "span"), 0),
        (lambda: t.order(t.MONTHS(1), t.DAYS(30), "span"), 1),
        (lambda: t.FORMAT(t.TIME(7, 5, 9), "%H-%M-%S", "time"), "07-05-09"),
        (lambda: t.ISO(t.PARSE_ZONED(F.lit("15.06.2024 12:00 +0200"), "%d.%m.%Y %H:%M %z"), "zoned"), "2024-06-15T12:00:00+02:00[+02:00]"),
        (lambda: t.DAYS(1.5), None),
        (lambda: t.ISO(t.difference(ntz("2024-01-03 01:00:00"), ntz("2024-01-01 00:00:00"), "datetime"), "span"), "P2DT1H"),
        (lambda: t.ISO(t.PARSE_DATETIME(F.lit("27/04/2025 14:30"), "%d/%m/%Y %H:%M"), "datetime"), "2025-04-27T14:30:00"),
        (lambda: t.ISO(t.TO_DATETIME(ntz("2024-01-03 01:00:00")), "datetime"), "2024-01-03T00:00:00"),
        (lambda: t.NANOSECOND(t.TIME(1, 2, 3, 456)), 456.0),
    ],
)
def test_temporal(spark, col, want):
    got = one(spark, col())
    assert got == want


NY = "America/New_York"


@pytest.mark.parametrize(
    ("civil", "mode", "want"),
    [
        ("2024-03-10 02:30:00", "compatible", "2024-03-10T03:30:00-04:00[America/New_York]"),
        ("2024-03-10 02:30:00", "reject", None),
        ("2024-03-10 02:30:00", "earlier", "2024-03-10T01:30:00-05:00[America/New_York]"),
        ("2024-11-03 01:30:00", "compatible", "2024-11-03T01:30:00-04:00[America/New_York]"),
        ("2024-11-03 01:30:00", "later", "2024-11-03T01:30:00-05:00[America/New_York]"),
        ("2024-11-03 01:30:00", "reject", None),
        ("2024-06-15 12:00:00", "reject", "2024-06-15T12:00:00-04:00[America/New_York]"),
    ],
)
def test_gaps_and_folds(spark, civil, mode, want):
    assert one(spark, t.ISO(t.ZONED(ntz(civil), F.lit(NY), mode), "zoned")) == want


def test_days_across_a_change(spark):
    z = t.ZONED(ntz("2024-03-09 12:00:00"), F.lit(NY))
    next_day = t.DATEADD(z, t.DAYS(1), "zoned")
    assert one(spark, t.ISO(next_day, "zoned")) == "2024-03-10T12:00:00-04:00[America/New_York]"
    assert one(spark, t.SECONDS_BETWEEN(z, next_day, "zoned")) == 82800.0
    assert one(spark, t.ISO(t.difference(next_day, z, "zoned"), "span")) == "PT23H"


def test_zones_against_python(spark):
    start = datetime.datetime(2023, 1, 1)
    hours = [(i, start + datetime.timedelta(hours=i * 37)) for i in range(400)]
    df = spark.createDataFrame(hours, "i int, t timestamp_ntz")
    z = t.IN_TZ(t.ZONED(F.col("t"), F.lit("UTC")), "Europe/Berlin")
    for r in df.select("t", t.TO_DATETIME_OF(z).alias("local"), t.IS_DST(z).alias("dst"), t.TZ_OFFSET_SECONDS(z).alias("offset")).collect():
        want = r.t.replace(tzinfo=datetime.UTC).astimezone(ZoneInfo("Europe/Berlin"))
        assert r.local == want.replace(tzinfo=None) and r.dst == bool(want.dst()) and r.offset == want.utcoffset().total_seconds()


def test_parse_zoned(spark):
    z = t.PARSE_ZONED(F.lit("2024-06-15T12:00:00-04:00[America/New_York]"))
    assert one(spark, t.ISO(z, "zoned")) == "2024-06-15T12:00:00-04:00[America/New_York]"
    assert one(spark, t.number(z, "zoned")) == 1718467200.0


U = "https://reader@Shop.test:9090/fruit/pears/green-ones?sort=up&q=two%20kilos&q=x#prices"


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (url.URL_SCHEME, "https"),
        (url.URL_HOST, "shop.test"),
        (url.URL_PORT, 9090.0),
        (url.URL_PATH, "/fruit/pears/green-ones"),
        (url.URL_QUERY, "sort=up&q=two%20kilos&q=x"),
        (url.URL_FRAGMENT, "prices"),
        (url.URL_VALID, True),
        (lambda u: url.URL_PARAM(u, "q"), "two kilos"),
        (lambda u: url.URL_PARAM(u, "no"), ""),
        (lambda u: url.URL_PATH_SEGMENT(u, 3), "green-ones"),
        (lambda u: url.URL_PATH_SEGMENT(u, -1), "green-ones"),
        (lambda u: url.URL_PATH_SEGMENT(u, 9), ""),
        (lambda u: url.URL_PATH_SEGMENT(u, 0), None),
        (lambda u: url.URL_JOIN(u, F.lit("../nuts?y=1")), "https://reader@Shop.test:9090/fruit/nuts?y=1"),
        (lambda u: url.URL_JOIN(u, F.lit("//other.org/z")), "https://other.org/z"),
    ],
)
def test_url(spark, f, want):
    assert one(spark, f(F.lit(U))) == want


def test_url_edges(spark):
    assert one(spark, url.URL_VALID(F.lit("plain words"))) is False
    assert one(spark, url.URL_VALID(F.lit("mailto:shop@shop.test"))) is True
    assert one(spark, url.URL_PATH(F.lit("https://shop.test"))) == "/"
    assert one(spark, url.URL_PORT(F.lit("https://shop.test:443/"))) == 0.0
    assert one(spark, url.URL_DECODE(F.lit("a+b%20c%zz"))) == "a+b c%zz"
    assert one(spark, url.URL_ENCODE(F.lit("a b-_.~*é"))) == "a%20b%2D%5F%2E%7E%2A%C3%A9"


def test_units(spark):
    q = lambda s: units.parse(F.lit(s))
    assert one(spark, units.compare(q("1000 m"), q("1 km"))) == 0
    assert round(one(spark, units.CONVERT(q("100 m/s"), "mph")), 2) == 223.69
    assert one(spark, units.error(q("3 km"), q("2 seconds"))) == "#UNIT!"
    assert one(spark, units.add(q("3 km"), q("2 seconds"))) is None
    assert one(spark, units.number(units.divide(q("4 km"), q("2 km")))) == 2.0
    assert one(spark, q("3 bananas")) is None and one(spark, q("3 km/bananas")) is None
    assert round(one(spark, units.CONVERT(units.power(q("20 feet"), 1), "m")), 3) == 6.096
    with pytest.raises(KeyError):
        units.CONVERT(q("3 km"), "bananas")


@pytest.mark.parametrize(
    ("f", "formula", "want"),
    [
        (lambda f: refs.stamp_deleted(f, [3, 4], []), "=C7+D8+E9", "=C7+#REF!+#REF!"),
        (lambda f: refs.stamp_deleted(f, [3], []), "=SUM(C:D)", "=SUM(C:#REF!)"),
        (lambda f: refs.stamp_deleted(f, [2, 3], []), "=SUM(C:D)", "=SUM(#REF!)"),
        (lambda f: refs.stamp_deleted(f, [], [2]), "=SUM(3:3)", "=SUM(#REF!)"),
        (lambda f: refs.stamp_deleted(f, [], [2]), "=MAX(C3#)", "=MAX(#REF!#)"),
        (lambda f: refs.adjust_deleted(f, cols=[5]), "=E7:H7", "=E7:G7"),
        (lambda f: refs.adjust_deleted(f, cols=[4, 7]), "=E7:H7", "=E7:F7"),
        (lambda f: refs.adjust_deleted(f, cols=[3]), "=D9+F9", "=#REF!+E9"),
        (lambda f: refs.adjust_deleted(f, cols=[1]), "=D2:B4", "=B2:C4"),
        (lambda f: refs.adjust_deleted(f, cols=[8]), "=D2:B4", "=D2:B4"),
        (lambda f: refs.adjust_deleted(f, cols=[0]), "=$F$2", "=E2"),
        (lambda f: refs.adjust_deleted(f, rows=[5]), "=SUM(4:9)", "=SUM(4:8)"),
        (lambda f: refs.adjust_deleted(f, cols=[0]), "=#REF!+D1", "=#REF!+D1"),
        (lambda f: refs.adjust_inserted(f, cols=[3, 3]), "=D4", "=F4"),
        (lambda f: refs.adjust_inserted(f, cols=[3], rows=[0]), "=$D$4+d3", "=$E$5+E4"),
        (lambda f: refs.adjust_inserted(f, cols=[4]), "=SUM(D:F)+d3", "=SUM(D:G)+d3"),
        (lambda f: refs.shift(f, -3, 0), "=D5*E3*6", "=D2*#REF!*6"),
        (lambda f: refs.shift(f, 0, 23, max_col=26), "=C2:D7", "=#REF!"),
        (lambda f: refs.shift(f, 2, 1), '=C3&"C3"&$C$3&SUM(D4)', '=D5&"C3"&$C$3&SUM(E6)'),
        (lambda f: refs.shift(f, 2, 1), "=$C:$D+4:6+rate+LOG10(C3)", "=$C:$D+6:8+rate+LOG10(D5)"),
        (lambda f: refs.move_columns(f, 2, 1, 4), "=C1+D1+E1+F1", "=E1+C1+D1+F1"),
        (lambda f: refs.move_columns(f, 5, 1, 4), "=D2:E9+SUM(D:E)", "=D2:E9+SUM(D:F)"),
        (lambda f: refs.move_columns(f, 5, 1, 4, True), "=$D2:E$9", "=$D2:F$9"),
        (lambda f: refs.move_rows(f, 6, 1, 4), "=C7+D5+SUM(7:7)+C5:C6", "=C5+D6+SUM(5:5)+C5:C6"),
        (lambda f: refs.move_rows(f, 6, 1, 4, True), "=C5:C6", "=C6:C7"),
        (lambda f: refs.move_rows(f, 6, 1, 6), "=C7", "=C7"),
        (lambda f: refs.shift(f, 1, 1), "no formula C3", "no formula C3"),
    ],
)
def test_rewrites(spark, f, formula, want):
    assert one(spark, f(F.lit(formula))) == want


def test_ranges(spark):
    got = spark.createDataFrame([(s,) for s in ("B2:A9", "A:C", "3:5", "A1:F", "A:F10", "x")], "s string").select(refs.parse_range(F.col("s"))).collect()
    assert [tuple(r[0]) if r[0] else None for r in got] == [(1, 0, 8, 1), (None, 0, None, 2), (2, None, 4, None), (0, 0, None, 5), None, None]


def test_registry(spark):
    r = Registry()
    r.add_function("fail", lambda x: 1 / 0, "double")
    with pytest.raises(ValueError):
        r.add_function("FAIL", lambda x: x, "double")
    with pytest.raises(KeyError):
        r.call("nothing")
    got = spark.range(2).select(r.call("Fail", F.col("id").cast("double")).alias("x")).first()["x"]
    assert got["value"] is None and got["error"].startswith("#VALUE!")

    class Even(CustomType):
        tag = "even"

        def parse(self, text):
            return F.when(text.rlike("^[0-9]*[02468]$"), text)

    r.add_type(Even())
    v = r.read("even", F.lit("12"))
    assert one(spark, (v == r.value("even", F.lit("12"))).col) is True and one(spark, (v < v).col) is False
    assert one(spark, r.read("even", F.lit("13")).out("x")) == "#VALUE!" and one(spark, (v + 1).out("x")) == "121"
    rows = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0), (3, None)], "g int, v double")
    got = r.over(rows, "spread", lambda d: d.v.max() - d.v.min() if d.v.notna().all() else 1 / 0, "double", "g").collect()
    assert sorted((x.g, x.spread if x.error is None else x.error[:7]) for x in got) == [(1, 1.0), (2, 0.0), (3, "#VALUE!")]
    assert one(spark, r.literal(F.lit("12")))["tag"] == "even" and one(spark, r.literal(F.lit("13"))) is None
