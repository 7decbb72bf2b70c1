"""Dates, times, civil date-times, zoned times and spans as Column expressions.

date      DATE
time      BIGINT, nanoseconds of the day
datetime  TIMESTAMP_NTZ (microseconds)
zoned     STRUCT<utc TIMESTAMP_NTZ, tz STRING>: the instant in UTC and a zone
zone      STRING, an IANA name or +HH:MM
span      STRUCT of years, months, weeks, days, hours, minutes, seconds, nanos (BIGINT each)

What a sheet shows as #VALUE! is NULL here; sheet.call() gives it as an error
value.  Sums over temporal values take their numbers: days since 1970 (date,
datetime), fraction of a day (time), seconds since 1970 (zoned); a span has
none.  Only IS_DST leaves the JVM.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import let

DAY = 86_400_000_000_000
UNITS = ("years", "months", "weeks", "days", "hours", "minutes", "seconds", "nanos")
ZONE = r"^([+-])([0-9]{2})(?::?([0-9]{2}))?$"
NTZ = "timestamp_ntz"


def _c(x: object) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _whole(x: object) -> Column:
    """An integer, or NULL if the number has a fraction."""
    if isinstance(x, int):
        return F.lit(x).cast("long")
    x = _c(x).cast("double")
    return F.when(x == F.rint(x), x.cast("long"))


# ---- constructors and parsers


def DATE(y: object, m: object, d: object) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp_ntz(_whole(y).cast("int"), _whole(m).cast("int"), _whole(d).cast("int"), zero, zero, F.lit(0)).cast("date")


def TODAY(now: Column | None = None) -> Column:
    return F.current_date() if now is None else now.cast("date")


def TIME(h: object, mi: object, s: object, ns: object = 0) -> Column:
    h, mi, s, ns = map(_whole, (h, mi, s, ns))
    good = h.between(0, 23) & mi.between(0, 59) & s.between(0, 59) & ns.between(0, 999_999_999)
    return F.when(good, ((h * 60 + mi) * 60 + s) * 1_000_000_000 + ns)


def DATETIME(y: object, mo: object, d: object, h: object, mi: object, s: object, ns: object = 0) -> Column:
    base = F.try_make_timestamp_ntz(*[_whole(x).cast("int") for x in (y, mo, d, h, mi)], _whole(s).cast("int"))
    return F.when(_whole(s) < 60, F.timestamp_add("MICROSECOND", F.floor(_whole(ns) / 1000).cast("long"), base))


#: Strptime and strftime codes and the JVM's patterns for them.
CODES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "j": "DDD", "p": "a", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm", "%": "'%'"}


def pattern(fmt: str) -> str:
    """The JVM pattern of a strftime format."""
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            if fmt[i + 1] not in CODES:
                raise ValueError(f"no pattern for %{fmt[i + 1]}")
            out, i = out + CODES[fmt[i + 1]], i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]), i + 1
    return out


def PARSE_DATE(s: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s.try_cast("date"))
    return F.try_to_date(s, pattern(fmt))


def PARSE_TIME(s: Column, fmt: str | None = None) -> Column:
    if fmt is not None:
        return TO_TIME(PARSE_DATETIME(F.concat(F.lit("1970-01-01 "), s), "%Y-%m-%d " + fmt))
    shape = r"^([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:\.([0-9]{1,9}))?)?$"
    part = [F.regexp_extract(s, shape, i) for i in range(1, 5)]
    number = [F.when(p == "", "0").otherwise(p).cast("long") for p in part[:3]]
    return F.when(s.rlike(shape), TIME(*number, F.rpad(part[3], 9, "0").cast("long")))


def PARSE_DATETIME(s: Column, fmt: str | None = None) -> Column:
    if fmt is None:
        return F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?$"), s.try_cast(NTZ))
    return F.try_to_timestamp(s, F.lit(pattern(fmt))).cast(NTZ)


def zone_ids() -> list[str]:
    """The names of zones that the JVM knows."""
    from pyspark.sql import SparkSession

    return sorted(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())


def TIMEZONE(name: Column) -> Column:
    """The zone's canonical name: +0530 and +5 hours' other forms become +05:30, Z is UTC; NULL for what no zone is called."""
    sign, hours, minutes = (F.regexp_extract(name, ZONE, i) for i in (1, 2, 3))
    offset = F.concat(sign, hours, F.lit(":"), F.when(minutes == "", "00").otherwise(minutes))
    near = F.when(hours == "", 0).otherwise(hours).cast("int") * 60 + F.when(minutes == "", 0).otherwise(minutes).cast("int") <= 18 * 60
    return F.when(name == "Z", "UTC").when(name.rlike(ZONE), F.when(near & (F.when(minutes == "", 0).otherwise(minutes).cast("int") < 60), offset)).when(name.isin(zone_ids()), name)


def _shift(civil: Column, offset_of: Column, tz: Column) -> Column:
    """civil less the zone's offset at the instant offset_of."""
    offset = F.timestamp_diff("MICROSECOND", offset_of, F.convert_timezone(F.lit("UTC"), tz, offset_of))
    return F.timestamp_add("MICROSECOND", -offset, civil)


def ZONED(civil: Column, tz: Column, mode: str = "compatible") -> Column:
    """civil time in a zone. In a gap, compatible and later go on by the gap; in a fold, compatible and earlier take the first; reject takes neither."""
    first = F.convert_timezone(tz, F.lit("UTC"), civil)
    shown = lambda u: F.convert_timezone(F.lit("UTC"), tz, u)

    def chosen(u: Column, civil: Column) -> Column:
        after = lambda u: _shift(civil, F.timestamp_add("HOUR", F.lit(6), u), tz)
        if mode == "earlier":
            return F.when(shown(u) != civil, after(u)).otherwise(u)
        fold = lambda a: (a != u) & (shown(u) == civil) & (shown(a) == civil)
        if mode == "later":
            return let(after(u), lambda a: F.when(fold(a), a).otherwise(u))
        return let(after(u), lambda a: F.when((shown(u) == civil) & ~fold(a), u))

    if mode == "compatible":
        utc = first
    elif mode in ("earlier", "later", "reject"):
        utc = let(F.struct(first.alias("u"), civil.alias("civil")), lambda x: chosen(x["u"], x["civil"]))
    else:
        raise ValueError(f"no mode {mode}")
    return let(utc, lambda u: F.when(u.isNotNull() & tz.isNotNull(), F.struct(u.alias("utc"), tz.alias("tz"))))


TO_ZONED = ZONED


def PARSE_ZONED(s: Column, fmt: str | None = None) -> Column:
    """RFC 9557: 2024-06-15T12:00:00-04:00[America/New_York], the offset fixes the instant; or by a format that ends in a zone (%Q, an IANA name, or %z, an offset)."""
    if fmt is not None:
        if fmt[-2:] not in ("%Q", "%z"):
            raise ValueError("the format of a zoned time ends in %Q or %z")
        tail = r"^(.*?)\s*([A-Za-z_]+(?:/[A-Za-z0-9_+-]+)*)$" if fmt.endswith("%Q") else r"^(.*?)\s*(Z|[+-][0-9]{2}:?[0-9]{2})$"
        civil = PARSE_DATETIME(F.regexp_extract(s, tail, 1), fmt[:-2].rstrip())
        return F.when(s.rlike(tail), let(TIMEZONE(F.regexp_extract(s, tail, 2)), lambda tz: F.when(tz.isNotNull(), ZONED(civil, tz))))
    shape = r"^([0-9-]{10}[T ][0-9:.]{5,18})(Z|[+-][0-9]{2}:?[0-9]{2})?\[([^\]]+)\]$"
    civil, offset, tz = PARSE_DATETIME(F.regexp_extract(s, shape, 1)), F.regexp_extract(s, shape, 2), TIMEZONE(F.regexp_extract(s, shape, 3))
    fixed = F.when(offset == "Z", "+00:00").otherwise(F.regexp_replace(offset, r"^([+-][0-9]{2}):?", "$1:"))
    by_offset = F.convert_timezone(F.when(offset != "", fixed), F.lit("UTC"), civil)
    known = let(tz, lambda tz: F.when(tz.isNotNull(), F.when(offset != "", let(by_offset, lambda u: F.when(u.isNotNull(), F.struct(u.alias("utc"), tz.alias("tz"))))).otherwise(ZONED(civil, tz))))
    return F.when(s.rlike(shape), known)


def IN_TZ(z: Column, tz: object) -> Column:
    return F.when(z.isNotNull(), F.struct(z["utc"].alias("utc"), _c(tz).alias("tz")))


def TO_UTC(z: Column) -> Column:
    return IN_TZ(z, "UTC")


def UTCNOW(now: Column | None = None) -> Column:
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), (F.current_timestamp() if now is None else now).cast(NTZ))
    return F.struct(utc.alias("utc"), F.lit("UTC").alias("tz"))


def NOW(now: Column | None = None) -> Column:
    return IN_TZ(UTCNOW(now), F.current_timezone())


# ---- spans


def SPAN(years: object = 0, months: object = 0, weeks: object = 0, days: object = 0, hours: object = 0, minutes: object = 0, seconds: object = 0, nanos: object = 0) -> Column:
    parts = [_whole(x) for x in (years, months, weeks, days, hours, minutes, seconds, nanos)]
    known = F.lit(True)
    for p, x in zip(parts, (years, months, weeks, days, hours, minutes, seconds, nanos)):
        if not isinstance(x, int):
            known = known & p.isNotNull()
    return F.when(known, _span(parts))


def _span(parts: list[Column]) -> Column:
    """A span of whole numbers."""
    return F.struct(*[p.cast("long").alias(n) for p, n in zip(parts, UNITS)])


def YEARS(n: object) -> Column:
    return SPAN(years=n)


def MONTHS(n: object) -> Column:
    return SPAN(months=n)


def WEEKS(n: object) -> Column:
    return SPAN(weeks=n)


def DAYS(n: object) -> Column:
    return SPAN(days=n)


def HOURS(n: object) -> Column:
    return SPAN(hours=n)


def MINUTES(n: object) -> Column:
    return SPAN(minutes=n)


def SECONDS(n: object) -> Column:
    return SPAN(seconds=n)


ISO_SPAN = r"^([+-])?P(?=.)(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?=\d)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?$"
#: Names of units in friendly spans such as "5h 30m" or "3 days".
FRIENDLY = {"years": "years|year|yrs|yr|y", "months": "months|month|mos|mo", "weeks": "weeks|week|wks|wk|w", "days": "days|day|d", "hours": "hours|hour|hrs|hr|h", "minutes": "minutes|minute|mins|min|m", "seconds": "seconds|second|secs|sec|s"}


def PARSE_SPAN(s: Column) -> Column:
    """ISO 8601 or friendly."""
    sign = F.when(F.regexp_extract(s, ISO_SPAN, 1) == "-", -1).otherwise(1)

    def iso(i: int) -> Column:
        part = F.regexp_extract(s, ISO_SPAN, i)
        return F.when(part == "", "0").otherwise(part).cast("long") * sign

    nanos = F.rpad(F.regexp_extract(s, ISO_SPAN, 9), 9, "0").cast("long") * sign
    each = "|".join(FRIENDLY.values())
    friendly = rf"^\s*(?:\d+\s*(?:{each})\b,?\s*)+$"

    def named(words: str) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(s, rf"(\d+)\s*(?:{words})\b", 1), F.lit("")).cast("long"), F.lit(0))

    return F.when(s.rlike(ISO_SPAN), _span([*[iso(i) for i in range(2, 9)], nanos])).when(s.rlike(friendly), _span([*[named(w) for w in FRIENDLY.values()], F.lit(0)]))


def _months(span: Column) -> Column:
    return (span["years"] * 12 + span["months"]).cast("int")


def _days(span: Column) -> Column:
    return span["weeks"] * 7 + span["days"]


def _nanos(span: Column) -> Column:
    return ((span["hours"] * 60 + span["minutes"]) * 60 + span["seconds"]) * 1_000_000_000 + span["nanos"]


def span_sum(a: Column, b: Column, sign: int = 1) -> Column:
    """Field by field."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(*[(a[n] + b[n] * sign).alias(n) for n in UNITS]))


def span_times(a: Column, n: object) -> Column:
    n = _whole(n)
    return F.when(a.isNotNull() & n.isNotNull(), F.struct(*[(a[u] * n).alias(u) for u in UNITS]))


def _micros(span: Column, relative: Column) -> Column:
    start = relative.cast(NTZ)
    return let(span, lambda x: F.timestamp_diff("MICROSECOND", start, datetime_add(start, x)))


def SPAN_TO_SECONDS(span: Column, relative: Column | None = None) -> Column:
    """Elapsed seconds from the date relative (1970-01-01)."""
    return _micros(span, F.lit("1970-01-01").cast("date") if relative is None else relative) / 1e6


def SPAN_TO_DAYS(span: Column, relative: Column | None = None) -> Column:
    return SPAN_TO_SECONDS(span, relative) / 86400.0


# ---- arithmetic: sign 1 adds, -1 subtracts


def date_add(d: Column, span: Column, sign: int = 1) -> Column:
    """Months clamp to the month's end; clock units count as the whole days they fill."""
    return F.date_add(F.add_months(d, _months(span) * sign), ((_days(span) + (_nanos(span) / DAY).cast("long")) * sign).cast("int"))


def time_add(t: Column, span: Column, sign: int = 1) -> Column:
    """Wraps at midnight; calendar units give NULL."""
    return F.when((_months(span) == 0) & (_days(span) == 0), F.pmod(t + _nanos(span) * sign, F.lit(DAY)))


def datetime_add(t: Column, span: Column, sign: int = 1) -> Column:
    """Months, then days, then clock units."""
    t = F.timestamp_add("MONTH", _months(span) * sign, t)
    t = F.timestamp_add("DAY", (_days(span) * sign).cast("int"), t)
    return F.timestamp_add("MICROSECOND", F.floor(_nanos(span) * sign / 1000).cast("long"), t)


def zoned_add(z: Column, span: Column, sign: int = 1) -> Column:
    """Calendar units move the wall clock, clock units the instant."""

    def moved(x: Column) -> Column:
        z, span = x["z"], x["span"]
        civil = F.timestamp_add("DAY", (_days(span) * sign).cast("int"), F.timestamp_add("MONTH", _months(span) * sign, TO_DATETIME_OF(z)))
        utc = F.when((_months(span) == 0) & (_days(span) == 0), z["utc"]).otherwise(ZONED(civil, z["tz"])["utc"])
        utc = F.timestamp_add("MICROSECOND", F.floor(_nanos(span) * sign / 1000).cast("long"), utc)
        return let(utc, lambda u: F.when(u.isNotNull(), F.struct(u.alias("utc"), z["tz"].alias("tz"))))

    return let(F.struct(z.alias("z"), span.alias("span")), moved)


ADD = {"date": date_add, "time": time_add, "datetime": datetime_add, "zoned": zoned_add}


def DATEADD(x: Column, span: Column, kind: str) -> Column:
    return ADD[kind](x, span)


def DATESUB(x: Column, span: Column, kind: str) -> Column:
    return ADD[kind](x, span, -1)


def _clock(micros: Column, days: bool) -> Column:
    """The span of some microseconds: clock units, and days if there are to be any."""
    day, hour, minute, second = 86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000

    def parts(m: Column) -> Column:
        size, sign, zero = F.abs(m), F.signum(m).cast("long"), F.lit(0).cast("long")
        whole = lambda x, unit: F.floor(x / unit) * sign
        rest = size % day if days else size
        return F.when(m.isNotNull(), _span([zero, zero, zero, whole(size, day) if days else zero, whole(rest, hour), whole(rest % hour, minute), whole(rest % minute, second), rest % second * 1000 * sign]))

    return let(micros, parts)


def difference(a: Column, b: Column, kind: str) -> Column:
    """a - b as a span: days between dates, days and clock units between date-times, clock units between times and zoned times."""
    if kind == "date":
        return DAYS(F.datediff(a, b))
    if kind == "time":
        return _clock(F.floor((a - b) / 1000), False)
    one, two = (a["utc"], b["utc"]) if kind == "zoned" else (a, b)
    return _clock(F.timestamp_diff("MICROSECOND", two, one), kind == "datetime")


# ---- accessors; x is a DATE or TIMESTAMP_NTZ (for a zoned time, its civil time: TO_DATETIME_OF)


def TO_DATETIME_OF(z: Column) -> Column:
    """Wall clock of a zoned time."""
    return F.convert_timezone(F.lit("UTC"), z["tz"], z["utc"])


def YEAR(x: Column) -> Column:
    return F.year(x).cast("double")


def MONTH(x: Column) -> Column:
    return F.month(x).cast("double")


def DAY_(x: Column) -> Column:
    return F.dayofmonth(x).cast("double")


def WEEKDAY(x: Column, iso: bool = True) -> Column:
    """Monday 1 to Sunday 7; not iso: Sunday 1 to Saturday 7."""
    return ((F.weekday(x) + 1) if iso else F.dayofweek(x)).cast("double")


def DAYOFYEAR(x: Column) -> Column:
    return F.dayofyear(x).cast("double")


def WEEKOFYEAR(x: Column) -> Column:
    return F.weekofyear(x).cast("double")


def QUARTER(x: Column) -> Column:
    return F.quarter(x).cast("double")


def IS_LEAP_YEAR(x: Column) -> Column:
    y = F.year(x)
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def TO_DATE(x: Column) -> Column:
    return x.cast("date")


def TO_TIME(t: Column) -> Column:
    """Nanoseconds of the day of a date-time."""
    return F.timestamp_diff("MICROSECOND", F.date_trunc("DAY", t).cast(NTZ), t) * 1000


def TO_DATETIME(x: Column, time: Column | None = None) -> Column:
    """Midnight of the day, or the given time of it."""
    start = x.cast("date").cast(NTZ)
    return start if time is None else F.timestamp_add("MICROSECOND", F.floor(time / 1000), start)


def HOUR(nanos: Column) -> Column:
    return F.floor(nanos / 3_600_000_000_000).cast("double")


def MINUTE(nanos: Column) -> Column:
    return (F.floor(nanos / 60_000_000_000) % 60).cast("double")


def SECOND(nanos: Column) -> Column:
    return (F.floor(nanos / 1_000_000_000) % 60).cast("double")


def NANOSECOND(nanos: Column) -> Column:
    return (nanos % 1_000_000_000).cast("double")


def TZ_NAME(z: Column) -> Column:
    return z["tz"]


def TZ_OFFSET_SECONDS(z: Column) -> Column:
    return F.timestamp_diff("SECOND", z["utc"], TO_DATETIME_OF(z)).cast("double")


@F.pandas_udf(T.BooleanType())
def _is_dst(seconds: pd.Series, tz: pd.Series) -> pd.Series:
    """Looked up once for each zone and UTC day, and by the second only on days that begin and end unlike."""
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    out = pd.Series([None] * len(tz), dtype="object")
    known = seconds.notna() & tz.notna()
    for name in tz[known].unique():
        zone = None if name[:1] in "+-" else ZoneInfo(name)
        dst = lambda s: zone is not None and bool(datetime.fromtimestamp(int(s), UTC).astimezone(zone).dst())
        own = seconds[known & (tz == name)]
        days = own // 86400
        ends = {d: (dst(d * 86400), dst(d * 86400 + 86399)) for d in days.unique()}
        one, two = days.map(lambda d: ends[d][0]), days.map(lambda d: ends[d][1])
        turns = own[one != two]
        out[own.index] = one
        out[turns.index] = turns.map({s: dst(s) for s in turns.unique()})
    return out


def IS_DST(z: Column) -> Column:
    """Daylight saving by the zone's own rules; offsets alone cannot tell."""
    return _is_dst(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast(NTZ), z["utc"]), z["tz"])


def FORMAT(x: Column, fmt: str, kind: str = "datetime") -> Column:
    """By a strftime format; kind: date, datetime, time or zoned, of which the last takes %Q (its zone) and %z (its offset) as well."""
    if kind == "time":
        return F.date_format(TO_DATETIME(F.lit("1970-01-01").cast("date"), x), pattern(fmt))
    if kind != "zoned":
        return F.date_format(x, pattern(fmt))

    def shown(z: Column) -> Column:
        parts = [z["tz"] if p == "%Q" else F.replace(offset_text(z), F.lit(":"), F.lit("")) if p == "%z" else F.date_format(TO_DATETIME_OF(z), pattern(p)) for p in re.split("(%Q|%z)", fmt) if p]
        return F.concat(*parts)

    return let(x, shown)


def offset_text(z: Column) -> Column:
    """+HH:MM of a zoned time."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return let(TZ_OFFSET_SECONDS(z).cast("int"), lambda o: F.concat(F.when(o < 0, "-").otherwise("+"), two(F.floor(F.abs(o) / 3600)), F.lit(":"), two(F.floor(F.abs(o) / 60) % 60)))


def _fraction(nanos: Column) -> Column:
    return F.when(nanos == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(nanos.cast("string"), 9, "0"), "0+$", "")))


def _iso_time(x: Column) -> Column:
    two = [F.lpad(f(x).cast("int").cast("string"), 2, "0") for f in (HOUR, MINUTE, SECOND)]
    return F.concat(F.concat_ws(":", *two), _fraction(x % 1_000_000_000))


def _iso_span(x: Column) -> Column:
    sign = F.when(F.greatest(*[x[n] for n in UNITS]) > 0, 1).otherwise(-1)

    def parts(y: Column) -> Column:
        def part(n: str, letter: str) -> Column:
            return F.when(y[n] != 0, F.concat(y[n].cast("string"), F.lit(letter))).otherwise("")

        seconds = F.when((y["seconds"] != 0) | (y["nanos"] != 0), F.concat(y["seconds"].cast("string"), _fraction(y["nanos"]), F.lit("S"))).otherwise("")
        clock = F.concat(part("hours", "H"), part("minutes", "M"), seconds)
        shown = F.concat(F.lit("P"), part("years", "Y"), part("months", "M"), part("weeks", "W"), part("days", "D"), let(clock, lambda c: F.when(c != "", F.concat(F.lit("T"), c)).otherwise("")))
        return let(shown, lambda t: F.when(t == "P", "PT0S").otherwise(F.concat(F.when(y["sign"] < 0, "-").otherwise(""), t)))

    signed = let(sign, lambda s: F.struct(s.alias("sign"), *[(x[n] * s).alias(n) for n in UNITS]))
    return F.when(x.isNotNull(), let(signed, parts))


def friendly(x: Column) -> Column:
    """A span as a sheet shows it: 1y 2mo 3d, 5h ago."""
    letters = ("y", "mo", "w", "d", "h", "m")

    def shown(x: Column) -> Column:
        sign = F.when(F.greatest(*[x[n] for n in UNITS]) > 0, 1).otherwise(-1)
        parts = [F.when(x[n] != 0, F.concat((x[n] * sign).cast("string"), F.lit(a))) for n, a in zip(UNITS, letters)]
        seconds = F.when((x["seconds"] != 0) | (x["nanos"] != 0), F.concat((x["seconds"] * sign).cast("string"), _fraction(x["nanos"] * sign), F.lit("s")))
        text = F.concat_ws(" ", *parts, seconds)
        return let(text, lambda t: F.when(t == "", "0s").otherwise(F.concat(t, F.when(sign < 0, " ago").otherwise(""))))

    return F.when(x.isNotNull(), let(x, shown))


def ISO(x: Column, kind: str) -> Column:
    """Canonical text."""
    if kind == "date":
        return F.date_format(x, "yyyy-MM-dd")
    if kind == "time":
        return let(x, _iso_time)
    if kind == "datetime":
        return let(x, lambda t: F.concat(ISO(t.cast("date"), "date"), F.lit("T"), ISO(TO_TIME(t), "time")))
    if kind == "zoned":
        return let(x, lambda z: F.concat(ISO(TO_DATETIME_OF(z), "datetime"), offset_text(z), F.lit("["), z["tz"], F.lit("]")))
    if kind == "span":
        return let(x, _iso_span)
    return x


def _between(a: Column, b: Column, kind: str, micros: float) -> Column:
    if kind == "date":
        return F.datediff(b, a) * (86_400_000_000 / micros)
    if kind == "time":
        return (b - a) / 1000 / micros
    if kind == "zoned":
        a, b = a["utc"], b["utc"]
    return F.timestamp_diff("MICROSECOND", a, b) / micros


def DAYS_BETWEEN(a: Column, b: Column, kind: str = "datetime") -> Column:
    """b - a in days, with fractions; elapsed time for zoned times."""
    return _between(a, b, kind, 86_400_000_000.0)


def HOURS_BETWEEN(a: Column, b: Column, kind: str = "datetime") -> Column:
    return _between(a, b, kind, 3_600_000_000.0)


def MINUTES_BETWEEN(a: Column, b: Column, kind: str = "datetime") -> Column:
    return _between(a, b, kind, 60_000_000.0)


def SECONDS_BETWEEN(a: Column, b: Column, kind: str = "datetime") -> Column:
    return _between(a, b, kind, 1_000_000.0)


def number(x: Column, kind: str) -> Column:
    """What a sum takes of a temporal value."""
    epoch = F.lit("1970-01-01")
    return {
        "date": lambda: F.unix_date(x).cast("double"),
        "time": lambda: x / DAY,
        "datetime": lambda: F.timestamp_diff("MICROSECOND", epoch.cast(NTZ), x) / 86_400_000_000.0,
        "zoned": lambda: F.floor(F.timestamp_diff("MICROSECOND", epoch.cast(NTZ), x["utc"]) / 1_000_000).cast("double"),
        "span": lambda: F.lit(None).cast("double"),
    }[kind]()


def temporal_literal(c: Column) -> Column:
    """Which temporal kind a cell's text has the shape of, or NULL: zoned, datetime, date, time, span in this order; a date must exist."""
    clock = r"[0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?"
    friendly = "|".join(FRIENDLY.values())
    return (
        F.when(c.rlike(rf"^[0-9-]{{10}}[T ]{clock}(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?\[[^\]]+\]$"), "zoned")
        .when(c.rlike(rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{clock}$"), "datetime")
        .when(PARSE_DATE(c).isNotNull(), "date")
        .when(c.rlike(rf"^{clock}$"), "time")
        .when(c.rlike(ISO_SPAN) | c.rlike(rf"^\s*(\d+\s*({friendly})\b,?\s*)+$"), "span")
    )


#: Parsers of the kinds' literals, in the order in which a cell's text is tried.
PARSE = {"zoned": PARSE_ZONED, "datetime": PARSE_DATETIME, "date": PARSE_DATE, "time": PARSE_TIME, "span": PARSE_SPAN}


def try_parse(kind: str, text: Column, fmt: str | None = None) -> Column:
    """What a text reads as in a kind, by its literals or a format; NULL if it does not."""
    if kind == "zone":
        return TIMEZONE(text)
    return PARSE[kind](text) if fmt is None or kind == "span" else PARSE[kind](text, fmt)


def order(a: Column, b: Column, kind: str) -> Column:
    """-1, 0 or 1 of two values of a kind: zoned times by instant, spans by their length from 1970-01-01; zones have only 0 and NULL."""
    if kind == "zone":
        return F.when(a == b, 0)
    if kind == "zoned":
        a, b = a["utc"], b["utc"]
    elif kind == "span":
        a, b = (_micros(x, F.lit("1970-01-01").cast("date")) * 1000 + x["nanos"] % 1000 for x in (a, b))
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.when(x["a"] < x["b"], -1).when(x["a"] > x["b"], 1).when(x["a"] == x["b"], 0))
