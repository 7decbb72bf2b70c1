"""URL functions as Column expressions; a text that is no absolute URL gives NULL (a sheet's #VALUE!)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?$"
#: Default ports, which a URL does not show.
PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}


def _part(u: Column, i: int) -> Column:
    return F.when(URL_VALID(u), F.regexp_extract(u, SHAPE, i))


def URL_VALID(u: Column) -> Column:
    """Has a scheme; those of the web need a host as well."""
    web = F.lower(F.regexp_extract(u, SHAPE, 1)).isin(*PORTS)
    host = F.regexp_extract(F.regexp_extract(u, SHAPE, 3), r"^(?:[^@]*@)?([^:]*)", 1)
    return F.coalesce(u.rlike(SHAPE) & (~web | ((host != "") & ~host.rlike(r"[\s<>^|%\\]"))), F.lit(False))


def URL_SCHEME(u: Column) -> Column:
    return F.lower(_part(u, 1))


def URL_HOST(u: Column) -> Column:
    return F.lower(F.regexp_extract(_part(u, 3), r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))


def URL_PORT(u: Column) -> Column:
    """The stated port, 0 without one or for the scheme's own."""
    port = F.regexp_extract(_part(u, 3), r":([0-9]+)$", 1)
    own = F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv])[URL_SCHEME(u)]
    return F.when(port == "", 0.0).when(port == F.coalesce(own, F.lit("")), 0.0).otherwise(F.nullif(port, F.lit("")).cast("double"))


def URL_PATH(u: Column) -> Column:
    path = _part(u, 4)
    return F.when((path == "") & (_part(u, 2) != ""), "/").otherwise(path)


def URL_QUERY(u: Column) -> Column:
    return _part(u, 6)


def URL_FRAGMENT(u: Column) -> Column:
    return _part(u, 8)


def URL_DECODE(t: Column) -> Column:
    """Percent-decoding alone: + stays, and so does a % without two hex digits; NULL if the bytes are no UTF-8."""
    safe = F.replace(F.regexp_replace(t, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.when(t.isNotNull(), F.try_url_decode(safe))


def URL_ENCODE(t: Column) -> Column:
    """All but letters and digits of ASCII."""
    out = F.url_encode(t)
    for plain, code in (("+", "%20"), ("-", "%2D"), ("_", "%5F"), (".", "%2E"), ("*", "%2A")):
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def URL_PATH_SEGMENT(u: Column, n: int) -> Column:
    """n-th non-empty segment, from 1, or from the end if negative; '' beyond."""
    if n == 0:
        return F.lit(None).cast("string")
    segments = F.filter(F.split(URL_PATH(u), "/"), lambda x: x != "")
    return F.when(URL_VALID(u), URL_DECODE(F.coalesce(F.try_element_at(segments, F.lit(n)), F.lit(""))))


def URL_PARAM(u: Column, key: str) -> Column:
    """First value of a query key, form-decoded; '' without the key."""
    pairs = F.transform(F.split(URL_QUERY(u), "&"), lambda p: F.split(p, "=", 2))
    form = lambda x: F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"))
    found = F.filter(pairs, lambda p: form(p[0]) == key)
    return F.when(URL_VALID(u), F.coalesce(form(F.try_element_at(F.try_element_at(found, F.lit(1)), F.lit(2))), F.lit("")))


def _tidy(path: Column) -> Column:
    """Path without . and .. segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    last = F.element_at(parts, -1)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def URL_JOIN(base: Column, rel: Column) -> Column:
    """Resolution of a relative reference (RFC 3986, section 5.2)."""
    front = F.concat(URL_SCHEME(base), F.lit("://"), _part(base, 3))
    path = F.regexp_extract(rel, r"^([^?#]*)", 1)
    rest = F.regexp_extract(rel, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(URL_PATH(base), r"^(.*/)", 1)
    query = F.when(_part(base, 5) == "", "").otherwise(_part(base, 5))
    out = (
        F.when(rel.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), rel)
        .when(rel.startswith("//"), F.concat(URL_SCHEME(base), F.lit(":"), rel))
        .when(rel == "", F.concat(front, URL_PATH(base), query))
        .when(rel.startswith("?"), F.concat(front, URL_PATH(base), rel))
        .when(rel.startswith("#"), F.concat(front, URL_PATH(base), query, rel))
        .when(rel.startswith("/"), F.concat(front, _tidy(path), rest))
        .otherwise(F.concat(front, _tidy(F.concat(folder, path)), rest))
    )
    return F.when(URL_VALID(base), out)
