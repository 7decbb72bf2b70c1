"""Work on columns of formula text: references, ranges, shifts and structural edits as Column expressions.

A formula is cut into pieces by one regular expression; rewrites are transforms
over that array, joined again.  A reference is one piece: a cell, a bounded range, a
range open to below (B2:D), whole columns or whole rows; it is read once, into
an array of its one or two ends.  Texts in quotes are tokens and stay untouched,
and so do texts that are no formulas and formulas that hold #REF!.  Rows and
columns are counted from 0 in the arguments, as in edits of a grid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import let
from ..sources.sheets import column_letters, column_number

QUOTED = r"\"[^\"]*\"|'[^']*'"
ENDS = r"(?![A-Za-z0-9_(])"
CELL = r"\$?[A-Za-z]+\$?[0-9]+"
SINGLE = CELL + ENDS
WHOLE = r"\$?[A-Za-z]+:\$?[A-Za-z]+|\$?[0-9]+:\$?[0-9]+"
RANGE = rf"(?:{CELL}:(?:{CELL}|\$?[A-Za-z]+)|{WHOLE}){ENDS}"
TOKEN = rf"({QUOTED}|#REF!|{SINGLE}|(?:{WHOLE}){ENDS}|[A-Za-z_][A-Za-z0-9_.]*|[0-9]+\.?[0-9]*|\s+|<=|>=|<>|.)"
#: Pieces for rewrites: a bounded range is one, and a called name has its bracket with it, so that LOG10( is no cell.
PIECE = rf"({QUOTED}|#REF!|{RANGE}|{SINGLE}|[A-Za-z_][A-Za-z0-9_.]*(?:\s*\()?|[0-9]+\.?[0-9]*|\s+|.)"
REFERENCE = rf"^(?:{RANGE}|{SINGLE})$"
PARTS = r"^(\$?)([A-Za-z]*)(\$?)([0-9]*)$"
REF = "#REF!"
#: Cells that a range may have to be listed one by one.
MOST_CELLS = 100_000


def tokens(formula: Column) -> Column:
    """array<string> of a formula's tokens, blanks among them; together they are the formula."""
    return F.regexp_extract_all(formula, F.lit(TOKEN), F.lit(1))


def pieces(formula: Column) -> Column:
    return F.regexp_extract_all(formula, F.lit(PIECE), F.lit(1))


def _placed(texts: Column) -> Column:
    """array<struct<text, start>> of texts that stand one after the other."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int>>").alias("out"))
    step = lambda acc, t: F.struct((acc["at"] + F.length(t)).alias("at"), F.concat(acc["out"], F.array(F.struct(t.alias("text"), acc["at"].alias("start")))).alias("out"))
    return F.aggregate(texts, start, step, lambda acc: acc["out"])


def classified(formula: Column) -> Column:
    """array<struct<text, kind, start>> with 0-based starts."""

    def of(every: Column) -> Column:
        def kind(t: Column, i: Column) -> Column:
            called = F.coalesce(F.get(every, i + 1)["text"], F.lit("")) == "("
            return (
                F.when(t.rlike(rf"^({QUOTED})$"), "string")
                .when(t.rlike(rf"^{SINGLE}$") & ~called, "cell")
                .when(t.rlike(rf"^(?:{WHOLE})$"), "range")
                .when(F.upper(t).isin("TRUE", "FALSE"), "boolean")
                .when(t.rlike(r"^[A-Za-z_]"), "identifier")
                .when(t.rlike(r"^[0-9]"), "number")
                .when(t.rlike(r"^\s+$"), "blank")
                .when(t == REF, "error")
                .when(t.rlike(r"^(<=|>=|<>|[-+*/^%&=<>])$"), "operator")
                .when(t.rlike(r"^[(){},;:#]$"), "punctuation")
                .otherwise("unknown")
            )

        return F.transform(every, lambda x, i: F.struct(x["text"].alias("text"), kind(x["text"], i).alias("kind"), x["start"].alias("start")))

    return let(_placed(tokens(formula)), of)


def extract_refs(formula: Column) -> Column:
    """array<struct<kind, text, start>> of what a formula refers to: cell, range, whole_column, whole_row, spill (A1#), name. Texts that are no formulas have none."""
    each = rf"({QUOTED}|#REF!|{RANGE}|{CELL}#|{SINGLE}|[A-Za-z_][A-Za-z0-9_.]*(?:\s*\()?|[0-9]+\.?[0-9]*|\s+|.)"
    t = lambda x: x["text"]
    kind = lambda x: (
        F.when(t(x).rlike(rf"^{CELL}#$"), "spill")
        .when(t(x).rlike(rf"^{SINGLE}$"), "cell")
        .when(t(x).rlike(r"^\$?[A-Za-z]+:\$?[A-Za-z]+$"), "whole_column")
        .when(t(x).rlike(r"^\$?[0-9]+:\$?[0-9]+$"), "whole_row")
        .when(t(x).rlike(rf"^{RANGE}$"), "range")
        .when(t(x).rlike(r"^[A-Za-z_][A-Za-z0-9_.]*$") & ~F.upper(t(x)).isin("TRUE", "FALSE"), "name")
    )
    found = F.transform(_placed(F.regexp_extract_all(formula, F.lit(each), F.lit(1))), lambda x: F.struct(kind(x).alias("kind"), t(x).alias("text"), x["start"].alias("start")))
    return F.when(_is_formula(formula), F.filter(found, lambda x: x["kind"].isNotNull())).otherwise(F.array().cast("array<struct<kind:string,text:string,start:int>>"))


def cell_refs(formula: Column) -> Column:
    """Distinct single cells that a formula names, among them the corners of its bounded ranges, upper case, without $."""
    texts = F.filter(pieces(formula), lambda t: t.rlike(REFERENCE))
    corners = F.flatten(F.transform(texts, lambda t: F.split(t, ":")))
    return F.array_distinct(F.transform(F.filter(corners, lambda t: t.rlike(rf"^{CELL}$")), lambda t: F.upper(F.replace(t, F.lit("$"), F.lit("")))))


def range_refs(formula: Column) -> Column:
    """array<struct<first_row, first_col, last_row, last_col>> (from 0) of all cells and ranges that a formula names; an open side is NULL."""
    texts = F.filter(pieces(formula), lambda t: t.rlike(REFERENCE))
    return F.transform(texts, lambda t: parse_range(F.when(t.contains(":"), t).otherwise(F.concat(t, F.lit(":"), t))))


def functions_used(formula: Column) -> Column:
    """Names that stand before a bracket, upper case."""
    bare = F.regexp_replace(formula, QUOTED, '""')
    return F.array_distinct(F.transform(F.regexp_extract_all(bare, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1)), lambda x: F.upper(x)))


def unknown_functions(formula: Column, known: list[str]) -> Column:
    """A lint: called names that no registry has."""
    return F.array_except(functions_used(formula), F.array(*[F.lit(k) for k in known]))


def dangling(formula: Column) -> Column:
    """A lint: how many references a formula has lost."""
    return F.size(F.filter(tokens(formula), lambda t: t == REF))


def parse_cell(ref: Column) -> Column:
    """struct<row, col>, from 0; NULL for what is no cell."""
    return F.when(ref.rlike(rf"^{CELL}$"), F.struct((F.regexp_extract(ref, PARTS, 4).cast("int") - 1).alias("row"), (column_number(F.regexp_extract(ref, PARTS, 2)) - 1).alias("col")))


def parse_range(text: Column) -> Column:
    """struct<first_row, first_col, last_row, last_col>, from 0 and put in order; an open end is NULL. A range open at its start alone is none."""
    shape = r"^\$?([A-Za-z]*)\$?([0-9]*):\$?([A-Za-z]*)\$?([0-9]*)$"
    c1, r1, c2, r2 = (F.regexp_extract(text, shape, i) for i in (1, 2, 3, 4))
    col = lambda c: F.when(c != "", column_number(c) - 1)
    row = lambda r: F.nullif(r, F.lit("")).cast("int") - 1
    good = text.rlike(shape) & ((c1 == "") == (c2 == "")) & ((c1 != "") | (r1 != "")) & ((r1 != "") | (r2 == ""))
    good = good & ((c1 != "") | (r2 != ""))
    both = (r1 != "") & (r2 != "")
    ordered = F.struct(
        F.when(both, F.least(row(r1), row(r2))).otherwise(row(r1)).alias("first_row"),
        F.least(col(c1), col(c2)).alias("first_col"),
        F.when(both, F.greatest(row(r1), row(r2))).alias("last_row"),
        F.greatest(col(c1), col(c2)).alias("last_col"),
    )
    return F.when(good, ordered)


# ---- rewrites


def _is_formula(formula: Column) -> Column:
    return formula.startswith("=")


def _end(text: Column) -> Column:
    """struct<text, dc, c, dr, r> of one end of a reference: $ marks, column and row from 1, NULL where the end has none."""
    mark, letters, second, digits = (F.regexp_extract(text, PARTS, i) for i in (1, 2, 3, 4))
    return F.struct(text.alias("text"), F.when(letters != "", mark).otherwise("").alias("dc"), F.when(letters != "", column_number(letters)).alias("c"), F.when(letters != "", second).otherwise(mark).alias("dr"), F.nullif(digits, F.lit("")).cast("int").alias("r"))


def _shown(end: Column, c: Column, r: Column, marks: bool = True) -> Column:
    """An end with another column and row, or its own text if both are as before."""
    parts = [end["dc"] if marks else F.lit(""), F.coalesce(column_letters(c), F.lit("")), end["dr"] if marks else F.lit(""), F.coalesce(r.cast("string"), F.lit(""))]
    return F.when(c.eqNullSafe(end["c"]) & r.eqNullSafe(end["r"]), end["text"]).otherwise(F.concat(*parts))


def _rewritten(formula: Column, change: Callable[[Column], Column]) -> Column:
    """The formula with change(ends) for each of its references; ends is an array of one or two."""

    def whole(parts: Column) -> Column:
        out = F.transform(parts, lambda t: F.when(t.rlike(REFERENCE), let(F.transform(F.split(t, ":"), _end), change)).otherwise(t))
        return F.when(F.exists(parts, lambda t: t == REF), F.array_join(parts, "")).otherwise(F.array_join(out, ""))

    return F.when(_is_formula(formula), let(pieces(formula), whole)).otherwise(formula)


def _each(ends: Column, to: Callable[[Column], Column]) -> Column:
    """The ends, each by itself; #REF! once where all ends are lost."""
    return let(F.transform(ends, to), lambda out: F.when(F.forall(out, lambda x: x == REF), REF).otherwise(F.array_join(out, ":")))


def shift(formula: Column, rows: int, cols: int, max_row: int = 1_048_576, max_col: int = 16_384) -> Column:
    """References moved as a copied formula's are: $ holds a part, what leaves the grid becomes #REF!, with its whole range."""

    def one(e: Column) -> Column:
        c, r = F.when(e["dc"] == "$", e["c"]).otherwise(e["c"] + cols), F.when(e["dr"] == "$", e["r"]).otherwise(e["r"] + rows)
        inside = F.coalesce(c.between(1, max_col), F.lit(True)) & F.coalesce(r.between(1, max_row), F.lit(True))
        return F.when(inside, _shown(e, c, r)).otherwise(REF)

    return _rewritten(formula, lambda ends: let(F.transform(ends, one), lambda out: F.when(F.array_contains(out, REF), REF).otherwise(F.array_join(out, ":"))))


def _hit(x: Column, places: list[int]) -> Column:
    return F.coalesce((x - 1).isin(places), F.lit(False)) if places else F.lit(False)


def stamp_deleted(formula: Column, cols: list[int], rows: list[int]) -> Column:
    """Every end in a deleted row or column becomes #REF!."""
    return _rewritten(formula, lambda ends: _each(ends, lambda e: F.when(_hit(e["c"], cols) | _hit(e["r"], rows), REF).otherwise(e["text"])))


def _after(x: Column, places: list[int]) -> Column:
    moved = x
    for p in places:
        moved = moved + F.when(x - 1 >= p, 1).otherwise(0)
    return moved


def adjust_inserted(formula: Column, cols: list[int] = [], rows: list[int] = []) -> Column:  # noqa: B006
    """References after rows or columns were put in: each index at or before a place moves it by one, so ranges grow; $ stays."""
    return _rewritten(formula, lambda ends: F.array_join(F.transform(ends, lambda e: _shown(e, _after(e["c"], cols), _after(e["r"], rows))), ":"))


def _left(low: Column, high: Column, places: list[int]) -> tuple[Column, Column, Column]:
    """First and last survivor of low..high after a deletion, in the new numbers, and whether there is none."""
    before = lambda x, also: sum((F.when((x - 1 >= p) if also else (x - 1 > p), 1).otherwise(0) for p in sorted(set(places))), F.lit(0))
    gone = before(high, True) - before(low, False)
    return low - before(low, False), high - before(high, True), gone > high - low


def adjust_deleted(formula: Column, cols: list[int] = [], rows: list[int] = []) -> Column:  # noqa: B006
    """References after rows or columns were taken out: survivors move up, ranges are trimmed, what is gone becomes #REF!; a reference that changes loses its $."""

    def change(ends: Column) -> Column:
        a, b = ends[0], F.element_at(ends, -1)
        (fc, lc, no_c), (fr, lr, no_r) = _left(F.least(a["c"], b["c"]), F.greatest(a["c"], b["c"]), cols), _left(F.least(a["r"], b["r"]), F.greatest(a["r"], b["r"]), rows)
        lr = F.when(b["r"].isNotNull(), lr)
        same = fc.eqNullSafe(a["c"]) & fr.eqNullSafe(a["r"]) & lc.eqNullSafe(b["c"]) & lr.eqNullSafe(b["r"])
        part = lambda c, r: F.concat(F.coalesce(column_letters(c), F.lit("")), F.coalesce(r.cast("string"), F.lit("")))
        changed = F.when(F.size(ends) == 1, part(fc, fr)).otherwise(F.concat(part(fc, fr), F.lit(":"), part(lc, lr)))
        # Order is put right only where something changes.
        untouched = F.lit(True)
        for lo, hi, places in ((F.least(a["c"], b["c"]), F.greatest(a["c"], b["c"]), cols), (F.least(a["r"], b["r"]), F.greatest(a["r"], b["r"]), rows)):
            x, y, _ = _left(lo, hi, places)
            untouched = untouched & x.eqNullSafe(lo) & y.eqNullSafe(hi)
        return F.when(F.coalesce(no_c, F.lit(False)) | F.coalesce(no_r, F.lit(False)), REF).when(same | untouched, F.array_join(F.transform(ends, lambda e: e["text"]), ":")).otherwise(changed)

    return _rewritten(formula, change)


def _move(formula: Column, axis: str, start: int, count: int, to: int, data_following: bool) -> Column:
    """References after a block of lines moved to begin at `to`."""
    if start == to or count < 1:
        return formula
    other = "r" if axis == "c" else "c"
    # Zones of lines (from 1) and by how far each moves.
    block = (start + 1, start + count, to - start)
    band = (start + count + 1, to + count, -count) if to > start else (to + 1, start, count)
    low, high = min(block[0], band[0]), max(block[1], band[1])
    zones = [(1, low - 1, 0), block, band, (high + 1, 1 << 30, 0)]

    def image(x: Column) -> Column:
        return F.when(x.between(*block[:2]), x + block[2]).when(x.between(*band[:2]), x + band[2]).otherwise(x)

    def shown(e: Column, x: Column) -> Column:
        return _shown(e, x, e["r"]) if axis == "c" else _shown(e, e["c"], x)

    def change(ends: Column) -> Column:
        a, b = ends[0], F.element_at(ends, -1)
        lo, hi = F.least(a[axis], b[axis]), F.greatest(a[axis], b[axis])
        # The box around all images: of each zone's share of the range the ends are enough.
        shares = [(F.greatest(lo, F.lit(p)) + d, F.least(hi, F.lit(q)) + d) for p, q, d in zones]
        first = F.least(*[F.when(x <= y, x) for x, y in shares])
        last = F.greatest(*[F.when(x <= y, y) for x, y in shares])
        boxed = F.when((first == lo) & (last == hi), F.array_join(F.transform(ends, lambda e: e["text"]), ":")).otherwise(F.concat(shown(a, first), F.lit(":"), shown(b, last)))
        follows = F.lit(True) if data_following else a[other].isNull()
        kept = F.array_join(F.transform(ends, lambda e: e["text"]), ":")
        return F.when(F.size(ends) == 1, shown(a, image(a[axis]))).when(lo.isNull() | ~follows, kept).otherwise(boxed)

    return _rewritten(formula, change)


def move_columns(formula: Column, start: int, count: int, to: int, data_following: bool = False) -> Column:
    """References after a block of columns moved (0-based; `to` is the block's new start).

    Single cells follow; whole columns become the box around their images;
    bounded ranges stay in place, or with data_following (as the definitions of
    names) become that box as well.
    """
    return _move(formula, "c", start, count, to, data_following)


def move_rows(formula: Column, start: int, count: int, to: int, data_following: bool = False) -> Column:
    """move_columns() for a block of rows."""
    return _move(formula, "r", start, count, to, data_following)
