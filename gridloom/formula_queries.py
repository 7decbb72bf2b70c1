"""Queries over formula text: every row of `part` has one of six formulas, and SQL derives what each edit makes of its parts.

A template is a list of tokens; a reference in it is a Ref, whose rows and
columns are SQL expressions over k (p_partkey) that Spark and DuckDB both read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .operators import references
from .queries import query, table


@dataclass
class End:
    """One end of a reference: column and row (from 1) as SQL, None for an open side, and its $ marks."""

    c: str | None
    r: str | None
    dc: str = ""
    dr: str = ""

    def text(self, c: str | None = None, r: str | None = None, marks: bool = True) -> str:
        """SQL of the end's text, with another column or row."""
        parts = []
        if self.c is not None:
            parts += [f"'{self.dc if marks else ''}'", f"chr(CAST(64 + ({c or self.c}) AS INT))"]
        if self.r is not None:
            parts += [f"'{self.dr if marks else ''}'", f"CAST(({r or self.r}) AS VARCHAR(9))"]
        return f"concat({', '.join(parts)})"


@dataclass
class Ref:
    kind: str
    ends: tuple[End, ...]

    def text(self) -> str:
        return self.joined(e.text() for e in self.ends)

    @staticmethod
    def joined(texts) -> str:
        return "concat(" + ", ':', ".join(texts) + ")"


def cell(c: str, r: str, dc: str = "", dr: str = "") -> Ref:
    return Ref("cell", (End(c, r, dc, dr),))


def block(a: Ref, b: Ref) -> Ref:
    return Ref("range", a.ends + b.ends)


def columns(a: str, b: str) -> Ref:
    return Ref("whole_column", (End(a, None), End(b, None)))


def lines(a: str, b: str) -> Ref:
    return Ref("whole_row", (End(None, a), End(None, b)))


TEMPLATES: list[list[str | Ref]] = [
    ["=", cell("k % 9 + 3", "k % 90 + 6"), "*", cell("5", "7", "$", "$"), "+", "SUM", "(", block(cell("4", "k % 20 + 5"), cell("k % 3 + 7", "29")), ")", "&", '"D7"'],
    ["=", "SUM", "(", columns("k % 5 + 3", "k % 5 + 6"), ")", "-", cell("k % 7 + 3", "9", "$")],
    ["=", "MAX", "(", lines("k % 11 + 5", "k % 11 + 8"), ")", "/", "LOG10", "(", cell("6", "k % 13 + 5", "", "$"), ")"],
    ["=", "AVERAGE", "(", block(cell("k % 4 + 4", "k % 6 + 6"), cell("k % 4 + 8", "k % 6 + 9")), ",", "rate", ")", "^", "2"],
    ["=", cell("k % 8 + 3", "k % 10 + 5"), "#", "+", "TRUE"],
    ["note ", '"E7"'],
]
OPERATORS, PUNCTUATION = "=*+-/^&", "(),#"


def text_sql(template: list[str | Ref], change: Callable[[Ref], str] | None = None) -> str:
    """SQL of a formula's text, with change(ref) for its references."""
    parts = [(change or Ref.text)(t) if isinstance(t, Ref) else f"'{t}'" for t in template]
    return f"concat({', '.join(parts)})"


def case_sql(of: Callable[[list[str | Ref]], str]) -> str:
    return "CASE k % 6 " + " ".join(f"WHEN {i} THEN {of(t)}" for i, t in enumerate(TEMPLATES)) + " END"


ROWS = "(SELECT p_partkey AS k, p_partkey FROM part)"


def rewritten(name: str, doc: str, change: Callable[[Ref], str], f: Callable[[Column], Column]) -> None:
    """Registers a query: f of every formula, against SQL that puts change(ref) in its references' places."""

    def run(spark, sf_dir):
        rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"))
        return rows.select("p_partkey", F.expr(case_sql(text_sql)).alias("f")).select("p_partkey", f(F.col("f")).alias("formula"))

    run.__name__, run.__doc__ = name, doc
    query(f"SELECT p_partkey, {case_sql(lambda t: text_sql(t, change))} AS formula FROM {ROWS}")(run)


def _lost(condition: str, otherwise: str) -> str:
    return f"CASE WHEN {condition} THEN '#REF!' ELSE {otherwise} END"


def _in(x: str | None, places: list[int]) -> str:
    return "false" if x is None or not places else f"({x}) - 1 IN ({', '.join(map(str, places))})"


def shifted(rows: int, cols: int) -> Callable[[Ref], str]:
    def change(ref: Ref) -> str:
        texts, out = [], ["false"]
        for e in ref.ends:
            c = None if e.c is None else e.c if e.dc else f"({e.c}) + ({cols})"
            r = None if e.r is None else e.r if e.dr else f"({e.r}) + ({rows})"
            out += [f"({x}) < 1" for x in (c, r) if x is not None]
            texts.append(e.text(c and f"greatest({c}, 1)", r))
        return _lost(" OR ".join(out), Ref.joined(texts))

    return change


def stamped(cols: list[int], rows: list[int]) -> Callable[[Ref], str]:
    def change(ref: Ref) -> str:
        hits = [f"({_in(e.c, cols)} OR {_in(e.r, rows)})" for e in ref.ends]
        return _lost(" AND ".join(hits), Ref.joined(_lost(h, e.text()) for h, e in zip(hits, ref.ends)))

    return change


def _shift_sql(x: str | None, places: list[int], test: str) -> str | None:
    """x less (or more) the number of places that pass the test."""
    return None if x is None else f"({x})" + "".join(f" {test[0]} (CASE WHEN {test[1:].format(x=f'(({x}) - 1)', p=p)} THEN 1 ELSE 0 END)" for p in places)


def inserted(cols: list[int], rows: list[int]) -> Callable[[Ref], str]:
    return lambda ref: Ref.joined(e.text(_shift_sql(e.c, cols, "+{x} >= {p}"), _shift_sql(e.r, rows, "+{x} >= {p}")) for e in ref.ends)


def deleted(cols: list[int], rows: list[int]) -> Callable[[Ref], str]:
    """Ranges here are in order, so their first end is the lower one."""

    def change(ref: Ref) -> str:
        a, b = ref.ends[0], ref.ends[-1]
        fc, fr = _shift_sql(a.c, cols, "-{p} < {x}"), _shift_sql(a.r, rows, "-{p} < {x}")
        lc, lr = _shift_sql(b.c, cols, "-{p} <= {x}"), _shift_sql(b.r, rows, "-{p} <= {x}")
        gone = " OR ".join([f"{y} < {x}" for x, y in ((fc, lc), (fr, lr)) if x is not None])
        same = " AND ".join([f"{x} = ({y})" for x, y in ((fc, a.c), (fr, a.r), (lc, b.c), (lr, b.r)) if x is not None])
        moved = a.text(fc, fr, False) if len(ref.ends) == 1 else Ref.joined((a.text(fc, fr, False), b.text(lc, lr, False)))
        return f"CASE WHEN {gone} THEN '#REF!' WHEN {same} THEN {ref.text()} ELSE {moved} END"

    return change


def moved(axis: str, start: int, count: int, to: int, follow: bool) -> Callable[[Ref], str]:
    """The new place of every line of a range is listed, and its box is the least and the greatest of them."""

    def image(x: str) -> str:
        x = f"({x})"
        band = f"{x} BETWEEN {start + count + 1} AND {to + count} THEN {x} - {count}" if to > start else f"{x} BETWEEN {to + 1} AND {start} THEN {x} + {count}"
        return f"CASE WHEN {x} BETWEEN {start + 1} AND {start + count} THEN {x} + ({to - start}) WHEN {band} ELSE {x} END"

    def put(e: End, x: str) -> str:
        return e.text(c=x) if axis == "c" else e.text(r=x)

    def change(ref: Ref) -> str:
        a, b = ref.ends[0], ref.ends[-1]
        x, y = (a.c, b.c) if axis == "c" else (a.r, b.r)
        other = a.r if axis == "c" else a.c
        if x is None or len(ref.ends) == 2 and other is not None and not follow:
            return ref.text()
        if len(ref.ends) == 1:
            return put(a, image(x))
        places = f"list_transform(range(({x})::BIGINT, ({y})::BIGINT + 1), lambda i: {image('i')})"
        return Ref.joined((put(a, f"list_min({places})"), put(b, f"list_max({places})")))

    return change


rewritten("formulas_shift", "Copied two rows down and one column right.", shifted(2, 1), lambda f: references.shift(f, 2, 1))
rewritten("formulas_shift_off_grid", "Copied six rows up and four columns left: what leaves the grid is lost.", shifted(-6, -4), lambda f: references.shift(f, -6, -4))
rewritten("formulas_stamp_deleted", "Ends in a deleted column or row are marked.", stamped([4, 6], [8, 9]), lambda f: references.stamp_deleted(f, [4, 6], [8, 9]))
rewritten("formulas_adjust_insert", "Two columns put in before E, a row before line 8.", inserted([4, 4], [7]), lambda f: references.adjust_inserted(f, cols=[4, 4], rows=[7]))
rewritten("formulas_adjust_delete", "Columns E and H and lines 9 to 11 taken out.", deleted([4, 7], [8, 9, 10]), lambda f: references.adjust_deleted(f, cols=[4, 7], rows=[8, 9, 10]))
rewritten("formulas_move_columns", "Columns F and G moved before D.", moved("c", 5, 2, 3, False), lambda f: references.move_columns(f, 5, 2, 3))
rewritten("formulas_move_columns_following", "The same, with bounded ranges following their data.", moved("c", 5, 2, 3, True), lambda f: references.move_columns(f, 5, 2, 3, True))
rewritten("formulas_move_rows", "Lines 7 to 9 moved behind line 12.", moved("r", 6, 3, 9, False), lambda f: references.move_rows(f, 6, 3, 9))
rewritten("formulas_move_rows_following", "The same, with bounded ranges following their data.", moved("r", 6, 3, 9, True), lambda f: references.move_rows(f, 6, 3, 9, True))


def _kinds(template: list[str | Ref]) -> list[tuple[str, str]]:
    """(SQL of the text, kind) of each token of a template."""
    out = []
    for i, t in enumerate(template):
        if isinstance(t, Ref) and t.kind == "range":
            out += [(t.ends[0].text(), "cell"), ("':'", "punctuation"), (t.ends[1].text(), "cell")]
        elif isinstance(t, Ref):
            out.append((t.text(), "cell" if t.kind == "cell" else "range"))
        elif t == "note ":
            out += [("'note'", "identifier"), ("' '", "blank")]
        else:
            kind = "string" if t.startswith('"') else "operator" if t in OPERATORS else "punctuation" if t in PUNCTUATION else "boolean" if t == "TRUE" else "number" if t.isdigit() else "identifier"
            out.append((f"'{t}'", kind))
    return out


def _tokens_sql(template: list[str | Ref]) -> str:
    """text@kind@start of all tokens; the starts are the lengths of all texts before."""
    parts, before = [], ["0"]
    for text, kind in _kinds(template):
        parts.append(f"concat({text}, '@{kind}@', CAST({' + '.join(before)} AS VARCHAR(9)))")
        before.append(f"length({text})")
    return f"concat_ws('|', {', '.join(parts)})"


def _formulas(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("k"))
    return rows.select("p_partkey", F.expr(case_sql(text_sql)).alias("f"))


@query(f"SELECT p_partkey, {case_sql(_tokens_sql)} AS tokens FROM {ROWS}")
def formula_token_kinds(spark, sf_dir):
    """Every token with its kind and where it starts."""
    shown = F.transform(references.classified(F.col("f")), lambda x: F.concat_ws("@", x["text"], x["kind"], x["start"].cast("string")))
    return _formulas(spark, sf_dir).select("p_partkey", F.array_join(shown, "|").alias("tokens"))


def _refs_sql(template: list[str | Ref]) -> str:
    parts, before = [], ["0"]
    if template[0] != "=":
        return "''"
    for i, t in enumerate(template):
        text = t.text() if isinstance(t, Ref) else f"'{t}'"
        follows = template[i + 1] if i + 1 < len(template) else ""
        spill = isinstance(t, Ref) and follows == "#"
        kind = "spill" if spill else t.kind if isinstance(t, Ref) else "name" if t.isidentifier() and follows != "(" and t != "TRUE" else None
        if kind:
            shown = f"concat({text}, '#')" if spill else text
            parts.append(f"concat('{kind}@', {shown}, '@', CAST({' + '.join(before)} AS VARCHAR(9)))")
        before.append(f"length({text})")
    return f"concat_ws('|', {', '.join(parts)})"


@query(f"SELECT p_partkey, {case_sql(_refs_sql)} AS refs FROM {ROWS}")
def formula_references(spark, sf_dir):
    """All that a formula refers to: cells, ranges, whole columns and rows, spills, names."""
    shown = F.transform(references.extract_refs(F.col("f")), lambda x: F.concat_ws("@", x["kind"], x["text"], x["start"].cast("string")))
    return _formulas(spark, sf_dir).select("p_partkey", F.array_join(shown, "|").alias("refs"))


def _called(template: list[str | Ref]) -> str:
    return ",".join(sorted(t for t, u in zip(template, template[1:]) if u == "("))


@query(f"SELECT p_partkey, {case_sql(lambda t: repr(_called(t)))} AS used, {case_sql(lambda t: repr(','.join(x for x in _called(t).split(',') if x in ('MAX', 'LOG10'))))} AS unknown FROM {ROWS}")
def formula_lint(spark, sf_dir):
    """Called names, and those that no registry has."""
    f = F.col("f")
    return _formulas(spark, sf_dir).select("p_partkey", F.array_join(F.sort_array(references.functions_used(f)), ",").alias("used"), F.array_join(F.sort_array(references.unknown_functions(f, ["SUM", "AVERAGE"])), ",").alias("unknown"))
