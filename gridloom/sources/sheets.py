"""Tables and texts as sheets, and back.

A table bound as a sheet has a letter for each column and Values for formulas.
The cell plane is a DataFrame cells(sheet, r, c, seq, raw): r and c from 1,
seq the order of edits, raw the text as it was entered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import Value, kind_of, literal

CELL = r"^\$?([A-Za-z]+)\$?([0-9]+)$"
#: Names of built-in functions.
BUILTIN = ("SUM", "AVERAGE", "MEAN", "AVG", "MIN", "MAX", "COUNT", "CONCAT", "ABS", "ROUND", "LEN", "UPPER", "LOWER", "IF", "FILTER", "SORT", "UNIQUE", "TRANSPOSE", "SEQUENCE")


def letters(n: int) -> str:
    """1 is A, 27 is AA."""
    out = ""
    while n > 0:
        n, d = divmod(n - 1, 26)
        out = chr(65 + d) + out
    return out


def column_number(c: Column) -> Column:
    """Number of a column's letters, as a Column."""
    digits = F.transform(F.split(F.upper(c), ""), lambda x: F.ascii(x) - 64)
    return F.aggregate(F.filter(digits, lambda d: d > 0), F.lit(0), lambda a, d: a * 26 + d)


def column_letters(n: Column) -> Column:
    """Letters of a column number (up to three)."""

    def one(x: Column) -> Column:
        return F.when(x > 0, F.char(x + 64)).otherwise("")

    last = F.pmod(n - 1, F.lit(26)) + 1
    rest = F.floor((n - 1) / 26)
    middle = F.when(rest > 0, F.pmod(rest - 1, F.lit(26)) + 1).otherwise(0)
    first = F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return F.concat(one(first), one(middle), one(last))


class Sheet:
    """A DataFrame whose columns are A, B, C ...; named values are expressions over them."""

    def __init__(self, df: DataFrame, names: dict[str, Value] | None = None):
        self.df, self.names = df, {k.upper(): v for k, v in (names or {}).items()}
        self.columns = [c for c in df.columns if not c.startswith("_")]

    def __getitem__(self, key: str) -> Value:
        """A named value, a column by its name, or by its letters."""
        if key.upper() in self.names:
            return self.names[key.upper()]
        if key in self.columns:
            name = key
        else:
            n = 0
            for ch in key.upper():
                n = n * 26 + ord(ch) - 64
            if not key.isalpha() or not 1 <= n <= len(self.columns):
                raise KeyError(f"#NAME? {key}")
            name = self.columns[n - 1]
        kind = kind_of(self.df.schema[name].dataType)
        col = F.col(name)
        if kind == "custom":
            from ..functions.types import of_data_type

            return of_data_type(col, self.df.schema[name].dataType)
        return Value(col.cast("double") if kind == "number" else col, kind)

    def named(self, **values: Value) -> Sheet:
        """With more names; a name is neither a cell reference nor a logical value nor a built-in function."""
        import re

        for n in values:
            if re.match(CELL, n) or n.upper() in ("TRUE", "FALSE", *BUILTIN) or not re.match(r"^[A-Za-z][A-Za-z0-9_.]*$", n):
                raise ValueError(f"{n} cannot be a name")
        return Sheet(self.df, self.names | values)

    def range(self, first: str, last: str, rows: tuple[int, int] | None = None, position: str = "_r") -> DataFrame:
        """Columns first to last, whole or with the rows of a position; reversed corners are put right."""
        at = sorted(self.columns.index(self.columns[_number(x) - 1]) for x in (first, last))
        out = self.df if rows is None else self.df.where(F.col(position).between(min(rows), max(rows)))
        keep = [c for c in self.df.columns if c.startswith("_")]
        return out.select(*keep, *self.columns[at[0] : at[1] + 1])


def _number(x: str) -> int:
    n = 0
    for ch in x.upper():
        n = n * 26 + ord(ch) - 64
    return n


# ---- the cell plane


def edits(rows: DataFrame, sheet: str = "main") -> DataFrame:
    """cells from rows(cell_id, raw, seq); ids that are no cell are left out."""
    return rows.where(F.col("cell_id").rlike(CELL)).select(
        F.lit(sheet).alias("sheet"),
        F.regexp_extract("cell_id", CELL, 2).cast("int").alias("r"),
        column_number(F.regexp_extract("cell_id", CELL, 1)).alias("c"),
        F.col("seq").cast("long").alias("seq"),
        "raw",
    )


#: Kinds that a typed edit may have.
KINDS = ("raw", "string", "number", "boolean", "empty", "custom")


def typed_edits(rows: DataFrame, sheet: str = "main") -> DataFrame:
    """cells of rows(cell_id, kind, value, tag, seq), with columns kind and tag: the value is read as that kind, whatever its text looks like. raw and empty edits are plain ones."""
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("no kind "), F.coalesce("kind", F.lit("NULL")), F.lit(" in "), F.col("cell_id"))))
    plain = rows.withColumn("raw", F.when(F.col("kind") == "empty", "").otherwise(F.col("value"))).withColumn("_kind", F.when(~known.isin("raw", "empty"), F.col("kind")))
    cells = edits(plain.select("cell_id", F.struct("raw", "_kind", "tag").alias("raw"), "seq"), sheet)
    return cells.select("sheet", "r", "c", "seq", F.col("raw.raw").alias("raw"), F.col("raw._kind").alias("kind"), F.col("raw.tag").alias("tag"))


def upsert(cells: DataFrame, new: DataFrame) -> DataFrame:
    """The last write of each cell wins, with its kind if it is a typed one; an empty text deletes, but an empty string is one. Both are cells; new edits have greater seq."""
    both = cells.unionByName(new, allowMissingColumns=True)
    more = [c for c in both.columns if c in ("kind", "tag")]
    last = both.groupBy("sheet", "r", "c").agg(F.max_by(F.struct("raw", *more), "seq").alias("_last"), F.max("seq").alias("seq"))
    gone = (F.col("_last.raw") == "") & (~F.coalesce(F.col("_last.kind") == "string", F.lit(False)) if "kind" in more else F.lit(True))
    return last.where(~gone).select("sheet", "r", "c", "seq", "_last.*")


def typed(cells: DataFrame) -> DataFrame:
    """With the value that each text reads as, or a typed edit says: kind, num, str, bool."""
    own = [c for c in cells.columns if c not in ("kind", "tag")]
    if "kind" not in cells.columns:
        return cells.withColumn("_v", literal(F.col("raw"))).select(*own, "_v.*")
    said, raw = F.col("kind"), F.col("raw")
    as_said = F.struct(
        F.when(said == "string", "text").otherwise(said).alias("kind"),
        F.when(said == "number", raw.try_cast("double")).alias("num"),
        F.when(said.isin("string", "custom"), raw).alias("str"),
        F.when(said == "boolean", F.lower(raw) == "true").alias("bool"),
    )
    return cells.withColumn("_v", F.when(said.isNotNull(), as_said).otherwise(literal(raw))).select(*own, "tag", "_v.*")


def read(cells: DataFrame, *ids: str) -> DataFrame:
    """The cells of these ids ($ marks do not count); a missing one is empty and has no row."""
    import re

    wanted = F.lit(False)
    for i in ids:
        m = re.match(CELL, i)
        if not m:
            raise ValueError(f"{i} is no cell")
        wanted = wanted | ((F.col("r") == int(m[2])) & (F.col("c") == _number(m[1])))
    return cells.where(wanted)


def read_sheet_text(spark: SparkSession, path: str, sheet: str = "main", strict: bool = True) -> DataFrame:
    """cells of `.sheet` lines `ID: raw`; # starts a comment, the last line of a cell wins, an empty text clears. strict: ValueError for a line of any other form."""
    lines = spark.read.text(path).withColumn("seq", F.monotonically_increasing_id())
    if strict and (bad := malformed(lines).orderBy("seq").first()) is not None:
        raise ValueError(f"not a cell's line: {bad['value']}")
    return parse_lines(lines, sheet)


LINE = r"^([A-Za-z]+[0-9]+):\s?(.*)$"


def malformed(lines: DataFrame) -> DataFrame:
    """The lines(value, seq) that are neither blank nor a comment nor a cell's."""
    return lines.where(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def parse_lines(lines: DataFrame, sheet: str = "main") -> DataFrame:
    """cells of lines(value, seq)."""
    rows = lines.where(F.col("value").rlike(LINE)).select(F.regexp_extract("value", LINE, 1).alias("cell_id"), F.trim(F.regexp_extract("value", LINE, 2)).alias("raw"), "seq")
    return upsert(edits(rows.limit(0), sheet), edits(rows, sheet))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """`ID: raw` lines, by column and then row."""
    line = F.concat(column_letters(F.col("c")), F.col("r").cast("string"), F.lit(": "), F.col("raw"))
    return cells.orderBy("c", "r").select(line.alias("value"))


def write_sheet_text(cells: DataFrame, path: str) -> None:
    sheet_lines(cells).write.mode("overwrite").text(path)


def snapshot_lines(cells: DataFrame, computed: DataFrame) -> DataFrame:
    """`ID: raw => shown` lines; computed: (r, c, shown)."""
    joined = cells.join(computed, ["r", "c"], "left")
    line = F.concat(column_letters(F.col("c")), F.col("r").cast("string"), F.lit(": "), F.col("raw"), F.lit(" => "), F.coalesce("shown", F.lit("")))
    return joined.orderBy("c", "r").select(line.alias("value"))


def verify_snapshot(lines: DataFrame, computed: DataFrame) -> DataFrame:
    """(cell, expected, shown) of the cells that differ from a snapshot; the first ` => ` parts text and value."""
    shape = r"^([A-Za-z]+)([0-9]+): (.*?) => (.*)$"
    want = lines.where(F.col("value").rlike(shape)).select(column_number(F.regexp_extract("value", shape, 1)).alias("c"), F.regexp_extract("value", shape, 2).cast("int").alias("r"), F.regexp_extract("value", shape, 4).alias("expected"))
    both = want.join(computed.select("r", "c", "shown"), ["r", "c"], "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("shown"))).select(F.concat(column_letters(F.col("c")), F.col("r").cast("string")).alias("cell"), "expected", "shown")


def from_tsv(spark: SparkSession, path: str, row: int = 1, col: int = 1, sheet: str = "main") -> DataFrame:
    """Cells of pasted tab-separated text, placed from (row, col); the file is read in its order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("i", "line"))
    return lines.select("i", F.posexplode(F.split("line", "\t")).alias("j", "raw")).where("raw <> ''").select(F.lit(sheet).alias("sheet"), (F.col("i") + row).alias("r"), (F.col("j") + col).alias("c"), F.lit(0).cast("long").alias("seq"), "raw")


def to_tsv(cells: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    """One row (r, line) for each row of the rectangle: its texts, tab-separated, empty where no cell is."""
    inside = cells.where(F.col("r").between(top, bottom) & F.col("c").between(left, right))
    rows = cells.sparkSession.range(top, bottom + 1).select(F.col("id").cast("int").alias("r"))
    at = inside.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("c", "raw"))).alias("m"))
    return rows.join(at, "r", "left").select("r", F.array_join(F.transform(F.sequence(F.lit(left), F.lit(right)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), "\t").alias("line"))


def from_json(spark: SparkSession, path: str, sheet: str = "main", lines: bool = False) -> DataFrame:
    """Cells of a JSON object {"A1": "raw", ...}, one a file (a task each); lines: one a line, which is how large stores are kept."""
    pairs = spark.read.text(path, wholetext=not lines).select(F.explode(F.from_json("value", "map<string,string>")).alias("cell_id", "raw"))
    return edits(pairs.withColumn("seq", F.lit(0)), sheet)


def to_json(cells: DataFrame, path: str, lines: bool = False) -> None:
    """What from_json() reads. One object holds all cells in a task; with lines each cell is an object of its own."""
    name = F.concat(column_letters(F.col("c")), F.col("r").cast("string"))
    if lines:
        out = cells.select(F.to_json(F.create_map(name, "raw")).alias("value"))
    else:
        pairs = F.sort_array(F.collect_list(F.struct("c", "r", name.alias("name"), "raw")))
        out = cells.agg(F.to_json(F.map_from_entries(F.transform(pairs, lambda x: F.struct(x["name"], x["raw"])))).alias("value")).coalesce(1)
    out.write.mode("overwrite").text(path)
