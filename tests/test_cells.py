"""Cell plane: edits, text sheets, snapshots, spills, cycles; and positions over many partitions."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import arrays
from gridloom.plans import workbook
from gridloom.sources import sheets


def cells(spark, rows):
    return sheets.edits(spark.createDataFrame([(i, raw, k) for k, (i, raw) in enumerate(rows)], "cell_id string, raw string, seq long"))


def ids(df):
    return {sheets.letters(r.c) + str(r.r): r.raw for r in df.collect()}


def test_upsert(spark):
    got = sheets.upsert(cells(spark, [("A1", "1"), ("B1", "x")]), cells(spark, [("$A$1", "2"), ("b1", ""), ("A0x", "?")]).withColumn("seq", F.col("seq") + 10))
    assert ids(got) == {"A1": "2"}


def test_typed(spark):
    got = {sheets.letters(r.c) + str(r.r): (r.kind, r.num) for r in sheets.typed(cells(spark, [("A1", "42"), ("A2", "hello"), ("A3", "=A1")])).collect()}
    assert got == {"A1": ("number", 42.0), "A2": ("text", None), "A3": ("formula", None)}


def test_sheet_text(spark, tmp_path):
    at = tmp_path / "book.sheet"
    at.write_text('# pears by week\nD4: =MAX(E2:E4)\n\nE2: 7\nE3: 8\nE3: 9\nE4: 5\nF2: x\nF2:\n')
    got = sheets.read_sheet_text(spark, str(at))
    assert ids(got) == {"D4": "=MAX(E2:E4)", "E2": "7", "E3": "9", "E4": "5"}
    assert [r.value for r in sheets.sheet_lines(got).collect()] == ["D4: =MAX(E2:E4)", "E2: 7", "E3: 9", "E4: 5"]
    sheets.write_sheet_text(got, str(tmp_path / "out"))
    assert ids(sheets.read_sheet_text(spark, str(tmp_path / "out"))) == ids(got)
    at.write_text("A1: 5\n  A2: 6\n")
    with pytest.raises(ValueError, match="A2: 6"):
        sheets.read_sheet_text(spark, str(at))
    assert ids(sheets.read_sheet_text(spark, str(at), strict=False)) == {"A1": "5"}


def test_snapshot(spark):
    book = cells(spark, [("A1", "=B1 => x"), ("B1", "2")])
    shown = spark.createDataFrame([(1, 1, "2"), (1, 2, "2")], "r int, c int, shown string")
    lines = sheets.snapshot_lines(cells(spark, [("A1", "=B1"), ("B1", "2")]), shown)
    assert [r.value for r in lines.collect()] == ["A1: =B1 => 2", "B1: 2 => 2"]
    assert sheets.verify_snapshot(lines, shown).count() == 0
    changed = shown.where("c = 1").withColumn("shown", F.lit("3"))
    assert {tuple(r) for r in sheets.verify_snapshot(lines, changed).collect()} == {("A1", "2", "3"), ("B1", "2", None)}
    assert book.count() == 2


def test_tsv_and_json(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\t2\n\tz\n")
    got = sheets.from_tsv(spark, str(tmp_path / "x.tsv"), 2, 3)
    assert ids(got) == {"C2": "1", "D2": "2", "D3": "z"}
    assert [r.line for r in sheets.to_tsv(got, 2, 3, 3, 4).orderBy("r").collect()] == ["1\t2", "\tz"]
    (tmp_path / "x.json").write_text('{"A1": "5", "B2": "=A1"}')
    assert ids(sheets.from_json(spark, str(tmp_path / "x.json"))) == {"A1": "5", "B2": "=A1"}
    for lines in (False, True):
        sheets.to_json(got, str(tmp_path / "out.json"), lines)
        assert ids(sheets.from_json(spark, str(tmp_path / "out.json"), lines=lines)) == ids(got)


def test_typed_edits(spark):
    """A kind stays until a raw edit comes; an unknown one is an error that names the cell."""
    schema = "cell_id string, kind string, value string, tag string, seq long"
    rows = [("A1", "string", "42", None, 1), ("A2", "string", "42", None, 1), ("A2", "raw", "42", None, 2), ("A3", "string", "=B1", None, 1), ("A4", "custom", "12", "money", 1), ("A5", "number", "7", None, 1), ("A5", "empty", None, None, 2), ("A6", "string", "", None, 1)]
    cells = sheets.typed_edits(spark.createDataFrame(rows, schema))
    got = {r.r: (r.kind, r.num, r.str, r.tag) for r in sheets.typed(sheets.upsert(cells.limit(0), cells)).collect()}
    assert got == {1: ("text", None, "42", None), 2: ("number", 42.0, None, None), 3: ("text", None, "=B1", None), 4: ("custom", None, "12", "money"), 6: ("text", None, "", None)}
    assert sheets.read(cells, "$A$5", "B9").count() == 2
    with pytest.raises(Exception, match="B2"):
        sheets.typed_edits(spark.createDataFrame([("B2", "bytes", "x", None, 1)], schema)).collect()


def test_shapes(spark):
    def frame(rows):
        return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1)], "r int, c int, v double")

    def cells_of(df):
        return {(r.r, r.c): r.v for r in df.collect()}

    minus = lambda x, y: x - y
    column, row, grid = frame([[10], [20]]), frame([[1, 2, 3]]), frame([[1, 2, 3], [4, 5, 6]])
    assert cells_of(arrays.broadcast(column, row, minus)) == {(i, j): 10.0 * i - j for i in (1, 2) for j in (1, 2, 3)}
    assert cells_of(arrays.broadcast(row, column, minus)) == {(i, j): j - 10.0 * i for i in (1, 2) for j in (1, 2, 3)}
    assert cells_of(arrays.broadcast(column, grid, minus)) == {(i, j): 10.0 * i - 3 * (i - 1) - j for i in (1, 2) for j in (1, 2, 3)}
    assert cells_of(arrays.broadcast(grid, row, minus)) == {(i, j): 3.0 * (i - 1) for i in (1, 2) for j in (1, 2, 3)}
    assert cells_of(arrays.broadcast(grid, frame([[1]]), minus))[2, 3] == 5.0
    bad = arrays.broadcast(column, frame([[1], [2], [3]]), minus).collect()
    assert len(bad) == 1 and bad[0].v is None and bad[0].error.startswith("#VALUE!")
    with pytest.raises(ValueError):
        arrays.align(column, frame([[1], [2], [3]]), minus)


def arrays_of(spark, rows):
    return spark.createDataFrame(rows, "anchor_r int, anchor_c int, seq long, r int, c int, v double")


def test_spill(spark):
    five = [(1, 1, 1, i, 1, float(i)) for i in range(1, 6)]
    blocker = spark.createDataFrame([(3, 1, "99")], "r int, c int, raw string")
    placed, blocked = workbook.spill(blocker, arrays_of(spark, five))
    assert placed.count() == 0 and [tuple(r) for r in blocked.collect()] == [(1, 1, "#SPILL!")]
    placed, blocked = workbook.spill(blocker.where("r > 9"), arrays_of(spark, five + [(3, 1, 2, 1, 1, 7.0)]))
    assert placed.count() == 5 and [tuple(r) for r in blocked.collect()] == [(3, 1, "#SPILL!")]
    assert [tuple(r) for r in workbook.regions(placed).collect()] == [(1, 1, 5, 1)]
    assert workbook.spill_array(placed, 2, 1).count() == 0


def test_cycles(spark):
    book = spark.createDataFrame([("A1", "=B1+1"), ("B1", "=A1"), ("C1", "=A1"), ("D1", "=E1"), ("F1", "=F1")], "cell_id string, raw string")
    got = {r.cell for r in workbook.circular(workbook.dependencies(book)).collect()}
    assert got == {"A1", "B1", "F1"}


def test_a_blocked_array_blocks_nothing(spark):
    chain = arrays_of(spark, [(3 * k, 1, k, i, 1, float(i)) for k in range(1, 6) for i in range(1, 5)])
    none = spark.createDataFrame([], "r int, c int, raw string")
    for most in (500_000, 4):
        placed, blocked = workbook.spill(none, chain, most)
        assert sorted({r.anchor_r for r in placed.collect()}) == [3, 9, 15]
        assert sorted(r.r for r in blocked.collect()) == [6, 12]


def test_long_chains_are_no_cycles(spark):
    edges = spark.createDataFrame([(f"A{i + 1}", f"A{i}") for i in range(300)] + [("B1", "B2"), ("B2", "B1"), ("B2", "C1"), ("C1", "D1"), ("D1", "D1")], "target string, source string")
    for most in (500_000, 295):
        assert {r.cell for r in workbook.circular(edges, most).collect()} == {"B1", "B2", "C1", "D1"}


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    got = arrays.numbered(df, F.col("x")).collect()
    assert sorted((r._r, r.x) for r in got) == [(i + 1, i) for i in range(1000)]


def test_sequence_and_unique(spark):
    got = arrays.SEQUENCE(spark, 2, 3, 10, 2).collect()
    assert [(r.r, r.c, r.v) for r in got] == [(1, 1, 10.0), (1, 2, 12.0), (1, 3, 14.0), (2, 1, 16.0), (2, 2, 18.0), (2, 3, 20.0)]
    df = spark.createDataFrame(list(enumerate([3, 1, 3, 2, 1], 1)), "_r long, v int")
    assert [(r.v, r["rank"]) for r in arrays.UNIQUE(df, "v").orderBy("rank").collect()] == [(3, 1), (1, 2), (2, 3)]
