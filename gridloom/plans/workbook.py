"""Placement of array results in the cell plane, pins, and chains, as joins and windows.

All of it works on whole sets of cells: overlaps are found by grouping cells,
not by walking a grid, and a filled-down formula is one expression or window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import REF, SPILL


def spill(cells: DataFrame, arrays: DataFrame, most_local: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """Places arrays(anchor_r, anchor_c, seq, r, c, v) over authored cells(r, c, raw).

    r and c count from 1 within an array.  An array is blocked as a whole by an
    authored cell other than its anchor, or by a cell of an array placed before
    it (smaller seq); nothing of a blocked array is placed and its anchor shows
    #SPILL!.  Returns (placed(r, c, v, anchor_r, anchor_c), blocked(r, c, v)).
    Blocked arrays block nothing.  Arrays that share cells are settled in rounds
    (of those open, an array first on all its cells is placed, and what shares a
    cell with it is blocked); once at most most_local of their cells are open,
    one task settles the rest in order.
    """
    from .scratch import stored

    at = arrays.select("anchor_r", "anchor_c", "seq", (F.col("anchor_r") + F.col("r") - 1).alias("r"), (F.col("anchor_c") + F.col("c") - 1).alias("c"), "v")
    own = (F.col("r") == F.col("anchor_r")) & (F.col("c") == F.col("anchor_c"))
    authored = cells.select("r", "c", F.lit(True).alias("taken"))
    marked = at.join(authored, ["r", "c"], "left").withColumn("hit", F.coalesce("taken", F.lit(False)) & ~own)
    blocked_by_cell = marked.groupBy("anchor_r", "anchor_c").agg(F.max("hit").alias("by_cell"))
    live = marked.join(blocked_by_cell, ["anchor_r", "anchor_c"]).where("not by_cell")
    behind = _behind(live.select("seq", "anchor_r", "anchor_c", "r", "c"), most_local, stored)
    good = live.join(behind, ["anchor_r", "anchor_c"], "left_anti").select("r", "c", "v", "anchor_r", "anchor_c")
    bad = blocked_by_cell.where("by_cell").select("anchor_r", "anchor_c").union(behind)
    return good, bad.select(F.col("anchor_r").alias("r"), F.col("anchor_c").alias("c"), F.lit(SPILL).alias("v"))


def _behind(live: DataFrame, most_local: int, stored) -> DataFrame:
    """(anchor_r, anchor_c) of the arrays of live(seq, anchor_r, anchor_c, r, c) that an array placed before them blocks."""
    anchor, on_cell = ["anchor_r", "anchor_c"], Window.partitionBy("r", "c")
    rank = F.struct("seq", "anchor_r", "anchor_c")
    shared = live.withColumn("many", F.min(rank).over(on_cell) != F.max(rank).over(on_cell)).where("many")
    open_ = stored(shared.select("seq", *anchor, "r", "c").distinct(), "open")
    blocked = []
    while open_.count() > most_local:
        first = open_.withColumn("first", F.min(rank).over(on_cell) == rank)
        placed = first.groupBy(anchor).agg(F.min("first").alias("first")).where("first").select(anchor)
        placed = stored(placed, "placed")
        rest = open_.join(placed, anchor, "left_anti")
        hit = rest.join(open_.join(placed, anchor, "left_semi").select("r", "c").distinct(), ["r", "c"], "left_semi").select(anchor).distinct()
        blocked.append(stored(hit, "blocked"))
        open_ = stored(rest.join(blocked[-1], anchor, "left_anti"), "open")
    out = open_.coalesce(1).mapInArrow(_in_order, open_.select(anchor).schema)
    for more in blocked:
        out = out.union(more)
    return out


def _in_order(batches):
    """Arrays that are kept out when cells(seq, anchor_r, anchor_c, r, c) are taken in order."""
    import pyarrow as pa

    cells, types = {}, None
    for batch in batches:
        types = [batch.schema.field(i).type for i in (1, 2)]
        for seq, ar, ac, r, c in zip(*(x.to_pylist() for x in batch.columns)):
            cells.setdefault((seq, ar, ac), []).append((r, c))
    taken, out = set(), []
    for name in sorted(cells):
        if taken.isdisjoint(cells[name]):
            taken.update(cells[name])
        else:
            out.append(name)
    if types:
        yield pa.RecordBatch.from_arrays([pa.array([name[i] for name in out], types[i - 1]) for i in (1, 2)], names=["anchor_r", "anchor_c"])


def regions(placed: DataFrame) -> DataFrame:
    """(anchor_r, anchor_c, rows, cols) of placed arrays."""
    return placed.groupBy("anchor_r", "anchor_c").agg((F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("cols"))


def spill_array(placed: DataFrame, anchor_r: int, anchor_c: int, shown: bool = False) -> DataFrame:
    """The array at an anchor (A1#) as a frame (r, c, v). Where none is, no rows; shown as in a sheet (v is text), one row #REF!."""
    if shown:
        own = spill_array(placed, anchor_r, anchor_c).withColumn("v", F.col("v").cast("string"))
        none = own.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(1).alias("r"), F.lit(1).alias("c"), F.lit(REF).alias("v"))
        return own.union(none)
    own = placed.where((F.col("anchor_r") == anchor_r) & (F.col("anchor_c") == anchor_c))
    return own.select((F.col("r") - anchor_r + 1).alias("r"), (F.col("c") - anchor_c + 1).alias("c"), "v")


def pin(arrays: DataFrame, pinned: DataFrame) -> DataFrame:
    """Arrays with those of pinned(same columns) in place of the formulas' at the same anchors."""
    keys = pinned.select("anchor_r", "anchor_c").distinct()
    return arrays.join(keys, ["anchor_r", "anchor_c"], "left_anti").unionByName(pinned)


def running_chain(df: DataFrame, step: Column, order: list[str], partition: list[str], start: float = 0.0) -> DataFrame:
    """The column A{n} = A{n-1} + step{n}, as one window for each partition."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("chain", F.lit(start) + F.sum(step).over(w))


def dependencies(formulas: DataFrame) -> DataFrame:
    """(target, source) edges of formulas(cell_id, raw): the cells that each one names, and its ranges, which are nodes of their own.

    A range (A1:B9, A:C, 3:5) has edges to the formulas within it, found by an
    equi-join on the column (of whole rows, on the row), so that many sums over
    one column cost one edge each.
    """
    from ..operators.references import parse_cell, range_refs
    from ..sources.sheets import column_letters

    each = formulas.select(F.upper(F.regexp_replace("cell_id", r"\$", "")).alias("target"), F.explode(range_refs(F.col("raw"))).alias("ref")).select("target", "ref.*")
    part = lambda c, r: F.concat(F.coalesce(column_letters(F.col(c) + 1), F.lit("")), F.coalesce((F.col(r) + 1).cast("string"), F.lit("")))
    single = F.coalesce((F.col("first_row") == F.col("last_row")) & (F.col("first_col") == F.col("last_col")), F.lit(False))
    name = F.when(single, part("first_col", "first_row")).otherwise(F.concat(part("first_col", "first_row"), F.lit(":"), part("last_col", "last_row")))
    each = each.withColumn("single", single).withColumn("source", name)
    ranges = each.where("not single").select("source", "first_row", "first_col", "last_row", "last_col").distinct()
    cells = formulas.select(F.upper(F.regexp_replace("cell_id", r"\$", "")).alias("cell"), parse_cell(F.col("cell_id")).alias("at")).select("cell", F.col("at.row").alias("row"), F.col("at.col").alias("col"))
    wide = ranges.where("first_col is not null").withColumn("_col", F.explode(F.sequence("first_col", "last_col")))
    wide = wide.join(cells, F.col("_col") == F.col("col")).where(F.coalesce(F.col("row") >= F.col("first_row"), F.lit(True)) & F.coalesce(F.col("row") <= F.col("last_row"), F.lit(True)))
    flat = ranges.where("first_col is null").withColumn("_row", F.explode(F.sequence("first_row", "last_row"))).join(cells, F.col("_row") == F.col("row"))
    inside = wide.select(F.col("source").alias("target"), F.col("cell").alias("source")).union(flat.select(F.col("source").alias("target"), F.col("cell").alias("source")))
    return each.select("target", "source").distinct().union(inside)


def circular(edges: DataFrame, most_local: int = 500_000) -> DataFrame:
    """(cell) of the cells on a cycle, or between cycles: what is left once nodes without sources or without dependants go, round by round. Ranges are nodes, but no cells.

    Rounds go on until none goes. Once at most most_local edges are left, one
    task peels them to the end, so that a long chain takes no round for each cell.
    """
    from .scratch import stored

    left = stored(edges.select("target", "source").distinct(), "cycle")
    size = left.count()
    while size > most_local:
        left = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("target", "source")
        left = left.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("target", "source")
        left = stored(left, "cycle")
        now = left.count()
        if now == size:
            return left.select(F.col("target").alias("cell")).distinct().where(~F.col("cell").contains(":"))
        size = now
    return left.coalesce(1).mapInArrow(_peeled, "cell string").where(~F.col("cell").contains(":"))


def _peeled(batches):
    """Cells that are left of edges(target, source), each edge looked at twice at most."""
    import pyarrow as pa

    edges = {(t, s) for batch in batches for t, s in zip(*(c.to_pylist() for c in batch.columns)) if t is not None and s is not None}
    ends = {cell for edge in edges for cell in edge}
    for near, far in ((0, 1), (1, 0)):
        many, behind = dict.fromkeys(ends, 0), {cell: [] for cell in ends}
        for edge in edges:
            many[edge[near]] += 1
            behind[edge[far]].append(edge[near])
        free = [cell for cell in ends if not many[cell]]
        gone = set(free)
        while free:
            for cell in behind[free.pop()]:
                many[cell] -= 1
                if not many[cell]:
                    gone.add(cell)
                    free.append(cell)
        ends -= gone
        edges = {edge for edge in edges if not (edge[0] in gone or edge[1] in gone)}
    yield pa.RecordBatch.from_arrays([pa.array(sorted(ends), pa.string())], names=["cell"])
