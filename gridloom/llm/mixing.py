"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document waits in its source's queue, in shuffled order, and leaves it at
a virtual finish time: the source's words up to and with the document, divided
by the source's target.  The mix takes documents in the order of their finish
times, over all sources, until its budget of words is used up.  A document can
leave at most `most` times (its repeats queue behind the source's last document).

Two departures from the method as it is usually put: the document's last half
counts as not yet served, so that whole documents round to the nearer side of a
target; and the order of finish times is not sorted as a whole, as all that it
decides is where the budget ends.  That place is found by sums over slices of
finish times, each time within the one slice that holds it, until few documents
are left to be put in order.  What is taken is what the whole sort would take.

Cases: a null text has size 0; null sources are one source, after all others;
documents of size 0 (null, empty or blank) use no words and are in the mix once,
taken 0; repeated rows are documents of their own; an empty table gives an empty
result; columns other than doc_id, text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import if_few, kept, pick, running, shielded

WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(source, source_size, rank, target) of sizes(source, source_size): the budget by weight, at most `most` times a source's size, the excess by weight again.

    Sources are capped in the order of capacity over weight; one is capped if
    its share of what those before it leave is above its capacity.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cyclic = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    by_fill = Window.orderBy(F.col("capacity") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(by_fill), F.lit(0))
    weight_left = F.col("all_weight") - F.coalesce(F.sum("weight").over(by_fill), F.lit(0))
    t = sizes.withColumn("rank", rank).withColumn("weight", cyclic.cast("long")).withColumn("capacity", F.col("source_size") * most)
    t = t.withColumn("budget", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weight", F.sum("weight").over(every))
    t = t.withColumn("capped", left * F.col("weight") > F.col("capacity") * weight_left)
    free = F.col("budget") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("capacity"))).over(every), F.lit(0))
    free_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("capacity").cast("double")).otherwise(free / free_weight * F.col("weight"))
    return t.select("source", "source_size", "rank", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, turns) for each document: taken is size times the number of turns in the mix."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = pick(docs, "doc_id", "source", "text").select("doc_id", "source", word_count(F.col("text")).alias("size")).withColumn("key", key)
    rows = kept(rows, "mix-sizes")
    targets = kept(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    queue = rows.join(targets.withColumnRenamed("source", "_source"), rows.source.eqNullSafe(F.col("_source"))).drop("_source")
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    queue = running(queue, "rank", order, F.col("size"), F.conv(F.substring("key", 1, 3), 16, 10).cast("int"), "up_to")
    queue = kept(queue, "mix-queue")
    # Only documents with words use up the budget, and only the slice of finish times in which it ends is looked at more closely.
    worded = queue.where("size > 0")
    turns = worded.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("finish", _finish(F.col("turn")))
    budget = F.floor(F.lit(share) * targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"])
    end = _end(turns, budget)
    goes = [F.lit(True)] * most
    if end is not None:
        fields = [F.lit(v).cast(turns.schema[n].dataType).alias(n) for n, v in zip(PLACE, end)]
        for k in range(most):
            at = F.struct(*[F.lit(k).alias("turn") if n == "turn" else _finish(F.lit(k)).alias("finish") if n == "finish" else F.col(n) for n in PLACE])
            goes[k] = at <= F.struct(*fields)
    taken = F.lit(0)
    for g in goes:
        taken = taken + g.cast("int")
    taken = F.when(F.col("size") > 0, taken).otherwise(1)
    return queue.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * taken).cast("long").alias("taken"), taken.cast("int").alias("turns"))


#: The order of the mix.
PLACE = ("finish", "rank", "turn", "key", "doc_id", "size")


def _finish(turn: Column) -> Column:
    """Virtual time at which a document has left its queue for the turn-th time, but for its last half."""
    return F.when(F.col("target") > 0, (turn * F.col("source_size") + F.col("up_to") - F.col("size") / 2) / F.col("target")).otherwise(0.0)


def _end(turns: DataFrame, budget: Column, slices: int = 4096, most: int = 100_000, depth: int = 4) -> tuple | None:
    """The place of the last document that the budget holds; () sorts before all others, None: it holds all."""
    words = turns.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), budget.cast("long").alias("budget"), F.min("finish").alias("low"), F.max("finish").alias("high")).first()
    if words["n"] <= words["budget"]:
        return None
    left, before, low, high = turns, 0, words["low"], words["high"]
    for _ in range(depth):
        width = (high - low) / slices
        if not width > 0:
            break
        slice_ = F.least(F.floor((F.col("finish") - low) / width), F.lit(slices - 1))
        sums = left.groupBy(slice_.alias("slice")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.min("finish").alias("low"), F.max("finish").alias("high")).orderBy("slice").collect()  # `slices` rows at most
        for r in sums:
            if before + r["words"] > words["budget"]:
                break
            before += r["words"]
        left, low, high = left.where(F.col("finish").between(r["low"], r["high"])), r["low"], r["high"]
        if r["rows"] <= most:
            break
    order = Window.orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)
    inside = left.select(*PLACE, (F.lit(before) + F.sum("size").over(order)).alias("through"))
    end = inside.where(F.col("through") <= words["budget"]).agg(F.max(F.struct(*PLACE)).alias("end")).first()["end"]
    if end is None:  # the slice's first document is beyond the budget
        end = turns.where(F.col("finish") < low).agg(F.max(F.struct(*PLACE)).alias("end")).first()["end"]
    return (-1.0, None, None, None, None, None) if end is None else tuple(end)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs as the mix has them: each row as many times as its turns. Rows that share doc_id and source take the same number of turns."""
    turns = mix(docs, weights, share, most).groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_source")).agg(F.max("turns").alias("_turns"))
    turns = kept(turns.where("_turns > 0"), "mix-turns")
    docs, restored = shielded(docs, "doc_id", "source")
    out = docs.join(if_few(turns), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("source").eqNullSafe(F.col("_source")))
    return restored(out.withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_turns")))))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, 2 * source_size AS capacity FROM r),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS all_weight,
             coalesce(sum(capacity) OVER f, 0) AS used, coalesce(sum(weight) OVER f, 0) AS used_weight
      FROM w WINDOW f AS (ORDER BY capacity::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (budget - used) * weight > capacity * (all_weight - used_weight) AS capped FROM b),
t AS (SELECT source, source_size, rank, CASE WHEN capped THEN capacity::DOUBLE ELSE
        (budget - coalesce(sum(CASE WHEN capped THEN capacity END) OVER (), 0)) / (sum(CASE WHEN NOT capped THEN weight END) OVER ()) * weight END AS target FROM c),
q AS (SELECT d.*, t.source_size, t.rank, t.target,
             sum(size) OVER (PARTITION BY t.rank ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT q.*, turn, CASE WHEN target > 0 THEN (turn * source_size + up_to - size / 2.0::DOUBLE) / target ELSE 0.0 END AS finish FROM q, (SELECT unnest([0, 1]) AS turn)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS through FROM f)
SELECT doc_id, source, size, source_size, target,
       sum(CASE WHEN through <= floor(1.5 * (SELECT sum(size) FROM d)) THEN size ELSE 0 END)::BIGINT AS taken
FROM g GROUP BY doc_id, source, size, source_size, target
"""
