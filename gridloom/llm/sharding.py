"""Resharding with the fewest moved bytes, as a minimum-cost flow between old and new shards.

The flow network is as small as the two shard counts: every old shard supplies
its bytes, every new shard takes its capacity, an edge from a shard to itself
is free and any other costs one for each byte.  Each edge's bytes are one block
of the old shard's documents, cut from the documents in the order of falling
size class, so that what moves, and what lies at a cut, are the smallest ones.

Files: a store of shards has the files of each version of a shard in a folder of
their own, and a manifest, to which a version's shards are added once all of its
files are written.  A reader takes each shard's greatest version in the manifest,
so a rewrite that dies, or tasks that run twice, change nothing, and the files
of shards that neither gain nor lose a document are never touched.

Law: "bytes".  A new shard differs from its capacity by less than one document
at each of its cuts.  Groups: equal texts are not held together, for a group may
be larger than a shard (a third of all rows) and the law is that of the bytes;
each row of a group is placed for itself.

Cases: a null text has no bytes and the row weighs `overhead`; repeated rows and
rows of one doc_id or none are placed each for itself, by where they stand; an
empty table gives an empty result and no files; other columns stay out of the
way and are written with the rows, under _file_names() (columns named shard, slot
or version are replaced).
"""

from __future__ import annotations

import heapq

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import kept, pick, running, shielded


def cheapest_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Bytes for each (old, new) edge at the least total cost: successive shortest paths with potentials. sum(supply) <= sum(capacity)."""
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    high = [0] * (n + m)
    while any(left):
        far = [0 if i < n and left[i] else None for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        done = set()
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            if u < n:
                steps = [(n + j, cost(u, j)) for j in range(m)]
            else:
                steps = [(i, -cost(i, u - n)) for i in range(n) if flow.get((i, u - n))]
            for v, c in steps:
                e = d + c + high[u] - high[v]
                if v not in done and (far[v] is None or e < far[v]):
                    far[v], came[v] = e, u
                    heapq.heappush(heap, (e, v))
        end = min((j for j in range(n, n + m) if room[j - n] and far[j] is not None), key=lambda j: (far[j] + high[j], j))
        for i, d in enumerate(far):
            if d is not None:
                high[i] += min(d, far[end])
            else:
                high[i] += far[end]
        path = [end]
        while came[path[-1]] is not None:
            path.append(came[path[-1]])
        path.reverse()
        most = min([left[path[0]], room[end - n], *(flow[(v, u - n)] for u, v in zip(path, path[1:]) if u >= n)])
        for u, v in zip(path, path[1:]):
            if u < n:
                flow[(u, v - n)] = flow.get((u, v - n), 0) + most
            else:
                flow[(v, u - n)] -= most
        left[path[0]] -= most
        room[end - n] -= most
    return {k: v for k, v in flow.items() if v}


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


#: The order of the rows of a bucket, and within a shard.
TIES = ["_at", "doc_id", "size"]


def _at(rows: DataFrame) -> Column:
    """A row's place in the order of a shard; rows of one doc_id are spread by where they stand."""
    return F.xxhash64("doc_id", *[c for c in ("_file", "_row") if c in rows.columns], F.lit("order"))


def _bucket() -> Column:
    """The leading part of the order in which an old shard is cut: falling size classes, each in 64 parts."""
    return F.floor(F.log2(F.col("size") + 1) * 32) * -64 + F.shiftright("_at", 58) + 32


def reshard(rows: DataFrame, shards: int, capacities: list[int] | None = None) -> DataFrame:
    """Adds shard and slot (gapless from 0 within a shard) to rows(doc_id, size, old, ...); old: the present shard, from 0.

    capacities: bytes for each new shard; without them all are equal.
    """
    rows = rows.withColumn("_at", _at(rows))
    sizes = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.sum("size").alias("n")).collect()}  # one row for each old shard
    supply = [int(sizes.get(i, 0)) for i in range(max(sizes, default=-1) + 1)]
    capacity = capacities or even(sum(supply), shards)
    if len(capacity) != shards or sum(capacity) < sum(supply):
        raise ValueError("the capacities must number as the shards and hold all bytes")
    flow = cheapest_flow(supply, capacity, lambda i, j: int(i != j))
    cuts = []
    for i in range(len(supply)):
        at = 0
        for j in sorted((j for k, j in flow if k == i), key=lambda j: (j != i, j)):
            at += flow[(i, j)]
            cuts.append((i, at, j))
    rows = running(rows, "old", TIES, F.col("size"), _bucket(), "_through")
    ends = {i: [(c[1], c[2]) for c in cuts if c[0] == i] for i in range(len(supply))}
    table = F.create_map(*[x for i, own in ends.items() if own for x in (F.lit(i), F.array(*[F.struct(F.lit(e).cast("long").alias("end"), F.lit(j).alias("to")) for e, j in own]))]) if cuts else None
    middle = F.col("_through") * 2 - F.col("size")
    to = F.lit(0) if table is None else F.coalesce(F.element_at(F.filter(table[F.col("old")], lambda c: c["end"] * 2 > middle), 1)["to"], F.element_at(table[F.col("old")], -1)["to"])
    rows = rows.withColumn("shard", to.cast("int"))
    rows = running(rows, "shard", TIES, F.lit(1), F.shiftright("_at", 54), "slot")
    return rows.withColumn("slot", (F.col("slot") - 1).cast("long")).drop("_at", "_through")


def sized(docs: DataFrame, overhead: int = 16, old_shards: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, old) of documents; the present layout is a hash of doc_id over old_shards."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        _present(old_shards).alias("old"),
    )


def place(docs: DataFrame, shards: int = 40, overhead: int = 16, old_shards: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, old, law, shard, slot, grown_shard) for every document."""
    rows = sized(docs, overhead, old_shards).withColumn("_row", F.monotonically_increasing_id())
    placed = reshard(kept(rows, "shard-sizes"), shards).drop("_row")
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def _affected(placed: DataFrame) -> list[int]:
    """The shards that gain or lose a document."""
    touched = placed.where("old <> shard")
    return sorted({r[0] for r in touched.select("shard").union(touched.select("old")).distinct().collect()})  # one row a shard


def _versions(spark: SparkSession, path: str) -> dict[int, int]:
    """Each shard's version in the store's manifest."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return {}
    rows = spark.read.schema("shard int, version int").parquet(f"{path}/manifest")
    return {r["shard"]: r["version"] for r in rows.groupBy("shard").agg(F.max("version").alias("version")).collect()}  # one row a shard


def commit(rows: DataFrame, path: str, shards: list[int]) -> None:
    """Writes rows (with shard and slot) as the next version of those shards in the store at path."""
    parts = F.pmod(F.xxhash64("slot"), F.lit(16))
    _write(rows.repartition("shard", parts).sortWithinPartitions("shard", "slot"), path, shards)


def _write(ordered: DataFrame, path: str, shards: list[int]) -> None:
    """commit() of rows that lie as they are to be written."""
    spark = ordered.sparkSession
    version = max(_versions(spark, path).values(), default=-1) + 1
    ordered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/files/version={version}")
    spark.createDataFrame([(s, version) for s in shards], "shard int, version int").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_shards(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """All rows of the store's shards (or of some), each shard in its version of the manifest."""
    by_version: dict[int, list[int]] = {}
    for shard, version in _versions(spark, path).items():
        if shards is None or shard in shards:
            by_version.setdefault(version, []).append(shard)
    there = F.lit(False)
    for version, own in by_version.items():
        there = there | ((F.col("version") == version) & F.col("shard").isin(own))
    return spark.read.option("basePath", f"{path}/files").option("mergeSchema", len(by_version) > 1).parquet(f"{path}/files").where(there).drop("version")


def _located(docs: DataFrame, names: list[str]) -> DataFrame:
    """docs (columns `names`) with _file and _row, which name a row for good: its place in its Parquet file, or else in a stored copy."""
    try:
        return docs.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        return kept(docs.select(*names, F.lit("").alias("_file"), F.monotonically_increasing_id().alias("_row")), "shard-rows")


def _moved(docs: DataFrame, placed: DataFrame, affected: list[int]) -> DataFrame:
    """The rows of docs (with _file, _row, size, old) that placed puts into the affected shards, with shard and slot, in 16 parts a shard.

    Whole rows are shuffled once.  What an old shard gives a new one is a run of
    its order, so a row finds its shard by the runs' last keys, a row for each
    edge of the flow, and its slot from the numbers of rows before its part of
    the shard (1,024 parts).
    """
    key = F.struct(_bucket().alias("bucket"), *TIES)
    placed = placed.withColumn("_at", _at(placed))
    runs = placed.groupBy("old", "shard").agg(F.max(key).alias("end"))
    runs = runs.groupBy(F.col("old").alias("_of")).agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("_runs"))
    part = F.shiftright("_at", 54)
    before = Window.partitionBy("_shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(F.col("shard").alias("_shard"), part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.select("_shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = docs.withColumn("_at", _at(docs)).join(F.broadcast(runs), F.col("old") == F.col("_of"))
    rows = rows.withColumn("shard", F.filter("_runs", lambda r: r["end"] >= key)[0]["shard"]).drop("_of", "_runs")
    rows = rows.where(F.col("shard").isin(affected)).withColumn("_file_part", F.shiftright("_at", 60)).repartition("shard", "_file_part")
    inside = Window.partitionBy("shard", "_file_part", part).orderBy(*TIES)
    rows = rows.withColumn("_inside", F.row_number().over(inside))
    rows = rows.join(F.broadcast(counts), (F.col("shard") == F.col("_shard")) & (part == F.col("_part")))
    return rows.withColumn("slot", (F.col("_inside") - 1 + F.col("_before")).cast("long"))


def _file_names(columns: list[str]) -> list[str | None]:
    """Names in the files: of such as differ in case alone the later ones get their place as a suffix; None: not written."""
    out: list[str | None] = []
    for i, c in enumerate(columns):
        taken = {n.lower() for n in out if n}
        out.append(None if c.lower() in ("shard", "slot", "version") else f"{c}_{i}" if c.lower() in taken else c)
    return out


def rewrite(docs: DataFrame, path: str, shards: int = 40, overhead: int = 16, old: Column | None = None, capacities: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    """Places docs and writes the files of the shards that gain or lose a document to the store at path; the others' files stay as they are.

    old: each row's present shard (from 0), an expression over docs.  Gives
    (placed, affected): placed(doc_id, size, text_crc32, old, shard, slot) of all
    rows, those of affected shards read back from their files.
    """
    docs = docs.withColumn("_old", (_present(32) if old is None else old).cast("int"))
    names = _file_names(docs.columns)
    docs = shielded(docs, "doc_id", "text", "_old")[0]
    inner = {c: n for c, n in zip(docs.columns, names) if n}
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size, crc = (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    docs = _located(docs, list(inner))
    sizes = kept(docs.select("doc_id", "_file", "_row", size, crc, F.col("_old").alias("old")), "shard-sizes")
    placed = kept(reshard(sizes, shards, capacities), "placements")
    affected = _affected(placed)
    whole = ["doc_id", "size", "text_crc32", "old", "shard", "slot"]
    if not affected:
        return placed.select(whole), affected
    moved = _moved(docs.select("*", size, F.col("_old").alias("old")), placed, affected)
    _write(moved.select(*[F.col(c).alias(n) for c, n in inner.items()], "slot", "shard"), path, affected)
    back = read_shards(docs.sparkSession, path, affected).select("doc_id", size, crc, F.col("_old").alias("old"), F.col("shard").cast("int").alias("shard"), "slot")
    return placed.where(~F.col("shard").isin(affected)).select(whole).union(back), affected


def _present(shards: int) -> Column:
    """The present layout where none is told: a hash of doc_id."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def resharded(docs: DataFrame, path: str, shards: int = 40, overhead: int = 16, old_shards: int = 32) -> DataFrame:
    """rewrite() from a layout by a hash of doc_id over old_shards, with law and grown_shard."""
    placed, _ = rewrite(docs, path, shards, overhead, _present(old_shards))
    return placed.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))
