"""Exact top-k inner products over an impact-ordered index, score at a time.

The index holds every row: vectors are turned into integers, dealt into blocks
of bounded size, and each component is a posting (vector, impact) of its
dimension.  Impacts are quantised; a segment is the postings of one block and
one impact level, the dimensions one after the other.  A block's segments are
processed by falling level for a block of queries.  After each, a score can
still grow by at most the query's length times the length of what the vector
has not yet given (Cauchy-Schwarz), so its place lies between two bounds.  A
query ends early only on proof, when at most `few` vectors can still be among
its k best; these possible members are scored exactly from the whole vectors.

Embeddings have no zeros, so a segment is processed as a matrix product over the
block and not posting by posting.  The bound is weak until nearly all of a vector's
length has been given, so the first level goes down to 1/32 of the greatest
impact (on unit vectors of 64 dimensions a query ends after it, with some 14 of
4,096 rows to be rescored); finer levels are rarely reached.  So the work is
about one product for each query and block, as without an index; what the
levels save is the exact arithmetic on all but the possible members.

A block of vectors stays where it is, and the blocks of queries, which are
smaller by `every`, are sent to it; each meeting returns k rows a query and a
last ranking takes the k best.

Cases: vectors that are null or hold null or non-finite components take no
part, on either side; with fewer than k others, all are returned; ties go to
the smaller vec_id; a repeated vec_id is a row of its own (a query skips all
rows of its own vec_id, and each such row asks once), dealt by the row and not
its id; vectors of unlike dimension score over the shorter of the two, those of
none score 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, pick
from .text import binaries

#: Levels begin at these shares of the block's greatest impact; the last has all below.
FLOORS = (1 / 32, 1 / 256, 0.0)


def finite(vector: str) -> Column:
    """Whether there is a vector and all of its components are finite."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with vectors of finite components."""
    return rows.where(finite(vector))


def integers(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(uid, vec_id, vector): floor(scale * component) with the component as double; uid names the row."""
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vector")
    return usable(pick(rows, "vec_id", "embedding")).select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long"), vector)


def dealt(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """rows with their block, each of about size rows, and the number of blocks."""
    blocks = max(1, -(-rows.count() // size))
    return rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int")), blocks


def _matrix(vectors: list) -> np.ndarray:
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _small(values: np.ndarray) -> bytes:
    """Integers in as few bytes each as hold them all."""
    top = int(np.abs(values).max(initial=0))
    return values.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if top <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{len(raw) // n}") if n else np.zeros(0, dtype=np.int64)


SEGMENTS = "block int, asked int, level int, width int, n int, ids binary, dimensions binary, vectors binary, impacts binary"


def build(rows: DataFrame, block_size: int = 8192) -> DataFrame:
    """The index of rows(uid, vec_id, vector): for each block one row a level with its segment, level 0 having the greatest impacts. asked is -1."""

    def segments(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        whole = _matrix(pdf["vector"].tolist())
        size = np.abs(whole)
        level = np.searchsorted(-np.array(FLOORS[:-1]), -(size / max(1, int(size.max(initial=1)))))
        level[size == 0] = -1
        out = []
        for at in range(len(FLOORS)):
            dimension, vector = np.nonzero((level == at).T)
            out.append((int(key[0]), -1, at, whole.shape[1], len(vector), pdf["vec_id"].to_numpy(dtype="<i8").tobytes() if at == 0 else b"", _small(dimension), _small(vector), _small(whole[vector, dimension])))
        return pd.DataFrame(out, columns=["block", "asked", "level", "width", "n", "ids", "dimensions", "vectors", "impacts"])

    return dealt(rows, block_size)[0].groupBy("block").applyInPandas(segments, SEGMENTS)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


class Block:
    """A block of the index: its segments by falling level."""

    def __init__(self, segments: list[tuple]):
        """segments: (width, number of postings, ids, dimensions, vectors, impacts) of each level."""
        self.width = segments[0][0]
        self.ids = np.frombuffer(segments[0][2], dtype="<i8")
        self.postings = []
        for _, n, _, *columns in segments:
            self.postings.append(tuple(_wide(c, n).astype(np.int64) for c in columns))
        self.whole = np.zeros((len(self.ids), self.width), dtype=np.int64)
        for dim, vec, impact in self.postings:
            self.whole[vec, dim] = impact

    def search(self, asked: np.ndarray, names: np.ndarray, k: int, few: int) -> list[tuple[int, int, int]]:
        """(query's row, vec_id, score) of the k best for each query."""
        ids, n, d = self.ids, len(self.ids), min(self.width, asked.shape[1])
        asked = asked[:, :d]
        sizes = np.sqrt((asked.astype(float) ** 2).sum(axis=1))
        exact = int(np.abs(asked).max(initial=0)) * int(np.abs(self.whole).max(initial=0)) * max(d, 1) < 2**24
        kind = np.float32 if exact else np.float64  # whole numbers below 2**24 and 2**53 are exact
        left = (self.whole[:, :d].astype(float) ** 2).sum(axis=1)
        open_ = np.arange(len(asked))
        scores = np.zeros((len(asked), n), dtype=kind)
        queries = np.ascontiguousarray(asked, dtype=kind)
        out = []
        for step, (dim, vec, impact) in enumerate(self.postings):
            keep = dim < d
            dim, vec, impact = dim[keep], vec[keep], impact[keep]
            part = np.zeros((d, n), dtype=kind)
            part[dim, vec] = impact
            scores[open_] += queries[open_] @ part
            left = np.maximum(left - np.bincount(vec, weights=impact.astype(float) ** 2, minlength=n), 0)
            more = np.sqrt(left)
            last = step == len(self.postings) - 1
            still = []
            for q in open_:
                slack = 0 if last else more * sizes[q] * (1 + 1e-9) + 1e-6
                own = ids == names[q]
                others = n - int(own.sum())
                if not others:
                    continue
                low = np.where(own, -np.inf, scores[q] - slack)
                edge = np.partition(low, n - min(k, others))[n - min(k, others)]
                members = np.flatnonzero((scores[q] + slack >= edge) & ~own)
                if last or len(members) <= few:
                    exactly = self.whole[members, :d] @ asked[q]
                    out.extend((int(q), int(ids[members[i]]), int(exactly[i])) for i in _best(ids[members], exactly, k))
                else:
                    still.append(q)
            open_ = np.array(still, dtype=np.int64)
            if not len(open_):
                break
        return out


def search(index: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 512, few: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries(uid, vec_id, vector): the k greatest inner products over the indexed rows, itself left out."""
    asked, _ = dealt(queries, query_block)

    def gather(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        whole = _matrix(pdf["vector"].tolist())
        names = pdf["vec_id"].to_numpy(dtype="<i8").tobytes()
        return pd.DataFrame([(int(key[0]), 0, whole.shape[1], whole.size, names, b"", b"", _small(whole))], columns=["asked", "level", "width", "n", "ids", "dimensions", "vectors", "impacts"])

    packs = asked.groupBy("block").applyInPandas(gather, SEGMENTS.removeprefix("block int, "))
    last = index.agg(F.coalesce(F.max("block"), F.lit(0)).alias("n")).first()["n"]
    sent = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segments, block = None, [], None
        for batch in batches:
            for number, pack, _, width, n, ids, *columns in zip(*(c.to_pylist() for c in batch.columns[:5]), *(binaries(c) for c in batch.columns[5:])):
                if pack < 0:
                    if number != at:
                        at, segments, block = number, [], None
                    segments.append((width, n, bytes(ids), *map(bytes, columns)))
                    continue
                if number != at:  # a block without vectors
                    continue
                block = block or Block(segments)
                own = np.frombuffer(ids, dtype="<i8")
                matrix = _wide(bytes(columns[2]), n).reshape(len(own), width).astype(np.int64)
                found = block.search(matrix, own, k, few)
                q = np.array([f[0] for f in found], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(q + (pack << 32)), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], names=["query_id", "_row", "vec_id", "score"])

    met = index.unionByName(sent).repartition("block").sortWithinPartitions("block", "asked", "level")
    found = met.mapInArrow(run, "query_id long, _row long, vec_id long, score long")
    order = Window.partitionBy("_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(rows: DataFrame, every: int = 50, k: int = 5, block_size: int = 8192) -> DataFrame:
    """The k best of all rows for each row whose vec_id is divisible by `every`."""
    ints = kept(integers(rows), "integers")
    index = kept(build(ints, block_size), "index")
    return search(index, ints.where(F.col("vec_id") % every == 0), k)
