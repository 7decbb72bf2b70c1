"""A factorisation machine over hashed words, structure statistics and metadata of a text.

Inputs: every word of the text, hashed into `buckets` features of weight
1/sqrt(words); the statistics of STATS, each in its own range of cells, both as
a cell and by the cell's place; the text's length.  Pairwise interactions have
low rank: sum over f of (sum v_if x_i)^2 - sum (v_if x_i)^2, halved, so that a
text is scored in time linear in its words.

Labels are learnt from at most `sample` rows (those of the smallest hash of
doc_id) and `sample_bytes` of their features, never from held-out ones.  The
model has a fixed size and is sent to the workers; every text is scored whole.

Cases: null and empty texts are scored by the cells of an empty text; null
labels and labels without a document are left out; with one class alone, or
none, the score is the share of label 1 (0.5 without labels); repeated rows are
scored each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import kept, pick, shielded
from .text import Chunk, U64, avalanche, begin, chunks, windows

#: Bytes that are counted apart.
MARKS = "|*&%$#!?.,;:-_=+<>{}[]()/\\@\"'"
STATS = 20
CELLS = 24


def _per(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return counts / np.maximum(whole, 1)


def statistics(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """STATS numbers from 0 to 1 for each document."""
    data, ofs = chunk.data, chunk.offsets
    n_bytes = np.diff(ofs)
    n_words = np.diff(of)

    def share(hit: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(hit)))
        return _per(total[at[1:]] - total[at[:-1]], whole)

    def kind(low: str, high: str) -> np.ndarray:
        return (data >= ord(low)) & (data <= ord(high))

    doc = np.repeat(np.arange(len(chunk)), n_words)

    def distinct(values: np.ndarray, owner: np.ndarray, whole: np.ndarray) -> np.ndarray:
        keys = np.unique((owner.astype(U64) << U64(40)) | (values >> U64(24)))
        return _per(np.bincount((keys >> U64(40)).astype(np.int64), minlength=len(chunk)), whole)

    marks = np.zeros(256, dtype=bool)
    marks[[ord(c) for c in MARKS]] = True
    first, last = data[starts] if len(starts) else data[:0], data[ends - 1] if len(ends) else data[:0]
    lengths = ends - starts
    pairs = windows(hashes, 2)
    own = doc[:-1] == doc[1:] if len(doc) else np.zeros(0, dtype=bool)
    breaks = np.flatnonzero(data == 10)
    line_at = np.unique(np.concatenate((ofs[:-1][n_bytes > 0], breaks + 1)))
    line_at = line_at[line_at < len(data)]
    line_doc = np.searchsorted(ofs, line_at, side="right") - 1
    line_end = np.append(line_at[1:], len(data))
    lines = np.bincount(line_doc, minlength=len(chunk))
    line_hash = chunk.hashes(line_at, line_end, lower=False, rough=True) if len(line_at) else hashes[:0]
    columns = [
        np.log2(n_words + 1) / 20,
        np.log2(n_bytes + 1) / 24,
        _per(n_bytes, n_words) / 24,
        share(kind("A", "Z"), ofs, n_bytes),
        share(kind("0", "9"), ofs, n_bytes),
        share(marks[data], ofs, n_bytes),
        share(data == ord("|"), ofs, n_words),
        share(np.isin(data, [ord(c) for c in "*&%$#"]), ofs, n_words),
        share(data == ord("!"), ofs, n_words),
        share(np.isin(data, [ord(c) for c in ".,"]), ofs, n_words),
        share(np.isin(data, [ord(c) for c in "<>{}=;"]), ofs, n_words),
        share(data >= 128, ofs, n_bytes),
        share((first >= 65) & (first <= 90), of, n_words),
        share(marks[last], of, n_words),
        share(lengths <= 2, of, n_words),
        share(lengths >= 12, of, n_words),
        distinct(hashes, doc, n_words),
        distinct(pairs[own], doc[:-1][own], n_words - 1),
        distinct(line_hash, line_doc, lines),
        _per(lines, n_words),
    ]
    return np.clip(np.nan_to_num(np.stack(columns, axis=1)), 0, 1).astype(np.float32)


@dataclass
class Features:
    """Of some documents: index and value of every feature, document by document."""

    index: np.ndarray
    value: np.ndarray
    offsets: np.ndarray


def features(chunk: Chunk, buckets: int) -> Features:
    starts, ends, of = chunk.words()
    hashes = chunk.hashes(starts, ends, lower=True) if len(starts) else np.zeros(0, dtype=U64)
    stats = statistics(chunk, starts, ends, of, hashes)
    n_words = np.diff(of)
    extra = 2 * STATS
    cell = np.minimum((np.sqrt(stats) * CELLS).astype(np.int64), CELLS - 1)
    base = buckets + np.arange(STATS) * CELLS
    index = np.empty(len(hashes) + extra * len(chunk), dtype=np.int64)
    value = np.empty(len(index), dtype=np.float32)
    offsets = of + np.arange(len(of)) * extra
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(chunk)) * extra, n_words)
    index[place] = (avalanche(hashes) % U64(buckets)).astype(np.int64)
    value[place] = np.repeat(1 / np.sqrt(np.maximum(n_words, 1)), n_words)
    rest = (offsets[1:] - extra)[:, None] + np.arange(STATS)
    index[rest], value[rest] = base + cell, 0.5
    index[rest + STATS], value[rest + STATS] = buckets + STATS * CELLS + np.arange(STATS), np.sqrt(stats)
    return Features(index, value, offsets)


def merged(f: Features) -> Features:
    """Equal words of a document as one entry of summed value, by rising index."""
    doc = np.repeat(np.arange(len(f.offsets) - 1), np.diff(f.offsets))
    size = int(f.index.max(initial=0)) + 1
    key, back = np.unique(doc * size + f.index, return_inverse=True)
    value = np.bincount(back, weights=f.value, minlength=len(key)).astype("<f4")
    return Features(key % size, value, np.searchsorted(key, np.arange(len(f.offsets)) * size))


@dataclass
class Model:
    buckets: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, f: Features) -> np.ndarray:
        x = f.value
        if not len(f.offsets) - 1:
            return np.zeros(0)
        pick = self.factors[f.index] * x[:, None]
        at = f.offsets[:-1]
        one = np.add.reduceat(pick, at, axis=0)
        two = np.add.reduceat((pick * pick).sum(axis=1), at)
        return self.bias + np.add.reduceat(self.linear[f.index] * x, at) + 0.5 * ((one * one).sum(axis=1) - two)

    def score(self, f: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(f), -30, 30)))


def fit(docs: list[Features], labels: np.ndarray, buckets: int, rank: int = 6, epochs: int = 6, rate: float = 0.08, decay: float = 1e-4, batch: int = 128, seed: int = 5) -> Model:
    """AdaGrad on the log loss, in batches, with both classes weighing the same up to a factor of four."""
    size, rng = buckets + STATS * CELLS + STATS, np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    model = Model(buckets, float(np.log(np.clip(share, 1e-3, 1 - 1e-3) / np.clip(1 - share, 1e-3, 1))), np.zeros(size, dtype=np.float32), (rng.standard_normal((size, rank)) * 0.05).astype(np.float32))
    if not len(labels) or not 0 < share < 1:
        model.factors[:] = 0
        return model
    seen_l, seen_f, seen_b = np.full(size, 1e-3, dtype=np.float32), np.full((size, rank), 1e-3, dtype=np.float32), 1e-3
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            index = np.concatenate([docs[i].index for i in own])
            x = np.concatenate([docs[i].value for i in own])
            counts = np.array([len(docs[i].index) for i in own])
            offsets = np.concatenate(([0], np.cumsum(counts)))
            f = Features(index, x, offsets)
            pick = model.factors[index] * x[:, None]
            one = np.add.reduceat(pick, offsets[:-1], axis=0)
            p = model.score(f)
            g = ((p - labels[own]) / len(own)).astype(np.float32)
            per = np.repeat(g, counts) * x
            grad_l = np.bincount(index, weights=per, minlength=size).astype(np.float32) + decay * model.linear
            seen_l += grad_l * grad_l
            model.linear -= rate * grad_l / np.sqrt(seen_l)
            inner = (np.repeat(one, counts, axis=0) - pick) * per[:, None]
            grad_f = np.stack([np.bincount(index, weights=inner[:, k], minlength=size) for k in range(rank)], axis=1).astype(np.float32) + decay * model.factors
            seen_f += grad_f * grad_f
            model.factors -= rate * grad_f / np.sqrt(seen_f)
            gb = float(g.sum())
            seen_b += gb * gb
            model.bias -= rate * gb / seen_b**0.5
    return model


def fold(folds: int):
    """The remainder of crc32(doc_id as text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 6000, buckets: int = 1 << 14, sample_bytes: int = 64 << 20) -> Model:
    """Learns labels.quality from at most `sample` labelled documents outside fold 0, whose features take at most sample_bytes (beyond them the last by hash are left out)."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    marked = marked.where(fold(folds) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("_quality", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            quality = batch.column(0).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                f = merged(features(chunk, buckets))
                for i in range(len(chunk)):
                    a, b = f.offsets[i], f.offsets[i + 1]
                    yield pa.RecordBatch.from_arrays([pa.array([float(quality[chunk.first + i])]), pa.array([f.index[a:b].astype("<i4").tobytes()]), pa.array([f.value[a:b].tobytes()])], names=["quality", "index", "value"])

    whole = kept(chosen.mapInArrow(rows, "quality double, index binary, value binary"), "quality-sample")
    order = [c.cast("long").alias(f"o{i}") for i, c in enumerate((F.crc32("index"), F.crc32("value"), F.octet_length("index")))]
    sizes = whole.select(*order).withColumn("through", 2 * F.sum("o2").over(Window.orderBy("o0", "o1", "o2")))  # at most `sample` rows
    most = sizes.where(F.col("through") > sample_bytes).agg(F.min(F.struct("o0", "o1", "o2")).alias("most")).first()["most"]
    if most is not None:
        whole = whole.where(F.struct(*order) < F.struct(*[F.lit(v).cast("long").alias(f"o{i}") for i, v in enumerate(most)]))
    got = whole.collect()  # at most `sample` rows of sample_bytes
    got.sort(key=lambda r: (zlib.crc32(r["index"]), zlib.crc32(r["value"]), r["quality"]))
    held = [Features(np.frombuffer(r["index"], dtype="<i4").astype(np.int64), np.frombuffer(r["value"], dtype="<f4"), np.array([0])) for r in got]
    return fit(held, np.array([r["quality"] for r in got], dtype=np.float64), buckets)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column _score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            parts = [sent.value.score(merged(features(chunk, sent.value.buckets))) for chunk in chunks(batch.column(batch.schema.get_field_index("text")))]
            yield batch.append_column("_score", pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64()))

    return docs.mapInArrow(rows, docs.select("*", F.lit(0.0).alias("_score")).schema)


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.3, sample: int = 6000) -> DataFrame:
    """docs with held_out, score and predicted (input columns of these names are replaced)."""
    model = train(pick(docs, "doc_id", "text"), pick(labels, "doc_id", "quality"), folds, sample)
    docs, restored = shielded(docs.drop("held_out", "score", "predicted"), "doc_id", "text")
    out = scored(docs, model).withColumn("held_out", fold(folds) == 0).withColumn("score", F.col("_score"))
    return restored(out.withColumn("predicted", (F.col("_score") >= threshold).cast("int")), "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier does not reject."""
    docs, restored = shielded(docs, "doc_id", "text")
    return restored(classify(docs, labels).where("predicted = 1"))
