"""A bigram language model whose counts live in a log-frequency Bloom filter.

Counting: tasks count the words and word pairs of their training texts and send
them, packed by hash range, to one place for each range; there the counts meet
and the range's segment of the filter is built.  A count c falls on level
1 + floor(log_base c); the filter holds (n-gram, j) for every j up to its level.
A reader probes j = 1, 2, ... until a miss and takes the mean count of the last
level, so that all counts of an order still sum to what was counted.

Size: `bits_each` bits for each entry (n-gram and level), whatever the corpus.
A corpus whose filter takes at most `most_bits` (64 MB), as its bytes alone show,
is counted first and the filter broadcast.  With more, blocks of texts send their
distinct words and pairs once: the task of a hash range counts them, builds the
range's segment, probes it for all who sent, and levels and exact counts come
back to the blocks (`routed`).  Scores are the same.

Probability: P(w|h) = a c(hw)/c(h) + (1 - a) P(w), P(w) = (c(w) + 0.1)/(N + 0.1 (V + 1)),
with all c from the filter; a text's first word follows an end.  The weight a is
a parameter; its default was not tuned on held-out texts.

The base score needs exact counts of words.  Up to `most_words` of them are
broadcast (16 bytes each); with more, texts' words travel to the counts' ranges
and partial sums come back.

Cases: a null or empty text is one end; a null doc_id counts as held out; with
no training text N = V = 0; repeated rows count and are scored each for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept, pick
from .text import Chunk, U64, avalanche, begin, binaries, chunks, sliced

END = U64(0x656E64206F662074)
PROBES = 4
FLUSH = 1_500_000
#: Bits that positions() can address in a segment.
ADDRESSED = 1 << 32
#: Bytes of text in a block that sends its n-grams together, and of text whose n-grams a hash range gets.
BLOCK_BYTES, RANGE_BYTES = 4 << 20, 8 << 20


def token_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an END after each document, and the documents' offsets."""
    starts, ends, of = chunk.words()
    words = chunk.hashes(starts, ends, lower=True) if len(starts) else np.zeros(0, dtype=U64)
    return np.insert(words, of[1:], END), of + np.arange(len(of))


def pair_hashes(tokens: np.ndarray, of: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[of[:-1]] = END
    return avalanche(before * U64(0x9E6C63D0876A9A47) + tokens * U64(0xC2B2AE3D27D4EB4F) + U64(1))


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(base) + 1e-9).astype(np.int64)


def positions(keys: np.ndarray, level: int, size: np.ndarray | int) -> Iterator[np.ndarray]:
    """The entry's bits within its segment of `size` bits, probe by probe."""
    h = avalanche(keys ^ U64(level * 0xD1342543DE82EF95 % 2**64))
    low, high, size = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1), np.asarray(size).astype(U64)
    for i in range(PROBES):
        yield (((low + U64(i) * high) & U64(0xFFFFFFFF)) * size) >> U64(32)


def segment(parts: list[tuple[np.ndarray, np.ndarray]], base: float, bits_each: float, most: int) -> np.ndarray:
    """Packed bits for (keys, counts) pairs, bits_each for each entry; never fewer: more than `most` bits cannot be addressed."""
    marked = [(keys, levels(counts, base)) for keys, counts in parts]
    size = int(max(64, bits_each * sum(int(q.sum()) for _, q in marked)))
    if size > most:
        raise ValueError(f"a segment of {size} bits is beyond {most}: hash ranges must be smaller")
    bits = np.zeros(size, dtype=bool)
    for keys, q in marked:
        for j in range(1, int(q.max(initial=0)) + 1):
            for p in positions(keys[q >= j], j, size):
                bits[p.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little"), size


def spread(parts: list[tuple[np.ndarray, np.ndarray]], base: float) -> list[list[float]]:
    """For each order, of each level the number of n-grams and the sum of their counts."""
    out = []
    for _, counts in parts:
        q = levels(counts, base)
        out += [np.bincount(q).astype(float).tolist(), np.bincount(q, weights=counts).tolist()]
    return out


def narrow(values: np.ndarray) -> bytes:
    """Numbers of 64 bits in as many bytes each as the greatest needs; the first byte tells how many."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widened(raw: memoryview | bytes) -> np.ndarray:
    width = raw[0]
    full = np.zeros(((len(raw) - 1) // width, 8), dtype=np.uint8)
    full[:, :width] = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, width)
    return full.view("<u8").reshape(-1)


@dataclass
class Counts:
    """What scoring needs: the filter's segments, the level means of both orders, N, V and, within the bound, exact counts of words."""

    shift: int
    bits: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    means: list[np.ndarray]
    total: int
    distinct: int
    words: tuple[np.ndarray, np.ndarray] | None
    weight: float

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        part = (keys >> U64(self.shift)).astype(np.int64)
        begin, yes = self.begin[part], np.ones(len(keys), dtype=bool)
        for p in positions(keys, level, self.size[part]):
            at = begin + p.astype(np.int64)
            yes &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return yes

    def probe(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Quantised counts by repeated membership probes."""
        return self.means[order - 1][self.level(keys, order)]

    def level(self, keys: np.ndarray, order: int) -> np.ndarray:
        return self.run(keys, len(self.means[order - 1]) - 1)

    def run(self, keys: np.ndarray, most: int = 255) -> np.ndarray:
        """How many levels from 1 on the filter has of each key."""
        found, alive = np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys))
        for j in range(1, most + 1):
            alive = alive[self.has(keys[alive], j)]
            if not len(alive):
                break
            found[alive] = j
        return found

    def floor(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def score(self, tokens: np.ndarray, of: np.ndarray, own: np.ndarray, back: np.ndarray) -> np.ndarray:
        """log10 probability of each document; tokens = own[back]."""
        return self.interpolated(of, self.probe(own, 1)[back], self.probe(pair_hashes(tokens, of), 2), self.probe(np.array([END]), 1)[0])

    def interpolated(self, of: np.ndarray, single: np.ndarray, pair: np.ndarray, end: float) -> np.ndarray:
        before = np.empty_like(single)
        before[1:] = single[:-1]
        before[of[:-1]] = end
        pair = np.minimum(pair, before)
        a = np.where(before > 0, self.weight, 0.0)
        p = a * pair / np.maximum(before, 1) + (1 - a) * (single + 0.1) / self.floor()
        return np.add.reduceat(np.log10(p), of[:-1])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / self.floor())


PACKED = "range int, keys1 binary, counts1 binary, keys2 binary, counts2 binary"
RANGES = "range int, keys1 binary, counts1 binary, bits binary, size long, means array<array<double>>, total long, distinct long"


def held_out(folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def count(docs: DataFrame, base: float = 1.5, bits_each: float = 8.0, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each hash range: exact word counts, the filter's segment, and for each order and level the number of n-grams and their sum."""
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(4, math.ceil(math.log2(max(1, text_bytes / range_bytes))))
    shift = 64 - bits

    def map_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> pa.RecordBatch:
            cuts, columns = None, [pa.array(np.arange(1 << bits, dtype=np.int32))]
            for own in held:
                keys, counts = counted(np.concatenate(own))
                cuts = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(shift)).tolist() + [len(keys)]
                counts = counts.astype("<u4")  # of FLUSH tokens and a chunk
                columns += [pa.array([a[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()) for a in (keys, counts)]
                own.clear()
            return pa.RecordBatch.from_arrays(columns, names=["range", "keys1", "counts1", "keys2", "counts2"])

        n = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                tokens, of = token_hashes(chunk)
                held[0].append(tokens)
                held[1].append(pair_hashes(tokens, of))
                n += len(tokens)
                if n >= FLUSH:
                    yield from sliced(flush())
                    n = 0
        if n:
            yield from sliced(flush())

    def reduce_side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: int, held: list[list]) -> pa.RecordBatch:
            parts = [counted(np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own]).astype(np.int64)) for own in held]
            packed, size = segment(parts, base, bits_each, ADDRESSED)
            means = spread(parts, base)
            (keys, counts), _ = parts
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([keys.tobytes()]), pa.array([counts.astype("<u8").tobytes()]), pa.array([packed.tobytes()]), pa.array([size], pa.int64()), pa.array([means], pa.list_(pa.list_(pa.float64()))), pa.array([int(counts.sum())], pa.int64()), pa.array([len(keys)], pa.int64())],
                names=["range", "keys1", "counts1", "bits", "size", "means", "total", "distinct"],
            )

        at, held = None, [[], []]
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != at:
                    if at is not None:
                        yield close(at, held)
                    at, held = row["range"], [[], []]
                for k, own in enumerate(held, 1):
                    own.append((np.frombuffer(row[f"keys{k}"], dtype="<u8"), np.frombuffer(row[f"counts{k}"], dtype="<u4")))
        if at is not None:
            yield close(at, held)

    packed = docs.select("text").mapInArrow(map_side, PACKED)
    return kept(packed.repartition("range").sortWithinPartitions("range").mapInArrow(reduce_side, RANGES), "lm-counts")


def model(ranges: DataFrame, weight: float, most_words: int, whole_filter: bool) -> Counts:
    """Gathers the bounded parts: the level means, the segments if whole_filter (else bits is None), and with them, if they are at most most_words, the exact word counts."""
    size = ranges.agg(F.sum("distinct").alias("v"), F.sum("total").alias("n")).first()
    total, distinct = int(size["n"] or 0), int(size["v"] or 0)
    exact = whole_filter and distinct <= most_words
    wanted = ["range", "size", "means", *(["bits"] if whole_filter else []), *(["keys1", "counts1"] if exact else [])]
    rows = sorted(ranges.select(*wanted).toLocalIterator(), key=lambda r: r["range"])
    n = 1 << max(4, (max((r["range"] for r in rows), default=0)).bit_length())
    begin, bits = np.zeros(n, dtype=np.int64), np.ones(n, dtype=np.int64)
    at, packed = 0, []
    sums = [np.zeros((2, 80)), np.zeros((2, 80))]
    for r in rows:
        begin[r["range"]], bits[r["range"]] = at * 8, r["size"]
        if whole_filter:
            packed.append(np.frombuffer(r["bits"], dtype=np.uint8))
            at += len(packed[-1])
        for k in range(2):
            for i in range(2):
                own = r["means"][2 * k + i]
                sums[k][i, : len(own)] += own
    means = []
    for many, whole in sums:
        top = int(np.flatnonzero(many)[-1]) if many.any() else 0
        filled = np.divide(whole[: top + 1], many[: top + 1], out=np.zeros(top + 1), where=many[: top + 1] > 0)
        means.append(np.maximum.accumulate(filled))
    words = None
    if exact:
        words = (np.concatenate([np.frombuffer(r["keys1"], dtype="<u8") for r in rows] or [np.zeros(0, dtype=U64)]), np.concatenate([np.frombuffer(r["counts1"], dtype="<u8") for r in rows] or [np.zeros(0, dtype=np.uint64)]))
    return Counts(64 - (n.bit_length() - 1), np.concatenate([*packed, np.zeros(1, dtype=np.uint8)]) if whole_filter else None, begin, bits, means, total, distinct, words, weight)


def _exact(own: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(own))
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return np.where(keys[at] == own, counts[at], 0).astype(float)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, folds: int = 10, weight: float = 0.2, most_words: int = 6_000_000, most_bits: int = 1 << 29, bits_each: float = 8.0) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; learns from those that are not held out."""
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", held_out(folds).alias("held_out"))
    # n bytes hold n / 2 words and the texts' ends at most, as many pairs, and a level is never above its count.
    size = rows.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("docs")).first()
    if bits_each * ((size["n"] or 0) + 3 * size["docs"]) > most_bits:
        return routed(rows, size["n"] or 0, weight, bits_each)
    ranges = count(rows.where(~F.col("held_out")), bits_each=bits_each)
    fitted = model(ranges, weight, most_words, True)
    sent = spark.sparkContext.broadcast(fitted)
    total, distinct = fitted.total, fitted.distinct
    shift, floor, exact = fitted.shift, fitted.floor(), fitted.words is not None
    del fitted

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = sent.value
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                tokens, of = token_hashes(chunk)
                own, back = np.unique(tokens, return_inverse=True)
                n = np.diff(of)
                if exact:
                    c = _exact(own, *lm.words)
                    base = np.add.reduceat(lm.base(c)[back], of[:-1])
                    known = np.add.reduceat((c > 0).astype(np.int64)[back], of[:-1])
                else:
                    base, known = np.zeros(len(chunk)), np.zeros(len(chunk), dtype=np.int64)
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(known), pa.array(base), pa.array(lm.score(tokens, of, own, back))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    if exact:
        out = kept(rows.select("doc_id", "text", "held_out").mapInArrow(scores, SCORES), "lm-scores")
        sent.destroy()
        return out.withColumn("train_tokens", F.lit(total).cast("long"))

    # More words than may be broadcast: each text's words go to their ranges, sums come back.
    rows = kept(rows.withColumn("uid", F.monotonically_increasing_id()), "lm-texts")
    scored = kept(rows.select("doc_id", "text", "held_out", "uid").mapInArrow(_with_uid(scores), SCORES + ", uid long"), "lm-scores")
    sent.destroy()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                tokens, of = token_hashes(chunk)
                doc = np.repeat(np.arange(len(chunk)), np.diff(of))
                order = np.argsort(tokens, kind="stable")
                tokens, doc = tokens[order], doc[order]
                part = (tokens >> U64(shift)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))).tolist()
                uid = batch.column(0).to_numpy(zero_copy_only=False)[chunk.first : chunk.first + len(chunk)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([tokens[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([uid[doc[a:b]].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([1] * (len(cuts) - 1), pa.int32())],
                    names=["range", "keys", "with", "asked"],
                )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table = None, (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.uint64))
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.frombuffer(row["keys"], dtype="<u8")
                if not row["asked"]:
                    at, table = row["range"], (keys, np.frombuffer(row["with"], dtype="<u8"))
                    continue
                c = _exact(keys, *(table if at == row["range"] else (keys[:0], keys[:0])))
                uid, back = np.unique(np.frombuffer(row["with"], dtype="<i8"), return_inverse=True)
                base = np.bincount(back, weights=np.log10((c + 0.1) / floor))
                yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(base), pa.array(np.bincount(back, weights=c > 0).astype(np.int64))], names=["_uid", "base", "known"])

    held = ranges.select("range", F.col("keys1").alias("keys"), F.col("counts1").alias("with"), F.lit(0).alias("asked"))
    asked = rows.select("uid", "text").mapInArrow(ask, "range int, keys binary, with binary, asked int")
    sums = held.union(asked).repartition("range").sortWithinPartitions("range", "asked").mapInArrow(answer, "_uid long, base double, known long")
    sums = sums.groupBy("_uid").agg(F.sum("base").alias("base"), F.sum("known").alias("known"))
    out = scored.join(sums, F.col("uid") == F.col("_uid"))
    return out.select("doc_id", "held_out", "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def _with_uid(function):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for out in function(iter([batch])):
                yield out.append_column("uid", batch.column(3).slice(at, out.num_rows))
                at += out.num_rows

    return run


BLOCKS = "block long, range int, doc_id array<long>, held_out array<boolean>, ends array<long>, text binary, levels1 binary, counts1 binary, levels2 binary"
ASKED = "range int, block long, keys1 binary, counts1 binary, keys2 binary, counts2 binary"
ANSWERS = "block long, range int, levels1 binary, counts1 binary, levels2 binary, size long, means array<array<double>>, total long, distinct long"


def routed(rows: DataFrame, text_bytes: int, weight: float, bits_each: float, base: float = 1.5, block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """score() with a filter larger than may be broadcast; rows(doc_id, text, held_out).

    Texts are held in blocks, compressed.  A block sends each hash range once its
    distinct words and pairs, sorted, as differences, with their counts in the
    block's training texts (0: only asked for).  The range's task adds the counts
    up, builds the segment and answers a level for each n-gram and the words'
    exact counts, in the order sent.  Hash ranges in rising order are the sorted
    keys again.  A row of no block has the range's level means.
    """
    shift = 64 - max(4, math.ceil(math.log2(max(1, text_bytes / range_bytes))))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        begin()
        name, held, size = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            doc_ids, texts, outs = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in range(3))
            (chunk,) = chunks(texts, 1 << 60)
            raw = zstandard.ZstdCompressor(level=1).compress(chunk.data.tobytes())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(chunk)], pa.int32()), own) for own in (doc_ids, outs, pa.array(chunk.offsets[1:], pa.int64()))]
            none = pa.array([None], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-1], pa.int32()), *lists, pa.array([raw], pa.binary()), none, none, none], names=["block", "range", "doc_id", "held_out", "ends", "text", "levels1", "counts1", "levels2"])

        for batch in batches:
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= block_bytes:
                yield flush()
                name, held, size = name + 1, [], 0
        if sum(b.num_rows for b in held):
            yield flush()

    def grams(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of a block's tokens and pairs, and the documents' offsets."""
        import zstandard

        offsets = np.concatenate(([0], ends)).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(zstandard.ZstdDecompressor().decompress(raw))])
        tokens, lengths = zip(*((own, np.diff(of)) for own, of in map(token_hashes, chunks(texts))))
        tokens, of = np.concatenate(tokens), np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return tokens, pair_hashes(tokens, of), of

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        edges = np.arange(1 << (64 - shift), dtype=U64) << U64(shift)
        for batch in batches:
            for i, name in enumerate(batch.column(0).to_pylist()):
                tokens, pairs, of = grams(batch.column(3)[i].as_py(), batch.column(2)[i].values.to_numpy())
                learnt = np.repeat(~batch.column(1)[i].values.to_numpy(zero_copy_only=False), np.diff(of)).astype(np.int64)
                columns = []
                for values in (tokens, pairs):
                    keys, counts = counted(values, learnt)
                    cuts = [*np.searchsorted(keys, edges).tolist(), len(keys)]
                    columns.append([narrow(np.diff(keys[a:b], prepend=e)) for a, b, e in zip(cuts, cuts[1:], edges)])
                    columns.append([narrow(counts[a:b]) for a, b in zip(cuts, cuts[1:])])
                n = len(edges)
                yield from sliced(pa.RecordBatch.from_arrays([pa.array(np.arange(n), pa.int32()), pa.array([name] * n, pa.int64()), *(pa.array(own, pa.binary()) for own in columns)], names=["range", "block", "keys1", "counts1", "keys2", "counts2"]))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        begin()

        def close(at: int, blocks: list[int], held: list[list]) -> Iterator[pa.RecordBatch]:
            sent, parts = [], []
            for own in held:
                lengths = [len(k) for k, _ in own]
                keys, back = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                counts = np.bincount(back, weights=np.concatenate([c for _, c in own]), minlength=len(keys)).astype(np.int64)
                own.clear()
                sent.append((keys, back, counts, np.concatenate(([0], np.cumsum(lengths)))))
                parts.append((keys[counts > 0], counts[counts > 0]))
            packed, size = segment(parts, base, bits_each, ADDRESSED)
            lm = Counts(63, packed, np.zeros(2, dtype=np.int64), np.full(2, size), [], 0, 0, None, weight)
            press = zstandard.ZstdCompressor(level=1).compress
            columns = []
            for keys, back, counts, cuts in sent:
                found = lm.run(keys)[back]
                columns.append([press(found[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])])
                columns.append([narrow(counts[back[a:b]]) for a, b in zip(cuts, cuts[1:])])
            columns = [pa.array([*own, None], pa.binary()) for own in columns[:3]]
            n, own = len(blocks), parts[0][1]
            last = lambda x, kind: pa.concat_arrays([pa.nulls(n, kind), pa.array([x], kind)])
            many = pa.list_(pa.list_(pa.float64()))
            yield from sliced(pa.RecordBatch.from_arrays([pa.array([*blocks, None], pa.int64()), pa.array([at] * (n + 1), pa.int32()), *columns, last(size, pa.int64()), last(spread(parts, base), many), last(int(own.sum()), pa.int64()), last(len(own), pa.int64())], names=["block", "range", "levels1", "counts1", "levels2", "size", "means", "total", "distinct"]))

        at, blocks, held = None, [], [[], []]
        for batch in batches:
            raws = [binaries(batch.column(i)) for i in range(2, 6)]
            for i, (part, name) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if part != at:
                    if blocks:
                        yield from close(at, blocks, held)
                    at, blocks, held = part, [], [[], []]
                blocks.append(name)
                for k, own in enumerate(held):
                    own.append(((U64(part) << U64(shift)) + np.cumsum(widened(raws[2 * k][i]), dtype=U64), widened(raws[2 * k + 1][i])))
        if blocks:
            yield from close(at, blocks, held)

    blocks = kept(rows.select("doc_id", "text", "held_out").mapInArrow(block, BLOCKS), "lm-blocks")
    asked = blocks.select("block", "held_out", "ends", "text").mapInArrow(ask, ASKED)
    answers = kept(asked.repartition("range").sortWithinPartitions("range").mapInArrow(answer, ANSWERS), "lm-answers")
    fitted = model(answers.where("block IS NULL"), weight, 0, False)
    means, total, distinct = fitted.means, fitted.total, fitted.distinct

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        begin()
        lm = Counts(63, None, None, None, means, total, distinct, None, weight)
        plain = zstandard.ZstdDecompressor().decompress

        def scores(docs: list, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            tokens, pairs, of = grams(docs[3], docs[2].to_numpy())
            level1, counts, level2 = (np.concatenate(own) for own in parts)
            own, back = np.unique(tokens, return_inverse=True)
            single, pair = (m[np.minimum(found, len(m) - 1)] for m, found in zip(means, (level1, level2)))
            pair = pair[np.unique(pairs, return_inverse=True)[1]]
            base = np.add.reduceat(lm.base(counts.astype(float))[back], of[:-1])
            known = np.add.reduceat((counts > 0).astype(np.int64)[back], of[:-1])
            score = lm.interpolated(of, single[back], pair, single[np.searchsorted(own, END)])
            return pa.RecordBatch.from_arrays([docs[0], docs[1], pa.array(np.diff(of)), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

        docs, parts = None, [[], [], []]
        for batch in batches:
            for i, part in enumerate(batch.column(1).to_pylist()):
                if part < 0:
                    if docs:
                        yield scores(docs, parts)
                    docs, parts = [*(batch.column(k)[i].values for k in (2, 3, 4)), batch.column(5)[i].as_py()], [[], [], []]
                else:
                    level1, counts, level2 = (batch.column(k)[i].as_py() for k in (6, 7, 8))
                    for own, found in zip(parts, (np.frombuffer(plain(level1), dtype=np.uint8), widened(counts), np.frombuffer(plain(level2), dtype=np.uint8))):
                        own.append(found)
        if docs:
            yield scores(docs, parts)

    none = F.lit(None)
    back = answers.where("block IS NOT NULL").select("block", "range", none.cast("array<long>").alias("doc_id"), none.cast("array<boolean>").alias("held_out"), none.cast("array<long>").alias("ends"), none.cast("binary").alias("text"), "levels1", "counts1", "levels2")
    out = blocks.union(back).repartition("block").sortWithinPartitions("block", "range").mapInArrow(close, SCORES)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
