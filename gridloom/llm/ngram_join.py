"""Parity-sketch join of documents by the Jaccard similarity of their word shingles.

Sets A and B of similarity p or more differ by at most (1-p)/(1+p) (|A|+|B|)
shingles.  A parity sketch XORs a hash of every shingle into the block that the
shingle falls in, so that a block of A equals that of B unless the sets differ
within it: the number of unlike blocks is at most the symmetric difference.
With more non-empty blocks than that bound, two similar sets share one.  Only
sets of like size meet: a size band [2^i, 2^(i+1)) has its own blocks, and sets
just above it join it too.  Of its blocks a set sends the bound plus one, those
of most shingles first (the order depends on a block's content alone, so that a
shared one is among them).  A set with too few non-empty blocks, which is rare,
sends all, and besides single shingles that reach every other such set.

Equal sets are one class, named by 128 bits.  In a bucket of equal blocks the
classes are compared with one of them, the one that stands in most buckets; what
a verified link has joined needs no more comparing.
Where a bucket still holds several components, its other pairs are screened by
fixed-size bit sketches, whose Hamming distance is at most the symmetric
difference, without leaving the bucket (sketches are folded to a like size there); those that pass are verified as well.
Every candidate is decided on its whole sets: a pivot's set is made once for
each SALT of its candidates and meets theirs there.  Hot buckets and pivots are
looked up by hot_join().  No bucket, candidate or partner is dropped.

Cases: null and empty texts have no shingles and link with nothing; a text of
fewer than k words is one shingle; rows without doc_id take no part in links
and get no component; repeated rows are equal sets; an empty table gives an
empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import components, hot_join, if_few, kept, pick, shielded
from .text import U64, avalanche, begin, binaries, chunks, fixed_binaries, shingle_sets, sliced

#: Bits of the sketches that travel with bucket rows.
SMALL_BITS = 2048
#: Classes of a bucket that are compared within one task; a larger bucket is cut into pairs of such parts.
PART = 1500
#: Candidates of a pivot that meet its set in one place.
SALT = 64


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    sums = np.array([avalanche(own + U64(0x5851F42D4C957F2D)).sum(dtype=U64), avalanche(own ^ U64(0x14057B7EF767814F)).sum(dtype=U64)])
    return avalanche(sums + np.array([len(own), ~len(own) % 2**64], dtype=U64)).tobytes()


def bound(a: int, b: int, percent: int) -> int:
    return (100 - percent) * (a + b) // (100 + percent)


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """The block signatures (uint64) that a set sends; own: sorted distinct hashes."""
    n = len(own)
    if not n:
        return own
    band = n.bit_length() - 1
    marks = avalanche(own ^ U64(0x2545F4914F6CDD1D))
    out = []
    for key in (band, band - 1):
        if key == band:
            most = bound(n, 100 * n // percent, percent)
        elif key >= 0 and percent * n < 100 << band:
            most = bound(n, (1 << band) - 1, percent)
        else:
            continue
        blocks = max(1, math.ceil(0.8 * (1 << key)))
        at = ((own >> U64(32)) * U64(blocks)) >> U64(32)  # rises with own
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        counts = np.diff(np.append(first, n))
        sign = avalanche(np.bitwise_xor.reduceat(marks, first) + at[first] * U64(0x9E3779B97F4A7C15) + U64(key + 1))
        if len(first) > most:
            rank = (U64(255) - np.minimum(counts, 255).astype(U64)) << U64(56) | sign >> U64(8)
            out.append(sign[np.argpartition(rank, most)[: most + 1]] if len(first) > most + 1 else sign)
        else:
            alone = avalanche(own + U64(0xA0761D6478BD642F * (key + 3) % 2**64))
            out += [sign, np.partition(alone, most)[: most + 1]]
    return np.concatenate(out)


def bit_sketch(own: np.ndarray) -> np.ndarray:
    """The whole set's parity sketch (uint64 words), four to eight bits for each shingle."""
    bits = max(256, 1 << (2 + (len(own) - 1).bit_length())) if len(own) else 256
    odd = np.bincount((avalanche(own ^ U64(0xE7037ED1A0B428DB)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same set with fewer bits."""
    return sketch if len(sketch) <= words else np.bitwise_xor.reduce(sketch.reshape(-1, words), axis=0)


def _classes(docs: DataFrame, k: int) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                got = []
                for _, own in shingle_sets(chunk, k):
                    sketch = bit_sketch(own)
                    got.append((len(own), fingerprint(own), sketch.tobytes(), folded(sketch, SMALL_BITS // 64).tobytes()))
                columns = [pa.array(c, t) for c, t in zip(zip(*got), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), *columns], names=["doc_id", "n_shingles", "set", "sketch", "small"])

    return docs.mapInArrow(rows, "doc_id long, n_shingles long, set binary, sketch binary, small binary")


def _buckets(docs: DataFrame, k: int, percent: int, range_bytes: int, flush: int = 300_000) -> DataFrame:
    """(bucket, set) for all sets of each bucket with several."""
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(4, math.ceil(math.log2(max(1, text_bytes / range_bytes))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        signs: list[np.ndarray] = []
        sets: list[np.ndarray] = []
        seen: set[bytes] = set()
        n = 0

        def out() -> pa.RecordBatch:
            every, owner = np.concatenate(signs), np.concatenate(sets)
            order = np.argsort(every)
            every, owner = every[order], owner[order]
            cuts = [*np.searchsorted(every, np.arange(1 << bits, dtype=U64) << U64(64 - bits)).tolist(), len(every)]
            short = ((every >> U64(32 - bits)) & U64(0xFFFFFFFF)).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array(np.arange(1 << bits, dtype=np.int32)), pa.array([short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([owner[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())],
                names=["range", "signs", "sets"],
            )

        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for _, own in shingle_sets(chunk, k):
                    name = fingerprint(own)
                    if not len(own) or name in seen:
                        continue
                    seen.add(name)
                    signs.append(signatures(own, percent))
                    sets.append(np.tile(np.frombuffer(name, dtype="<u8"), (len(signs[-1]), 1)))
                    n += len(signs[-1])
                if n >= flush:
                    yield from sliced(out())
                    signs, sets, seen, n = [], [], set(), 0
        if n:
            yield from sliced(out())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: int, held: list) -> pa.RecordBatch:
            signs = np.concatenate([np.frombuffer(s, dtype="<u4") for s, _ in held])
            sets = np.concatenate([np.frombuffer(s, dtype="<u8").reshape(-1, 2) for _, s in held])
            order = np.argsort(signs, kind="stable")
            signs, sets = signs[order], sets[order]
            first = np.ones(len(signs), dtype=bool)
            first[1:] = signs[1:] != signs[:-1]
            alone = first & np.append(first[1:], True)[: len(first)]
            signs, sets = signs[~alone], sets[~alone]
            order = np.lexsort((sets[:, 1], sets[:, 0], signs))
            signs, sets = signs[order], sets[order]
            if len(signs):
                new = np.concatenate(([True], (signs[1:] != signs[:-1]) | (sets[1:] != sets[:-1]).any(axis=1)))
                signs, sets = signs[new], sets[new]
                like = signs[1:] == signs[:-1]
                several = np.append(like, False) | np.concatenate(([False], like))
                signs, sets = signs[several], sets[several]
            return pa.RecordBatch.from_arrays([pa.array((at << 32) + signs.astype(np.int64)), fixed_binaries(sets)], names=["bucket", "set"])

        at, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != at:
                    if at is not None:
                        yield close(at, held)
                    at, held = row["range"], []
                held.append((row["signs"], row["sets"]))
        if at is not None:
            yield close(at, held)

    packed = docs.select("text").mapInArrow(send, "range int, signs binary, sets binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInArrow(meet, "bucket long, set binary")


def _stars(rows: DataFrame) -> DataFrame:
    """(bucket, pivot, member) from rows(bucket, set); pivot: the set that stands in most buckets, which in a family of near copies is the most central one."""
    count = rows.groupBy(F.col("set").alias("_set")).agg(F.count("*").alias("_n"))
    rows = kept(rows.join(count, F.col("set") == F.col("_set")).select("bucket", "set", "_n"), "bucket-rows")
    top = rows.groupBy(F.col("bucket").alias("_bucket")).agg(F.max(F.struct("_n", "set")).alias("top"), F.count("*").alias("_rows"))
    met = hot_join(rows, top, "bucket", "_bucket", "_rows", rows.count()).where(F.col("set") != F.col("top.set"))
    return met.select("bucket", F.col("top.set").alias("pivot"), F.col("set").alias("member"))


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) of documents, one of each set, for the pairs(a, b) of sets of similarity percent or more: sketches first, then whole sets.

    sketches: (set, doc_id, n, sketch, ...).  The sets of the pairs left are made
    anew where their texts are read: b's once for each pair, a's once for each
    salt of its pairs, and meet under (a, salt).
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for na, nb, x, y in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), binaries(batch.column(3)), binaries(batch.column(5))):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                words = min(len(x), len(y))
                apart = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                good.append(apart <= bound(na, nb, percent) and 100 * min(na, nb) >= percent * max(na, nb))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1, 6, 7, 8)], names=["a", "b", "da", "db", "salt"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(5).to_pylist()
            for chunk in chunks(batch.column(0)):
                got = [(row, own.astype("<u8").tobytes()) for row, own in shingle_sets(chunk, k) if fingerprint(own) == names[row]]
                if got:
                    rows = pa.array([g[0] for g in got])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(1, 5)), pa.array([g[1] for g in got], pa.binary())], names=["a", "salt", "side", "doc", "shingles"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, doc, pivot = None, None, None
        for batch in batches:
            out = []
            for a, salt, side, own, shingles in zip(*(batch.column(i).to_pylist() for i in range(4)), binaries(batch.column(4))):
                shingles = np.frombuffer(shingles, dtype="<u8")
                if side == 0:
                    at, doc, pivot = (a, salt), own, shingles.copy()
                elif at == (a, salt):
                    where = np.minimum(np.searchsorted(pivot, shingles), len(pivot) - 1)
                    shared = int((pivot[where] == shingles).sum())
                    if 100 * shared >= percent * (len(pivot) + len(shingles) - shared):
                        out.append((doc, own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    pairs = kept(pairs, "pairs")
    total = pairs.count()
    side = lambda s: sketches.select(F.col("set").alias(f"_{s}"), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"), F.col("doc_id").alias(f"d{s}"))
    many = lambda s: pairs.groupBy(F.col(s).alias(f"_of_{s}")).agg(F.count("*").alias(f"_n{s}"))
    drawn = {s: kept(side(s).join(many(s), F.col(f"_{s}") == F.col(f"_of_{s}")), "drawn") for s in "ab"}
    close = hot_join(hot_join(pairs, drawn["a"], "a", "_a", "_na", total, None), drawn["b"], "b", "_b", "_nb", total, None)
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("_na") / SALT)).cast("int").alias("salt")
    close = close.select("a", "b", "na", "sa", "nb", "sb", "da", "db", salt).mapInArrow(near, "a binary, b binary, da long, db long, salt int")
    close = kept(close, "near-pairs")
    pivots = close.select("a", "salt", F.lit(0).alias("side"), F.col("da").alias("doc"), F.col("a").alias("name")).distinct()
    asked = kept(pivots.union(close.select("a", "salt", F.lit(1), "db", "b")), "asked")
    texts = docs.join(if_few(asked), F.col("doc_id") == F.col("doc")).select("text", "a", "salt", "side", "doc", "name")
    met = texts.mapInArrow(again, "a binary, salt int, side int, doc long, shingles binary").repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return kept(met.mapInArrow(exact, "a long, b long"), "links")


def _rest(stars: DataFrame, of: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket but of different components whose sketches allow a link; of: (set, component)."""
    own = of.select(F.col("set").alias("member"), F.col("component").alias("of_member"))
    placed = stars.join(own, "member")
    mixed = placed.groupBy(F.col("bucket").alias("_bucket")).agg(F.min("of_member").alias("low"), F.max("of_member").alias("high"), F.count("*").alias("size")).where("low <> high")
    rows = hot_join(placed, mixed, "bucket", "_bucket", "size", stars.count()).select("bucket", F.col("member").alias("set"), F.col("of_member").alias("component"), "size")
    rows = rows.join(sketches.select("set", "n", "small"), "set")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("set"), parts).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("bucket", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "set", "part", "component", "n", "small")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: tuple, held: list) -> set[tuple[bytes, bytes]]:
            part, of, n = (np.array([r[i] for r in held], dtype=np.int64) for i in (1, 2, 3))
            sketches = [np.frombuffer(r[4], dtype=np.uint64) for r in held]
            words = min(len(x) for x in sketches)
            bits = np.stack([folded(x, words) for x in sketches])
            found = set()
            for i in range(len(held)):
                js = np.arange(i + 1, len(held))
                js = js[of[js] != of[i]]
                if at[1] != at[2]:
                    js = js[part[js] != part[i]]
                js = js[100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i])]
                if len(js):
                    js = js[np.bitwise_count(bits[js] ^ bits[i]).sum(axis=1) * (100 + percent) <= (100 - percent) * (n[js] + n[i])]
                    found.update((held[i][0], held[j][0]) for j in js.tolist())  # in the order of their names
            return found

        def rows_of(found: set[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*sorted(found))], names=["a", "b"])

        at, held = None, []
        for batch in batches:
            found = set()
            for b, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (b, p, q) != at:
                    if len(held) > 1:
                        found |= close(at, held)
                    at, held = (b, p, q), []
                held.append(row)
            if found:
                yield rows_of(found)
        if len(held) > 1 and (found := close(at, held)):
            yield rows_of(found)

    return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q", "set").mapInArrow(compare, "a binary, b binary").distinct()


def join(docs: DataFrame, k: int = 5, percent: int = 75, range_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; component_id: the smallest doc_id that its links reach."""
    docs = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    rows = kept(_classes(docs, k), "shingle-counts")
    classes = kept(rows.where("n_shingles > 0 and doc_id is not null").groupBy("set").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.count("*").alias("_rows")), "classes")
    named = docs.where("doc_id is not null")
    stars = kept(_stars(kept(_buckets(named, k, percent, range_bytes), "buckets")), "stars")
    used = stars.select(F.col("pivot").alias("_s")).union(stars.select("member")).distinct()
    wanted = classes.join(used, F.col("set") == F.col("_s"), "left_semi")
    drawn = rows.select(F.col("set").alias("_set"), F.col("doc_id").alias("_id"), "sketch", "small")
    sketches = kept(wanted.join(drawn, (F.col("set") == F.col("_set")) & (F.col("doc_id") == F.col("_id"))).select("set", "doc_id", "n", "sketch", "small").dropDuplicates(["set"]), "sketches")

    links = _verified(stars.select(F.col("pivot").alias("a"), F.col("member").alias("b")).distinct(), sketches, named, k, percent)
    final = kept(components(links), "components")
    of = sketches.join(final, F.col("doc_id") == F.col("id"), "left").select("set", F.coalesce("component", "doc_id").alias("component"))
    rest = kept(_rest(stars, kept(of, "components"), sketches, percent), "rest-pairs")
    if rest.limit(1).count():
        more = _verified(rest, sketches, named, k, percent)
        final = kept(components(final.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "components")
    tops = kept(classes.join(final, F.col("doc_id") == F.col("id"), "left").select(F.col("set").alias("_set"), F.coalesce("component", "doc_id").alias("component_id"), "_rows"), "class-tops")
    linked = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    found = hot_join(rows.where(linked).select("doc_id", "n_shingles", "set"), tops, "set", "_set", "_rows", rows.count())
    return found.select("doc_id", "n_shingles", "component_id").union(rows.where(~linked).select("doc_id", "n_shingles", "doc_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """docs without the documents of a component but its smallest doc_id; of rows that share that doc_id one stays. Rows without doc_id stay."""
    found = join(docs, k, percent)
    gone = kept(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    docs, restored = shielded(docs, "doc_id")
    left = docs.join(if_few(gone), F.col("doc_id") == F.col("_gone"), "left_anti")
    twice = kept(left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")), "twice")
    if not twice.limit(1).count():
        return restored(left)
    same = F.col("doc_id") == F.col("_twice")
    return restored(left.join(if_few(twice), same, "left_anti").union(left.join(if_few(twice), same, "left_semi").dropDuplicates(["doc_id"])))
