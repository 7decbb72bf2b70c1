"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations.

Each of `tables` tables rotates a unit vector twice, three rounds of random
signs and a Walsh-Hadamard transform each, and names it by the nearest
cross-polytope corner of both rotations (the coordinate of greatest size and
its sign).  Multiprobe: for each rotation the runner-up corner is tried too, so
a vector stands in four buckets of a table, of which the pair's first common
one counts.  At 64 dimensions a pair at the threshold of 0.98 shares a bucket of
one table with a chance of 0.96, so of four tables it is missed with one of
about 2 in a million (measured: 1.000 of 4,000 pairs from three tables on).

First only the buckets' names travel, with a sketch of 256 signs of rotated
coordinates.  A bucket's vectors that no other one of it is near to (a quarter
of unlike signs; 0.98 has 16 of 256 on the average, with a deviation of 4) go no
further.  The few left fetch their vectors, meet again by bucket, and are
verified by their cosine in double precision.  Vectors meet only within a label.

Equal vectors of a label (by 128 bits of hash) are one class with a weight, so
that copies are neither compared nor expanded.  Links are counted where they are
verified and only a spanning set of them leaves a bucket.  A bucket of more than
PART classes is cut into pairs of parts, dealt to different tasks; none is dropped.

Cases: a null label, a null or zero vector, or one with null or non-finite
components links with nothing, and is returned with its own id as component;
vectors of unlike dimension never link; repeated vec_ids are vectors of their
own under one id; a null vec_id has no component and is not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import FEW_BYTES, components, hot_join, if_few, kept, pick
from .text import U64, avalanche, binaries, fixed_binaries
from .topk import finite

PART = 1024
#: Signs of a sketch, and the dimensions from which sketches are used.
SIGNS, LEAST_WIDTH = 256, 32


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        h *= 2
    return x


def rotated(unit: np.ndarray, table: int, turn: int) -> np.ndarray:
    width = 1 << max(1, (unit.shape[1] - 1).bit_length())
    x = np.zeros((len(unit), width), dtype=np.float32)
    x[:, : unit.shape[1]] = unit
    rng = np.random.default_rng([table, turn, 77])
    for _ in range(3):
        x = hadamard(x * rng.choice(np.array([-1, 1], dtype=np.float32), width)) / np.float32(width**0.5)
    return x


def corners(x: np.ndarray) -> np.ndarray:
    """The two nearest cross-polytope corners of each rotated row, nearest first."""
    size = np.abs(x)
    two = np.argpartition(-size, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(-np.take_along_axis(size, two, 1), axis=1, kind="stable"), 1)
    return 2 * two + (np.take_along_axis(x, two, 1) < 0)


def buckets(unit: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Four bucket names in each table, shape (rows, tables, 4), and a sketch of each row (uint64 words); all zero where the vectors are too short for one."""
    out, signs = np.empty((len(unit), tables, 4), dtype=np.int32), []
    for t in range(tables):
        x, y = rotated(unit, t, 0), rotated(unit, t, 1)
        a, b = corners(x), corners(y)
        out[:, t] = np.stack([(a[:, i] << 15) + b[:, j] for i in (0, 1) for j in (0, 1)], axis=1)
        signs += [x[:, :64] < 0, y[:, :64] < 0]
    if unit.shape[1] < LEAST_WIDTH:
        return out, np.zeros((len(unit), SIGNS // 64), dtype=U64)
    bits = np.concatenate(signs, axis=1)[:, :SIGNS]
    bits = np.pad(bits, ((0, 0), (0, SIGNS - bits.shape[1])))
    return out, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def bucket_keys(label: np.ndarray, width: np.ndarray | int, table: np.ndarray, name: np.ndarray) -> np.ndarray:
    """One 64-bit key for each bucket; a clash of keys costs comparisons alone."""
    at = avalanche(label.astype(np.int64).view(U64) + np.asarray(width).astype(U64) * U64(0x9E3779B97F4A7C15))
    return avalanche(at ^ (table.astype(U64) << U64(40)) ^ name.astype(U64)).view(np.int64)


def _units(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _by_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch's rows of each width, with their vectors as a matrix."""
    wide = np.diff(batch.column(column).offsets.to_numpy())
    for width in np.unique(wide):
        own = batch.filter(pa.array(wide == width))
        yield own, np.array(own.column(column).flatten()).reshape(-1, width)


def _near(sketches: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sketches[:, None] ^ others[None]).sum(axis=2, dtype=np.int64) <= SIGNS // 4


def near_any(keys: np.ndarray, part: np.ndarray, cross: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """Which rows have a near one under the same key (sorted); where cross, one of the other part."""
    n, alive = len(keys), np.zeros(len(keys), dtype=bool)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if n else np.zeros(1, dtype=np.int64)
    size = np.diff(edge)
    small = np.flatnonzero(np.repeat(size <= 16, size))
    for lag in range(1, 16):
        i = small[small + lag < n]
        i = i[keys[i] == keys[i + lag]]
        if not len(i):
            break
        i = i[(np.bitwise_count(sketches[i] ^ sketches[i + lag]).sum(axis=1) <= SIGNS // 4) & (~cross[i] | (part[i] != part[i + lag]))]
        alive[i] = alive[i + lag] = True
    for a, b in zip(edge[:-1][size > 16].tolist(), edge[1:][size > 16].tolist()):
        for low in range(a, b, PART):
            at = np.arange(low, min(low + PART, b))
            hit = _near(sketches[at], sketches[a:b])
            hit[np.arange(len(at)), at - a] = False
            if cross[a]:
                hit &= part[at][:, None] != part[a:b][None]
            alive[at] |= hit.any(axis=1)
    return alive


def dedup(rows: DataFrame, cosine: float = 0.98, tables: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of rows(vec_id, embedding, label)."""
    rows = pick(rows, "vec_id", "embedding", "label").select(F.col("vec_id").cast("long"), "embedding", "label")
    fit = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    zero = F.lit(0).cast(rows.schema["embedding"].dataType.elementType)
    vector = F.transform("embedding", lambda x: x + zero)  # no -0.0
    named = rows.select("vec_id", "label", F.coalesce(fit, F.lit(False)).alias("fit"), vector.alias("vector"))
    named = named.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit("second"), "vector"), "code": F.xxhash64("label")})
    classes = named.where("fit").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("weight"), F.first("code").alias("code"), F.first("vector").alias("vector"))
    classes = kept(classes.withColumn("uid", F.monotonically_increasing_id()), "vector-classes")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors in _by_width(batch, 2):
                names, sketches = buckets(_units(vectors), tables)
                who = np.repeat(np.arange(own.num_rows), tables * 4)
                table = np.tile(np.repeat(np.arange(tables), 4), own.num_rows)
                keys = bucket_keys(own.column(1).to_numpy()[who], vectors.shape[1], table, names.reshape(-1))
                yield pa.RecordBatch.from_arrays([pa.array(keys), own.column(0).take(pa.array(who)), *(pa.array(sketches[who, i].view(np.int64)) for i in range(SIGNS // 64))], names=["key", "uid", *SKETCH])

    placed = kept(classes.select("uid", "code", "vector").mapInArrow(place, "key long, uid long, " + ", ".join(f"{c} long" for c in SKETCH)), "buckets")
    total = placed.count()
    part_size = max(PART, total * 64 // FEW_BYTES)  # so that the table of larger buckets can be broadcast
    large = placed.groupBy(F.col("key").alias("_key")).count().where(F.col("count") > part_size).select("_key", F.ceil(F.col("count") / part_size).cast("int").alias("parts"))
    met = placed.join(F.broadcast(large), F.col("key") == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = met.withColumn("part", F.pmod(F.xxhash64("uid"), "parts").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("key", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "uid", *SKETCH)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(c: list[np.ndarray]) -> pa.RecordBatch:
            key, p, q, part, uid = c[:5]
            group = avalanche(key.view(U64) ^ avalanche((p.astype(U64) << U64(32)) + q.astype(U64)))
            alive = near_any(group, part, p != q, np.stack(c[5:], axis=1).view(U64))
            return pa.RecordBatch.from_arrays([pa.array(x[alive]) for x in (key, p, q, part, uid)], names=["key", "p", "q", "part", "uid"])

        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(x) for x in zip(held, columns)]
            key, p, q = columns[:3]
            last = (key == key[-1]) & (p == p[-1]) & (q == q[-1]) if len(key) else key == 0
            cut = len(key) - int(last.sum())
            held = [x[cut:] for x in columns]
            if cut:
                yield out([x[:cut] for x in columns])
        if held is not None and len(held[0]):
            yield out(held)

    group = ["key", "p", "q"]
    alive = kept(met.repartition(*group).sortWithinPartitions(*group).mapInArrow(screen, "key long, p int, q int, part int, uid long"), "near-vectors")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, vectors in _by_width(batch, 4):
                names, _ = buckets(_units(vectors), tables)
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(np.full(own.num_rows, vectors.shape[1], dtype=np.int32)), fixed_binaries(vectors), fixed_binaries(names.reshape(own.num_rows, -1))], names=["_uid", "code", "class_id", "weight", "width", "vector", "names"])

    who = kept(alive.select(F.col("uid").alias("_u")).distinct(), "near-ids")
    drawn = classes.join(if_few(who), F.col("uid") == F.col("_u"), "left_semi").select("uid", "code", "class_id", "weight", "vector")
    drawn = kept(drawn.mapInArrow(draw, "_uid long, code long, class_id long, weight long, width int, vector binary, names binary"), "near-drawn")
    kind = "<f4" if dict(classes.dtypes)["vector"] == "array<float>" else "<f8"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: tuple, held: list) -> list[tuple[int, int, int]]:
            key, p, q = at
            part, uid, code, ids, weight, width = (np.array([r[i] for r in held], dtype=np.int64) for i in range(6))
            names = np.stack([np.frombuffer(r[7], dtype="<i4") for r in held]).reshape(len(held), tables, 4)
            pairs = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
            for w in np.unique(width):
                own = np.flatnonzero(width == w)
                unit = _units(np.stack([np.frombuffer(held[i][6], dtype=kind) for i in own]))
                for low in range(0, len(own), PART):
                    product = unit[low : low + PART] @ unit.T
                    i, j = np.nonzero(product >= cosine - 1e-9)
                    i += low
                    i, j = i[i < j], j[i < j]
                    near = np.abs(product[i - low, j] - cosine) < 1e-9
                    near[near] = [cosine_of(unit[x], unit[y]) < cosine for x, y in zip(i[near], j[near])]
                    pairs.append((own[i[~near]], own[j[~near]]))
            i, j = (np.concatenate(x) for x in zip(*pairs))
            good = (code[i] == code[j]) & (part[i] != part[j] if p != q else True)
            i, j = i[good], j[good]
            # A pair counts in the first bucket that both stand in, by table and then by name.
            first = np.full(len(i), -1, dtype=np.int64)
            for t in range(tables - 1, -1, -1):
                a, b = names[i, t], names[j, t]
                both = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int32).max).min(axis=1).astype(np.int64) if len(i) else first
                first = np.where(both < np.iinfo(np.int32).max, (t << 32) + both, first)
            good = bucket_keys(code[i], width[i], first >> 32, first & 0xFFFFFFFF) == key
            i, j = i[good], j[good]
            links = np.bincount(i, weights=weight[j], minlength=len(held)) + np.bincount(j, weights=weight[i], minlength=len(held))
            top = np.arange(len(held))
            while True:  # the least class that each reaches within the bucket
                new = top.copy()
                np.minimum.at(new, i, top[j])
                np.minimum.at(new, j, top[i])
                new = new[new]
                if (new == top).all():
                    break
                top = new
            hit = np.flatnonzero(links)
            return [(int(uid[x]), int(ids[x]), int(ids[top[x]]), int(links[x])) for x in hit]

        at, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:9]), *(binaries(c) for c in batch.columns[9:])):
                if row[:3] != at:
                    if len(held) > 1:
                        found += close(at, held)
                    at, held = row[:3], []
                held.append((*row[3:9], bytes(row[9]), bytes(row[10])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["uid", "a", "b", "links"])
        if len(held) > 1 and (found := close(at, held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["uid", "a", "b", "links"])

    again = alive.join(if_few(drawn), F.col("uid") == F.col("_uid")).select(*group, "part", "uid", "code", "class_id", "weight", "width", "vector", "names")
    found = kept(again.repartition(*group).sortWithinPartitions(*group, "uid").mapInArrow(verify, "uid long, a long, b long, links long"), "vector-links")
    # Two classes of one id (repeated vec_ids) are one node of the components.
    tops = components(found.select("a", "b"))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    of = classes.join(links.withColumnRenamed("uid", "_uid"), F.col("uid") == F.col("_uid"), "left").join(tops, F.col("class_id") == F.col("id"), "left")
    key = F.struct("label", "h1", "h2")
    of = kept(of.select(key.alias("_class"), "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component")), "vector-tops")
    out = hot_join(named.where("fit").select("vec_id", key.alias("class")), of, "class", "_class", "weight", rows.count())
    out = out.select("vec_id", "n_links", "component").union(named.where("not fit").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


SKETCH = tuple(f"s{i}" for i in range(SIGNS // 64))


def cosine_of(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.dot(x, y) / np.sqrt(np.dot(x, x) * np.dot(y, y)))
