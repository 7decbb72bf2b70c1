"""Best-fit packing of documents' tokens into sequences of a fixed length.

Documents longer than a sequence are cut; the first piece takes what is over,
all others fill a sequence.  The pieces below a full sequence, at most one for
each document, are dealt by hash into groups of some thousands.  Each group is
packed by a grouping genetic algorithm: a crossover injects well-filled bins of
one parent whole into the other, drops the bins that held the same pieces, and
puts the displaced pieces back by best fit.

The first individual is the best-fit packing of falling lengths.  A group that
it packs into as few bins as lower_bound() proves necessary is done (so is most
real text, with its many short pieces).  All other groups evolve on several
islands of their own random numbers; between the epochs the islands' elites meet
and each island goes on from all of them.  The bins that stay underfilled are
dealt anew in a later round.

Cases: a null or empty text has its end id alone; equal doc_ids are pieces of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import if_few, kept, pick
from .text import chunks
from .tokens import BYTES, encoder

PIECES = "uid long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, end_id: int, room: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece; with_ids adds the piece's ids (array<int>)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        encode = encoder(vocabulary, True).encode
        for batch in batches:
            doc_ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else np.array(batch.column(0).to_pylist(), dtype=object)
            for chunk in chunks(batch.column(1), BYTES):
                ids, of = encode(chunk)
                ids = np.insert(ids, of[1:], end_id).astype("<u4")
                of = of + np.arange(len(of))
                n = of[1:] - of[:-1]
                many = -(-n // room)
                doc = np.repeat(np.arange(len(n)), many)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                short = n[doc] - (many[doc] - 1) * room
                start = np.where(piece == 0, 0, short + (piece - 1) * room)
                length = np.where(piece == 0, short, room)
                raw, at = memoryview(ids.tobytes()), of[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist())]
                columns = [pa.array(uid + np.arange(len(doc))), pa.array(doc_ids[chunk.first + doc], pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
                names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    # The pieces of a chunk, one after the other, are all of its ids.
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                    names.append("ids")
                uid += len(doc)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)


def best_fit(order: list[int], length: list[int], bins: list[list[int]], fill: list[int], room: int) -> None:
    """Puts the pieces of order into bins, each where it leaves the least room, or into a new bin."""
    free: list[list[int]] = [[] for _ in range(room + 1)]
    for b, f in enumerate(fill):
        free[room - f].append(b)
    mask = sum(1 << r for r, own in enumerate(free) if own)
    for i in order:
        k = length[i]
        fits = mask >> k
        if fits:
            r = k + (fits & -fits).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            b, r = len(bins), room
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += k
        free[r - k].append(b)
        mask |= 1 << (r - k)


def fitness(fill: list[int], room: int) -> tuple[int, float]:
    """Fewer bins first, then uneven ones: a nearly empty bin is nearly gone."""
    return -len(fill), float(np.square(np.array(fill, dtype=float) / room).sum())


def crossover(one: tuple[list, list], two: tuple[list, list], length: list[int], room: int, rng: random.Random) -> tuple[list, list]:
    """Bins of `one` with a sample of the well-filled bins of `two` put in whole."""
    good = [b for b, f in enumerate(two[1]) if f >= room - 2]
    chosen = rng.sample(good, max(1, len(good) // 4)) if good else []
    there = {i for b in chosen for i in two[0][b]}
    bins, fill, out = [list(two[0][b]) for b in chosen], [two[1][b] for b in chosen], []
    loose = sorted(one[1])[: max(1, len(one[1]) // 20)][-1]
    for own, f in zip(*one):
        if there.isdisjoint(own) and (f > loose or rng.random() < 0.5):
            bins.append(list(own))
            fill.append(f)
        else:
            out += [i for i in own if i not in there]
    rng.shuffle(out)
    out.sort(key=lambda i: -length[i])
    best_fit(out, length, bins, fill, room)
    return bins, fill


def lower_bound(length: list[int], room: int) -> int:
    """Bins that any packing needs: all lengths together, and k at most of those above room / (k + 1) in one bin."""
    sizes = np.array(length, dtype=np.int64)
    return max([-(-int(sizes.sum()) // room), *(-(-int((sizes * (k + 1) > room).sum()) // k) for k in range(1, 9))])


def falling(length: list[int], room: int, weight=lambda i: 1.0) -> tuple[list, list]:
    """Best fit of the falling lengths, each times its weight."""
    bins: list[list[int]] = []
    fill: list[int] = []
    best_fit(sorted(range(len(length)), key=lambda i: -length[i] * weight(i)), length, bins, fill, room)
    return bins, fill


def evolve(length: list[int], start: list[tuple[list, list]], room: int, population: int, generations: int, rng: random.Random, idle: int = 4) -> tuple[list, list]:
    """The best solution found; ends early at lower_bound(), or after `idle` generations without a better one."""
    least = lower_bound(length, room)
    alive = list(start) or [falling(length, room)]
    while len(alive) < population and max(-len(s[1]) for s in alive) < -least:
        alive.append(falling(length, room, lambda i: rng.uniform(0.93, 1.0)))
    best, waited = None, 0
    for _ in range(generations + 1):
        alive.sort(key=lambda s: fitness(s[1], room), reverse=True)
        del alive[population:]
        now = fitness(alive[0][1], room)
        best, waited = (now, 0) if best is None or now > best else (best, waited + 1)
        if len(alive[0][1]) <= least or len(alive) < 2 or waited > idle:
            break
        alive += [crossover(*rng.sample(alive, 2), length, room, rng) for _ in range(population // 2)]
    return max(alive, key=lambda s: fitness(s[1], room))


def _bins_of(items: pd.DataFrame, column: str, length: list[int]) -> tuple[list, list]:
    bins: dict[int, list[int]] = {}
    for i, b in enumerate(items[column].astype(int).tolist()):
        bins.setdefault(b, []).append(i)
    return list(bins.values()), [sum(length[i] for i in own) for own in bins.values()]


def _packed(group: int, island: int, items: pd.DataFrame, found: tuple[list, list], room: int) -> pd.DataFrame:
    bins, fill = found
    at, offset = np.zeros(len(items), dtype=np.int64), np.zeros(len(items), dtype=np.int64)
    length = items["length"].tolist()
    for b, own in enumerate(bins):
        to = 0
        for i in own:
            at[i], offset[i] = b, to
            to += length[i]
    filled = np.array(fill, dtype=np.int64)[at] if len(fill) else at
    return pd.DataFrame({"group": group, "island": island, "uid": items["uid"], "length": items["length"], "bin": at, "offset": offset, "fill": filled, "bins": len(bins), "solved": len(bins) <= lower_bound(length, room)})


def _seed(room: int):
    def run(key, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("uid").reset_index(drop=True)
        return _packed(int(key[0]), 0, items, falling(items["length"].tolist(), room), room)

    return run


def _epoch(room: int, population: int, effort: int, last: bool):
    def run(key, items: pd.DataFrame) -> pd.DataFrame:
        group, island = int(key[0]), int(key[1])
        elites = sorted(c for c in items.columns if c.startswith("bin") and items[c].notna().all())
        items = items.sort_values("uid").reset_index(drop=True)
        length = items["length"].tolist()
        start = [_bins_of(items, c, length) for c in elites]
        generations = max(2, effort // max(1, len(length) * (population // 2)))
        found = evolve(length, start, room, population, generations, random.Random(f"{group} {island} {last}"), max(2, generations // 2))
        return _packed(group, island, items, found, room)

    return run


PLACED = "group long, island int, uid long, length int, bin long, offset long, fill long, bins long, solved boolean"


def evolved(hard: DataFrame, room: int, islands: int, population: int, effort: int) -> DataFrame:
    """The rows of PLACED of the best packing found for each group of hard(group, uid, length, bin0), bin0 being its first packing."""
    apart = F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))
    first = kept(hard.withColumn("island", apart).groupBy("group", "island").applyInPandas(_epoch(room, population, effort, False), PLACED), "pack-epoch")
    # Migration: every island of a group gets the elites of all, the best packing wins.
    elites = first.groupBy("group", "uid", "length").agg(*[F.max(F.when(F.col("island") == i, F.col("bin"))).alias(f"bin{i}") for i in range(islands)])
    second = kept(elites.withColumn("island", apart).groupBy("group", "island").applyInPandas(_epoch(room, population, effort, True), PLACED), "pack-epoch")
    best = second.groupBy("group").agg(F.min(F.struct("bins", "island")).alias("best")).select(F.col("group").alias("_group"), F.col("best.island").alias("_island"))  # one row a group
    return second.join(best, (F.col("group") == F.col("_group")) & (F.col("island") == F.col("_island"))).drop("_group", "_island")


def arrange(items: DataFrame, room: int, group_size: int = 8192, islands: int = 2, population: int = 12, effort: int = 60_000, rounds: int = 3) -> DataFrame:
    """(uid, sequence_id, offset) of items(uid, length), each shorter than room. effort: pieces that the crossovers of an island may handle in an epoch, so that small groups evolve for longer."""
    done = None
    for k in range(rounds):
        groups = max(1, -(-items.count() // group_size))
        dealt = items.select(F.pmod(F.xxhash64("uid", F.lit(k)), F.lit(groups)).alias("group"), "uid", "length")
        found = kept(dealt.groupBy("group").applyInPandas(_seed(room), PLACED), "pack-seeds")
        hard = found.where("not solved")
        if hard.limit(1).count():
            found = found.where("solved").unionByName(evolved(hard.select("group", "uid", "length", F.col("bin").alias("bin0")), room, islands, population, effort))
        found = found.select("uid", "length", "offset", "fill", (F.lit(k + 1) * F.lit(1 << 56) + F.col("group") * (1 << 24) + F.col("bin")).alias("sequence_id"))
        final = k == rounds - 1 or groups == 1
        good = found if final else found.where(F.col("fill") >= room - room // 128)
        good = good.select("uid", "sequence_id", "offset")
        done = good if done is None else done.union(good)
        if final:
            return done
        items = kept(found.where(F.col("fill") < room - room // 128).select("uid", "length"), "pack-rest")


def pack(docs: DataFrame, vocabulary: str, end_id: int, room: int = 1024, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and its offset there."""
    cut = kept(pieces(docs, vocabulary, end_id, room, with_ids), "pieces")
    placed = kept(arrange(cut.where(F.col("length") < room).select("uid", "length"), room), "placed")
    full = cut.where(F.col("length") == room).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = cut.join(if_few(placed), "uid")
    return part.select(*full.columns).union(full).withColumn("length", F.col("length").cast("long")).drop("uid")
