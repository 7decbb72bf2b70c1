"""Removal of repeated passages by suffix automata of reference shards.

A window is `length` consecutive words of one document.  Every window holds one
anchor, the run of ANCHOR words with the least hash within it; equal windows
have equal anchors.  An anchor that occurs once belongs to windows that occur
once, so only documents with repeated anchors go on.  Their windows are routed
by anchor to a reference shard, the one of the first document that has it, as
maximal runs of windows of the same shard.  Equal windows meet in one shard.

A shard's task streams these runs through a suffix automaton over words: a run
whose matching statistics reach `length` everywhere is known, any other is
added to the automaton.  Then it streams them once more and counts how often
each state of match length `length` is reached; windows of states reached more
than once are the repeated ones.

Where all shards' automata together are small (`most_broadcast` bytes, of which
the runs' words are a lower bound that is looked at first), they are broadcast,
and the documents with repeated anchors stream through each of them for their
matching statistics (`streamed`).  Beyond it the runs themselves are what meets
the automaton, in the shard's own task (`spans`): sending every shard to every
document would cost shards times corpus.  Both give the same maximal spans.

A first document whose anchors occur so often that its runs might exceed a shard
(a passage or family that many documents share) has no automaton: its windows
are counted one by one, by 128-bit hash, those of a batch added up before the
shuffle, so that no task holds all places of a window.

Cases: null and empty texts have no words; a text shorter than a window keeps
all; windows that overlap in one document (as in a period) count as often as
they start; rows of one doc_id or none are documents of their own; an empty
table gives an empty result; dedup() keeps other columns, but replaces such of
its outputs' names (n_words, n_removed, kept_text).
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import hot_join, kept, shielded
from .text import U64, avalanche, begin, binaries, chunks, windows

ANCHOR = 16
#: Distinct repeated windows (16 bytes each) that may be broadcast, and words that are cut into windows at a time.
FEW_WINDOWS, CUT = 1_000_000, 500_000
#: Bytes of all automata together that may be broadcast.
MOST_BROADCAST = 8 << 20


def _least(values: np.ndarray, k: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each run of k values."""
    done, out = 1, values
    while done < k:
        step = min(done, k - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def window_anchors(every: np.ndarray, of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window that lies within one document, its anchor), over a chunk's word hashes."""
    if len(every) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    anchors = _least(windows(every, ANCHOR), length - ANCHOR + 1, np.minimum)
    last = np.repeat(of[1:], np.diff(of))[: len(anchors)]  # end of the document of each word
    starts = np.flatnonzero(np.arange(len(anchors)) + length <= last)
    return starts, anchors[starts]


class Automaton:
    """A generalised suffix automaton over integers."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, words: list[int]) -> None:
        nexts, link, size = self.next, self.link, self.size
        last = 0
        for w in words:
            there = nexts[last].get(w)
            if there is not None:
                if size[there] == size[last] + 1:
                    last = there
                    continue
                copy = len(size)
                size.append(size[last] + 1)
                nexts.append(dict(nexts[there]))
                link.append(link[there])
                link[there] = copy
                p = last
                while p != -1 and nexts[p].get(w) == there:
                    nexts[p][w] = copy
                    p = link[p]
                last = copy
                continue
            new = len(size)
            size.append(size[last] + 1)
            nexts.append({})
            link.append(0)
            p = last
            while p != -1 and w not in nexts[p]:
                nexts[p][w] = new
                p = link[p]
            if p != -1:
                q = nexts[p][w]
                if size[q] == size[p] + 1:
                    link[new] = q
                else:
                    copy = len(size)
                    size.append(size[p] + 1)
                    nexts.append(dict(nexts[q]))
                    link.append(link[q])
                    link[q] = link[new] = copy
                    while p != -1 and nexts[p].get(w) == q:
                        nexts[p][w] = copy
                        p = link[p]
            last = new

    def states(self, words: list[int], length: int) -> list[int]:
        """For each window of words: the state that its last word reaches, or -1 where its match is shorter than the window."""
        nexts, link, size = self.next, self.link, self.size
        state = matched = 0
        out = []
        for i, w in enumerate(words, 1):
            to = nexts[state].get(w)
            while to is None and state:
                state = link[state]
                matched = size[state]
                to = nexts[state].get(w)
            if to is not None:
                state, matched = to, matched + 1
            while state and size[link[state]] >= length:
                state = link[state]
                matched = min(matched, size[state])
            if i >= length:
                out.append(state if matched >= length else -1)
        return out


def repeated(runs: list[list[int]], length: int) -> list[np.ndarray]:
    """For each run of words which of its windows occur more than once among all runs."""
    machine = Automaton()
    for words in runs:
        if -1 in machine.states(words, length):
            machine.add(words)
    reached = [np.array(machine.states(words, length), dtype=np.int64) for words in runs]
    counts = np.bincount(np.concatenate(reached), minlength=1) if reached else None
    return [counts[own] > 1 for own in reached]


def routed(rows: DataFrame, length: int, shard_words: int) -> DataFrame:
    """(home, uid, at, words): the runs of windows with repeated anchors of rows(uid, text).

    home is the first document that has the anchors, or -2 minus it where all its
    runs together might hold more than shard_words words.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                starts, ends, of = chunk.words()
                every = chunk.hashes(starts, ends, lower=False) if len(starts) else np.zeros(0, dtype=U64)
                at, anchor = window_anchors(every, of, length)
                doc = np.searchsorted(of, at, side="right") - 1
                place = windows(every, ANCHOR)
                uid = batch.column(0).to_numpy()[chunk.first : chunk.first + len(chunk)]
                # An anchor occurs where its hash stands among the 16-word runs that some window of its document picks.
                picked = np.zeros(len(place), dtype=bool)
                if len(at):
                    whole = np.zeros(len(place), dtype=U64)
                    whole[at] = anchor
                    back = np.concatenate((np.zeros(length - ANCHOR, dtype=U64), whole))
                    picked = _least(back, length - ANCHOR + 1, np.maximum) == place
                    picked &= place > 0
                hit = np.flatnonzero(picked)
                owner = np.searchsorted(of, hit, side="right") - 1
                order = np.lexsort((place[hit], owner))
                key, own = place[hit][order], owner[order]
                first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))) if len(key) else np.zeros(0, dtype=np.int64)
                many = np.diff(np.append(first, len(key)))
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(uid[own[first]]), pa.array(many.astype(np.int32))], names=["anchor", "uid", "many"])

    found = rows.select("uid", "text").mapInArrow(anchors, "anchor long, uid long, many int")
    found = kept(found, "anchors")
    shared = found.groupBy("anchor").agg(F.sum("many").alias("many"), F.min("uid").alias("home"), F.count("*").alias("docs")).where("many > 1")
    # Each place of an anchor lies in length - ANCHOR + 1 windows at most, and each run adds length - 1 words.
    words = F.sum("many").over(Window.partitionBy("home")) * (2 * length - ANCHOR)
    shared = shared.select(F.col("anchor").alias("_anchor"), F.when(words > shard_words, -2 - F.col("home")).otherwise(F.col("home")).alias("home"), "docs")
    shared = kept(shared, "shared-anchors")
    of_doc = hot_join(found, shared, "anchor", "_anchor", "docs", found.count()).groupBy("uid").agg(F.collect_list(F.struct("anchor", "home")).alias("known"))
    texts = rows.select(F.col("uid").alias("_uid"), "text").join(of_doc, F.col("_uid") == F.col("uid")).select("uid", "text", "known")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            edges = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            names, homes = (flat.field(i).to_numpy() for i in (0, 1))
            for chunk in chunks(batch.column(1)):
                starts, ends, of = chunk.words()
                every = chunk.hashes(starts, ends, lower=False)
                at, anchor = window_anchors(every, of, length)
                cuts = np.searchsorted(at, of)
                out: list[list] = [[], [], [], []]
                for i in range(len(chunk)):
                    own_at, own = at[cuts[i] : cuts[i + 1]], anchor[cuts[i] : cuts[i + 1]].view(np.int64)
                    row = chunk.first + i
                    know, home = names[edges[row] : edges[row + 1]], homes[edges[row] : edges[row + 1]]
                    order = np.argsort(know)
                    know, home = know[order], home[order]
                    where = np.minimum(np.searchsorted(know, own), len(know) - 1)
                    to = np.where(know[where] == own, home[where], -1)
                    turn = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True]))) if len(to) else [0]
                    for a, b in zip(turn[:-1], turn[1:]):
                        if to[a] != -1:
                            out[0].append(int(to[a]))
                            out[1].append(batch.column(0)[row].as_py())
                            out[2].append(int(own_at[a] - of[i]))
                            out[3].append(every[own_at[a] : own_at[b - 1] + length].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["home", "uid", "at", "words"])

    return kept(texts.mapInArrow(route, "home long, uid long, at long, words binary"), "runs")


def counted(runs: DataFrame, length: int) -> DataFrame:
    """(uid, first, end) that windows which occur more than once in runs(uid, at, words) cover."""

    def cut(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Two hashes of each window and its place (uid, first word), some runs at a time."""
        uid, at = (batch.column(i).to_numpy() for i in (0, 1))
        held = [np.frombuffer(w, dtype="<u8") for w in binaries(batch.column(2))]
        ends = np.cumsum([len(w) for w in held])
        a = 0
        while a < len(held):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CUT, side="right")))
            own = np.array([len(w) for w in held[a:b]])
            every = np.concatenate(held[a:b])
            run = np.repeat(np.arange(len(own)), own)
            inside = np.arange(len(every)) - np.repeat(np.cumsum(own) - own, own)
            start = np.flatnonzero(inside + length <= own[run])
            one, two = (windows(w, length)[start].view(np.int64) for w in (every, avalanche(every ^ U64(0x9E3779B97F4A7C15))))
            yield one, two, np.stack((uid[a:b][run[start]], at[a:b][run[start]] + inside[start]), axis=1).astype("<i8")
            a = b

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two, place in cut(batch):
                order = np.lexsort((two, one))
                one, two, place = one[order], two[order], np.ascontiguousarray(place[order])
                first = np.flatnonzero(np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))))
                offsets = pa.py_buffer((np.append(first, len(one)) * 16).astype(np.int32).tobytes())
                places = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(place.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(one[first]), pa.array(two[first]), places], names=["one", "two", "places"])

    def covers(place: np.ndarray) -> pa.RecordBatch:
        place = place[np.lexsort((place[:, 1], place[:, 0]))]
        new = np.ones(len(place), dtype=bool)
        new[1:] = (place[1:, 0] != place[:-1, 0]) | (place[1:, 1] > place[:-1, 1] + length)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1 if len(place) else first
        return pa.RecordBatch.from_arrays([pa.array(place[first, 0]), pa.array(place[first, 1]), pa.array(place[last, 1] + length)], names=["uid", "first", "end"])

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield covers(np.frombuffer(b"".join(binaries(batch.column(0))), dtype="<i8").reshape(-1, 2))

    runs, schema = runs.select("uid", "at", "words"), "uid long, first long, end long"
    every = runs.mapInArrow(grouped, "one long, two long, places binary")
    again = every.groupBy("one", "two").agg(F.sum(F.octet_length("places")).alias("n")).where("n > 16")
    again = kept(again.select(F.col("one").alias("_one"), F.col("two").alias("_two")), "windows")
    if again.count() > FEW_WINDOWS:
        return every.join(again, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left_semi").select("places").mapInArrow(covered, schema)

    table = again.orderBy("_one", "_two").toArrow()
    sent = runs.sparkSession.sparkContext.broadcast(tuple(table.column(i).to_numpy() for i in (0, 1)))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, twos = sent.value
        most = int(np.unique(ones, return_counts=True)[1].max(initial=0))  # 1 unless first hashes meet
        for batch in batches:
            for one, two, place in cut(batch):
                at, hit = np.searchsorted(ones, one), np.zeros(len(one), dtype=bool)
                for k in range(most):
                    here = np.minimum(at + k, len(ones) - 1)
                    hit |= (ones[here] == one) & (twos[here] == two)
                yield covers(place[hit])

    return runs.mapInArrow(marked, schema)


#: Bytes that an automaton takes for each word at least, pickled.
WORD_BYTES = 60


def streamed(rows: DataFrame, runs: DataFrame, length: int, shards: int, most_broadcast: int) -> DataFrame | None:
    """(uid, first, end) of the repeated windows of rows(uid, text), by the broadcast automata of runs(home, uid, words); None if they are too large."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(at: int, held: dict[bytes, int]) -> pa.RecordBatch:
            machine, counts = Automaton(), Counter()
            every = [(np.frombuffer(w, dtype="<u8").tolist(), n) for w, n in held.items()]
            for words, _ in every:
                if -1 in machine.states(words, length):
                    machine.add(words)
            for words, n in every:
                for state in machine.states(words, length):
                    counts[state] += n
            data = pickle.dumps((machine.next, machine.link, machine.size, {state for state, n in counts.items() if n > 1}))
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([data], pa.binary())], names=["shard", "data"])

        at, held = None, Counter()
        for batch in batches:
            for shard, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if shard != at:
                    if held:
                        yield close(at, held)
                    at, held = shard, Counter()
                held[words] += 1
        if held:
            yield close(at, held)

    shard = F.pmod(F.xxhash64(F.greatest("home", -2 - F.col("home"))), F.lit(shards)).cast("int").alias("shard")
    built = kept(runs.select(shard, "words").repartition("shard").sortWithinPartitions("shard").mapInArrow(learn, "shard int, data binary"), "automata")
    if (built.agg(F.sum(F.octet_length("data")).alias("n")).first()["n"] or 0) > most_broadcast:
        return None
    sent = rows.sparkSession.sparkContext.broadcast([bytes(r["data"]) for r in built.collect()])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = []
        for data in sent.value:
            machine = Automaton()
            machine.next, machine.link, machine.size, repeats = pickle.loads(data)
            machines.append((machine, repeats))
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                starts, ends, of = chunk.words()
                every = chunk.hashes(starts, ends, lower=False).tolist() if len(starts) else []
                out: list[list] = [[], [], []]
                for i in range(len(chunk)):
                    words = every[of[i] : of[i + 1]]
                    hit = np.zeros(max(0, len(words) - length + 1), dtype=bool)
                    for machine, repeats in machines:
                        hit |= np.fromiter((state in repeats for state in machine.states(words, length)), dtype=bool, count=len(hit))
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
                    uid = batch.column(0)[chunk.first + i].as_py()
                    for a, b in zip(turn[::2], turn[1::2]):
                        for own, value in zip(out, (uid, a, b - 1 + length)):
                            own.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["uid", "first", "end"])

    asked = F.broadcast(runs.select(F.col("uid").alias("_of")).distinct())  # not more than there are runs, whose words are bounded
    found = kept(rows.select("uid", "text").join(asked, F.col("uid") == F.col("_of"), "left_semi").mapInArrow(stream, "uid long, first long, end long"), "streamed")
    sent.destroy()
    return found


def spans(rows: DataFrame, length: int, shard_words: int, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(uid, spans: array of (first word, end)) of the words of rows(uid, text) that repeated windows cover."""
    every = routed(rows, length, shard_words)
    size = every.groupBy(F.col("home") < 0).agg(F.sum(F.octet_length("words"))).collect()  # two rows
    words = {many: n // 8 for many, n in size}
    together = sum(words.values())
    if together * WORD_BYTES <= most_broadcast:
        got = streamed(rows, every, length, max(1, math.ceil(together / shard_words)), most_broadcast)
        if got is not None:
            return got.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    runs = every.where("home >= 0")
    shards = max(1, math.ceil(words.get(False, 0) / shard_words))
    # Runs of the same words are one, with the number of its places.
    runs = runs.withColumn("shard", F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(held: dict[bytes, list]) -> pa.RecordBatch:
            words = [np.frombuffer(w, dtype="<u8") for w in held]
            # A run at two places or more is repeated throughout; once in the automaton, it counts twice.
            runs_ = [w.tolist() for w in words]
            twice = [r for r, own in zip(runs_, held.values()) if len(own) > 1]
            flags = repeated(runs_ + twice, length)[: len(runs_)]
            out: list[list] = [[], [], []]
            for hit, own in zip(flags, held.values()):
                turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))).tolist()
                for a, b in zip(turn[::2], turn[1::2]):
                    for uid, at in own:
                        out[0].append(uid)
                        out[1].append(at + a)
                        out[2].append(at + b - 1 + length)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["uid", "first", "end"])

        at, held = None, {}
        for batch in batches:
            for shard, uid, start, words in zip(*(c.to_pylist() for c in batch.columns)):
                if shard != at:
                    if held:
                        yield close(held)
                    at, held = shard, {}
                held.setdefault(words, []).append((uid, start))
        if held:
            yield close(held)

    got = runs.select("shard", "uid", "at", "words").repartition("shard").sortWithinPartitions("shard").mapInArrow(match, "uid long, first long, end long")
    if words.get(True):
        got = got.union(counted(every.where("home < 0"), length))
    return got.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))


def dedup(docs: DataFrame, length: int = 35, shard_words: int = 120_000, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with n_words, n_removed, and kept_text: the words that no repeated window covers, joined by one space."""
    docs, restored = shielded(docs.drop("n_words", "n_removed", "kept_text"), "text")
    rows = docs.withColumn("_uid", F.monotonically_increasing_id())
    rows = kept(rows, "numbered")
    found = spans(rows.select(F.col("_uid").alias("uid"), "text"), length, shard_words, most_broadcast)
    joined = rows.join(found.withColumnRenamed("uid", "_of"), F.col("_uid") == F.col("_of"), "left").drop("_uid", "_of")
    fields = joined.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).drop("spans").schema
    column = joined.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin()
        for batch in batches:
            n, gone, texts = [], [], []
            spans_ = batch.column(batch.num_columns - 1)
            for chunk in chunks(batch.column(column)):
                starts, ends, of = chunk.words()
                raw = chunk.data.tobytes()
                for i in range(len(chunk)):
                    a, b = int(of[i]), int(of[i + 1])
                    words = raw[int(chunk.offsets[i]) : int(chunk.offsets[i + 1])].split()
                    if len(words) != b - a:
                        words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                    here = spans_[chunk.first + i].as_py()
                    n.append(b - a)
                    if here:
                        at, stay = 0, []
                        for s in here:
                            stay += words[at : max(at, s["first"])]
                            at = max(at, s["end"])
                        words = stay + words[at:]
                    gone.append(b - a - len(words))
                    texts.append(b" ".join(words).decode("utf-8", "replace"))
            columns = batch.columns[:-1] + [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_words", "n_removed", "kept_text"])

    return restored(joined.mapInArrow(cut, fields), "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """docs whose texts lack the words of repeated windows; a text without any stays as it is, one that loses all words becomes empty."""
    counted = ["n_chars"] if "n_chars" in docs.columns else []
    docs, restored = shielded(docs, "text", *counted)
    cut = dedup(docs, length).withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if counted:
        cut = cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return restored(cut)
