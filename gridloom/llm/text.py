"""Vectorised word work on Arrow text batches, used inside Spark tasks.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  All positions are
byte offsets into one flat buffer that holds the documents of a chunk one after
the other; no word crosses a document.  Hashes are 64-bit: a polynomial over
random byte values modulo 2**64, finished by an avalanche step.  Such polynomials
have systematic clashes for long texts of a certain form (of 2**k letters, from
2**10 on whatever the base), so spans of more than SHORT bytes are hashed by
BLAKE2 instead.  Different words differ but for a chance of about 2**-64, and
2**-50 for short ones of that form; a name of a set or a window is 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_LOWER = _BYTE.copy()
_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BLANK = np.zeros(256, dtype=bool)
BLANKS = frozenset([0x20, *range(0x09, 0x0E)])
_BLANK[[*BLANKS]] = True
#: Bytes of text that are handled at once, and the longest span that is hashed by a polynomial.
CHUNK_BYTES, SHORT = 1 << 18, 32
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_powers: dict[int, np.ndarray] = {}
#: How to drop what a worker keeps for its next task, by name: done once other work begins there.
spare: dict[str, Callable[[], None]] = {}


def begin(keeps: str | None = None) -> None:
    """At the start of a task's work: drops what earlier work has kept, but for `keeps`."""
    for name in [n for n in spare if n != keeps]:
        spare.pop(name)()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, CHUNK_BYTES), base, dtype=U64)
        full[0] = 1
        have = _powers[base] = np.multiply.accumulate(full)
    return have[:n]


def avalanche(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Chunk:
    """Some documents: data (uint8) and offsets (len(docs) + 1) into it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the number of words before each document."""
        n = len(self.data)
        if not n:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(len(self.offsets), dtype=np.int64)
        solid = ~_BLANK[self.data]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < n)]
        before[inner] = False
        after[inner - 1] = False
        starts = np.flatnonzero(solid & ~before)
        return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, self.offsets)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), but each unit also holds the blanks before its word; blanks that end a document are a unit."""
        n = len(self.data)
        if not n:
            return self.words()
        blank = _BLANK[self.data]
        edge = np.zeros(n, dtype=bool)
        edge[1:] = blank[1:] & ~blank[:-1]
        edge[self.offsets[:-1][self.offsets[:-1] < n]] = True
        starts = np.flatnonzero(edge)
        return starts, np.append(starts[1:], n), np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool, rough: bool = False) -> np.ndarray:
        """One hash for each span of bytes; lower folds A-Z; rough: long spans by the polynomial as well, for counts alone."""
        n = len(self.data)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((_LOWER if lower else _BYTE)[self.data] * powers(_BASE, n), out=total[1:])
        span = (total[ends] - total[starts]) * powers(_BASE_INVERSE, n + 1)[starts]
        out = avalanche(span + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
        if not rough and len(wide := np.flatnonzero(ends - starts > SHORT)):
            raw = self.data.tobytes()
            raw = raw.translate(_FOLD) if lower else raw
            out[wide] = np.frombuffer(b"".join(blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(starts[wide].tolist(), ends[wide].tolist())), dtype="<u8")
        return out

    def text(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column in chunks of about `most` bytes, whole documents each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    ofs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ofs, ofs[at] + most, side="right")) - 1)
        yield Chunk(data[ofs[at] : ofs[to]], ofs[at : to + 1] - ofs[at], at)
        at = to


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k values; none if there are fewer."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(_BASE, len(values)), out=total[1:])
    return avalanche((total[k:] - total[:-k]) * powers(_BASE_INVERSE, n))


def shingle_sets(chunk: Chunk, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each document's k-word shingles, A-Z folded; fewer words: the whole sequence is one; no words: none."""
    starts, ends, of = chunk.words()
    every = chunk.hashes(starts, ends, lower=True)
    runs = windows(every, k)
    for i in range(len(chunk)):
        a, b = of[i], of[i + 1]
        if b - a >= k:
            own = np.sort(runs[a : b - k + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        else:
            own = windows(every[a:b], int(b - a)) if b > a else every[:0]
            own = own ^ U64(0xA5A5A5A5A5A5A5A5)  # a short text is no shingle of a longer one
        yield chunk.first + i, own


def sliced(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about `most` bytes."""
    rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def fixed_binaries(values: np.ndarray) -> pa.Array:
    """The rows of a contiguous array as a binary column."""
    each = values.nbytes // len(values) if len(values) else 0
    offsets = np.arange(len(values) + 1, dtype=np.int32) * each
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def binaries(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without copies."""
    n = len(column)
    ofs = np.frombuffer(column.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + n + 1].tolist()
    raw = memoryview(column.buffers()[2]) if column.buffers()[2] is not None else memoryview(b"")
    return [raw[a:b] for a, b in zip(ofs, ofs[1:])]
