"""Token ids of whole texts by a public tokenizer, and their bit-plane files.

Encoding: a tokenizer that never joins a blank to what stands before it encodes
a text as its pieces, one after the other.  Each distinct piece is encoded once
by the tokenizers library and kept; texts are then put together by array work.
For the same reason new pieces that begin with a blank are encoded thousands at a
time, as one text; with a byte-level vocabulary the ids' bytes tell where each ends.

A vocabulary that marks ends of words merges within runs of letters, of signs,
and single digits, case aside.  Where the tokenizer is of that known form, plain
words are cut into those runs here, A-Z folded, and new runs are encoded
thousands at a time, as one text with blanks between; the marks tell where each
ends.  All other words are encoded whole, by the tokenizer.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import pick
from .text import BLANKS, Chunk, chunks, spare

#: The blanks of Unicode outside ASCII, in UTF-8.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


#: The normalizer and the split for which runs() finds what is merged.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}

#: Kinds of bytes. OTHER makes its word one that is encoded whole: apostrophes (contractions), "<" (added tokens), controls and what PLAIN lacks.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
_KIND = np.full(256, OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_KIND[0x30:0x3A] = DIGIT
_KIND[[*BLANKS]] = BLANK
_KIND[[*b"'<"]] = OTHER
_FOLD = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)


def _plain(c: str) -> bool:
    """A letter that stays one, alone and whatever stands beside it, when normalized and lower-cased."""
    low = c.lower()
    return len(low) == 1 and all(unicodedata.category(x)[0] == "L" and unicodedata.normalize("NFC", x) == x for x in (c, low)) and c != "\u03a3"


#: By code point: the letters of two bytes in Latin, Greek and Cyrillic that are cut out as those of ASCII are.
PLAIN = np.zeros(1 << 11, dtype=bool)
PLAIN[[c for c in range(0xC0, 0x482) if _plain(chr(c))]] = True


def runs(chunk: Chunk) -> tuple[Chunk, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(the chunk with A-Z folded in plain words; start and end byte of each run, and the number of runs before each document; which runs are whole words that are not plain)."""
    data, n = chunk.data, len(chunk.data)
    kind, edge = _KIND[data], np.zeros(n + 1, dtype=bool)
    edge[chunk.offsets] = True
    lead = np.flatnonzero(data[:-1] >> 5 == 0b110)
    after = data[lead + 1]
    lead = lead[PLAIN[(data[lead] & 0x1F).astype(np.int64) << 6 | after & 0x3F] & (after >> 6 == 0b10) & ~edge[lead + 1]]
    kind[lead] = kind[lead + 1] = LETTER
    solid = kind != BLANK
    first, cut = solid.copy(), kind == DIGIT
    first[1:] &= ~solid[:-1] | edge[1:-1]
    cut[1:] |= solid[1:] & (kind[1:] != kind[:-1])
    cut |= first
    folded, whole = _FOLD[data], np.zeros(n, dtype=bool)
    if len(other := np.flatnonzero(kind == OTHER)):
        last = solid.copy()
        last[:-1] &= ~solid[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        own = np.unique(np.searchsorted(starts, other, side="right") - 1)
        steps = np.zeros(n + 1, dtype=np.int8)
        steps[starts[own]] += 1
        steps[ends[own]] -= 1
        whole = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
        cut &= first | ~whole
        folded = np.where(whole, data, folded)
    last = solid.copy()
    last[:-1] &= ~solid[1:] | cut[1:]
    starts = np.flatnonzero(cut)
    return Chunk(folded, chunk.offsets, chunk.first), starts, np.flatnonzero(last) + 1, np.searchsorted(starts, chunk.offsets), whole[starts]


#: Pieces that the tokenizer takes at a time, and bytes of text whose ids are made at a time.
LEARNT, BYTES = 4096, 1 << 19


class Encoder:
    """ids of a chunk's texts without special tokens. blanks: the vocabulary keeps blanks, in front of words.

    What is kept takes at most most_bytes; beyond them all of it is forgotten.
    """

    def __init__(self, path: str, blanks: bool, most_bytes: int = 24 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.blanks, self.most = Tokenizer.from_file(path), blanks, most_bytes
        self.widths, self.marks = (self._widths(), None) if blanks else (None, self._marks())
        self.forget()

    def _widths(self) -> np.ndarray | None:
        """The bytes of each id; None where the ids of a text do not hold its bytes, one after the other."""
        made = json.loads(self.tokenizer.to_str())
        split = made["pre_tokenizer"] or {}
        if made["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)  # a letter for each byte
        added = {t["id"]: len(t["content"].encode()) for t in made["added_tokens"]}
        out = np.zeros(max([*vocabulary.values(), *added], default=-1) + 1, dtype=np.int64)
        out[np.fromiter(vocabulary.values(), dtype=np.int64, count=len(vocabulary))] = [*map(len, vocabulary)]
        out[list(added)] = list(added.values())
        return out

    def _marks(self) -> np.ndarray | None:
        """Which ids end a run; None where the tokenizer is not one for runs()."""
        made = json.loads(self.tokenizer.to_str())
        model, added, mark = made["model"], made["added_tokens"], made["model"].get("end_of_word_suffix")
        steps = [{k: v for k, v in step.items() if k != "trim_offsets"} for step in (made["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if made["normalizer"] != NORMALIZER or steps != [SPLIT, LEVEL] or model["type"] != "BPE" or model["dropout"] or not mark:
            return None
        if any(t["normalized"] or t["content"][0] != "<" for t in added):
            return None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        out = np.zeros(max([*vocabulary.values(), *(t["id"] for t in added)], default=-1) + 1, dtype=bool)
        out[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        return out

    def size(self, more: int = 0) -> int:
        """Bytes that are kept, with `more` pieces of some four ids."""
        return 20 * (self.n + more) + 4 * (self.used + 4 * more)

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.begin, self.flat, self.used, self.n = np.zeros(1024, dtype=np.int64), np.zeros(4096, dtype=np.int32), 0, 0

    def direct(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pieces, how many each has)."""
        ids = self.direct(pieces)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum())), lengths

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_ids() of pieces that begin with a blank and end with none, as one text; one by one if an id should reach over a piece's end."""
        ids = np.array(self.direct([b"".join(pieces)])[0], dtype=np.int32)
        ends, wanted = np.cumsum(self.widths[ids]), np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        last = np.searchsorted(ends, wanted)
        if ends[-1] != wanted[-1] or (ends[last] != wanted).any():
            return self._ids(pieces)
        return ids, np.diff(last, prepend=-1)

    def _spaced(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """_ids() of runs of plain words, as one text; one by one if they should not have one mark each."""
        ids = np.array(self.direct([b" ".join(pieces)])[0], dtype=np.int32)
        last = np.flatnonzero(self.marks[ids])
        if len(last) != len(pieces) or last[-1] != len(ids) - 1:
            return self._ids(pieces)
        return ids, np.diff(last, prepend=-1)

    def learn(self, hashes: np.ndarray, pieces: list[bytes], alone: np.ndarray | None = None) -> None:
        """hashes: sorted, none known yet. alone: of runs(), the pieces that are not of plain words."""
        if alone is not None:
            whole = ~alone
        elif self.widths is not None:
            whole = np.fromiter((p[0] in BLANKS and p[-1] not in BLANKS for p in pieces), dtype=bool, count=len(pieces))
        else:
            whole = np.zeros(len(pieces), dtype=bool)
        order, made = [], []
        for own, encode in ((np.flatnonzero(whole), self._joined if alone is None else self._spaced), (np.flatnonzero(~whole), self._ids)):
            order.append(own)
            made += [encode([pieces[i] for i in own[at : at + LEARNT].tolist()]) for at in range(0, len(own), LEARNT)]
        ids, lengths = (np.concatenate(own) for own in zip(*made))
        n, total = len(pieces), len(ids)
        while self.n + n + 1 > len(self.begin):
            self.begin = np.concatenate((self.begin, np.zeros_like(self.begin)))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[self.used : self.used + total] = ids
        self.begin[self.n + 1 : self.n + n + 1] = self.used + np.cumsum(lengths)
        entry = np.empty(n, dtype=np.int32)
        entry[np.concatenate(order)] = np.arange(self.n, self.n + n, dtype=np.int32)
        where = np.searchsorted(self.keys, hashes)
        self.keys, self.at = np.insert(self.keys, where, hashes), np.insert(self.at, where, entry)
        self.n, self.used = self.n + n, self.used + total

    def encode(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of each document's ids)."""
        if self.blanks and WIDE_BLANK.search(chunk.data.tobytes()):
            return self._one_by_one(chunk)
        alone = None
        if self.marks is not None:
            chunk, starts, ends, of, alone = runs(chunk)
        else:
            starts, ends, of = chunk.units() if self.blanks else chunk.words()
        if not len(starts):
            return np.zeros(0, dtype=np.int32), np.zeros(len(chunk) + 1, dtype=np.int64)
        own, first, back = np.unique(chunk.hashes(starts, ends, lower=False), return_index=True, return_inverse=True)
        if self.size(len(own)) > self.most:
            self.forget()
        where = np.minimum(np.searchsorted(self.keys, own), max(0, len(self.keys) - 1))
        new = self.keys[where] != own if len(self.keys) else np.ones(len(own), dtype=bool)
        if new.any():
            raw = chunk.data.tobytes()
            fresh = first[new]
            self.learn(own[new], [raw[a:b] for a, b in zip(starts[fresh].tolist(), ends[fresh].tolist())], None if alone is None else alone[fresh])
            where = np.searchsorted(self.keys, own)
        entry = self.at[where].astype(np.int64)[back]
        begin = self.begin[entry]
        lengths = self.begin[entry + 1] - begin
        through = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(lengths, out=through[1:])
        return self.flat[np.repeat(begin - through[:-1], lengths) + np.arange(through[-1])], through[of]

    def _one_by_one(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """For chunks with wide blanks, which the tokenizer may join to plain ones: such texts are encoded whole."""
        out, at = [], [0]
        for i in range(len(chunk)):
            raw = chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]]
            if WIDE_BLANK.search(text := raw.tobytes()):
                out.append(np.array(self.direct([text])[0], dtype=np.int32))
            else:
                out.append(self.encode(Chunk(raw, np.array([0, len(raw)]), 0))[0])
            at.append(at[-1] + len(out[-1]))
        return np.concatenate(out), np.array(at)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, blanks: bool) -> Encoder:
    """One a worker, kept for the next task of the same vocabulary; other work in the same worker has it dropped."""
    if (path, blanks) not in _encoders:
        _encoders.clear()
        _encoders[path, blanks] = Encoder(path, blanks)
    spare["encoders"] = _encoders.clear
    return _encoders[path, blanks]


# ---- files of ids

MAGIC = b"IDPL"
HEAD = struct.Struct("<4sBBHIIQ")  # magic, 1: bit planes or 0: byte planes, bytes an id, unused, ids a block, documents, ids


def planes(ids: np.ndarray, width: int, bits: bool) -> list[bytes]:
    """The block's planes: plane k holds bit (or byte) k of every id, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if not bits:
        return [np.ascontiguousarray(octets[:, k]).tobytes() for k in range(width)]
    each = np.unpackbits(np.ascontiguousarray(octets), axis=1, bitorder="little")
    return list(map(bytes, np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little")))


def unplaned(parts: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if bits:
        each = np.unpackbits(np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(8 * width, -1), axis=1, bitorder="little", count=n)
        octets = np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little")
    else:
        octets = np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(width, n).T
    full = np.zeros((n, 4), dtype=np.uint8)
    full[:, :width] = octets
    return full.view("<u4").reshape(-1)


def pack(ids: np.ndarray, lengths: np.ndarray, block: int, bits: bool, level: int) -> bytes:
    """A self-contained file of some documents: head, chunk index (the compressed size of each plane, block by block, and of the lengths), planes, lengths."""
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    width = max(1, (int(ids.max(initial=0)).bit_length() + 7) // 8)
    parts = [press(p) for at in range(0, len(ids), block) for p in planes(ids[at : at + block], width, bits)]
    parts.append(press(lengths.astype("<u8").tobytes()))
    index = np.array([len(p) for p in parts], dtype="<u4").tobytes()
    return b"".join([HEAD.pack(MAGIC, bits, width, 0, block, len(lengths), len(ids)), index, *parts])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, lengths) of a file."""
    import zstandard

    magic, bits, width, _, block, docs, n = HEAD.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a file of id planes")
    press = zstandard.ZstdDecompressor().decompress
    each = width * (8 if bits else 1)
    blocks = -(-n // block)
    sizes = np.frombuffer(raw, dtype="<u4", count=blocks * each + 1, offset=HEAD.size)
    ends = HEAD.size + 4 * len(sizes) + np.cumsum(sizes.astype(np.int64))
    parts = [press(raw[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())]
    ids = [unplaned(parts[b * each : (b + 1) * each], min(block, n - b * block), width, bool(bits)) for b in range(blocks)]
    lengths = np.frombuffer(parts[-1], dtype="<u8").astype(np.int64)
    assert len(lengths) == docs
    return np.concatenate(ids) if ids else np.zeros(0, dtype="<u4"), lengths


FILES = "part int, file int, n_ids long, doc_ids array<long>, data binary"


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, blanks: bool = False, file_ids: int = 1 << 18, block: int = 1 << 15, bits: bool = True, level: int = 1) -> None:
    """Writes the documents' ids, each followed by end_id, as a table of files in ascending doc_id order (null first).

    Each row of the table is one file in the format of pack(): whole documents,
    file_ids ids or a little more.  part and file order the files.  A null text
    is empty: its ids are the end_id alone.  Equal doc_ids lie side by side, in
    the order of the table, by which the rows of one doc_id (or of none) can be
    dealt to several tasks.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, file, schema = TaskContext.get().partitionId(), 0, pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list = []
        n = 0

        def flush() -> pa.RecordBatch:
            raw = pack(np.concatenate(held), np.concatenate(lengths), block, bits, level)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file], pa.int32()), pa.array([n], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([raw], pa.binary())], schema=schema)

        encode = encoder(vocabulary, blanks).encode
        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for chunk in chunks(batch.column(1), BYTES):
                ids, of = encode(chunk)
                own = of[1:] - of[:-1] + 1
                held.append(np.insert(ids, of[1:], end_id))
                lengths.append(own)
                names += ids_of[chunk.first : chunk.first + len(chunk)]
                n += int(own.sum())
                if n >= file_ids:
                    yield flush()
                    held, lengths, names, n, file = [], [], [], 0, file + 1
        if names:
            yield flush()

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("at"))
    ordered = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    ordered.mapInArrow(files, FILES).write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from a table of files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = unpack(batch.column(2)[row].as_py())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                k = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[row].as_py()] * k, pa.int32()), pa.array([batch.column(1)[row].as_py()] * k, pa.int32()), batch.column(3)[row].values, pa.array(ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "file", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_of_part"))
    places = files.select(F.col("part").alias("_p"), F.col("file").alias("_f"), F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("_of_file"))
    places = places.join(parts, F.col("_p") == F.col("_part")).withColumn("_start", F.col("_of_file") + F.col("_of_part"))
    docs = files.select("part", "file", "data", "doc_ids").mapInArrow(rows, "part int, file int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    docs = docs.join(places, (docs.part == F.col("_p")) & (docs.file == F.col("_f")))
    return docs.select("doc_id", (F.col("inside") + F.col("_start")).alias("start"), "n_tokens", "ids_crc32")
