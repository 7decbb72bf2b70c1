"""Every dealt operator on a small table with edge cases, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm import langmodel, mixing, ngram_join, packing, quality, sharding, substring, tables, text, tokens, topk, vector_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
#: Extra columns whose names the operators use within.
EXTRA = "uid long, `set` string, key string, TEXT string, shard int, spans string, _uid long, score double, rank int, bucket int"


def made(n, rng, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    rng = random.Random(7)
    base, passage = made(300, rng), made(60, rng)
    texts = [None, "", " \t\n", "one", "One two\tthree", "one two three", base, base, base.upper(), base + " tail", passage, made(90, rng) + " " + passage + " " + made(90, rng), passage + " " + made(400, rng)]
    words = base.split()
    for k in range(12):  # near copies of near copies
        words = list(words)
        words[(k * 23) % 300] = f"x{k}"
        texts.append(" ".join(words))
    texts += ["a b " * 60, "ab  c　d   e <|endoftext|> f", "naïve Ünïcode ÄÖ " * 5, made(5000, rng), "same words again and again here"]
    return [(i, t, "en", None if i % 5 == 4 else f"s{i % 5}", len(t or "")) for i, t in enumerate(texts)] + [(6, base, "en", "s1", len(base))]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return spark.createDataFrame([r + (0, "x", "x", "other", 0, "x", 0, 0.0, 0, 0) for r in rows], f"{SCHEMA}, {EXTRA}").repartition(3, "doc_id")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def words_of(t):
    return WORD.findall(t or "")


def test_words_and_hashes():
    import pyarrow as pa

    texts = [r[1] for r in documents()]
    for most in (1, 1000, 1 << 20):
        got = []
        for chunk in text.chunks(pa.array(texts), most):
            starts, ends, of = chunk.words()
            every = [chunk.text(a, b).decode() for a, b in zip(starts, ends)]
            got += [every[of[i] : of[i + 1]] for i in range(len(chunk))]
        assert got == [words_of(t) for t in texts]


def test_ngram_join(docs, none):
    rows = documents()
    sets = []
    for r in rows:
        w = words_of((r[1] or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    top = {r[0]: r[0] for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                top[max(x, y)] = min(x, y)
    got = ngram_join.join(docs, range_bytes=500).collect()
    assert Counter(tuple(r) for r in got) == Counter((r[0], len(s), find(r[0])) for r, s in zip(rows, sets))
    assert ngram_join.join(none).count() == 0
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(r[0] for r in left.select("doc_id").collect()) == sorted({find(r[0]) for r in rows})


def test_signatures_never_miss():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 7, 8, 15, 16, 31, 64, 100, 255, 256, 700, 3000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = ngram_join.bound(n, n, 75)
            drop, add = rng.integers(0, most + 1), 0
            add = rng.integers(0, most - drop + 1)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], rng.integers(0, 2**64, add, dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                assert np.intersect1d(ngram_join.signatures(a, 75), ngram_join.signatures(b, 75)).size
                x, y = ngram_join.bit_sketch(a), ngram_join.bit_sketch(b)
                k = min(len(x), len(y))
                apart = int(np.bitwise_count(ngram_join.folded(x, k) ^ ngram_join.folded(y, k)).sum())
                assert apart <= len(a) + len(b) - 2 * both


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (200, 200), (100, 101)]
    got = {r["id"]: r["component"] for r in tables.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100}
    assert tables.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        v = rng.standard_normal(64)
        rows.append((i, (v / np.linalg.norm(v)).astype(np.float32).tolist(), int(i % 3)))
    for i in range(400, 500):  # near copies in a chain, and exact copies
        v = np.array(rows[i - 40][1]) + rng.standard_normal(64) * (0.012 if i % 2 else 0.0)
        rows.append((i, v.astype(np.float32).tolist(), rows[i - 40][2]))
    rows += [(500, None, 1), (501, [float("nan")] * 64, 1), (502, [0.0] * 64, 1), (503, [None] + [1.0] * 63, 1), (504, rows[0][1], None), (505, [1.0, 2.0], 1), (506, [float("inf")] * 64, 1), (7, rows[7][1], 1), (507, [0.0, 1.0], 1), (508, [-0.0, 2.0], 1), (509, [-0.0, 1.0], 1)]
    return rows


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([r + (0, 0) for r in vectors()], "vec_id long, embedding array<float>, label int, level int, EMBEDDING int").repartition(3)


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("few", [1, 64])
def test_top_k(embeddings, few):
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(np.int64)) for i, v, _ in vectors() if usable(v)]
    want = []
    for q, x in rows:
        if q % 50 == 0:
            scored = sorted((-int(x[: min(len(x), len(y))] @ y[: min(len(x), len(y))]), c) for c, y in rows if c != q)[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(scored, 1)]
    ints = tables.kept(topk.integers(embeddings), "ints")
    got = topk.search(topk.build(ints, 90), ints.where("vec_id % 50 = 0"), 5, query_block=4, few=few)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    again = topk.search(topk.build(ints, 7), ints.where("vec_id % 50 = 0"), 5, query_block=1000, few=few)
    assert sorted(map(tuple, again.collect())) == sorted(want)
    assert topk.top_k(embeddings.limit(0)).count() == 0
    assert topk.top_k(embeddings.where("vec_id in (0, 3)")).count() == 1


def test_top_k_of_odd_vectors(spark):
    """Vectors of no component score 0, repeated rows are rows, great components are exact, a query alone finds nothing."""
    rows = [(0, []), (1, [1.0]), (2, [1.0]), (2, [1.0]), (50, [1e6, -2.0]), (3, [-1e6, 3.0])]
    ints = {i: [np.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50):
        scored = sorted((-int(sum(int(a) * int(b) for a, b in zip(ints[q], [int(x) for x in ints[c]]))), c) for c, _ in rows if c != q)[:5]
        want += [(q, k, c, -s) for k, (s, c) in enumerate(scored, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_size=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(spark.createDataFrame(rows[:1], "vec_id long, embedding array<double>")).count() == 0


def test_vector_dedup(embeddings, monkeypatch):
    monkeypatch.setattr(vector_dedup, "PART", 3)
    rows = vectors()
    n, top = Counter(), {r[0]: r[0] for r in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    good = [(k, i, np.array(v, dtype=np.float32).astype(float), c) for k, (i, v, c) in enumerate(rows) if usable(v) and any(v) and c is not None]
    for a, (ka, ia, x, ca) in enumerate(good):
        for kb, ib, y, cb in good[:a]:
            if ca == cb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[ka] += 1
                n[kb] += 1
                p, q = find(ia), find(ib)
                top[max(p, q)] = min(p, q)
    want = Counter((i, n[k], find(i), find(i) == i) for k, (i, _, _) in enumerate(rows))
    assert Counter(map(tuple, vector_dedup.dedup(embeddings).collect())) == want
    assert vector_dedup.dedup(embeddings.where("false")).count() == 0


def test_language_model_beyond_the_broadcast_bound(docs):
    """The filter keeps its bits for each entry, and scores do not depend on how it is reached."""
    rows = tables.pick(docs, "text")
    ranges = langmodel.count(rows, range_bytes=1 << 10)
    entries = sum(sum(j * n for j, n in enumerate(r["means"][2 * k])) for r in ranges.collect() for k in range(2))
    assert sum(r["size"] for r in ranges.collect()) >= 8 * entries > 1 << 12
    want, got = (sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in langmodel.score(docs, most_bits=most).collect()) for most in (1 << 29, 1 << 12))
    assert got == want and len(got) == len(documents())
    with pytest.raises(ValueError):
        langmodel.segment([(np.arange(2000, dtype=np.uint64), np.ones(2000))], 1.5, 8.0, 1 << 12)


def test_language_model_sends_each_block_once(spark, monkeypatch):
    """Beyond the broadcast bound texts go in large compressed blocks, which ask and count in one shuffle."""
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, made(300, rng)) for i in range(1500)], "doc_id long, text string").coalesce(1)
    made_tables, kept = {}, langmodel.kept
    monkeypatch.setattr(langmodel, "kept", lambda df, name: made_tables.setdefault(name, kept(df, name)))
    got = langmodel.score(docs, most_bits=1 << 12)
    assert got.count() == 1500 and "lm-counts" not in made_tables
    blocks = made_tables["lm-blocks"]
    assert blocks.count() == 1  # before: one for each 256 KB
    assert blocks.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] < 0.7 * docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]


def test_narrow_numbers():
    for values in ([], [0], [255, 0], [256], [2**64 - 1, 3]):
        values = np.array(values, dtype=np.uint64)
        assert langmodel.widened(langmodel.narrow(values)).tolist() == values.tolist()


@pytest.mark.parametrize("most_words", [6_000_000, 10])
def test_language_model(docs, none, most_words):
    rows = documents()
    spoken = [[*words_of((r[1] or "").translate(FOLD)), "\n"] for r in rows]
    out = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    counts = Counter(w for t, o in zip(spoken, out) if not o for w in t)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((r[0], o, len(t), sum(counts[w] > 0 for w in t), total, round(sum(log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t), 6)) for r, t, o in zip(rows, spoken, out))
    got = langmodel.score(docs, most_words=most_words).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert langmodel.score(none).count() == 0


def test_scores_against_exact_counts(docs):
    """With a filter too wide for chance hits a score is that of the quantised counts, worked out by hand."""
    rows = documents()
    spoken = [[*words_of((r[1] or "").translate(FOLD)), "\n"] for r in rows]
    out = [zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows]
    single, double = Counter(), Counter()
    for t, o in zip(spoken, out):
        if not o:
            single.update(t)
            double.update(zip(["\n", *t], t))

    def quantised(counts):
        level = {w: 1 + int(np.floor(np.log(c) / np.log(1.5) + 1e-9)) for w, c in counts.items()}
        mean = {q: np.mean([counts[w] for w in counts if level[w] == q]) for q in set(level.values())}
        return {w: max(m for q, m in mean.items() if q <= level[w]) for w in counts}

    one, two = quantised(single), quantised(double)
    floor = sum(single.values()) + 0.1 * (len(single) + 1)

    def p(h, w):
        c = one.get(h, 0.0)
        a = 0.2 if c else 0.0
        return a * min(two.get((h, w), 0.0), c) / max(c, 1) + (1 - a) * (one.get(w, 0.0) + 0.1) / floor

    want = sorted((r[0], round(sum(log10(p(h, w)) for h, w in zip(["\n", *t], t)), 4)) for r, t in zip(rows, spoken))
    got = langmodel.score(docs, bits_each=400.0).collect()
    assert sorted((r.doc_id, round(r.score, 4)) for r in got) == want


def test_filter_counts():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64, 20000, dtype=np.uint64))
    counts = rng.integers(1, 200, len(keys))
    packed, size = langmodel.segment([(keys, counts)], 1.5, 10.0, 1 << 30)
    q = langmodel.levels(counts, 1.5)
    means = np.bincount(q, weights=counts) / np.maximum(np.bincount(q), 1)
    lm = langmodel.Counts(63, packed, np.zeros(2, dtype=np.int64), np.full(2, size), [means, means], 1, 1, None, 0.2)
    got = lm.probe(keys, 1)
    assert (got >= means[q] - 1e-9).all() and (got == means[q]).mean() > 0.97
    unseen = rng.integers(0, 2**64, 20000, dtype=np.uint64)
    assert (lm.probe(unseen, 1) > 0).mean() < 0.03


def test_new_pieces_are_encoded_as_one_text():
    """As the whole text is, whatever its blanks, letters and added tokens; pieces after blanks take one call for thousands."""
    rng = random.Random(3)
    odd = ["", " ", "a\n", " a  b\t\tc \n\n d ", "x<|endoftext|>y z", " <|endoftext|> ", "it's 'll don't", "caf\u00e9 \u4f60\u597d \U0001f600\U0001f600 e\u0301", "\x1c a\x1f b\x00 c", "a\u00a0b \u2003 c", "1234 5,6.7 --- ..."]
    texts = odd + [rng.choice((" ", "\n", "  ")).join(f"{rng.randrange(1 << 30):x}" for _ in range(300)) for _ in range(10)]
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    calls, direct = [], encoder.direct
    encoder.direct = lambda own: calls.append(len(own)) or direct(own)
    for most in (1 << 20, 1):
        for chunk in text.chunks(pa.array(texts), most):
            ids, of = encoder.encode(chunk)
            for i in range(len(chunk)):
                assert ids[of[i] : of[i + 1]].tolist() == direct([texts[chunk.first + i].encode()])[0]
        encoder.forget()
    calls.clear()
    (chunk,) = text.chunks(pa.array(texts[len(odd) :]))
    encoder.encode(chunk)
    assert sum(calls) <= 1 + 10  # before: one for each of some 3,000 pieces


def test_runs_of_plain_words_are_encoded_as_one_text():
    """As the whole text is, whatever its cases, signs, marks, contractions and added tokens; each run once, thousands in one call."""
    rng = random.Random(5)
    odd = ["", " ", "\n a\t\tB ", "Don't DON'T it's's !'s 'll'd' rock'n'roll", "x<|endoftext|>Y <|ENDOFTEXT|> <|startoftext|><a></w> b</w>", "a1b22 3.14,15 x_y--z...*** #|", "\u00c9t\u00e9 \u00c4\u00d6### \u00df$$$ a\u00d7b \u00bd\u00b2 \u00aa. \u0130stanbul I\u0307."]
    odd += ["e\u0301# E\u0301. h\u0331 H\u0331 \u1e96 \u00fc\u0304 \u0304a", "\u0391\u03a3.\u0392 \u039f\u0394\u039f\u03a3 \u03b1\u0374 \u0395\u03bb\u03bb\u03ac\u03b4\u03b1.", "\u041f\u0440\u0438\u0432\u0435\u0442, \u041c\u0418\u0420!1 \u0438\u0306", "\u4f60\u597d,\U0001f600. a\u2014b a\u00a0b\u2003 c\u0085d", "\x1ca \x1fB\x00c\x7f D\x07"]
    letters = "abcXYZ019.,*'<|>-\u00e9\u00c9\u00df\u0130\u0301\u03a3\u03c3\u0416\u01c5\u00d7 \u00a0\u4f60\x1c\n"
    odd += ["".join(rng.choices(letters, k=rng.randrange(40))) for _ in range(500)]
    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), False)
    calls, direct = [], encoder.direct
    encoder.direct = lambda own: calls.append(len(own)) or direct(own)
    whole = direct([t.encode() for t in odd])
    for most in (1 << 20, 300, 1):
        for chunk in text.chunks(pa.array(odd), most):
            ids, of = encoder.encode(chunk)
            for i in range(len(chunk)):
                assert ids[of[i] : of[i + 1]].tolist() == whole[chunk.first + i]
        encoder.forget()
    cut = [b"a#\xc3", b"\xa9#b \xe9 #\xc3 \x80#", b"\xc3\xa9#\xa9#"]  # no UTF-8
    ids, of = encoder.encode(text.Chunk(np.frombuffer(b"".join(cut), dtype=np.uint8), np.cumsum([0, *map(len, cut)]), 0))
    assert [ids[a:b].tolist() for a, b in zip(of, of[1:])] == direct(cut)
    calls.clear()
    words = ["".join(rng.choices("abcdefgh\u00e9", k=8)) for _ in range(1000)]
    (chunk,) = text.chunks(pa.array([" ".join(w + end for w in words for end in (".", ",", "***", "")), " ".join(words).title()]))
    encoder.encode(chunk)
    assert sum(calls) <= 1100  # before: one for each of 5,000 words; the title's letters outside ASCII are not folded


def test_token_files(docs, none, spark, tmp_path):
    path, rows = public_tokenizers.path("word_bpe_49k.json"), sorted(documents(), key=lambda r: r[0])
    tokenizer = Tokenizer.from_file(path)
    ids = [[*e.ids, 1] for e in tokenizer.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]
    start, want = 0, []
    for r, own in zip(rows, ids):
        want.append((r[0], start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    for bits in (True, False):
        at = str(tmp_path / f"ids{bits}")
        tokens.write(docs, at, path, 1, file_ids=500, block=64, bits=bits)
        got = sorted(map(tuple, tokens.read(spark.read.schema(tokens.FILES).parquet(at)).collect()), key=lambda r: (r[0], r[1]))
        assert got == want
    tokens.write(none, str(tmp_path / "none"), path, 1)
    assert tokens.read(spark.read.schema(tokens.FILES).parquet(str(tmp_path / "none"))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
@pytest.mark.parametrize("bits", [True, False])
def test_planes_round_trip(n, bits):
    ids = np.random.default_rng(n).integers(0, [200, 70000, 2**32][n % 3], n, dtype=np.uint64).astype("<u4")
    got, lengths = tokens.unpack(tokens.pack(ids, np.array([n]), 16, bits, 3))
    assert (got == ids).all() and lengths.tolist() == [n]


def test_packing(docs, none):
    path, room = public_tokenizers.path("byte_bpe_50k.json"), 64
    tokenizer = Tokenizer.from_file(path)
    want = Counter()
    total = 0
    for r in documents():
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        many = -(-len(ids) // room)
        cuts = [0, *[len(ids) - (many - 1 - k) * room for k in range(many)]]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
        total += len(ids)
    got = packing.pack(docs, path, 2, room, with_ids=True).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    assert len(bins) <= -(-total // room) + 2
    assert packing.pack(none, path, 2, room).count() == 0


def test_genetic_packing_beats_plain_best_fit(spark):
    rng = random.Random(2)
    length = [rng.randrange(1, 64) for _ in range(600)]
    bins, fill = [], []
    packing.best_fit(sorted(range(600), key=lambda i: -length[i]), length, bins, fill, 64)
    best = packing.evolve(length, [], 64, 6, 20, random.Random(1))
    assert sorted(i for own in best[0] for i in own) == list(range(600))
    assert all(sum(length[i] for i in own) == f <= 64 for own, f in zip(*best))
    assert len(best[0]) <= len(bins)
    items = spark.createDataFrame(list(enumerate(length)), "uid long, length int")
    got = packing.arrange(items, 64, group_size=100)
    again = packing.arrange(items, 64, group_size=100)
    assert got.count() == 600 and got.select("sequence_id").distinct().count() <= len(bins) + 6
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_mixing(docs, none):
    rows = documents()
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in rows)
    sizes, target, taken = {}, {}, Counter()
    for r in got:
        sizes[r.source], target[r.source] = r.source_size, r.target
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.taken == r.size * r.turns
    total = sum(sizes.values())
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    free = [s for s in order if target[s] < 2 * sizes[s]]
    assert len({round(target[s] / weights[s], 6) for s in free}) <= 1
    assert all(target[s] <= 2 * sizes[s] + 1e-9 for s in order)
    assert mixing.mix(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() >= sum(r.turns for r in got)


def test_quality(docs, none, spark):
    rng = random.Random(4)
    rows = [(i, made(40, rng) if i % 2 else " | ".join(made(1, rng) for _ in range(40))) for i in range(400)] + [(900, None), (901, "")]
    texts = spark.createDataFrame([r + (1.0,) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    got = quality.classify(texts, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.97 * len(held)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.classify(none, labels).count() == 0
    few = quality.train(texts, labels.where("doc_id < 400"), sample_bytes=60_000)  # about a hundred rows' features
    assert 0.3 < 1 / (1 + np.exp(-few.bias)) < 0.7 and few.linear.any() and not quality.train(texts, labels.where("doc_id < 400"), sample_bytes=10).linear.any()
    bare = quality.classify(texts, labels.where("false")).first()
    assert bare.score == 0.5


def test_scored_as_trained(spark):
    """A text's score is that of its words with their repeats summed."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    n = 64 + quality.STATS * quality.CELLS + quality.STATS
    m = quality.Model(64, 0.1, rng.standard_normal(n) * 0.1, rng.standard_normal((n, 6)) * 0.3)
    texts = ["one two three " * 50, "one two three", None, "a b a"]
    want = []
    for t in texts:
        f = quality.features(next(iter(text.chunks(pa.array([t])))), 64)
        x = np.zeros(n)
        np.add.at(x, f.index, f.value)
        want.append(1 / (1 + np.exp(-(0.1 + m.linear @ x + 0.5 * (((m.factors.T @ x) ** 2).sum() - ((m.factors * x[:, None]) ** 2).sum())))))
    got = quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), m).collect()
    assert np.allclose([r._score for r in sorted(got, key=lambda r: r.doc_id)], want, atol=1e-5)


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    m = quality.Model(8, 0.3, rng.standard_normal(40), rng.standard_normal((40, 3)))
    index, value = np.array([1, 5, 5, 30]), np.array([0.5, 1.0, 2.0, -1.0])
    want = 0.3 + (m.linear[index] * value).sum()
    for i in range(4):
        for j in range(i):
            want += m.factors[index[i]] @ m.factors[index[j]] * value[i] * value[j]
    got = m.raw(quality.Features(index, value, np.array([0, 4])))
    assert abs(got[0] - want) < 1e-9


def test_sharding(docs, none, spark, tmp_path):
    rows = documents()
    placed = sharding.place(docs, shards=4, old_shards=3)
    got = placed.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.place(none).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = [r["n"] for r in sharding.place(many, 10, old_shards=7).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 300
    _, affected = sharding.rewrite(many, str(tmp_path / "shards"), 10, old=sharding._present(7))
    assert affected == list(range(10)) and sharding.read_shards(spark, str(tmp_path / "shards")).count() == 3000


def test_rewrite_leaves_other_shards_alone(spark, tmp_path):
    """One document too many in shard 0 goes to shard 1; the files of shards 2 and 3 stay, and so does what a reader sees of them."""
    import os

    at, rows = str(tmp_path / "store"), [(i, "x" * 84, i // 10, "kept") for i in range(40)] + [(40, "x" * 84, 0, "kept")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, home int, SHARD string")
    first = docs.where("doc_id < 40").select("doc_id", "text", "home", F.col("home").alias("_old"), F.col("doc_id").alias("slot"), F.col("home").alias("shard"))
    sharding.commit(first, at, [0, 1, 2, 3])
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(at) for f in names if f.endswith(".parquet") and "/shard=" in d}
    before = files()
    placed, affected = sharding.rewrite(docs, at, 4, old=F.col("home"), capacities=[1000, 1100, 1000, 1000])
    assert affected == [0, 1] and placed.count() == 41
    after = files()
    assert {f: t for f, t in after.items() if f in before} == before and set(after) > set(before)
    assert all("/shard=0/" in f or "/shard=1/" in f for f in set(after) - set(before))
    got = sharding.read_shards(spark, at)
    assert got.where("shard in (2, 3)").count() == 20 and sorted(r.doc_id for r in got.select("doc_id").collect()) == list(range(41))
    # A rewrite that died before its manifest is not seen.
    first.withColumn("shard", F.lit(0)).write.partitionBy("shard").parquet(f"{at}/files/version=7")
    assert sharding.read_shards(spark, at).count() == 41


def test_shard_files(docs, spark, tmp_path):
    """The files hold every row once, repeated rows and null doc_ids too, and the result is what is read from them."""
    rows = [(i, "x" * (i % 97)) for i in range(600)] + [(7, None), (7, ""), (None, "lost"), (None, "lost"), (None, None), (6, "other"), (6, "other")]
    few = spark.createDataFrame(rows, "doc_id long, text string")
    few.write.parquet(str(tmp_path / "in"))
    want = Counter(rows)
    for k, given in enumerate((few, spark.read.parquet(str(tmp_path / "in")))):
        at = str(tmp_path / f"shards{k}")
        got = sharding.resharded(given, at, 4, old_shards=3).collect()
        files = sharding.read_shards(spark, at).collect()
        assert Counter((r.doc_id, r.text) for r in files) == want
        key = lambda r: (r.doc_id, r.shard, r.slot)
        assert Counter(map(key, files)) == Counter(map(key, got))
        for s in range(4):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    placed, affected = sharding.rewrite(docs, str(tmp_path / "again"), 4, old=sharding._present(3))  # names that differ in case alone
    texts, where = {(r[0], len((r[1] or "").encode()) + 16): r[1] for r in documents()}, placed.where(F.col("shard").isin(affected)).collect()
    assert placed.count() == len(documents())
    assert Counter((r.doc_id, r.text, r.shard) for r in sharding.read_shards(spark, str(tmp_path / "again")).collect()) == Counter((r.doc_id, texts[r.doc_id, r["size"]], r.shard) for r in where)


def test_resharding_shuffles_whole_rows_once(spark, tmp_path):
    """A row finds its shard and slot by itself, as it was placed, and no join on files and rows shuffles its text."""
    rng = random.Random(8)
    rows = [(rng.choice((None, 7, i)), rng.choice(("", "same", made(rng.randrange(60), rng)))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = sharding._located(spark.read.parquet(str(tmp_path / "docs")), ["doc_id", "text"])
    docs = docs.select("*", (F.octet_length("text") + 16).cast("long").alias("size"), sharding._present(5).alias("old"))
    placed = tables.kept(sharding.reshard(docs.drop("text"), 7), "placements")
    affected = [0, 2, 3, 4, 6]
    moved = sharding._moved(docs, placed, affected)
    name = lambda d: sorted((r["_file"], r["_row"], r["shard"], r["slot"]) for r in d.collect())
    assert name(moved) == name(placed.where(F.col("shard").isin(affected)))
    plan = moved._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "SortMergeJoin" not in plan


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(20):
        supply = [rng.randrange(1, 1000) for _ in range(rng.randrange(1, 7))]
        capacity = sharding.even(sum(supply), rng.randrange(1, 9))
        flow = sharding.cheapest_flow(supply, capacity, lambda i, j: int(i != j))
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(len(supply))] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= c for k, c in enumerate(capacity))
        stay = sum(min(s, capacity[i]) for i, s in enumerate(supply) if i < len(capacity))
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - stay


@pytest.mark.parametrize("shard_words, broadcast", [(50, 0), (50, 1 << 23), (120_000, 0), (120_000, 1 << 23), (120_000, 1 << 19)])
def test_substring(docs, none, shard_words, broadcast):
    """Routed runs, broadcast automata, and automata that turn out too large to be broadcast."""
    rows = documents()
    spoken, counts = [words_of(r[1]) for r in rows], Counter()
    for w in spoken:
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = Counter()
    for r, w in zip(rows, spoken):
        gone = set()
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        want[r[0], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()] += 1
    got = substring.dedup(docs, 35, shard_words, broadcast).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    assert Counter(map(tuple, got)) == want
    assert substring.dedup(none).count() == 0
    assert substring.without_repeats(docs).columns == docs.columns


def test_no_home_of_runs_exceeds_a_shard(spark, monkeypatch):
    """A passage that all documents share is spread; what is cut stays the same."""
    rng = random.Random(5)
    passage = made(60, rng)
    rows = [(i, made(20, rng) + " " + passage + " " + made(20, rng) + (" " + passage[: 40 * (i % 3)] if i % 2 else "")) for i in range(150)] + [(1000, made(90, rng)), (1001, "p q " * 40)]
    texts = spark.createDataFrame(rows, "uid long, text string").repartition(3)
    runs = substring.routed(texts, 35, 4000).groupBy("home").agg(F.sum(F.octet_length("words")).alias("n")).collect()
    assert all(r.n <= 8 * 4000 for r in runs if r.home >= 0) and any(r.n > 8 * 4000 for r in runs if r.home < 0)
    spoken, counts = [(i, words_of(t)) for i, t in rows], Counter()
    for _, w in spoken:
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = {i: sum(any(counts[tuple(w[k : k + 35])] > 1 for k in range(max(0, at - 34), min(at, len(w) - 35) + 1)) for at in range(len(w))) for i, w in spoken}
    for most, few in ((4000, 1_000_000), (4000, 0), (120_000, 0)):
        monkeypatch.setattr(substring, "FEW_WINDOWS", few)
        got = substring.dedup(texts.withColumnRenamed("uid", "doc_id"), 35, most, 0).collect()
        assert {r.doc_id: r.n_removed for r in got} == want


def test_automaton_against_counting():
    rng = random.Random(9)
    for _ in range(200):
        k, n = rng.randrange(1, 5), rng.randrange(1, 6)
        runs = [[rng.randrange(2) for _ in range(rng.randrange(k, 12))] for _ in range(n)]
        counts = Counter(tuple(r[i : i + k]) for r in runs for i in range(len(r) - k + 1))
        got = substring.repeated(runs, k)
        assert [g.tolist() for g in got] == [[counts[tuple(r[i : i + k])] > 1 for i in range(len(r) - k + 1)] for r in runs]
