"""The corpus pipeline, stage by stage, on a small table with planted cases; and joins on hot keys."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm import packing, tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def words(n, rng):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: clean prose, junk, a group of near copies, a passage that two documents share, rows without words."""
    rng = random.Random(11)
    clean = [words(rng.randrange(60, 200), rng) for _ in range(300)]
    base, passage = words(150, rng), words(50, rng)
    near = [base.replace(base.split()[k], f"x{k}", 1) for k in range(5, 15)]
    shared = [words(80, rng) + " " + passage + " " + words(80, rng) for _ in range(2)]
    junk = [" | ".join("$#" * 3 for _ in range(40)) for _ in range(120)]
    texts = clean + near + shared + junk + [None, "", "  ", clean[0], clean[0]]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(20, clean[20], "en", "s1", 5), (None, words(70, rng), "en", "s1", 9)]
    labels = [(i, int(i < 312), 0) for i in range(len(clean) + 12 + len(junk))] + [(5, None, 0), (None, 1, 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def kept_by(spark, folder, *names):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for n in names:
        docs = tables.kept(STAGES[n](spark, docs, folder[0]), n)
    return docs


def test_classifier_drops_junk_and_keeps_clean_documents(spark, folder):
    got = {r.doc_id for r in kept_by(spark, folder, "quality_classifier").collect()}
    assert len(got & set(range(312))) >= 300 and len(got & set(range(312, 432))) <= 3
    assert kept_by(spark, folder, "quality_classifier").columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_near_duplicates_leaves_one_of_each_group(spark, folder):
    rows = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id < 312 or doc_id >= 432 or doc_id is null")
    got = Counter(r.doc_id for r in STAGES["near_duplicates"](spark, rows, folder[0]).collect())
    # Near copies 300 to 309 are one group; 435 and 436 repeat 0; the second row of 20 goes; rows without words or doc_id stay.
    assert got == Counter([*range(301), 310, 311, 432, 433, 434, None])


def test_repeated_passages_go(spark, folder):
    rows = spark.read.parquet(f"{folder[0]}/documents.parquet").where("doc_id in (310, 311, 1, 432)")
    got = {r.doc_id: r for r in STAGES["repeated_passages"](spark, rows, folder[0]).collect()}
    assert [len((got[i].text or "").split()) for i in (310, 311, 1, 432)] == [160, 160, len(folder[1][1][1].split()), 0]
    assert got[310].n_chars == len(got[310].text) and got[432].text is None


def test_source_mix_takes_documents_without_words_once(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    got = Counter(r.doc_id for r in STAGES["source_mix"](spark, docs, folder[0]).collect())
    assert [got[i] for i in (432, 433, 434)] == [1, 1, 1] and max(got.values()) <= 4
    size = Counter({r[0]: len((r[1] or "").split()) for r in folder[1]})
    total = sum(len((r[1] or "").split()) for r in folder[1])
    assert abs(sum(size[i] * n for i, n in got.items()) - 1.5 * total) <= 400


def test_whole_pipeline(spark, folder):
    """Every piece of what the stages before have kept, its ids, and sequences without gaps."""
    got = corpus_pipeline.run(spark, folder[0]).collect()
    assert got and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    ids = {r.doc_id for r in got}
    assert not ids & set(range(301, 310)) and len(ids & set(range(312, 432))) <= 3 and len(ids & set(range(301))) >= 150


@pytest.mark.parametrize("case", ["empty", "one", "nulls", "repeated"])
def test_every_stage_on_edge_tables(spark, folder, case):
    rows = {"empty": [], "one": [(1, "a few plain words", "en", "s", 5)], "nulls": [(None, None, None, None, None)] * 3, "repeated": [(4, "so it goes " * 30, "en", "s", 5)] * 6}[case]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], f"{SCHEMA}, score double, TEXT string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder[0])
        n = out.count()
        assert n <= 2 * len(rows) and (name == "packed_sequences" or out.columns == docs.columns)
        assert case != "empty" or n == 0


def test_a_store_of_the_run_is_deleted(spark, folder, tmp_path):
    from gridloom.plans import scratch

    before = len(scratch._made)
    with scratch.scope():
        tables.kept(spark.range(3), "x")
        path = scratch._made[-1][1]
    import os

    assert len(scratch._made) == before and not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("bytes_", [16 << 20, 1 << 10, 1])
@pytest.mark.parametrize("each", [64, None])
def test_hot_join(spark, monkeypatch, bytes_, each):
    """Whether all keys, some or none are broadcast, the join is the same."""
    monkeypatch.setattr(tables, "FEW_BYTES", bytes_)
    keys = [0] * 500 + [1] * 60 + list(range(2, 60)) + [99]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    counts = Counter(keys)
    right = spark.createDataFrame([(k, n, f"v{k}") for k, n in counts.items() if k != 99] + [(77, 0, "none")], "own int, n int, v string")
    got = tables.hot_join(left, right, "k", "own", "n", len(keys), each).select("i", "v").collect()
    assert sorted(map(tuple, got)) == [(i, f"v{k}") for i, k in enumerate(keys) if k != 99]


@pytest.mark.parametrize("bytes_", [16 << 20, 1 << 8])
def test_components_of_a_hub(spark, monkeypatch, bytes_):
    monkeypatch.setattr(tables, "FEW_BYTES", bytes_)
    edges = [(1000, i) for i in range(1, 300)] + [(i, i + 1) for i in range(2000, 2040)]
    got = {r["id"]: r["component"] for r in tables.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in [*range(1, 300), 1000]} | {i: 2000 for i in range(2000, 2041)}


def test_islands_gain_on_hard_groups(spark):
    """Ninety pieces of a sixth to a half of a sequence: crossovers find fewer sequences than best fit and than any first individual."""
    rng, room = random.Random(4), 1000
    length = [rng.randrange(150, 500) for _ in range(90)]
    plain, least = len(packing.falling(length, room)[0]), packing.lower_bound(length, room)
    chance = random.Random(1)
    first = min(len(packing.falling(length, room, lambda i: chance.uniform(0.93, 1.0))[0]) for _ in range(24))
    best = packing.evolve(length, [], room, 24, 80, random.Random(1), idle=40)
    assert sorted(i for own in best[0] for i in own) == list(range(90)) and all(f <= room for f in best[1])
    assert least <= len(best[0]) < min(plain, first)
    assert packing.lower_bound([600] * 5, 1000) == 5 and packing.lower_bound([400] * 5, 1000) == 3 and packing.lower_bound([], 10) == 0
    items = spark.createDataFrame(list(enumerate(length)), "uid long, length int")
    got = packing.arrange(items, room, population=24, effort=300_000).collect()
    assert len(got) == 90 and len({r.sequence_id for r in got}) < plain
