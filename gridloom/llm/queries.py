"""The queries op1_ to op10_ over the driver's tables: each applies one operator with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langmodel, mixing, ngram_join, packing, quality, sharding, substring, tokens, topk, vector_dedup
from .tables import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), k=5, percent=75)


def op2_impact_ordered_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op3_bloom_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmodel.score(_table(spark, sf_dir, "documents"))


def op4_cross_polytope_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.dedup(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op5_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    tokens.write(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokens.read(spark.read.schema(tokens.FILES).parquet(path))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("turns")


def op7_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, room=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, _table(spark, sf_dir, "labels")).drop("text")


def op9_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "shards")
    placed = sharding.resharded(_table(spark, sf_dir, "documents"), path)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old")


def op10_automaton_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
        op1_ngram_jaccard_join,
        op2_impact_ordered_top_k,
        op3_bloom_language_model,
        op4_cross_polytope_dedup,
        op5_bit_plane_ids,
        op6_source_mixing,
        op7_genetic_packing,
        op8_factorisation_machine,
        op9_flow_resharding,
        op10_automaton_substring_dedup,
    )}
ORACLE_SQL: dict[str, str] = {"op6_source_mixing": mixing.ORACLE_SQL}
