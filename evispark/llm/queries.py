"""The corpus operators as registered queries, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, hmm, langid, merkle, mixing, neardup, quality_gam, quality_rules, secrets, tokencount, trie, urlfilter
from .common import ADDED, part_of, table
from .sql import oracle_sql  # noqa: F401  for __spark_entry__

#: Files of public tokenizers; their places are parameters.
VOCABULARY = os.environ.get("EVISPARK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
WORD_VOCABULARY = os.environ.get("EVISPARK_WORD_VOCABULARY", "/opt/tokenizers/word_bpe_49k.json")


@cache
def frequent_words() -> list[str]:
    return secrets.ranked_words(WORD_VOCABULARY, VOCABULARY)


def added(*names: str) -> list:
    return [F.col(ADDED + n).alias(n) for n in names]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    digest = F.sha2(F.concat_ws(",", ADDED + "items").cast("binary"), 256)
    return seen.select("doc_id", *added("n_words", "n_hit"), F.size(ADDED + "items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", *added("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.planned(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col(ADDED + "spans")
    base = F.sha2(secrets.listed(spans, ("assign", "access", "hex")).cast("binary"), 256)
    counts = [secrets.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"], frequent_words()).select("doc_id", *counts, base.alias("base_sha256"), secrets.listed(spans).alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.trained(langid.training_rows(docs))
    held = F.coalesce(part_of("doc_id", 4) == 2, F.lit(False))
    return langid.predicted(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), *added("lang_pred", "score"))


def op6_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_gam.trained(docs, labels.where(part_of("doc_id", 3) != 1))
    held = F.coalesce(part_of("doc_id", 3) == 1, F.lit(False))
    out = quality_gam.scored(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), *added("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokencount.pieces_of(VOCABULARY)
    return tokencount.counted(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"]).select("doc_id", *added("n_words", "n_tokens", "n_unknown"))


def op10_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = hmm.scored(docs, ~hmm.held_out(), ["doc_id"]).withColumnRenamed("k_doc_id", "doc_id")
    return out.select("doc_id", hmm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), urlfilter.default_rules(spark), ["page_id"]).select("page_id", *added("host", "path", "rule", "verdict"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda n_chars: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = table(spark, sf_dir, "documents")
    made = merkle.manifest(docs.select(merkle.group_of(F.col("lang")).alias("grp"), leaf(F.col("n_chars")).alias("node"), F.when(tampered, leaf(F.col("n_chars") + 1)).alias("shown"), "doc_id"), ["doc_id"])
    rows = made.proofs().withColumn("steps", merkle.steps_of(F.col("path")))
    rows = rows.withColumn("folded_root", merkle.folded(merkle.hex_of(F.coalesce("shown", "node")), F.col("steps")))
    return rows.select("doc_id", merkle.hex_of(F.col("node")).alias("leaf"), merkle.hex_of(F.col("subroot")).alias("subroot"), F.lit(made.root).cast("string").alias("root"), merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lit(made.root).cast("string")).alias("verified"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n.startswith("op") and callable(f)}
