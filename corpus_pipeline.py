"""The corpus pipeline: each stage's Parquet is the next one's documents.

Every stage takes any number of documents, null values in any column, empty and very long texts, repeated rows, an empty
table, and further columns of any name, which stay as they are. All but the last return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evispark.llm import decontaminate, mixing, neardup, quality_rules, queries, secrets
from evispark.llm.common import drop, result_of, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the quality rules reject go.

    Null, empty and blank texts go, having too few words; null languages and sources are groups with fences of their own;
    of repeated rows all stay or all go; a value on a fence is inside.
    """
    return quality_rules.keep_good(docs)


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: of each near-duplicate class the document of the least id stays; a null id counts as the least.

    Null texts and texts without words are classes of their own and stay; of rows equal in id and words one stays.
    """
    return neardup.near_duplicate_free(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents go that share a window with a benchmark item and have a word in twenty hit, or more.

    Null and empty texts have no words and stay; an empty benchmark hits nothing; of repeated rows all stay or all go.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: every document stays, and in its text each secret is replaced by a mark of its kind; null texts stay null."""
    return secrets.redact(docs, queries.frequent_words())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a row for each copy that the mix takes, its number in mix_epoch (mix_epoch_2 where that name is taken).

    Null and empty texts have no words to take and go; repeated rows are documents of their own; of ties at a source's cut
    the lower id comes first, and equal rows share what is left; the copy at the cut keeps its first words.
    """
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("near-duplicates", deduplication), ("decontamination", decontamination), ("secrets", secret_redaction), ("mixing", mixture)]

#: Weighted min-wise signatures have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus. Of what is written on the way, only one stage's result and its successor's tables stand at once; the last one stays until common.discard(), at exit at the latest."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = result_of(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
        if k:
            drop(docs)
        docs = out
    return docs
