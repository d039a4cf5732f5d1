"""Vector retrieval: filtered cosine top-k, one or many queries, lookups, counts and stale deletes.

A single query is JVM-side arithmetic with a take-ordered plan. Many queries are one scan: a block of query vectors within
a byte bound is broadcast, each Arrow batch is met slice by slice in matrix products of a bounded number of scores, each
task keeps its best k for each query, and a group-limited window joins the tasks' bests. Queries beyond one block come
block by block, each one's results written before the next is broadcast, so neither plan nor broadcasts grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ids import strip
from ..storage import new_path

#: Bytes of a block of query vectors; scores that a task holds at once.
QUERY_BYTES, CELLS = 16 << 20, 4 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, filters: dict[str, str] | None = None) -> DataFrame:
    """The k nearest by cosine, ties by chunk id; filters are equalities that reach the scan."""
    for column, value in (filters or {}).items():
        vectors = vectors.where(F.col(column) == value)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col("vector"), q)).orderBy(F.desc("score"), "chunk_id").limit(k)


def blocks_of(queries: DataFrame, most_bytes: int) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of queries(query_id, query), each within most_bytes; they stream through the driver."""
    ids, rows, size = [], [], 0
    for r in queries.toLocalIterator():
        ids.append(r.query_id)
        rows.append(np.asarray(r["query"], np.float64))
        size += rows[-1].nbytes
        if size >= most_bytes:
            yield ids, np.stack(rows)
            ids, rows, size = [], [], 0
    if ids:
        yield ids, np.stack(rows)


def nearer(score: np.ndarray, ident: np.ndarray, new: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each query's known and new scores, ties by name."""
    known, score = score.shape[1], np.concatenate((score, new), axis=1)
    if score.shape[1] > k:
        edge = np.partition(score, -k, axis=1)[:, -k]
        name = lambda r, j: ident[r, j] if j < known else names[j - known]
        order = np.array([sorted(np.flatnonzero(s >= e).tolist(), key=lambda j, r=r, s=s: (-s[j], name(r, j)))[:k] for r, (s, e) in enumerate(zip(score, edge))])
    else:
        order = np.broadcast_to(np.arange(score.shape[1]), score.shape)
    old = order < known
    kept = np.take_along_axis(ident, np.where(old, order, 0), 1) if known else np.empty(order.shape, object)
    return np.take_along_axis(score, order, 1), np.where(old, kept, names[np.where(old, 0, order - known)])


def searched(source: DataFrame, ids: list, matrix: np.ndarray, k: int, kind: pa.DataType, schema: str) -> DataFrame:
    """Each task's best k of source(chunk_id, vector) for one block of queries."""
    norms = np.linalg.norm(matrix, axis=1)
    shared = source.sparkSession.sparkContext.broadcast((ids, matrix / np.where(norms == 0, 1, norms)[:, None]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best_score, best_id = np.zeros((len(names), 0)), np.zeros((len(names), 0), object)
        rows = max(1, CELLS // len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                size = np.linalg.norm(v, axis=1)
                score = q @ (v / np.where(size == 0, 1, size)[:, None]).T
                best_score, best_id = nearer(best_score, best_id, score, np.array(part.column(0).to_pylist(), object), k)
        width = best_score.shape[1]
        for at in range(0, len(names) if width else 0, 10_000):
            own = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array([n for n in names[own] for _ in range(width)], kind), pa.array(best_id[own].ravel().tolist(), pa.string()), pa.array(best_score[own].ravel())], names=["query_id", "chunk_id", "score"])

    return source.mapInArrow(search, schema)


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query_id, chunk_id, score, rank): for every query the k nearest rows; equal scores go by chunk id."""
    spark, path = vectors.sparkSession, None
    source = vectors.select("chunk_id", "vector").where(F.col("vector").isNotNull())
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, chunk_id string, score double"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    blocks = blocks_of(queries, query_bytes)
    block, following = next(blocks, None), next(blocks, None)
    if block is None:
        return spark.createDataFrame([], schema + ", rank int")
    while block is not None:
        out = searched(source, *block, k, kind, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if following is None and path is None:
            return out
        path = path or new_path(spark, "vector-hits")
        out.write.mode("append").parquet(path)
        block, following = following, next(blocks, None)
    return spark.read.schema(schema + ", rank int").parquet(path)


def lookup(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose chunk id is asked for; absent ids are absent. Sort by chunk id where it is shown."""
    return vectors.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def generation_counts(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("paper_version_id", "vector_generation_fingerprint").agg(F.count("*").alias("points"))


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """By chunk id, the last write wins (new rows by `pos`)."""
    rest = [c for c in old.columns if c != "chunk_id"]
    rows = old.withColumn("pos", F.lit(-1).cast("long")).unionByName(new.withColumn("pos", F.col("pos").cast("long")))
    return rows.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), "pos").alias("last")).select("chunk_id", "last.*")


def delete_stale(vectors: DataFrame, current: DataFrame) -> DataFrame:
    """vectors without those whose generation differs from current(paper_version_id, generation) of their version."""
    met = vectors.join(current.select("paper_version_id", F.col("generation").alias("now")), "paper_version_id", "left")
    return met.where(F.coalesce(F.col("vector_generation_fingerprint") == F.col("now"), F.col("now").isNull())).drop("now")


def payloads(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """chunks met with what their papers add to a vector's payload: title, source, ids, categories and year."""
    own = papers.select("paper_id", F.col("title").alias("paper_title"), "source", "source_id", "categories", F.year("published_at").alias("published_year"))
    return chunks.join(own, "paper_id")


def check_compatible(dimension: int, metric: str, wanted_dimension: int, wanted_metric: str = "cosine") -> None:
    """A collection with another dimension or metric is an error, never made anew."""
    if dimension != wanted_dimension or metric != wanted_metric:
        raise ValueError(f"the collection has {dimension} dimensions and {metric}; {wanted_dimension} and {wanted_metric} are wanted")


def check_chunks(chunks: DataFrame, expected: int) -> DataFrame:
    """One row of precheck counts: rows, duplicate ids, blank texts, and whether all are as they must be."""
    out = chunks.agg(F.count("*").alias("rows"), (F.count("*") - F.count_distinct("chunk_id")).alias("duplicates"), F.count_if(F.coalesce(strip("text"), F.lit("")) == "").alias("blank"))
    return out.withColumn("ok", (F.col("rows") == expected) & (F.col("rows") > 0) & (F.col("duplicates") == 0) & (F.col("blank") == 0))
