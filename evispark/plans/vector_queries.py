"""Vector retrieval and evidence fusion over the embeddings, every 20th of which is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import evidence_id
from ..operators import evidence as E
from ..operators import graph_paths as G
from ..operators import vectors as V
from .projections import GRAPH_SQL, packed_edges, requests, table

K, REACH = 10, 60


def vectors(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("vec_id").cast("string")
    return table(spark, d, "embeddings").select(F.concat(F.lit("chunk:vec:"), text).alias("chunk_id"), F.concat(F.lit("paper:vec:"), (F.col("vec_id") % 20).cast("string")).alias("paper_version_id"), F.concat(F.lit("section-"), F.col("label").cast("string")).alias("section_type"), F.when(F.col("vec_id") % 7 == 0, "old").otherwise("current").alias("vector_generation_fingerprint"), F.col("embedding").alias("vector"), "vec_id", "label")


def queries_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def _first_query(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").orderBy("vec_id").first()["embedding"]


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.top_k(vectors(spark, d), _first_query(spark, d), K).select("chunk_id", F.round("score", 6).alias("score"))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return V.top_k(vectors(spark, d), _first_query(spark, d), K, {"paper_version_id": "paper:vec:3"}).select("chunk_id", "section_type", F.round("score", 6).alias("score"))


def hits(spark: SparkSession, d: str) -> DataFrame:
    return V.top_k_batch(vectors(spark, d), queries_of(spark, d), K)


def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.concat(F.lit("chunk:vec:"), F.col("user_id").cast("string")).alias("chunk_id"))
    return V.lookup(vectors(spark, d), asked).select("chunk_id", "paper_version_id", "vector_generation_fingerprint")


def generation_count(spark: SparkSession, d: str) -> DataFrame:
    return V.generation_counts(vectors(spark, d))


def stale_delete(spark: SparkSession, d: str) -> DataFrame:
    """Versions whose number is even are at generation `current`; others have no current one."""
    v = vectors(spark, d)
    current = v.select("paper_version_id").distinct().where(F.substring_index("paper_version_id", ":", -1).cast("int") % 2 == 0).withColumn("generation", F.lit("current"))
    return V.delete_stale(v, current).select("chunk_id", "paper_version_id", "vector_generation_fingerprint")


def text_evidence(spark: SparkSession, d: str) -> DataFrame:
    met = hits(spark, d).join(vectors(spark, d).select("chunk_id", "vector_generation_fingerprint"), "chunk_id")
    out = E.text_evidence(met, on_invalid="mark")
    return out.select("query_id", "evidence_id", "chunk_id", F.round("score", 6).alias("score"), "score_kind", "valid")


def beside(spark: SparkSession, d: str, v: DataFrame) -> DataFrame:
    """Rows of v with the queries of their label whose number is within REACH: candidates are named, so the join is on equal numbers."""
    asked = queries_of(spark, d).select("query_id", "query_label", F.explode(F.sequence(F.col("query_id") - REACH, F.col("query_id") + REACH)).alias("vec_id"))
    return v.join(asked, "vec_id").where("label = query_label")


def branches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vector hits; as graph items the 10 nearest numbers of the query's label within REACH, each supported by its own chunk and the next one's."""
    v = vectors(spark, d)
    name = lambda c: E.text_evidence_id(F.concat(F.lit("chunk:vec:"), c.cast("string")), F.lit("g"))
    vec = hits(spark, d).withColumn("evidence_id", name(F.substring_index("chunk_id", ":", -1))).select("query_id", "evidence_id", F.col("rank").alias("pos"))
    near = beside(spark, d, v).select("query_id", "vec_id", F.abs(F.col("vec_id") - F.col("query_id")).alias("gap"))
    near = near.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "vec_id"))).where(F.col("pos") <= K)
    even = F.col("vec_id") % 2 == 0
    graph = near.select("query_id", F.when(even, name(F.col("vec_id"))).otherwise(evidence_id(F.lit("graph_path"), F.col("vec_id").cast("string"))).alias("evidence_id"), "pos", F.array(name(F.col("vec_id")), name(F.col("vec_id") + 1)).alias("supporting_text_evidence_ids"))
    support = graph.select("query_id", F.posexplode("supporting_text_evidence_ids").alias("at", "evidence_id"), "pos").select("query_id", "evidence_id", (F.col("pos") * 10 + F.col("at")).alias("pos"))
    return vec, graph, support


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    out = E.fused(*branches(spark, d), top_k=K)
    return out.select("query_id", "evidence_id", F.round("fusion_score", 9).alias("fusion_score"), F.col("best_rank").cast("long").alias("best_rank"), F.array_join("branches", ",").alias("branches"), "cross_store_supported", F.col("position").cast("long").alias("position"))


def fusion_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    vec, graph, support = branches(spark, d)
    return E.fusion_diagnostics(vec, graph, support, E.fused(vec, graph, support, top_k=None))


def evidence_pool(spark: SparkSession, d: str) -> DataFrame:
    vec, graph, support = branches(spark, d)
    items = vec.unionByName(graph.select("query_id", "evidence_id", (F.col("pos") + 100).alias("pos"))).unionByName(support.withColumn("pos", F.col("pos") + 1000))
    return E.pool(items).select("query_id", "evidence_id", "label")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    vec, graph, _ = branches(spark, d)
    return vec.withColumn("round", F.lit(1)).unionByName(graph.select("query_id", "evidence_id", "pos").withColumn("round", F.lit(2)))


def round_merge(spark: SparkSession, d: str) -> DataFrame:
    return E.merged_rounds(_rounds(spark, d)).select("query_id", "evidence_id", F.array_join(F.col("retrieval_rounds").cast("array<string>"), ",").alias("rounds"), F.col("first_seen_round").cast("long").alias("first_seen_round"), F.col("pos").cast("long").alias("pos"))


def no_new_evidence(spark: SparkSession, d: str) -> DataFrame:
    vec, graph, _ = branches(spark, d)
    return E.new_evidence(graph, vec)


def _shared(spark: SparkSession, d: str) -> DataFrame:
    e = packed_edges(spark, d)
    out = G.ranked("shared_datasets", requests(spark, d, "paper"), None, e, limit=5).unionByName(G.ranked("paper_authors", requests(spark, d, "paper"), None, e, limit=5))
    rels = F.transform("rels", lambda r: F.struct(r["source_chunk_id"].alias("source_chunk_id"), r["supporting_chunk_ids"].alias("supporting_chunk_ids"), F.when(r["relationship_type"] == "authored_by", "metadata").otherwise("chunk").alias("provenance_type")))
    made = E.graph_provenance(rels)
    return out.select(F.col("start").alias("query_id"), "evidence_id", "operation", made["source_chunk_ids"].alias("source_chunk_ids"), made["provenance_type"].alias("provenance_type"), "path_confidence")


def graph_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _shared(spark, d).select("query_id", "evidence_id", "operation", F.array_join("source_chunk_ids", ",").alias("chunks"), "provenance_type", F.round("path_confidence", 6).alias("score"))


def provenance_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of lines that were neither returned nor accepted are missing from the store."""
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    store = table(spark, d, "lineitem").where("l_returnflag <> 'N'").select(F.concat_ws(":", F.lit("chunk:tpch"), *[F.col(k).cast("string") for k in keys]).alias("chunk_id"), F.lit("current").alias("vector_generation_fingerprint")).distinct()
    out = E.bridge(_shared(spark, d), store)
    return out.select("query_id", "evidence_id", F.array_join("supporting_text_evidence_ids", ",").alias("support"), F.array_join("warnings", ";").alias("warnings"), "provenance_complete")


NAMES = ["vector_topk", "vector_topk_filtered", "vector_topk_batch", "chunk_lookup", "generation_count", "stale_delete", "text_evidence", "graph_evidence", "provenance_bridge", "rrf_fusion", "fusion_diagnostics", "evidence_pool", "round_merge", "no_new_evidence"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_ID = "'evidence:' || substr(sha256('text|qdrant|chunk:vec:' || {} || '|g'), 1, 16)"
_HITS = """v AS (SELECT *, 'chunk:vec:' || vec_id AS chunk_id, 'paper:vec:' || (vec_id % 20) AS version, CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE 'current' END AS generation FROM embeddings),
q AS (SELECT vec_id AS query_id, embedding AS query, label AS query_label FROM embeddings WHERE vec_id % 20 = 0),
hits AS (SELECT query_id, chunk_id, vec_id, generation, list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]) AS score, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], query::DOUBLE[]) DESC, chunk_id) AS rank FROM v, q QUALIFY rank <= 10)"""
_BRANCHES = f"""WITH {_HITS},
vec AS (SELECT query_id, {_ID.format('vec_id')} AS id, rank AS pos FROM hits),
near AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS pos FROM v JOIN (SELECT query_id, query_label, unnest(range(query_id - {REACH}, query_id + {REACH} + 1)) AS asked FROM q) ON asked = vec_id AND label = query_label QUALIFY pos <= 10),
graph AS (SELECT query_id, CASE WHEN vec_id % 2 = 0 THEN {_ID.format('vec_id')} ELSE 'evidence:' || substr(sha256('graph_path|' || vec_id), 1, 16) END AS id, pos, {_ID.format('vec_id')} AS s0, {_ID.format('(vec_id + 1)')} AS s1 FROM near),
support AS (SELECT query_id, s0 AS id, pos * 10 AS pos FROM graph UNION ALL SELECT query_id, s1, pos * 10 + 1 FROM graph),
rows AS (SELECT query_id, id, 'vector' AS branch, pos AS rank FROM vec UNION ALL SELECT query_id, id, 'graph', pos FROM graph UNION ALL SELECT query_id, id, 'graph_support', NULL FROM support),
linked AS (SELECT DISTINCT g.query_id, g.id FROM graph g JOIN vec v ON v.query_id = g.query_id AND (v.id = g.s0 OR v.id = g.s1)),
fused AS (SELECT r.query_id, r.id, sum(coalesce(1.0 / (60 + rank), 0)) AS score, min(rank) AS best_rank, array_to_string(list_sort(list(DISTINCT branch)), ',') AS branches, (r.query_id, r.id) IN (SELECT (query_id, id) FROM linked) AS linked FROM rows r GROUP BY r.query_id, r.id)"""


def oracle_sql() -> dict[str, str]:
    first = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
    score = f"round(list_cosine_similarity(embedding::DOUBLE[], {first}::DOUBLE[]), 6)"
    shared = f"""{GRAPH_SQL},
raw AS MATERIALIZED (SELECT s.id AS start, 'shared_datasets' AS operation, 'graph_path' AS kind, s.id AS n1, m.id AS n2, x.id AS n3, e.rid AS r1, f.rid AS r2, row_number() OVER (PARTITION BY s.id ORDER BY m.id, x.id) AS place FROM nodes s JOIN edges e ON e.src = s.id JOIN nodes m ON m.id = e.dst JOIN edges f ON f.dst = m.id JOIN nodes x ON x.id = f.src WHERE s.kind = 'paper' AND e.type = 'evaluated_on' AND f.type = 'evaluated_on' AND x.id <> s.id QUALIFY place <= 5
  UNION ALL SELECT s.id, 'paper_authors', 'graph_relationship', s.id, m.id, NULL, e.rid, NULL, 1 FROM nodes s JOIN edges e ON e.src = s.id JOIN nodes m ON m.id = e.dst WHERE s.kind = 'paper' AND e.type = 'authored_by'),
shared AS MATERIALIZED (SELECT start AS query_id, operation, 'evidence:' || substr(sha256(concat_ws('|', kind, operation, n1, n2, n3, r1, r2)), 1, 16) AS evidence_id, list_concat(coalesce(e.chunks, []), coalesce(f.chunks, [])) AS each, CASE WHEN operation = 'paper_authors' THEN 'metadata' ELSE 'chunk' END AS provenance_type, least(e.conf, coalesce(f.conf, e.conf)) AS score FROM raw JOIN edges e ON e.rid = r1 LEFT JOIN edges f ON f.rid = r2),
graph AS (SELECT * EXCLUDE each, list_filter(each, lambda x, i: list_position(each, x) = i) AS chunks FROM shared)"""
    return {
        "vector_topk": f"SELECT 'chunk:vec:' || vec_id AS chunk_id, {score} AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], {first}::DOUBLE[]) DESC, chunk_id LIMIT 10",
        "vector_topk_filtered": f"SELECT 'chunk:vec:' || vec_id AS chunk_id, 'section-' || label AS section_type, {score} AS score FROM embeddings WHERE vec_id % 20 = 3 ORDER BY list_cosine_similarity(embedding::DOUBLE[], {first}::DOUBLE[]) DESC, chunk_id LIMIT 10",
        "vector_topk_batch": f"WITH {_HITS} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits",
        "chunk_lookup": f"WITH {_HITS} SELECT chunk_id, version AS paper_version_id, generation AS vector_generation_fingerprint FROM v WHERE vec_id IN (SELECT user_id FROM events)",
        "generation_count": f"WITH {_HITS} SELECT version AS paper_version_id, generation AS vector_generation_fingerprint, count(*) AS points FROM v GROUP BY ALL",
        "stale_delete": f"WITH {_HITS} SELECT chunk_id, version AS paper_version_id, generation AS vector_generation_fingerprint FROM v WHERE vec_id % 20 % 2 = 1 OR generation = 'current'",
        "text_evidence": f"WITH {_HITS}, h AS (SELECT *, score BETWEEN -1e-9 AND 1 + 1e-9 AS valid FROM hits) SELECT query_id, CASE WHEN valid THEN 'evidence:' || substr(sha256('text|qdrant|' || chunk_id || '|' || generation), 1, 16) END AS evidence_id, chunk_id, round(CASE WHEN valid THEN greatest(0, least(1, score)) ELSE score END, 6) AS score, CASE WHEN valid THEN 'vector_similarity' END AS score_kind, valid FROM h",
        "graph_evidence": f"{shared} SELECT query_id, evidence_id, operation, array_to_string(chunks, ',') AS chunks, provenance_type, round(score, 6) AS score FROM graph",
        "provenance_bridge": f"""{shared}, store AS (SELECT DISTINCT 'chunk:tpch:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS chunk FROM lineitem WHERE l_returnflag <> 'N'),
          wanted AS (SELECT query_id, evidence_id, unnest(chunks[:5]) AS c, generate_subscripts(chunks[:5], 1) AS i FROM graph),
          met AS (SELECT w.query_id, w.evidence_id, string_agg('evidence:' || substr(sha256('text|qdrant|' || c || '|current'), 1, 16), ',' ORDER BY i) FILTER (s.chunk IS NOT NULL) AS support, string_agg('missing chunk ' || c, ';' ORDER BY i) FILTER (s.chunk IS NULL) AS lost FROM wanted w LEFT JOIN store s ON s.chunk = w.c GROUP BY ALL),
          done AS (SELECT g.query_id, g.evidence_id, coalesce(support, '') AS support, CASE WHEN len(chunks) = 0 AND provenance_type = 'metadata' THEN 'metadata evidence has no chunk' ELSE coalesce(lost, '') END AS warnings FROM graph g LEFT JOIN met m ON m.query_id = g.query_id AND m.evidence_id = g.evidence_id)
          SELECT *, warnings = '' AS provenance_complete FROM done""",
        "rrf_fusion": f"{_BRANCHES} SELECT query_id, id AS evidence_id, round(score, 9) AS fusion_score, best_rank, branches, linked AS cross_store_supported, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(best_rank, 1000000), id) AS position FROM fused QUALIFY position <= 10",
        "fusion_diagnostics": f"{_BRANCHES}, n AS (SELECT query_id, count(*) FILTER (branch = 'vector') AS vector_candidates, count(*) FILTER (branch = 'graph') AS graph_candidates, count(*) FILTER (branch = 'graph_support') AS support_candidates FROM rows GROUP BY 1), u AS (SELECT query_id, count(*) AS unique_items, count(*) FILTER (linked) AS cross_store_links FROM fused GROUP BY 1) SELECT *, vector_candidates + graph_candidates + support_candidates - unique_items AS duplicates FROM n JOIN u USING (query_id)",
        "evidence_pool": f"{_BRANCHES}, items AS (SELECT query_id, id, pos FROM vec UNION ALL SELECT query_id, id, pos + 100 FROM graph UNION ALL SELECT query_id, id, pos + 1000 FROM support), one AS (SELECT query_id, id, min(pos) AS pos FROM items GROUP BY 1, 2) SELECT query_id, id AS evidence_id, 'E' || row_number() OVER (PARTITION BY query_id ORDER BY pos) AS label FROM one",
        "round_merge": f"{_BRANCHES}, r AS (SELECT query_id, id, 1 AS round, pos FROM vec UNION ALL SELECT query_id, id, 2, pos FROM graph) SELECT query_id, id AS evidence_id, array_to_string(list_sort(list(DISTINCT round)), ',') AS rounds, min(round)::BIGINT AS first_seen_round, arg_min(pos, round * 1000 + pos) AS pos FROM r GROUP BY 1, 2",
        "no_new_evidence": f"{_BRANCHES} SELECT g.query_id, count(*) FILTER (v.id IS NULL) AS new_items FROM (SELECT DISTINCT query_id, id FROM graph) g LEFT JOIN vec v ON v.query_id = g.query_id AND v.id = g.id GROUP BY 1",
    }
