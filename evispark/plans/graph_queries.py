"""Graph retrieval over every entity of the start's type, as evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph_paths as G
from .projections import GRAPH_SQL, made_nodes, nodes, packed_edges, requests

LIMIT = 20
STARTS = {"papers_for_method": "method", "papers_for_dataset": "dataset", "papers_for_task": "task", "methods_for_dataset": "dataset"}


def shown(out: DataFrame) -> DataFrame:
    return out.select("start", F.col("rank").cast("long").alias("rank"), "evidence_id", "evidence_type", F.array_join("entity_ids", ">").alias("entity_path"), F.array_join("relationship_ids", ">").alias("relationship_path"), F.array_join("source_chunk_ids", ",").alias("chunks"), F.round("path_confidence", 6).alias("confidence"), "text", "paper_id")


def _query(operation: str, depth: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return shown(G.ranked(operation, requests(spark, d, STARTS.get(operation, "paper")), None, packed_edges(spark, d), depth=depth, limit=LIMIT))

    return run


def _raw_sql(operation: str, depth: int) -> str:
    """start, place, n1..n3, r1, r2: all paths of all starts, cut at the limit."""
    shape, kind, end = G.OPERATIONS[operation]
    one = f"SELECT s.id AS start, s.id AS n1, x.id AS n2, NULL AS n3, e.rid AS r1, NULL AS r2, row_number() OVER (PARTITION BY s.id ORDER BY {{order}}) AS place FROM nodes s JOIN edges e ON {{on}} JOIN nodes x ON {{to}} WHERE s.kind = '{STARTS.get(operation, 'paper')}' AND e.type = '{kind}' AND x.kind = '{end}' QUALIFY place <= {LIMIT}"
    two = f"SELECT s.id AS start, s.id AS n1, m.id AS n2, x.id AS n3, e.rid AS r1, f.rid AS r2, row_number() OVER (PARTITION BY s.id ORDER BY {{order}}) AS place FROM nodes s JOIN edges e ON {{on}} JOIN nodes m ON {{mid}} JOIN edges f ON {{then}} JOIN nodes x ON {{to}} WHERE s.kind = '{STARTS.get(operation, 'paper')}' AND {{where}} QUALIFY place <= {LIMIT}"
    if shape == "outgoing":
        return one.format(on="e.src = s.id", to="x.id = e.dst", order="e.conf DESC, x.id")
    if shape == "incoming":
        return one.format(on="e.dst = s.id", to="x.id = e.src", order="e.conf DESC, x.id")
    if shape == "shared":
        return two.format(on="e.src = s.id", mid="m.id = e.dst", then="f.dst = m.id", to="x.id = f.src", where=f"e.type = '{kind}' AND f.type = '{kind}' AND m.kind = '{end}' AND x.kind = 'paper' AND x.id <> s.id", order="m.id, x.id")
    if shape == "citing":
        return two.format(on="e.dst = s.id", mid="m.id = e.src", then="f.src = m.id", to="x.id = f.dst", where=f"e.type = 'cites' AND f.type = '{kind}' AND m.kind = 'paper' AND x.kind = '{end}'", order="x.id, m.id")
    if shape == "through_paper":
        return two.format(on="e.dst = s.id", mid="m.id = e.src", then="f.src = m.id", to="x.id = f.dst", where=f"e.type = 'evaluated_on' AND f.type = '{kind}' AND m.kind = 'paper' AND x.kind = '{end}'", order="x.id, m.id")
    if depth == 1:
        branches = [one.format(on="e.src = s.id", to="x.id = e.dst", order="x.id"), one.format(on="e.dst = s.id", to="x.id = e.src", order="x.id")]
    else:
        where = "e.type = 'cites' AND f.type = 'cites' AND m.kind = 'paper' AND x.kind = 'paper' AND e.rid <> f.rid"
        branches = [two.format(on="e.src = s.id", mid="m.id = e.dst", then="f.src = m.id", to="x.id = f.dst", where=where, order="m.id, x.id"), two.format(on="e.dst = s.id", mid="m.id = e.src", then="f.dst = m.id", to="x.id = f.src", where=where, order="m.id, x.id")]
    return f"SELECT * EXCLUDE (place, branch, within), row_number() OVER (PARTITION BY start ORDER BY branch, within) AS place FROM (SELECT *, 0 AS branch, place AS within FROM ({branches[0]}) UNION ALL SELECT *, 1, place FROM ({branches[1]})) QUALIFY place <= {LIMIT}"


def _sql(operation: str, depth: int) -> str:
    kind = "CASE WHEN r2 IS NULL THEN 'graph_relationship' ELSE 'graph_path' END"
    label = lambda a: f"{a}.kind || ':' || {a}.shown"
    return f"""{GRAPH_SQL},
found AS ({_raw_sql(operation, depth)}),
full_paths AS (SELECT p.start, {kind} AS evidence_type,
   'evidence:' || substr(sha256(concat_ws('|', {kind}, '{operation}', n1, n2, n3, r1, r2)), 1, 16) AS evidence_id,
   concat_ws('>', n1, n2, n3) AS entity_path, concat_ws('>', r1, r2) AS relationship_path,
   least(e.conf, coalesce(f.conf, e.conf)) AS confidence, CASE WHEN r2 IS NULL THEN 1 ELSE 2 END AS hops,
   list_concat(coalesce(e.chunks, []), coalesce(f.chunks, [])) AS all_chunks,
   CASE WHEN r2 IS NULL THEN upper(a.kind[1]) || a.kind[2:] || ' ''' || a.shown || ''' ' || replace(e.type, '_', ' ') || ' ' || b.kind || ' ''' || b.shown || '''.'
     ELSE 'Graph path: ' || {label('a')} || ' -> ' || {label('b')} || ' -> ' || {label('c')} || '.' END AS text,
   CASE WHEN a.kind = 'paper' THEN a.id WHEN b.kind = 'paper' THEN b.id WHEN c.kind = 'paper' THEN c.id END AS paper_id
  FROM found p JOIN nodes a ON a.id = n1 JOIN nodes b ON b.id = n2 LEFT JOIN nodes c ON c.id = n3 JOIN edges e ON e.rid = r1 LEFT JOIN edges f ON f.rid = r2)
SELECT start, row_number() OVER (PARTITION BY start ORDER BY hops, confidence DESC, evidence_id) AS rank, evidence_id, evidence_type, entity_path, relationship_path,
  array_to_string(list_filter(all_chunks, lambda x, i: list_position(all_chunks, x) = i), ',') AS chunks, round(confidence, 6) AS confidence, text, paper_id FROM full_paths"""


def lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every node's name in upper case finds its node."""
    n = nodes(spark, d)
    names = n.select(F.upper("canonical_name").alias("name"), "entity_type").distinct()
    return G.lookup_by_name(names, n, LIMIT).select("asked", "asked_type", "entity_id", F.col("place").cast("long").alias("place"))


def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    out = G.neighbourhood(requests(spark, d, "paper"), None, packed_edges(spark, d))
    return out.select("start", "relationship_id", "relationship_type", "target_entity_id", "target_type", "target_name", F.round("confidence", 6).alias("confidence"))


def context(spark: SparkSession, d: str) -> DataFrame:
    starts = made_nodes(spark, d).select(F.col("entity_id").alias("start"))
    return G.context(starts, None, packed_edges(spark, d)).select("start", "direction", "relationship_id", "relationship_type", "entity_id", "entity_type", "canonical_name")


def ambiguity(spark: SparkSession, d: str) -> DataFrame:
    """Bare part names stand for several datasets; one asked name is unknown."""
    from .projections import table

    p = table(spark, d, "part")
    known = p.select(F.col("p_name").alias("canonical_name"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("dataset").alias("entity_type"))
    names = p.select(F.upper("p_name").alias("name")).union(p.sparkSession.createDataFrame([("no such part",)], "name string")).distinct().withColumn("entity_type", F.lit("dataset"))
    return G.resolution(names, known).select("name", "status", F.array_join("candidates", ",").alias("candidates"))


def queries() -> dict:
    out = {f"graph_{op}": _query(op, 1) for op in G.OPERATIONS if op != "citation_neighborhood"}
    out |= {f"graph_citation_neighborhood_d{k}": _query("citation_neighborhood", k) for k in (1, 2)}
    return out | {"graph_entity_lookup_by_name": lookup, "graph_paper_neighborhood": neighbourhood, "graph_entity_context": context, "graph_resolution_ambiguity": ambiguity}


def oracle_sql() -> dict[str, str]:
    out = {f"graph_{op}": _sql(op, 1) for op in G.OPERATIONS if op != "citation_neighborhood"}
    out |= {f"graph_citation_neighborhood_d{k}": _sql("citation_neighborhood", k) for k in (1, 2)}
    return out | {
        "graph_entity_lookup_by_name": f"{GRAPH_SQL}, names AS (SELECT DISTINCT upper(name) AS asked, kind AS asked_type FROM nodes) SELECT asked, asked_type, id AS entity_id, row_number() OVER (PARTITION BY asked, asked_type ORDER BY kind, id) AS place FROM names JOIN nodes ON lower(asked) = lower(name) AND asked_type = kind QUALIFY place <= {LIMIT}",
        "graph_paper_neighborhood": f"{GRAPH_SQL} SELECT s.id AS start, rid AS relationship_id, type AS relationship_type, dst AS target_entity_id, x.kind AS target_type, x.name AS target_name, round(conf, 6) AS confidence FROM nodes s JOIN edges ON src = s.id JOIN nodes x ON x.id = dst WHERE s.kind = 'paper'",
        "graph_entity_context": f"{GRAPH_SQL} SELECT s.id AS start, 'outgoing' AS direction, rid AS relationship_id, type AS relationship_type, x.id AS entity_id, x.kind AS entity_type, x.name AS canonical_name FROM nodes s JOIN edges ON src = s.id JOIN nodes x ON x.id = dst UNION ALL SELECT s.id, 'incoming', rid, type, x.id, x.kind, x.name FROM nodes s JOIN edges ON dst = s.id JOIN nodes x ON x.id = src",
        "graph_resolution_ambiguity": "WITH names AS (SELECT DISTINCT upper(p_name) AS name FROM part UNION SELECT 'no such part'), hits AS (SELECT name, 'part:' || p_partkey AS id FROM names JOIN part ON lower(name) = lower(p_name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY id) <= 2) SELECT n.name, CASE count(h.id) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, coalesce(array_to_string(list_sort(list(h.id) FILTER (h.id IS NOT NULL)), ','), '') AS candidates FROM names n LEFT JOIN hits h ON h.name = n.name GROUP BY n.name",
    }
