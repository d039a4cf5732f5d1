"""Decision rules, metrics and the control plane over requests and results made from events, conversations and vectors."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import control, decisions, metrics
from . import vector_queries
from .projections import table

S = Settings()
N = len(decisions.INTENTS)
COVER = ["complete", "partial", "insufficient"]
STATUS = ["valid", "partially_valid", "invalid", "no_citations"]
FLOW = ["SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", "SUCCESS", *decisions.HARD_GATES]


def nth(values: list[str], index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _e():
    return F.col("event_id")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """An event is a request: its number gives the intent and what was resolved."""
    e = _e()
    ops = F.when(e % 5 == 0, F.array(F.lit("paper_methods"), F.lit("paper_tasks"))).when(e % 5 == 1, F.array(F.lit("paper_methods"), F.lit("paper_methods"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "events").select(e.alias("request_id"), nth(decisions.INTENTS, e).alias("intent"), ops.alias("requested_operations"), (e % 7 == 3).cast("int").alias("n_ambiguous"), (e % 11 == 5).cast("int").alias("n_missing"), F.when(e % 3 != 0, F.concat(F.lit("entity:"), F.col("user_id").cast("string"))).alias("entity_id"), F.when(e % 2 == 0, "paper").otherwise("method").alias("entity_type"))


def plan_table(spark: SparkSession, d: str) -> DataFrame:
    out = decisions.plans(requests(spark, d), decisions.intents(spark), S)
    return out.select(*[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) if c in ("graph_depth", "graph_limit", "vector_top_k") else F.col(c) for c in out.columns])


def judged(spark: SparkSession, d: str) -> DataFrame:
    e = _e()
    rows = table(spark, d, "events").select(e.alias("request_id"), nth(decisions.INTENTS, e).alias("intent"), (F.lit(1) + F.pmod(e.bitwiseXOR(F.lit(5)), F.lit(2))).cast("int").alias("graph_depth"), F.when(e % 4 == 0, 100).otherwise(20).alias("graph_limit"), (e % 3).cast("int").alias("n_text"), (F.floor(e / 3) % 3).cast("int").alias("n_graph"), F.when(e % 9 == 0, 50).otherwise(5).alias("vector_top_k"), (1 + F.floor(e / 2) % 2).cast("int").alias("round"))
    rows = rows.join(F.broadcast(decisions.intents(spark)), "intent", "left").drop("reason_code")  # one row an intent
    return decisions.sufficiency(rows, S)


def sufficiency_gates(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select("request_id", "intent", F.col("sufficient").cast("string").alias("sufficient"), "coverage", "refinement", "needs_model")


def refinement_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = decisions.refinements(judged(spark, d), S)
    return out.select("request_id", "next_strategy", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("next_vector_top_k", "next_graph_limit", "next_graph_depth")])


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Every turn with markers put into its text: a good one twice, an unknown one, a range and E0 by turns."""
    t = F.col("turn")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" [E"), (t % 4 + 1).cast("string"), F.lit("] ."), F.when(t % 3 == 0, " then [E1-E2] and [E0]").otherwise(""), F.lit(" also [E"), (t % 4 + 1).cast("string"), F.lit("] and [E"), (t % 6 + 1).cast("string"), F.lit("] ,"))
    return table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string")).alias("answer_id"), text.alias("text"), "conv_id", "turn").distinct()


def _context(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    each = answers(spark, d).select("answer_id", "conv_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n"))
    label = F.concat(F.lit("E"), F.col("n").cast("string"))
    item = F.concat(F.lit("ev"), F.col("n").cast("string"))
    context = each.where("n <= 5").select("answer_id", label.alias("label"), F.when((F.col("conv_id") % 5 == 0) & (F.col("n") == 2), "other").otherwise(item).alias("evidence_id"))
    pool = each.where("n <> 4").select("answer_id", label.alias("label"), item.alias("evidence_id"), ((F.col("conv_id") % 3 == 0) & (F.col("n") == 3)).alias("fatal"))
    return context, pool


def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    return decisions.markers(answers(spark, d)).select("answer_id", F.col("position").cast("long").alias("position"), "marker", "label")


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return decisions.resolved_markers(decisions.markers(answers(spark, d)), *_context(spark, d))


def marker_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("answer_id", F.col("position").cast("long").alias("position"), "marker", "reason", F.coalesce(F.col("citation_number").cast("long"), F.lit(0)).alias("citation_number"))


def answer_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return decisions.rewritten(answers(spark, d), _resolved(spark, d))


def _grounded(spark: SparkSession, d: str) -> DataFrame:
    e = _e()
    yes = lambda m, r=0: e % m == r
    return table(spark, d, "events").select(e.alias("request_id"), nth(FLOW, e).alias("status"), (~yes(6)).alias("sufficient"), (e % 4).cast("int").alias("n_evidence"), (e % 3).cast("int").alias("n_fatal"), nth(STATUS, F.floor(e / 5)).alias("validation_status"), (F.floor(e / 7) % 3).cast("int").alias("n_citations"), F.when(~yes(10), nth(decisions.INTENTS, e)).alias("intent"), nth(COVER, F.floor(e / 4)).alias("coverage"), (F.floor(e / 9) % 2).cast("int").alias("n_missing"), yes(4, 1).alias("provenance_gap"), yes(2).alias("cites_text"), yes(3).alias("cites_graph"), yes(5).alias("cites_path"), (~yes(8)).alias("semantic_coverage"), (~yes(7)).alias("structural_coverage"), (F.lit(1) + F.floor(e / 6) % 2).cast("int").alias("round"))


def grounding_gates(spark: SparkSession, d: str) -> DataFrame:
    return decisions.hard_gate(_grounded(spark, d)).select("request_id", "gate", "abstention")


def confidence_ladder(spark: SparkSession, d: str) -> DataFrame:
    return decisions.confidence(_grounded(spark, d)).select("request_id", "strong", "confidence", F.array_join("reasons", ",").alias("reasons"))


TARGETS = ["chunk", "entity", "relationship", "path", "paper"]


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases are query vectors; the strategies vector and graph return hits and the nearest numbers.

    Targets are the label mates beside the query, of a kind by their number: a vector is a chunk and an entity, two share
    a relationship, both make a path, and every 20th is of one paper.
    """
    v = vector_queries.vectors(spark, d)
    q = vector_queries.queries_of(spark, d)
    number = F.substring_index("chunk_id", ":", -1).cast("long")
    vec = vector_queries.hits(spark, d).select(F.col("query_id").alias("case_id"), F.lit("vector").alias("strategy"), "rank", "chunk_id", number.alias("vec_id"))
    near = v.join(q.select("query_id", F.explode(F.sequence(F.col("query_id") - 6, F.col("query_id") + 6)).alias("vec_id")), "vec_id").select(F.col("query_id").alias("case_id"), "vec_id", "chunk_id", F.abs(F.col("vec_id") - F.col("query_id")).alias("gap"))
    graph = metrics.ranked_within(near, ["case_id"], [F.col("gap"), F.col("vec_id")]).select("case_id", F.lit("graph").alias("strategy"), "rank", "chunk_id", "vec_id")
    paper = F.concat(F.lit("paper:vec:"), (F.col("vec_id") % 20).cast("string"))
    relationship = F.concat(F.lit("relationship:vec:"), F.floor(F.col("vec_id") / 2).cast("string"))
    signature = metrics.path_signature(F.array("chunk_id", paper), F.array(relationship))
    items = vec.unionByName(graph).withColumn("paper_id", paper).withColumn("entity_ids", F.array("chunk_id")).withColumn("relationship_ids", F.array(relationship)).withColumn("signature", signature).drop("vec_id")
    kind = nth(TARGETS, F.col("vec_id"))
    name = F.when(kind.isin("chunk", "entity"), F.col("chunk_id")).when(kind == "relationship", relationship).when(kind == "path", F.concat(F.lit("path:"), F.col("chunk_id"))).otherwise(paper)
    targets = vector_queries.beside(spark, d, v).select(F.col("query_id").alias("case_id"), kind.alias("target_type"), name.alias("target_id"), F.when(kind == "path", signature).alias("signature"))
    return items, targets, metrics.target_matches(items, targets)


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    items, targets, matches = _evaluation(spark, d)
    out = metrics.ranking_metrics(items, targets, matches, 5)
    return out.select("case_id", "strategy", F.col("hit").cast("long").alias("hit"), *[F.round(c, 9).alias(c) for c in ("reciprocal_rank", "precision", "recall", "ndcg")])


def structural_metrics(spark: SparkSession, d: str) -> DataFrame:
    items, targets, matches = _evaluation(spark, d)
    # every second item ends at the path of the next vector
    number = F.regexp_extract("chunk_id", "[0-9]+$", 0)
    following = F.concat(F.lit("path:"), F.regexp_replace("chunk_id", "[0-9]+$", ""), (number.cast("long") + 1).cast("string"))
    none = F.array().cast("array<string>")
    ends = metrics.endpoint(F.when(F.col("rank") % 2 == 0, F.array(F.lit("x"), following)).otherwise(none), none, F.col("entity_ids"))
    out = metrics.structural_metrics(items.withColumn("provenance_complete", F.col("rank") % 2 == 1).withColumn("endpoint", ends), targets, matches)
    return out.select("case_id", "strategy", *[F.coalesce(F.round(c, 9), F.lit(-1.0)).alias(c) for c in ("entity_recall", "relationship_recall", "exact_path_match", "endpoint_accuracy", "provenance_rate")])


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = _e()
    return table(spark, d, "events").select(F.floor(e / 3).alias("case_id"), nth(["vector", "graph", "hybrid"], e).alias("strategy"), F.col("event_type").alias("category"), (e % 5 != 0).alias("applicable"), (e % 4 == 0).cast("int").alias("hit"), F.round(F.col("value"), 2).alias("latency_ms"), ((e % 8) / 8).alias("recall"), (1 / (1 + e % 3)).alias("reciprocal_rank"), (e % 2 == 0).alias("correct"), (F.floor(e / 2) % 2 == 0).alias("citations_ok"))


def strategy_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return metrics.strategy_aggregate(_results(spark, d))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.latency_percentiles(_results(spark, d), ["strategy", "category"], "latency_ms")


def case_comparison(spark: SparkSession, d: str) -> DataFrame:
    return metrics.case_comparison(_results(spark, d))


def pairwise_wins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pairwise_wins(_results(spark, d).withColumnRenamed("strategy", "system"))


def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    e = _e()
    reason = metrics.failure_reason((e % 6).cast("int"), e % 5 == 1, e % 4 == 0)
    return metrics.failure_histogram(table(spark, d, "events").select(nth(["vector", "graph", "hybrid"], F.floor(e / 2)).alias("system"), reason.alias("reason")))


def illegal_transitions(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events in order are a job's statuses."""
    status = nth([*control.STATUS_CHAIN, "failed"], _e())
    moves = table(spark, d, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.struct("ts", "event_id").alias("pos"), "event_id")
    return control.illegal_transitions(moves).select("job_id", "event_id", "previous", "status")


def resume_points(spark: SparkSession, d: str) -> DataFrame:
    chain = [*control.STATUS_CHAIN, "failed"]
    jobs = table(spark, d, "events").select(_e().alias("job_id"), nth(chain, _e()).alias("status"), nth(control.STATUS_CHAIN, F.floor(_e() / 13)).alias("failed_stage"))
    return control.resume_points(jobs).select("job_id", "status", "next_stage")


def step_attempts(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.struct("ts", "event_id").alias("pos"), "event_id")
    return control.step_attempts(steps).select("event_id", "job_id", "stage", F.col("attempt").cast("long").alias("attempt"))


def stale_versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders' generations are their lines' statuses at last; what is stored is the order's own status."""
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_version_id"), F.col("o_orderstatus").alias("generation"))
    current = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("paper_version_id")).agg(F.max("l_linestatus").alias("generation"))
    return control.stale(stored, current)


def discovery_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order are results of one id, their part's last digit the version."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.concat(F.lit("v"), (F.col("l_partkey") % 10).cast("string")).alias("version"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"), "l_partkey", "l_suppkey")
    return control.deduplicated(rows).select("source_id", "version", F.col("l_partkey"), F.col("l_suppkey"), F.col("first_pos.l_linenumber").cast("long").alias("first_line"))


def date_range_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders of 1994 to 1996, of which cancelled ones (P) have no date."""
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("timestamp")).alias("published_at"))
    return control.in_dates(rows, datetime(1994, 1, 1), datetime(1996, 12, 31)).select("o_orderkey", F.year("published_at").cast("long").alias("published_year"))


def id_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers as ids, abstract URLs and PDF URLs by turns."""
    k = F.col("page_id")
    name = F.concat(F.lit("2401."), F.lpad(k.cast("string"), 5, F.lit("0")), F.when(k % 2 == 0, F.concat(F.lit("v"), (k % 9 + 1).cast("string"))).otherwise(""))
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://arxiv.org/abs/"), name)).when(k % 4 == 1, F.concat(F.lit("  http://www.arxiv.org/pdf/"), name, F.lit(".pdf"))).when(k % 4 == 2, F.concat(F.lit("http://export.arxiv.org/pdf/"), name, F.lit("/"))).otherwise(name)
    rows = table(spark, d, "pages").select("page_id", "url", raw.alias("raw"))
    return rows.select("page_id", control.normalised_id("raw")["source_id"].alias("source_id"), control.normalised_id("raw")["version"].alias("version"), control.trusted_url("raw").alias("trusted"), control.trusted_url("url").alias("own_url_trusted"))


NAMES = ["plan_table", "sufficiency_gates", "refinement_bounds", "marker_scan", "marker_resolution", "answer_rewrite", "grounding_gates", "confidence_ladder", "ranking_metrics", "structural_metrics", "strategy_aggregate", "latency_percentiles", "case_comparison", "pairwise_wins", "failure_histogram", "illegal_transitions", "resume_points", "step_attempts", "stale_versions", "discovery_dedup", "date_range_filter", "id_normalise"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _nth(values: list[str], index: str) -> str:
    return f"({_list(values)})[({index}) % {len(values)} + 1]"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def oracle_sql() -> dict[str, str]:
    D = decisions
    table_rows = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in (i, D.operation_of(i), D.strategy_of(i), D.reason_of(i))) + ")" for i in D.INTENTS)
    intents = f"t(intent, operation, strategy, reason_code) AS (VALUES {table_rows})"
    intent = _nth(D.INTENTS, "event_id")
    structural = f"intent NOT IN ('{D.SEMANTIC}', '{D.MIXED}', '{D.UNKNOWN}')"
    grow = "coalesce(operation IS NOT NULL AND ((operation = 'citation_neighborhood' AND graph_depth < 2) OR graph_limit < 100), false)"
    s = "(operation IS NOT NULL AND n_graph > 0)"
    judged = f"""WITH {intents}, r AS (SELECT event_id AS request_id, {intent} AS intent, 1 + xor(event_id, 5) % 2 AS graph_depth, CASE WHEN event_id % 4 = 0 THEN 100 ELSE 20 END AS graph_limit, event_id % 3 AS n_text, event_id // 3 % 3 AS n_graph, CASE WHEN event_id % 9 = 0 THEN 50 ELSE 5 END AS vector_top_k, 1 + event_id // 2 % 2 AS round FROM events),
      m AS (SELECT r.*, operation, strategy FROM r LEFT JOIN t USING (intent)), k AS (SELECT *, CASE WHEN n_text + n_graph = 0 THEN 'empty' WHEN {structural} THEN 'structural' WHEN intent = '{D.MIXED}' AND (NOT {s} OR n_text = 0) THEN 'mixed' ELSE 'model' END AS kind FROM m),
      j AS (SELECT *, CASE kind WHEN 'empty' THEN false WHEN 'structural' THEN {s} WHEN 'mixed' THEN false END AS sufficient,
        CASE kind WHEN 'empty' THEN 'insufficient' WHEN 'structural' THEN CASE WHEN {s} THEN 'complete' ELSE 'insufficient' END WHEN 'mixed' THEN 'partial' END AS coverage,
        CASE kind WHEN 'empty' THEN CASE WHEN strategy IN ('vector', 'hybrid') THEN 'vector_expansion' WHEN operation = 'citation_neighborhood' THEN 'graph_depth_expansion' ELSE 'none' END WHEN 'structural' THEN CASE WHEN {grow} THEN 'graph_depth_expansion' ELSE 'none' END
          WHEN 'mixed' THEN CASE WHEN n_text = 0 AND NOT {s} THEN 'hybrid_expansion' WHEN n_text = 0 THEN 'vector_expansion' WHEN {grow} THEN 'graph_depth_expansion' ELSE 'none' END END AS refinement, kind = 'model' AS needs_model FROM k)"""
    ev = lambda c: f"least(greatest({c} * 2, {c} + 1), {50 if c == 'vector_top_k' else 100})"
    answers = """a AS (SELECT DISTINCT conv_id || ':' || turn AS answer_id, conv_id, turn, coalesce(text, '') || ' [E' || (turn % 4 + 1) || '] .' || CASE WHEN turn % 3 = 0 THEN ' then [E1-E2] and [E0]' ELSE '' END || ' also [E' || (turn % 4 + 1) || '] and [E' || (turn % 6 + 1) || '] ,' AS text FROM conversations),
      l AS (SELECT *, regexp_extract_all(text, '\\[E[^\\]]*\\]') AS ms FROM a), m AS (SELECT answer_id, conv_id, unnest(ms) AS marker, generate_subscripts(ms, 1) - 1 AS position FROM l), s AS (SELECT *, CASE WHEN regexp_matches(marker, '^\\[E[1-9][0-9]*\\]$') THEN marker[2:-2] END AS label FROM m)"""
    resolved = f"""{answers}, v AS (SELECT *, TRY_CAST(label[2:] AS INTEGER) AS n FROM s), w AS (SELECT *, CASE WHEN label IS NULL THEN 'invalid_syntax' WHEN n > 5 THEN 'not_in_answer_context' WHEN n = 4 THEN 'not_in_evidence_pool' WHEN n = 2 AND conv_id % 5 = 0 THEN 'context_pool_mismatch' WHEN n = 3 AND conv_id % 3 = 0 THEN 'fatal_provenance' END AS reason FROM v),
      f AS (SELECT *, min(position) FILTER (reason IS NULL) OVER (PARTITION BY answer_id, label) AS first FROM w), z AS (SELECT *, CASE WHEN reason IS NULL THEN dense_rank() OVER (PARTITION BY answer_id, reason IS NULL ORDER BY first) END AS citation_number FROM f)"""
    flow = _nth(FLOW, "event_id")
    grounded = f"""g AS (SELECT event_id AS request_id, {flow} AS status, event_id % 6 <> 0 AS sufficient, event_id % 4 AS n_evidence, event_id % 3 AS n_fatal, {_nth(STATUS, 'event_id // 5')} AS validation_status, event_id // 7 % 3 AS n_citations, CASE WHEN event_id % 10 <> 0 THEN {intent} END AS intent, {_nth(COVER, 'event_id // 4')} AS coverage,
      event_id // 9 % 2 AS n_missing, event_id % 4 = 1 AS gap, event_id % 2 = 0 AS ct, event_id % 3 = 0 AS cg, event_id % 5 = 0 AS cp, event_id % 8 <> 0 AS sem, event_id % 7 <> 0 AS str, 1 + event_id // 6 % 2 AS round FROM events)"""
    gate = f"CASE {' '.join(f"WHEN status = '{k}' THEN '{v}'" for k, v in D.HARD_GATES.items())} WHEN NOT sufficient THEN 'insufficient_retrieval_evidence' WHEN n_evidence = 0 THEN 'empty_evidence' WHEN validation_status IN ('invalid', 'no_citations') THEN 'citation_validation_failed' WHEN n_citations = 0 THEN 'no_trusted_citations' WHEN n_fatal >= n_evidence THEN 'fatal_provenance' END"
    results = "r AS (SELECT event_id // 3 AS case_id, (['vector', 'graph', 'hybrid'])[event_id % 3 + 1] AS strategy, event_type AS category, event_id % 5 <> 0 AS applicable, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS hit, round(value, 2) AS latency_ms, (event_id % 8) / 8 AS recall, 1 / (1 + event_id % 3) AS reciprocal_rank, event_id % 2 = 0 AS correct, event_id // 2 % 2 = 0 AS citations_ok FROM events)"
    chain = [*control.STATUS_CHAIN, "failed"]
    status = _nth(chain, "event_id")
    steps = " OR ".join(f"(previous = '{a}' AND status = '{b}')" for a, b in zip(control.STATUS_CHAIN, control.STATUS_CHAIN[1:]))
    nxt = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in control.NEXT_STAGE.items() if v)
    from .vector_queries import _HITS, REACH

    evaluation = f"""WITH {_HITS}, near AS (SELECT query_id AS case_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS rank FROM v JOIN (SELECT query_id, unnest(range(query_id - 6, query_id + 7)) AS asked FROM q) ON asked = vec_id),
      items AS (SELECT query_id AS case_id, 'vector' AS strategy, rank, vec_id FROM hits UNION ALL SELECT case_id, 'graph', rank, vec_id FROM near),
      mates AS (SELECT query_id AS case_id, vec_id AS t, {_nth(TARGETS, 'vec_id')} AS kind FROM v JOIN (SELECT query_id, query_label, unnest(range(query_id - {REACH}, query_id + {REACH} + 1)) AS asked FROM q) ON asked = vec_id AND label = query_label),
      targets AS (SELECT case_id, kind, t, CASE kind WHEN 'relationship' THEN 'r' || t // 2 WHEN 'paper' THEN 'p' || t % 20 WHEN 'path' THEN 'w' || t ELSE 'c' || t END AS target_id FROM mates),
      matches AS (SELECT i.case_id, i.strategy, i.rank, t.target_id FROM items i JOIN targets t ON t.case_id = i.case_id AND CASE kind WHEN 'relationship' THEN i.vec_id // 2 = t // 2 WHEN 'paper' THEN i.vec_id % 20 = t % 20 ELSE i.vec_id = t END)"""
    return {
        "plan_table": f"""WITH {intents}, r AS (SELECT event_id AS request_id, {intent} AS intent, event_id % 5 = 0 AS several, event_id % 7 = 3 AS amb, event_id % 11 = 5 AS mis, CASE WHEN event_id % 3 <> 0 THEN 'entity:' || user_id END AS entity_id, event_id % 2 = 0 AS paper FROM events),
          s AS (SELECT r.*, operation AS op, strategy AS st, reason_code, CASE WHEN strategy IS NULL OR several THEN 'unsupported_graph_operation' WHEN amb THEN 'ambiguous' WHEN mis THEN 'entity_not_found' ELSE 'ok' END AS status FROM r LEFT JOIN t USING (intent))
          SELECT request_id, intent, status, CASE WHEN status = 'ok' THEN op END AS operation, CASE WHEN status = 'ok' THEN st END AS strategy, reason_code, CASE WHEN status = 'ok' AND op IS NOT NULL THEN entity_id END AS graph_entity_id, CASE WHEN status = 'ok' THEN CASE WHEN op = 'citation_neighborhood' AND entity_id IS NOT NULL THEN 2 ELSE 1 END ELSE -1 END AS graph_depth,
          CASE WHEN status = 'ok' THEN 20 ELSE -1 END AS graph_limit, CASE WHEN status = 'ok' THEN 5 ELSE -1 END AS vector_top_k, CASE WHEN status = 'ok' AND st IN ('vector', 'hybrid') AND paper THEN entity_id END AS paper_filter FROM s""",
        "sufficiency_gates": f"{judged} SELECT request_id, intent, CAST(sufficient AS VARCHAR) AS sufficient, coverage, refinement, needs_model FROM j",
        "refinement_bounds": f"""{judged}, n AS (SELECT *, CASE WHEN coalesce(sufficient, false) OR round >= 2 THEN NULL WHEN refinement = 'vector_expansion' AND strategy IN ('vector', 'hybrid') AND {ev('vector_top_k')} > vector_top_k THEN 'vector' WHEN refinement = 'hybrid_expansion' AND strategy = 'hybrid' AND ({ev('vector_top_k')} > vector_top_k OR {ev('graph_limit')} > graph_limit) THEN 'hybrid' WHEN refinement = 'graph_depth_expansion' AND {grow} THEN 'graph' END AS next_strategy, operation = 'citation_neighborhood' AND graph_depth < 2 AS deeper FROM j)
          SELECT request_id, next_strategy, CASE WHEN next_strategy IN ('vector', 'hybrid') THEN {ev('vector_top_k')} ELSE -1 END AS next_vector_top_k, CASE WHEN next_strategy = 'hybrid' OR (next_strategy = 'graph' AND NOT deeper) THEN {ev('graph_limit')} WHEN next_strategy = 'graph' THEN graph_limit ELSE -1 END AS next_graph_limit, CASE WHEN next_strategy = 'graph' THEN graph_depth + CASE WHEN deeper THEN 1 ELSE 0 END ELSE -1 END AS next_graph_depth FROM n""",
        "marker_scan": f"WITH {answers} SELECT answer_id, position, marker, label FROM s",
        "marker_resolution": f"WITH {resolved} SELECT answer_id, position, marker, reason, coalesce(citation_number, 0) AS citation_number FROM z",
        "answer_rewrite": f"""WITH {resolved}, n AS (SELECT answer_id, list(CASE WHEN citation_number IS NULL THEN '' ELSE '[' || citation_number || ']' END ORDER BY position) AS nums, count(citation_number) AS good, count(*) - count(citation_number) AS bad FROM z GROUP BY 1)
          SELECT a.answer_id, trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split_regex(text, '\\[E[^\\]]*\\]'), lambda p, i: p || coalesce(nums[i], '')), ''), '[ \\t]+([,.;:])', '\\1', 'g'), '[\\s\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g')) AS text,
            CASE WHEN good IS NULL THEN 'no_citations' WHEN good > 0 AND bad > 0 THEN 'partially_valid' WHEN good > 0 THEN 'valid' ELSE 'invalid' END AS validation_status FROM a LEFT JOIN n ON n.answer_id = a.answer_id""",
        "grounding_gates": f"WITH {grounded}, h AS (SELECT request_id, {gate} AS gate FROM g) SELECT request_id, gate, CASE {' '.join(f"WHEN gate = '{k}' THEN '{v}'" for k, v in D.ABSTENTIONS.items())} WHEN gate IS NOT NULL THEN '{D.ABSTENTION}' END AS abstention FROM h",
        "confidence_ladder": f"""WITH {grounded}, b AS (SELECT *, intent IS NULL OR (sufficient AND coverage = 'complete' AND n_missing = 0 AND validation_status = 'valid' AND n_citations > 0 AND NOT gap AND CASE WHEN intent = '{D.SEMANTIC}' THEN sem AND ct WHEN intent = '{D.MIXED}' THEN sem AND str AND ct AND (cg OR cp) WHEN intent IN {_in(D.NEEDS_PATH)} THEN str AND cp ELSE str AND (cg OR cp) END) AS strong, coverage <> 'complete' AS lim, validation_status = 'partially_valid' AS part FROM g),
          c AS (SELECT *, list_filter([CASE WHEN round > 1 THEN 'sufficient_after_refinement' END, CASE WHEN part THEN 'partial_citation_validation' END, CASE WHEN gap THEN 'provenance_incomplete' END, CASE WHEN n_missing > 0 THEN 'missing_information' END, CASE WHEN lim OR NOT strong THEN 'limited_evidence_coverage' END], lambda x: x IS NOT NULL) AS rs FROM b)
          SELECT request_id, strong, CASE WHEN lim THEN 'low' WHEN part OR gap OR n_missing > 0 OR NOT strong THEN 'medium' ELSE 'high' END AS confidence, CASE WHEN len(rs) = 0 THEN 'strong_grounded_support' ELSE array_to_string(rs, ',') END AS reasons FROM c""",
        "ranking_metrics": f"""{evaluation}, f AS (SELECT case_id, strategy, target_id, min(rank) AS first FROM matches GROUP BY ALL), s AS (SELECT case_id, strategy, min(first) AS best, count(*) FILTER (first <= 5) AS found, coalesce(list_sum(list_transform(list(DISTINCT first) FILTER (first <= 5), lambda r: 1 / log2(r + 1))), 0) AS gain FROM f GROUP BY ALL),
          w AS (SELECT case_id, strategy, count(*) FILTER (rank <= 5) AS within_k FROM items GROUP BY ALL), t AS (SELECT case_id, count(DISTINCT target_id) AS n FROM targets GROUP BY ALL), j AS (SELECT w.*, coalesce(best, 99) AS best, s.best IS NULL AS no, coalesce(found, 0) AS found, coalesce(gain, 0) AS gain, n, least(5, n, within_k) AS ideal_n FROM w JOIN t USING (case_id) LEFT JOIN s USING (case_id, strategy))
          SELECT case_id, strategy, CAST(best <= 5 AS BIGINT) AS hit, round(CASE WHEN no THEN 0 ELSE 1 / best END, 9) AS reciprocal_rank, round(found / within_k, 9) AS precision, round(found / n, 9) AS recall, round(gain / list_sum(list_transform(range(1, ideal_n + 1), lambda r: 1 / log2(r + 1))), 9) AS ndcg FROM j""",
        "structural_metrics": f"""{evaluation}, p AS (SELECT case_id, strategy, avg(CASE WHEN rank % 2 = 1 THEN 1.0 ELSE 0 END) AS rate FROM items GROUP BY ALL), x AS (SELECT p.case_id, p.strategy, rate, t.kind, (p.case_id, p.strategy, t.target_id) IN (SELECT (case_id, strategy, target_id) FROM matches) AS hit, (p.case_id, p.strategy, t.target_id) IN (SELECT (case_id, strategy, 'w' || (vec_id + 1)) FROM items WHERE rank % 2 = 0) AS ends FROM p LEFT JOIN (SELECT DISTINCT case_id, kind, target_id FROM targets) t ON t.case_id = p.case_id)
          SELECT case_id, strategy, {', '.join(f"coalesce(round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END) FILTER (kind = '{k}'), 9), -1) AS {n}" for k, n in (('entity', 'entity_recall'), ('relationship', 'relationship_recall'), ('path', 'exact_path_match')))}, coalesce(round(avg(CASE WHEN hit OR ends THEN 1.0 ELSE 0 END) FILTER (kind = 'path'), 9), -1) AS endpoint_accuracy, round(max(rate), 9) AS provenance_rate FROM x GROUP BY ALL""",
        "strategy_aggregate": f"WITH {results} SELECT category, strategy, count(*) AS cases, count(*) FILTER (applicable) AS applicable_cases, round(coalesce(avg(hit) FILTER (applicable), 0), 9) AS hit, round(coalesce(avg(recall) FILTER (applicable), 0), 9) AS recall, round(coalesce(avg(reciprocal_rank) FILTER (applicable), 0), 9) AS reciprocal_rank, round(avg(latency_ms), 6) AS latency_mean, round(quantile_cont(latency_ms, 0.5), 6) AS latency_median, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95 FROM r GROUP BY GROUPING SETS ((strategy), (category, strategy))",
        "latency_percentiles": f"WITH {results} SELECT strategy, category, count(latency_ms) AS n, round(avg(latency_ms), 6) AS mean, " + ", ".join(f"round(quantile_cont(latency_ms, {p}), 6) AS {n}" for n, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + " FROM r GROUP BY ALL",
        "case_comparison": f"""WITH {results}, s AS (SELECT case_id, strategy, applicable AND hit > 0 AS hit, reciprocal_rank AS mrr, applicable FROM r),
          c AS (SELECT case_id, coalesce(bool_or(hit) FILTER (strategy = 'vector'), false) AS v, coalesce(bool_or(hit) FILTER (strategy = 'graph'), false) AS g, coalesce(bool_or(hit) FILTER (strategy = 'hybrid'), false) AS h,
            coalesce(bool_or(applicable) FILTER (strategy = 'hybrid'), false) AS h_applies, coalesce(max(mrr) FILTER (strategy = 'vector'), 0) AS v_mrr, coalesce(max(mrr) FILTER (strategy = 'hybrid'), 0) AS h_mrr FROM s GROUP BY 1)
          SELECT case_id, CASE WHEN h AND NOT v THEN 'HYBRID_WINS' WHEN g AND NOT v THEN 'GRAPH_WINS' WHEN v AND (NOT h_applies OR v_mrr >= h_mrr OR NOT h) THEN 'VECTOR_WINS' WHEN NOT v AND NOT g AND NOT h THEN 'ALL_FAIL' ELSE 'NO_CLEAR_WIN' END AS comparison FROM c""",
        "pairwise_wins": f"WITH {results}, x AS (SELECT case_id, strategy AS s, CASE WHEN applicable THEN (CASE WHEN correct THEN 1 ELSE 0 END, CASE WHEN citations_ok THEN 1 ELSE 0 END, recall, -latency_ms) ELSE (0, 0, 0, 0) END AS q FROM r) SELECT l.s AS left_system, m.s AS right_system, count(*) FILTER (l.q > m.q) AS wins, count(*) FILTER (l.q = m.q) AS ties, count(*) FILTER (l.q < m.q) AS losses FROM x l JOIN x m ON l.case_id = m.case_id AND l.s < m.s GROUP BY ALL",
        "failure_histogram": "WITH r AS (SELECT (['vector', 'graph', 'hybrid'])[event_id // 2 % 3 + 1] AS system, CASE WHEN event_id % 6 = 0 THEN 'no_results' WHEN event_id % 5 = 1 THEN 'provenance_gap' WHEN event_id % 4 <> 0 THEN 'nothing_relevant' END AS reason FROM events) SELECT system, coalesce(reason, 'none') AS reason, count(*) AS failures FROM r GROUP BY ALL",
        "illegal_transitions": f"WITH m AS (SELECT user_id AS job_id, event_id, {status} AS status, lag({status}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT job_id, event_id, previous, status FROM m WHERE previous IS NOT NULL AND NOT (previous NOT IN ('ready', 'failed') AND ({steps} OR status = 'failed'))",
        "resume_points": f"WITH j AS (SELECT event_id AS job_id, {status} AS status, {_nth(control.STATUS_CHAIN, 'event_id // 13')} AS failed_stage FROM events) SELECT job_id, status, CASE CASE WHEN status = 'failed' THEN failed_stage ELSE status END {nxt} END AS next_stage FROM j",
        "step_attempts": "SELECT event_id, user_id AS job_id, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events",
        "stale_versions": "WITH c AS (SELECT l_orderkey AS k, max(l_linestatus) AS generation FROM lineitem GROUP BY 1) SELECT k AS paper_version_id, generation, o_orderstatus AS stored_generation FROM c LEFT JOIN orders ON o_orderkey = k WHERE o_orderstatus IS DISTINCT FROM generation",
        "discovery_dedup": "WITH r AS (SELECT CAST(l_orderkey AS VARCHAR) AS source_id, l_partkey % 10 AS v, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 10 DESC, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS nth, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first_line FROM lineitem) SELECT source_id, 'v' || v AS version, l_partkey, l_suppkey, first_line::BIGINT AS first_line FROM r WHERE nth = 1",
        "date_range_filter": "SELECT o_orderkey, year(o_orderdate) AS published_year FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'",
        "id_normalise": "SELECT page_id, '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS source_id, CASE WHEN page_id % 2 = 0 THEN 'v' || (page_id % 9 + 1) END AS version, page_id % 4 IN (0, 2) AS trusted, false AS own_url_trusted FROM pages",
    }
