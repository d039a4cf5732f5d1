"""Answer contexts, evaluation scores and planning rates over records made from conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, metrics
from . import decision_queries, graph_queries
from .decision_queries import _nth, nth
from .projections import table

MOST, CHARS = 4, 700
TYPES = ["text", "graph_relationship", "graph_path", "text"]


def _pool(spark: SparkSession, d: str) -> DataFrame:
    """Users are answers, their first eight events the pool in order of their numbers; graph items are supported by the pool's next item and by one that isn't there."""
    order = metrics.ranked_within(table(spark, d, "events"), ["user_id"], [F.col("event_id")]).where(F.col("rank") <= 8)
    kind = nth(TYPES, F.col("event_id"))
    name = lambda c: F.concat(F.lit("ev:"), c.cast("string"))
    following = F.lead("event_id").over(metrics.Window.partitionBy("user_id").orderBy("event_id"))
    out = order.withColumn("evidence_type", kind).withColumn("evidence_id", name(F.col("event_id"))).withColumn("next", following)
    support = F.when(kind != "text", F.filter(F.array(name(F.col("next")), F.lit("ev:gone")), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    return out.select(F.col("user_id").alias("answer_id"), (F.col("rank") - 1).alias("pos"), F.concat(F.lit("E"), F.col("rank").cast("string")).alias("label"), "evidence_id", "evidence_type", support.alias("supporting_text_evidence_ids"), "event_id", "event_type")


def context_selection(spark: SparkSession, d: str) -> DataFrame:
    out = decisions.selected_context(_pool(spark, d), MOST)
    return out.select("answer_id", "evidence_id", F.col("place").cast("long").alias("place"))


def _rendered(spark: SparkSession, d: str) -> DataFrame:
    p, e = _pool(spark, d), F.col("event_id")
    none = F.lit(None)
    items = p.select("answer_id", F.col("pos").alias("place"), "label", "evidence_type", "evidence_id", F.concat(F.lit("p"), (e % 3).cast("string")).alias("paper_id"), F.when(e % 2 == 0, "pv").alias("paper_version_id"), F.col("event_type").alias("section_type"), F.when(e % 3 > 0, e % 9).cast("int").alias("page_start"), F.when(e % 3 > 1, e % 9 + e % 2).cast("int").alias("page_end"), F.when(e % 4 > 0, e % 4 == 1).alias("provenance_complete"), F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")), F.lit(1), (e % 5).cast("int")).alias("warnings"), F.when(e % 6 > 0, F.concat(F.lit("text of "), e.cast("string"))).otherwise(none.cast("string")).alias("text"), F.array(F.lit("x"), F.concat(F.lit("y"), (e % 2).cast("string"))).alias("entity_ids"), F.array(F.lit("r"), F.lit("s")).alias("relationship_ids"), "supporting_text_evidence_ids")
    return decisions.rendered(items)


def context_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _rendered(spark, d).select("answer_id", "label", F.concat("head", "body").alias("block"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    out = decisions.budgeted(_rendered(spark, d), CHARS)
    return out.select("answer_id", "label", "truncated", F.length("rendered").cast("long").alias("size"), F.sha2("rendered", 256).alias("rendered_sha256"))


def uncited_evidence(spark: SparkSession, d: str) -> DataFrame:
    pool = _pool(spark, d)
    return decisions.uncited(pool.select("answer_id", "label"), pool.where("event_id % 3 = 0").select("answer_id", "label"))


def evidence_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _pool(spark, d).withColumn("evidence_type", F.when(F.col("event_id") % 10 == 0, "metadata").otherwise(F.col("evidence_type")))
    return decisions.evidence_summary(rows, ["answer_id"])


def fatal_provenance(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    warnings = F.array(F.when(e % 4 == 0, F.lit("A FATAL gap")).otherwise(F.lit("missing chunk")), F.lit("note"))
    flag = F.when(e % 3 == 0, F.lit(None).cast("boolean")).otherwise(e % 5 == 0)
    return table(spark, d, "events").select("event_id", decisions.fatal(flag, warnings).alias("fatal"))


def path_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Of every dataset's methods: node and edge ids by turns."""
    out = graph_queries._query("methods_for_dataset", 1)(spark, d)
    split = lambda c: F.split(c, ">")
    return out.select("start", "evidence_id", F.array_join(metrics.path_signature(split("entity_path"), split("relationship_path")), " ").alias("signature"))


def target_matching(spark: SparkSession, d: str) -> DataFrame:
    _, _, matches = decision_queries._evaluation(spark, d)
    return matches.groupBy("case_id", "strategy").agg(F.count("*").alias("matches"), F.min("rank").cast("long").alias("first"))


CATEGORIES = ["semantic", "structural", "shared_entity", "multi_hop", "mixed", "unanswerable", "ambiguous"]
STATUSES = ["answered", "answered", "abstained", "answered", "requires_disambiguation", "failed", "not_applicable"]
CHECKS = ["valid", "invalid", "partially_valid", "valid", "no_citations"]
SYSTEMS = ["vector_rag", "graph_rag", "hybrid_rag", "agentic_hybrid_rag"]


def _end_to_end(spark: SparkSession, d: str) -> DataFrame:
    """Turns are cases that four systems answer with the turn's text; everything else is of their numbers."""
    t, s, h = F.col("turn"), F.col("s"), F.col("conv_id") + F.col("turn")
    text = lambda c: F.concat(F.lit("c"), c.cast("string"))
    none = F.array().cast("array<string>")
    every = table(spark, d, "conversations").distinct().withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3))))
    status = nth(STATUSES, F.col("conv_id") + 2 * t + 3 * s)
    category = nth(CATEGORIES, h)
    unchecked = h % 6 == 5
    cited = F.array(*[F.struct(F.lit(e).alias("evidence_id"), text(t % 3).alias("chunk_id"), F.lit(None).cast("string").alias("paper_id"), none.alias("relationship_ids"), F.array(F.concat(F.lit("e"), s.cast("string"))).alias("entity_ids"), none.alias("source_chunk_ids"), whole.alias("provenance_complete")) for e, whole in (("x1", t % 5 > 0), ("x2", F.lit(None).cast("boolean")))])
    plan = F.struct(F.when(h % 3 > 0, nth(["hybrid", "graph"], t)).alias("strategy"), F.when(t % 3 > 0, F.lit("mixed")).alias("intent"), F.lit(None).cast("string").alias("operation"))
    rows = every.select(
        F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"), "role").alias("case_id"), nth(SYSTEMS, s).alias("system"), category.alias("category"),
        (category == "unanswerable").alias("expected_abstention"), (category == "ambiguous").alias("expected_disambiguation"), status.alias("answer_status"),
        F.coalesce("text", F.lit("")).alias("answer"), F.when(t % 4 == 0, none).otherwise(F.array(F.lit("THE"), F.lit(None).cast("string"))).alias("facts"),
        ((t + s) % 3).alias("relevant_count"), (F.col("conv_id") % 4).alias("n_targets"), ((t + s) % 3 / 2).alias("evidence_recall"),
        F.when(h % 6 > 0, cited).otherwise(F.slice(cited, 1, 0)).alias("citations"), F.array(F.when(s % 2 == 0, text(t % 2 + 1)).otherwise(F.concat(F.lit("e"), s.cast("string")))).alias("required_citations"),
        F.when(~unchecked, t % 3).alias("valid_markers"), F.when(~unchecked, s % 2).alias("invalid_markers"), F.when(~unchecked, nth(CHECKS, h + s)).alias("citation_status"), F.when(~unchecked, F.least(t % 3, F.lit(1))).alias("trusted_citations"),
        nth(["hybrid", "vector", "graph"], t).alias("selected_strategy"), nth(["mixed", "citation"], h).alias("planner_intent"), F.lit(None).cast("string").alias("graph_operation"), F.when(h % 5 > 0, plan).alias("expected_plan"),
        F.when(status == "not_applicable", "graph_not_applicable").when((status == "failed") & (s == 3), "execution_error").alias("failure_reason"),
        (s == 3).alias("refined"), ((s == 3) & (F.col("conv_id") % 3 == 0)).alias("refinement_success"), (F.length(F.coalesce("text", F.lit(""))) + 10 * s).cast("double").alias("latency_ms"),
        (s + t % 2).alias("llm_calls"), nth(list(metrics.CONFIDENCES), h + 2 * s).alias("confidence"),
        F.when(s > 1, F.create_map(F.lit("prompt"), F.length(F.coalesce("text", F.lit(""))).cast("long"), F.lit("completion"), t.cast("long"))).alias("token_usage"),
    )
    return metrics.end_to_end_scores(rows)


def end_to_end_scores(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.round(c, 9).alias(c)
    flag = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c)
    return _end_to_end(spark, d).select("case_id", "system", "abstained", "answer_correct", "abstention_correct", "disambiguation_correct", *map(rate, ("citation_validity_rate", "trusted_citation_rate", "provenance_completeness")), *map(flag, ("planning_correct", "strategy_correct")), "failure_reason")


def end_to_end_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.end_to_end_aggregate(_end_to_end(spark, d))
    whole = [c for c in out.columns if c == "cases" or c.endswith("_cases")]
    return out.select("system", *whole, *[F.coalesce(F.round(c, 9), F.lit(-1.0)).alias(c) for c in out.columns if c not in ("system", *whole)])


def end_to_end_tokens(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_totals(_end_to_end(spark, d))


def end_to_end_wins(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pairwise_wins(metrics.compared(_end_to_end(spark, d)))


def end_to_end_failures(spark: SparkSession, d: str) -> DataFrame:
    return metrics.failure_histogram(_end_to_end(spark, d).withColumnRenamed("failure_reason", "reason"))


def agentic_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return metrics.outcomes(metrics.compared(_end_to_end(spark, d)), "agentic_hybrid_rag", ["vector_rag", "hybrid_rag"])


def planning_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Plans of events against what their users' numbers say."""
    plans = decision_queries.plan_table(spark, d).select("request_id", "intent", "strategy", "operation")
    e = F.col("event_id")
    cases = table(spark, d, "events").select(e.alias("request_id"), nth(decisions.INTENTS, e + F.when(e % 6 == 0, 1).otherwise(0)).alias("expected_intent"), nth(["vector", "graph", "hybrid"], e).alias("expected_strategy"), F.when(e % 2 == 0, nth(decisions.INTENTS, e)).alias("expected_operation"), F.lit("paper").alias("expected_entity_type"), F.when(e % 2 == 0, "paper").otherwise("method").alias("planned_entity_type"))
    met = cases.join(plans, "request_id").withColumnsRenamed({"intent": "planned_intent", "strategy": "planned_strategy", "operation": "planned_operation"})
    out = metrics.planning_accuracy(met)
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


NAMES = ["context_selection", "context_blocks", "context_budget", "uncited_evidence", "evidence_summary", "fatal_provenance", "path_signatures", "target_matching", "end_to_end_scores", "end_to_end_aggregate", "end_to_end_tokens", "end_to_end_wins", "end_to_end_failures", "agentic_outcomes", "planning_accuracy"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    sql = decision_queries.oracle_sql()
    pool = f"""p AS (SELECT user_id AS answer_id, event_id, event_type, row_number() OVER w - 1 AS pos, lead(event_id) OVER w AS next, {_nth(TYPES, 'event_id')} AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY pos < 8),
      q AS (SELECT * REPLACE (CASE WHEN pos < 7 THEN next END AS next) FROM p),
      pool AS (SELECT *, 'E' || (pos + 1) AS label, 'ev:' || event_id AS id, CASE WHEN kind = 'text' THEN [] WHEN next IS NULL THEN ['ev:gone'] ELSE ['ev:' || next, 'ev:gone'] END AS support FROM q)"""
    none = lambda c: f"coalesce(CAST({c} AS VARCHAR), 'None')"
    nl = "chr(10)"
    blocks = f"""items AS (SELECT *, 'p' || (event_id % 3) AS paper, CASE WHEN event_id % 2 = 0 THEN 'pv' END AS version, CASE WHEN event_id % 3 > 0 THEN event_id % 9 END AS p1, CASE WHEN event_id % 3 > 1 THEN event_id % 9 + event_id % 2 END AS p2, CASE event_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'True' ELSE 'False' END AS whole,
        array_to_string((['''a''', '''b''', '''c'''])[1:least(3, event_id % 5)], ', ') AS warns, array_to_string(support, ', ') AS ss FROM pool),
      made AS (SELECT *, '<EVIDENCE id="' || label || '" type="' || upper(kind) || '">' || {nl} || 'stable_evidence_id: ' || id || {nl} || 'paper_id: ' || paper || {nl} || 'paper_version_id: ' || {none('version')} || {nl} || 'section: ' || {none('event_type')} || {nl} || 'pages: ' || CASE WHEN p1 IS NULL THEN 'None' WHEN p2 IS NULL OR p1 = p2 THEN CAST(p1 AS VARCHAR) ELSE p1 || '-' || p2 END || {nl} || 'provenance_complete: ' || whole || {nl} || 'provenance_warnings: [' || warns || ']' || {nl} || 'Content:' || {nl} AS head,
        CASE kind WHEN 'text' THEN CASE WHEN event_id % 6 > 0 THEN 'text of ' || event_id ELSE '' END WHEN 'graph_relationship' THEN 'Graph relationship:' || {nl} || 'entities: x -> y' || (event_id % 2) || {nl} || 'relationships: r, s' || {nl} || 'supporting_text_evidence_ids: ' || ss ELSE 'Graph path:' || {nl} || 'nodes: x -> y' || (event_id % 2) || {nl} || 'relationships: r -> s' || {nl} || 'supporting_text_evidence_ids: ' || ss END AS body FROM items)"""
    turns = f"""t AS (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS answer FROM conversations), a AS (SELECT t.*, s, conv_id + turn AS h FROM t, range(4) AS n(s)),
      r AS (SELECT *, conv_id || ':' || turn || ':' || role AS case_id, {_nth(SYSTEMS, 's')} AS system, {_nth(CATEGORIES, 'h')} AS category, {_nth(STATUSES, 'conv_id + 2 * turn + 3 * s')} AS status, {_nth(list(metrics.CONFIDENCES), 'h + 2 * s')} AS confidence, h % 6 = 5 AS unchecked, turn % 3 AS good, s % 2 AS bad,
        CASE WHEN h % 6 <> 5 THEN {_nth(CHECKS, 'h + s')} END AS citation_status, length(answer) + 10 * s AS latency FROM a),
      x AS (SELECT *, category = 'unanswerable' AS ea, category = 'ambiguous' AS ed, status = 'not_applicable' AS na, status = 'failed' AND s = 3 AS err, status IN ('abstained', 'requires_disambiguation', 'failed') AS abstained FROM r),
      y AS (SELECT *, NOT ea AND NOT ed AND status = 'answered' AND ((turn + s) % 3 > 0 OR conv_id % 4 = 0) AND (turn % 4 = 0 OR contains(lower(answer), 'the')) AND h % 6 > 0 AND (s % 2 = 1 OR turn % 2 + 1 = turn % 3) AS ok, ea AND abstained AND NOT err AS ok_a, ed AND status = 'requires_disambiguation' AS ok_d,
        CASE WHEN na OR err THEN 0 ELSE (turn + s) % 3 / 2 END AS recall, CASE WHEN na OR err OR unchecked OR good + bad = 0 THEN 0 ELSE good / (good + bad) END AS validity, CASE WHEN na OR err OR unchecked OR good + bad = 0 THEN 0 ELSE least(good, 1) / (good + bad) END AS trust, CASE WHEN na OR err OR h % 6 = 0 THEN 0 WHEN turn % 5 > 0 THEN 1 ELSE 0.5 END AS whole,
        CASE WHEN s = 3 AND NOT na AND NOT err AND h % 5 > 0 THEN h % 3 = 0 OR {_nth(['hybrid', 'graph'], 'turn')} = {_nth(['hybrid', 'vector', 'graph'], 'turn')} END AS strategy_ok, turn % 3 = 0 OR h % 2 = 0 AS intent_ok FROM x),
      z AS (SELECT *, CASE WHEN na THEN 'graph_not_applicable' WHEN err THEN 'execution_error' WHEN ok OR ok_a OR ok_d THEN NULL WHEN citation_status <> 'valid' THEN 'citation_' || citation_status WHEN recall = 0 THEN 'retrieval_miss' WHEN NOT ea AND NOT ed AND abstained THEN 'unnecessary_abstention' ELSE 'answer_incorrect' END AS reason,
        CASE WHEN strategy_ok IS NOT NULL THEN strategy_ok AND intent_ok END AS plan_ok, ed AND NOT na AND NOT err AS wants_choice, NOT unchecked AND good > 0 AS trusted FROM y),
      q AS (SELECT case_id, system, CASE WHEN na THEN (0, 0, 0.0::DOUBLE, 0.0::DOUBLE) ELSE (CASE WHEN ok OR ok_a OR ok_d THEN 1 ELSE 0 END, CASE WHEN citation_status = 'valid' AND trusted THEN 1 ELSE 0 END, recall::DOUBLE, -latency::DOUBLE) END AS quality FROM z)"""
    mean = lambda value, where="true": f"round(coalesce(avg({value}) FILTER ({where}), 0), 9)"
    share = lambda flag, where="true": mean(f"CASE WHEN {flag} THEN 1.0 ELSE 0 END", where)
    asked = "NOT wants_choice AND NOT na AND category <> 'unanswerable'"
    figures = {
        "answer_accuracy": share("ok", asked), "correct_abstention_rate": share("ok_a", "ea AND NOT na"), "false_answer_rate": share("status = 'answered'", "ea AND NOT na"),
        "grounded_answer_rate": share("status = 'answered' AND trusted AND confidence <> 'insufficient_evidence'", asked), "evidence_recall": mean("recall", "NOT wants_choice AND NOT na"),
        "citation_validity_rate": mean("validity", "status = 'answered'"), "trusted_citation_rate": mean("trust", "status = 'answered'"), "provenance_completeness": mean("whole", "status = 'answered'"),
        "planning_accuracy": "coalesce(round(avg(CASE WHEN plan_ok THEN 1.0 WHEN NOT plan_ok THEN 0 END), 9), -1)", "strategy_accuracy": "coalesce(round(avg(CASE WHEN strategy_ok THEN 1.0 WHEN NOT strategy_ok THEN 0 END), 9), -1)",
        "refinement_rate": share("s = 3"), "refinement_success_rate": share("conv_id % 3 = 0", "s = 3"), "high_confidence_error_rate": share("NOT ok", "status = 'answered' AND confidence = 'high'"),
        "mean_latency_ms": mean("latency", "NOT na"), "median_latency_ms": "round(coalesce(quantile_cont(latency, 0.5) FILTER (NOT na), 0), 9)", "p95_latency_ms": "round(coalesce(quantile_cont(latency, 0.95) FILTER (NOT na), 0), 9)", "llm_calls_per_query": mean("s + turn % 2"),
    }
    evaluation = sql["ranking_metrics"].split(", f AS (SELECT case_id, strategy, target_id")[0]
    graph = graph_queries._sql("methods_for_dataset", 1)
    same = lambda a, b: f"round(avg(CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 1.0 ELSE 0 END), 9)"
    return {
        "context_selection": f"""WITH {pool}, each AS (SELECT answer_id, id, pos, -1 AS child FROM pool UNION ALL SELECT p.answer_id, s.id, p.pos, i FROM (SELECT answer_id, pos, unnest(support) AS sid, generate_subscripts(support, 1) - 1 AS i FROM pool) p JOIN pool s ON s.answer_id = p.answer_id AND s.id = p.sid),
          first AS (SELECT answer_id, id, min(pos * 100 + child) AS spot FROM each GROUP BY ALL) SELECT answer_id, id AS evidence_id, row_number() OVER (PARTITION BY answer_id ORDER BY spot) AS place FROM first QUALIFY place <= {MOST}""",
        "context_blocks": f"WITH {pool}, {blocks} SELECT answer_id, label, head || body AS block FROM made",
        "context_budget": f"""WITH {pool}, {blocks}, z AS (SELECT *, chr(10) || '</EVIDENCE>' AS foot FROM made), b AS (SELECT *, {CHARS} - coalesce(sum(length(head) + length(body) + length(foot)) OVER (PARTITION BY answer_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM z),
          c AS (SELECT *, (room - length(head) - length(foot))::BIGINT AS body_room FROM b WHERE room > length(head) + length(foot)), o AS (SELECT *, length(body) > body_room AS truncated, head || CASE WHEN length(body) > body_room THEN substr(body, 1, greatest(0, body_room - 12)) || chr(10) || '[truncated]' ELSE body END || foot AS rendered FROM c)
          SELECT answer_id, label, truncated, length(rendered) AS size, sha256(rendered) AS rendered_sha256 FROM o""",
        "uncited_evidence": f"WITH {pool} SELECT answer_id, label FROM pool WHERE event_id % 3 <> 0",
        "evidence_summary": f"WITH {pool}, k AS (SELECT answer_id, CASE WHEN event_id % 10 = 0 THEN 'metadata' ELSE kind END AS kind FROM pool) SELECT answer_id, count(*) AS evidence_count, count(*) FILTER (kind = 'text') AS text_evidence_count, count(*) FILTER (kind LIKE 'graph%') AS graph_evidence_count, count(*) FILTER (kind = 'metadata') AS metadata_evidence_count FROM k GROUP BY 1",
        "fatal_provenance": "SELECT event_id, event_id % 4 = 0 OR (event_id % 3 <> 0 AND event_id % 5 = 0) AS fatal FROM events",
        "path_signatures": f"SELECT start, evidence_id, split_part(entity_path, '>', 1) || ' ' || split_part(relationship_path, '>', 1) || ' ' || split_part(entity_path, '>', 2) || ' ' || split_part(relationship_path, '>', 2) || ' ' || split_part(entity_path, '>', 3) AS signature FROM ({graph})",
        "target_matching": f"{evaluation} SELECT case_id, strategy, count(*) AS matches, min(rank)::BIGINT AS first FROM matches GROUP BY ALL",
        "end_to_end_scores": f"WITH {turns} SELECT case_id, system, abstained, ok AS answer_correct, ok_a AS abstention_correct, ok_d AS disambiguation_correct, round(validity, 9) AS citation_validity_rate, round(trust, 9) AS trusted_citation_rate, round(whole, 9) AS provenance_completeness, coalesce(CAST(plan_ok AS INT), -1) AS planning_correct, coalesce(CAST(strategy_ok AS INT), -1) AS strategy_correct, reason AS failure_reason FROM z",
        "end_to_end_aggregate": f"WITH {turns} SELECT system, count(*) AS cases, {', '.join(f"count(*) FILTER (confidence = '{c}') AS {c}_cases" for c in metrics.CONFIDENCES)}, {', '.join(f'{v} AS {n}' for n, v in figures.items())} FROM z GROUP BY 1",
        "end_to_end_tokens": f"WITH {turns} SELECT system, 'prompt' AS token_kind, sum(length(answer))::BIGINT AS tokens FROM z WHERE s > 1 GROUP BY 1 UNION ALL SELECT system, 'completion', sum(turn)::BIGINT FROM z WHERE s > 1 GROUP BY 1",
        "end_to_end_wins": f"WITH {turns} SELECT l.system AS left_system, m.system AS right_system, count(*) FILTER (l.quality > m.quality) AS wins, count(*) FILTER (l.quality = m.quality) AS ties, count(*) FILTER (l.quality < m.quality) AS losses FROM q l JOIN q m ON l.case_id = m.case_id AND l.system < m.system GROUP BY ALL",
        "end_to_end_failures": f"WITH {turns} SELECT system, coalesce(reason, 'none') AS reason, count(*) AS failures FROM z GROUP BY ALL",
        "agentic_outcomes": f"WITH {turns}, g AS (SELECT case_id, max(quality) FILTER (system = 'agentic_hybrid_rag') AS own, max(quality) FILTER (system IN ('vector_rag', 'hybrid_rag')) AS best FROM q GROUP BY 1) SELECT case_id, CASE WHEN own > best THEN 'win' ELSE 'loss' END AS outcome FROM g WHERE own <> best",
        "planning_accuracy": f"""WITH plans AS ({sql['plan_table']}), m AS (SELECT p.*, event_id, {_nth(decisions.INTENTS, 'event_id + CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END')} AS ei, {_nth(['vector', 'graph', 'hybrid'], 'event_id')} AS es, CASE WHEN event_id % 2 = 0 THEN {_nth(decisions.INTENTS, 'event_id')} END AS eo FROM events JOIN plans p ON request_id = event_id)
          SELECT {same('ei', 'intent')} AS intent_accuracy, {same('es', 'strategy')} AS strategy_accuracy, {same('eo', 'operation')} AS operation_accuracy, {same("'paper'", "CASE WHEN event_id % 2 = 0 THEN 'paper' ELSE 'method' END")} AS entity_type_accuracy FROM m""",
    }
