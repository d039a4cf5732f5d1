"""Planning, sufficiency, refinement, citations, grounding and confidence as batch rules over rows of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.ids import spaced
from .graph_paths import OPERATIONS

SEMANTIC, MIXED, UNKNOWN = "semantic_explanation", "mixed_semantic_structural", "unknown"
INTENTS = [SEMANTIC, *OPERATIONS, MIXED, UNKNOWN]
# Intents whose reason is multi-hop, and those that need a cited path.
MULTI_HOP = ["datasets_from_citing_papers", "methods_for_dataset", "citation_neighborhood", "shared_datasets", "shared_methods"]
NEEDS_PATH = ["datasets_from_citing_papers", "methods_for_dataset", "citation_neighborhood"]
# Workflow status -> the reason that forbids an answer.
HARD_GATES = {
    "PLANNING_FAILED": "planning_failed",
    "REQUIRES_DISAMBIGUATION": "entity_ambiguous",
    "ENTITY_NOT_FOUND": "entity_not_found",
    "UNSUPPORTED_OPERATION": "unsupported_operation",
    "RETRIEVAL_FAILED": "retrieval_failed",
    "EMPTY_EVIDENCE": "empty_evidence",
    "INSUFFICIENT_EVIDENCE": "insufficient_retrieval_evidence",
    "REFINEMENT_FAILED": "refinement_failed",
    "CRITIC_FAILED": "critic_failed",
    "ANSWER_GENERATION_FAILED": "generation_failed",
    "CITATION_VALIDATION_FAILED": "citation_validation_failed",
}
# What an abstention says.
ABSTENTIONS = {
    "entity_not_found": "The requested entity could not be resolved in the indexed research corpus.",
    "entity_ambiguous": "The requested entity is ambiguous. Please select one of the available candidates.",
    "unsupported_operation": "The current graph retrieval capabilities do not support this question reliably.",
    "retrieval_failed": "The retrieval system could not obtain reliable evidence for this question.",
    "citation_validation_failed": "The generated response could not be verified against the retrieved evidence.",
}
ABSTENTION = "The available evidence is insufficient to answer this question reliably."


def operation_of(intent: str) -> str | None:
    return "paper_datasets" if intent == MIXED else intent if intent in OPERATIONS else None


def strategy_of(intent: str) -> str | None:
    return {SEMANTIC: "vector", MIXED: "hybrid"}.get(intent) or ("graph" if operation_of(intent) else None)


def reason_of(intent: str) -> str:
    return {SEMANTIC: "semantic_only", MIXED: "mixed_query"}.get(intent) or ("multi_hop_query" if intent in MULTI_HOP else "structural_query" if operation_of(intent) else "unsupported_operation")


def intents(spark: SparkSession) -> DataFrame:
    """The planning table: a row for each intent."""
    return spark.createDataFrame([(i, operation_of(i), strategy_of(i), reason_of(i)) for i in INTENTS], "intent string, operation string, strategy string, reason_code string")


def plans(requests: DataFrame, table: DataFrame, settings: Settings) -> DataFrame:
    """requests(request_id, intent, requested_operations, n_ambiguous, n_missing, entity_id, entity_type) with status, and the plan of those that are ok.

    Gates in order: unknown intent, no operation, several operations, ambiguous entity, missing entity.
    """
    met = requests.join(F.broadcast(table), "intent", "left")  # one row for each intent
    several = F.size(F.array_distinct("requested_operations")) > 1
    status = F.when(F.col("strategy").isNull() | (F.col("strategy").isin("graph", "hybrid") & F.col("operation").isNull()) | several, "unsupported_graph_operation").when(F.col("n_ambiguous") > 0, "ambiguous").when(F.col("n_missing") > 0, "entity_not_found").otherwise("ok")
    met = met.withColumn("status", status)
    ok = lambda c: F.when(F.col("status") == "ok", c)
    graph = F.col("operation").isNotNull() & F.col("entity_id").isNotNull()
    depth = F.when(graph & (F.col("operation") == "citation_neighborhood"), 2).otherwise(1)
    paper = F.col("strategy").isin("vector", "hybrid") & (F.col("entity_type") == "paper")
    return met.select("request_id", "intent", "status", ok(F.col("operation")).alias("operation"), ok(F.col("strategy")).alias("strategy"), "reason_code", ok(F.when(graph, F.col("entity_id"))).alias("graph_entity_id"), ok(depth).alias("graph_depth"), ok(F.lit(settings.graph_limit)).alias("graph_limit"), ok(F.lit(settings.vector_top_k)).alias("vector_top_k"), ok(F.when(paper, F.col("entity_id"))).alias("paper_filter"))


def _expandable(settings: Settings) -> Column:
    depth = (F.col("operation") == "citation_neighborhood") & (F.col("graph_depth") < min(settings.graph_depth_max, 2))
    return F.coalesce(F.col("operation").isNotNull() & (depth | (F.col("graph_limit") < settings.graph_limit_max)), F.lit(False))


def sufficiency(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows(request_id, intent, operation, strategy, graph_depth, graph_limit, n_text, n_graph) judged without a model where rules decide; `needs_model` marks the rest."""
    empty = F.col("n_text") + F.col("n_graph") == 0
    structural = F.col("operation").isNotNull() & (F.col("n_graph") > 0)
    is_structural = ~F.col("intent").isin(SEMANTIC, MIXED, UNKNOWN)
    mixed_gate = (F.col("intent") == MIXED) & (~structural | (F.col("n_text") == 0))
    grow = _expandable(settings)
    default = F.when(F.col("strategy").isin("vector", "hybrid"), "vector_expansion").when(F.col("operation") == "citation_neighborhood", "graph_depth_expansion").otherwise("none")
    no_text = F.col("n_text") == 0
    mixed_fix = F.when(no_text & ~structural, F.when(F.col("strategy") == "hybrid", "hybrid_expansion").otherwise("vector_expansion")).when(no_text, "vector_expansion").when(grow, "graph_depth_expansion").otherwise("none")
    pick = lambda a, b, c: F.when(empty, a).when(is_structural, b).when(mixed_gate, c)
    sufficient = pick(F.lit(False), structural, F.lit(False))
    coverage = pick(F.lit("insufficient"), F.when(structural, "complete").otherwise("insufficient"), F.lit("partial"))
    fix = pick(default, F.when(grow, "graph_depth_expansion").otherwise("none"), mixed_fix)
    return rows.withColumn("sufficient", sufficient).withColumn("coverage", coverage).withColumn("refinement", fix).withColumn("needs_model", ~empty & ~is_structural & ~mixed_gate)


def refinements(rows: DataFrame, settings: Settings) -> DataFrame:
    """rows(request_id, strategy, operation, refinement, sufficient, round, vector_top_k, graph_limit, graph_depth) with the next round's strategy and bounds, null where there is none."""
    double = lambda c, most: F.least(F.greatest(F.col(c) * 2, F.col(c) + 1), F.lit(most))
    k, n = double("vector_top_k", settings.vector_top_k_max), double("graph_limit", settings.graph_limit_max)
    grows_k, grows_n = k > F.col("vector_top_k"), n > F.col("graph_limit")
    deeper = (F.col("operation") == "citation_neighborhood") & (F.col("graph_depth") < min(settings.graph_depth_max, 2))
    open_ = ~F.coalesce(F.col("sufficient"), F.lit(False)) & (F.col("round") < settings.retrieval_rounds)
    vector = (F.col("refinement") == "vector_expansion") & F.col("strategy").isin("vector", "hybrid") & grows_k
    hybrid = (F.col("refinement") == "hybrid_expansion") & (F.col("strategy") == "hybrid") & (grows_k | grows_n)
    graph = (F.col("refinement") == "graph_depth_expansion") & _expandable(settings)
    runs = F.when(open_ & vector, "vector").when(open_ & hybrid, "hybrid").when(open_ & graph, "graph")
    out = rows.withColumn("next_strategy", runs)
    out = out.withColumn("next_vector_top_k", F.when(runs.isin("vector", "hybrid"), k)).withColumn("next_graph_limit", F.when(runs == "hybrid", n).when(runs == "graph", F.when(deeper, F.col("graph_limit")).otherwise(n)))
    return out.withColumn("next_graph_depth", F.when(runs == "graph", F.when(deeper, F.col("graph_depth") + 1).otherwise(F.col("graph_depth"))))


# What looks like a citation marker, and what is one.
MARKER_LIKE, MARKER = r"\[E[^\]]*\]", r"^\[E([1-9][0-9]*)\]$"


def markers(answers: DataFrame) -> DataFrame:
    """answers(answer_id, text): every marker-like string with its place and label (null: bad syntax)."""
    each = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(MARKER_LIKE), F.lit(0))).alias("position", "marker"))
    number = F.regexp_extract("marker", MARKER, 1)
    return each.withColumn("label", F.when(number != "", F.concat(F.lit("E"), number)))


def resolved_markers(found: DataFrame, context: DataFrame, pool: DataFrame) -> DataFrame:
    """Markers met with context(answer_id, label, evidence_id) and pool(answer_id, label, evidence_id, fatal): the first reason against each, and citation numbers by first valid appearance."""
    c = context.select("answer_id", "label", F.col("evidence_id").alias("context_id"))
    p = pool.select("answer_id", "label", F.col("evidence_id").alias("pool_id"), "fatal")
    met = found.join(c, ["answer_id", "label"], "left").join(p, ["answer_id", "label"], "left")
    reason = F.when(F.col("label").isNull(), "invalid_syntax").when(F.col("context_id").isNull(), "not_in_answer_context").when(F.col("pool_id").isNull(), "not_in_evidence_pool").when(F.col("pool_id") != F.col("context_id"), "context_pool_mismatch").when(F.col("fatal"), "fatal_provenance")
    met = met.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNull(), F.col("position"))).over(Window.partitionBy("answer_id", "label"))
    met = met.withColumn("first", first)
    number = F.dense_rank().over(Window.partitionBy("answer_id", F.col("reason").isNull()).orderBy("first"))
    return met.withColumn("citation_number", F.when(F.col("reason").isNull(), number)).select("answer_id", "position", "marker", "label", "reason", "citation_number")


def rewritten(answers: DataFrame, resolved: DataFrame) -> DataFrame:
    """answers with valid markers as [n], invalid ones removed, spacing repaired, and the validation status."""
    by = resolved.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("position", "citation_number"))).alias("each"), F.count_if(F.col("citation_number").isNotNull()).alias("valid"), F.count_if(F.col("citation_number").isNull()).alias("invalid"))
    met = answers.join(by, "answer_id", "left")
    pieces = F.split("text", MARKER_LIKE)
    number = lambda i: F.coalesce(F.concat(F.lit("["), F.get("each", i)["citation_number"].cast("string"), F.lit("]")), F.lit(""))
    text = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, number(i)).otherwise(""))), "")
    text = spaced(F.regexp_replace(text, r"[ \t]+([,.;:])", "$1"))
    status = F.when(F.coalesce("valid", F.lit(0)) + F.coalesce("invalid", F.lit(0)) == 0, "no_citations").when((F.col("valid") > 0) & (F.col("invalid") > 0), "partially_valid").when(F.col("valid") > 0, "valid").otherwise("invalid")
    return met.select("answer_id", text.alias("text"), status.alias("validation_status"))


def fatal(flag: Column, warnings: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) | F.exists(warnings, lambda w: F.contains(F.lower(w), F.lit("fatal")))


def hard_gate(rows: DataFrame) -> DataFrame:
    """rows(status, sufficient, n_evidence, n_fatal, validation_status, n_citations): the reason that forbids an answer, and what is said then."""
    gates = F.create_map(*[F.lit(x) for kv in HARD_GATES.items() for x in kv])
    reason = F.coalesce(
        F.try_element_at(gates, F.col("status")),
        F.when(~F.coalesce(F.col("sufficient"), F.lit(False)), "insufficient_retrieval_evidence")
        .when(F.col("n_evidence") == 0, "empty_evidence")
        .when(F.col("validation_status").isin("invalid", "no_citations"), "citation_validation_failed")
        .when(F.col("n_citations") == 0, "no_trusted_citations")
        .when(F.col("n_fatal") >= F.col("n_evidence"), "fatal_provenance"),
    )
    said = F.create_map(*[F.lit(x) for kv in ABSTENTIONS.items() for x in kv])
    return rows.withColumn("gate", reason).withColumn("abstention", F.when(F.col("gate").isNotNull(), F.coalesce(F.try_element_at(said, F.col("gate")), F.lit(ABSTENTION))))


def strong_support() -> Column:
    """Whether citations carry what the intent needs; without an intent they do."""
    graph, path, text = F.col("cites_graph") | F.col("cites_path"), F.col("cites_path"), F.col("cites_text")
    base = F.col("sufficient") & (F.col("coverage") == "complete") & (F.col("n_missing") == 0) & (F.col("validation_status") == "valid") & (F.col("n_citations") > 0) & ~F.col("provenance_gap")
    semantic, structural = F.col("semantic_coverage"), F.col("structural_coverage")
    need = F.when(F.col("intent") == SEMANTIC, semantic & text).when(F.col("intent") == MIXED, semantic & structural & text & graph).when(F.col("intent").isin(NEEDS_PATH), structural & path).otherwise(structural & graph)
    return F.col("intent").isNull() | F.coalesce(base & need, F.lit(False))


def confidence(rows: DataFrame) -> DataFrame:
    """Ungated rows with their confidence: high, capped by what is missing; reasons in the order of the checks, each once."""
    strong = strong_support()
    limited = F.coalesce(F.col("coverage") != "complete", F.lit(True))
    partial, gap, missing = F.col("validation_status") == "partially_valid", F.col("provenance_gap"), F.col("n_missing") > 0
    refined = F.col("round") > 1
    level = F.when(limited, "low").when(partial | gap | missing | ~strong, "medium").otherwise("high")
    some = refined | partial | gap | missing | limited | ~strong
    reasons = F.array(F.when(refined, "sufficient_after_refinement"), F.when(partial, "partial_citation_validation"), F.when(gap, "provenance_incomplete"), F.when(missing, "missing_information"), F.when(limited | ~strong, "limited_evidence_coverage"), F.when(strong & ~some, "strong_grounded_support"))
    return rows.withColumn("strong", strong).withColumn("confidence", level).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))


def selected_context(pool: DataFrame, most: int = 10) -> DataFrame:
    """pool(answer_id, pos, evidence_id, supporting_text_evidence_ids): the items of an answer's context.

    Pool order, each graph item's support right after it, nothing twice, at most `most`.
    """
    own = pool.select("answer_id", "evidence_id", "pos", F.lit(-1).alias("child"))
    ids = pool.select("answer_id", "evidence_id")
    support = pool.select("answer_id", "pos", F.posexplode("supporting_text_evidence_ids").alias("child", "evidence_id")).join(ids, ["answer_id", "evidence_id"], "left_semi")
    first = own.unionByName(support).groupBy("answer_id", "evidence_id").agg(F.min(F.struct("pos", "child")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("at"))).where(F.col("place") <= most).select("answer_id", "evidence_id", "place")


# Fixed value: what ends a text that was cut.
TRUNCATED = "\n[truncated]"


def page_range(first: Column, last: Column) -> Column:
    """"3", "3-5", or null without a page."""
    return F.when(last.isNull() | (first == last), first.cast("string")).when(first.isNull(), F.concat(F.lit("None-"), last.cast("string"))).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))


def rendered(items: DataFrame) -> DataFrame:
    """items(label, evidence_type, evidence_id, paper_id, paper_version_id, section_type, page_start, page_end, provenance_complete, warnings, text, entity_ids, relationship_ids, supporting_text_evidence_ids) with `head` and `body`, what a model reads of them; missing values read None."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    whole = F.initcap(F.col("provenance_complete").cast("string"))
    few = F.transform(F.slice("warnings", 1, 3), lambda w: F.concat(F.lit("'"), w, F.lit("'")))
    head = F.concat_ws("\n", F.concat(F.lit('<EVIDENCE id="'), F.col("label"), F.lit('" type="'), F.upper("evidence_type"), F.lit('">')), *[F.concat(F.lit(f"{name}: "), shown(value)) for name, value in (("stable_evidence_id", F.col("evidence_id")), ("paper_id", F.col("paper_id")), ("paper_version_id", F.col("paper_version_id")), ("section", F.col("section_type")), ("pages", page_range(F.col("page_start"), F.col("page_end"))), ("provenance_complete", whole))], F.concat(F.lit("provenance_warnings: ["), F.array_join(few, ", "), F.lit("]")), F.lit("Content:\n"))
    support = F.concat(F.lit("supporting_text_evidence_ids: "), F.array_join("supporting_text_evidence_ids", ", "))
    relation = F.concat_ws("\n", F.lit("Graph relationship:"), F.concat(F.lit("entities: "), F.array_join("entity_ids", " -> ")), F.concat(F.lit("relationships: "), F.array_join("relationship_ids", ", ")), support)
    path = F.concat_ws("\n", F.lit("Graph path:"), F.concat(F.lit("nodes: "), F.array_join("entity_ids", " -> ")), F.concat(F.lit("relationships: "), F.array_join("relationship_ids", " -> ")), support)
    kind = F.col("evidence_type")
    body = F.when(kind == "graph_relationship", relation).when(kind == "graph_path", path).otherwise(F.coalesce("text", F.lit("")))
    return items.withColumn("head", head).withColumn("body", body)


def budgeted(items: DataFrame, most_chars: int, foot: str = "\n</EVIDENCE>") -> DataFrame:
    """items(answer_id, place, head, body): rendered blocks within a budget of characters.

    The first block that doesn't fit has its body cut with a mark if its frame fits, and ends the context.
    """
    frame, size = F.length("head") + len(foot), F.length("head") + F.length("body") + len(foot)
    before = F.coalesce(F.sum(size).over(Window.partitionBy("answer_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = items.withColumn("left", F.lit(most_chars) - before).where((F.col("left") > 0) & (F.col("left") > frame))
    room = F.col("left") - F.length("head") - len(foot)
    cut = F.length("body") > room
    body = F.when(cut, F.concat(F.substring("body", F.lit(1), F.greatest(F.lit(0), room - len(TRUNCATED)).cast("int")), F.lit(TRUNCATED))).otherwise(F.col("body"))
    return rows.withColumn("truncated", cut).withColumn("rendered", F.concat("head", body, F.lit(foot))).drop("left")


def evidence_summary(items: DataFrame, by: list[str]) -> DataFrame:
    kind = F.col("evidence_type")
    return items.groupBy(*by).agg(F.count("*").alias("evidence_count"), F.count_if(kind == "text").alias("text_evidence_count"), F.count_if(kind.isin("graph_relationship", "graph_path")).alias("graph_evidence_count"), F.count_if(kind == "metadata").alias("metadata_evidence_count"))


def uncited(context: DataFrame, cited: DataFrame) -> DataFrame:
    """Labels of an answer's context that no valid marker cites."""
    return context.join(cited.select("answer_id", "label").distinct(), ["answer_id", "label"], "left_anti")
