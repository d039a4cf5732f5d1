"""Stages from pages to vectors, and what a second run does."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from evispark.config import Settings
from evispark.operators import control, decisions, metrics
from evispark.plans import ingestion
from evispark.providers import HashEmbedding

S = Settings(chunk_size=12, chunk_overlap=3, chunk_min_tokens=3)


class Counting(HashEmbedding):
    seen: list = []


@pytest.fixture(scope="module")
def pages(spark):
    text = lambda v, n: f"Running head\n{n}. {['Introduction', 'Methods', 'Results'][n - 1]}\n" + "\n\n".join(f"{v} sentence {n} {k} of the page." for k in range(6)) + f"\nPage {n}"
    return spark.createDataFrame([(f"paper:{v}", f"{v}:v1", n, text(v, n)) for v in ("x", "y") for n in (1, 2, 3)], "paper_id string, paper_version_id string, page_number int, text string")


def test_stages_and_reuse(spark, pages):
    sections = ingestion.parse(pages)
    assert [(r.section_type, "Running" in r.text, "Page" in r.text) for r in sections.where("paper_id = 'paper:x'").orderBy("order").collect()] == [("introduction", False, False), ("methodology", False, False), ("results", False, False)]
    chunks = ingestion.chunk(sections, S).cache()
    schema = chunks.withColumn("vector", F.array().cast("array<float>")).withColumn("vector_generation_fingerprint", F.lit("")).limit(0)
    empty = schema.select("chunk_id", "paper_version_id", "text", "vector", "vector_generation_fingerprint")
    one = ingestion.index(chunks, empty, HashEmbedding()).cache()
    ingestion.verified(one, chunks)
    again = ingestion.index(chunks, one, HashEmbedding())
    key = lambda df: sorted((r.chunk_id, tuple(r.vector), r.vector_generation_fingerprint) for r in df.collect())
    assert key(again) == key(one)
    changed = ingestion.chunk(ingestion.parse(pages.withColumn("text", F.when(F.col("paper_id") == "paper:x", F.concat("text", F.lit("\nmore words here"))).otherwise(F.col("text")))), S).cache()
    two = ingestion.index(changed, one, HashEmbedding()).cache()
    ingestion.verified(two, changed)
    y = lambda df: key(df.where("paper_version_id = 'y:v1'"))
    assert y(two) == y(one) and key(two) != key(one)
    with pytest.raises(ValueError):
        ingestion.verified(one.limit(1), chunks)


def test_versions_and_moves(spark):
    asked = spark.createDataFrame([("p", "v1", "a"), ("p", "v2", "b"), ("q", "v1", None)], "paper_id string, version string, checksum string")
    stored = spark.createDataFrame([("p", "v1", "z"), ("q", "v1", "c")], "paper_id string, version string, checksum string")
    new, conflicts = control.new_versions(asked, stored)
    assert [r.version for r in new.collect()] == ["v2"] and [r.paper_id for r in conflicts.collect()] == ["p"]
    v = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "paper_version_id string, pages int, parser string")
    r = spark.createDataFrame([("b", None)], "paper_version_id string, pages int")
    assert sorted(tuple(x) for x in control.stage_results(v, r).collect()) == [("a", 1, "x"), ("b", None, "y")]
    jobs = spark.createDataFrame([("j", "parsing", None, None)], "job_id string, status string, started_at timestamp, completed_at timestamp")
    assert control.moved(jobs, "parsed", datetime(2024, 1, 1)).first().started_at == datetime(2024, 1, 1)
    with pytest.raises(Exception, match="illegal move"):
        control.moved(jobs, "ready", datetime(2024, 1, 1)).collect()
    more = spark.createDataFrame([("j", "parsed", None), ("k", "ready", None), ("l", "failed", "chunking")], "job_id string, status string, failed_stage string")
    assert {(r.next_stage, r.jobs) for r in ingestion.work_left(more).collect()} == {("chunk", 1)}


CASES = {
    # category, status, answer, facts, relevant, targets, required, cited, citation_status, valid, invalid, given reason -> correct, abstention, disambiguation, reason
    "right": ("semantic", "answered", "It uses GraphRAG.", ["graphrag", None], 1, 2, ["E1"], ["E1"], "valid", 1, 0, None, (True, False, False, None)),
    "no target found": ("semantic", "answered", "It uses GraphRAG.", ["graphrag"], 0, 2, [], ["E1"], "valid", 1, 0, None, (False, False, False, "retrieval_miss")),
    "no target set": ("semantic", "answered", "yes", [], 0, 0, [], ["E1"], "valid", 1, 0, None, (True, False, False, None)),
    "fact lacks": ("semantic", "answered", "No", ["x"], 1, 2, [], ["E1"], "valid", 1, 0, None, (False, False, False, "answer_incorrect")),
    "citation lacks": ("semantic", "answered", "x", ["x"], 1, 2, ["E2"], ["E1"], "partially_valid", 1, 1, None, (False, False, False, "citation_partially_valid")),
    "needless": ("semantic", "abstained", "", [], 1, 2, [], [], None, None, None, None, (False, False, False, "unnecessary_abstention")),
    "abstains": ("unanswerable", "abstained", "", [], 0, 0, [], [], None, None, None, None, (False, True, False, None)),
    "should abstain": ("unanswerable", "answered", "x", [], 1, 0, [], ["E1"], "valid", 1, 0, None, (False, False, False, "answer_incorrect")),
    "asks back": ("ambiguous", "requires_disambiguation", "", [], 0, 0, [], [], None, None, None, None, (False, False, True, None)),
    "not applicable": ("ambiguous", "not_applicable", "", [], 1, 1, [], [], None, None, None, "no graph", (False, False, False, "no graph")),
    "broken": ("unanswerable", "failed", "", [], 1, 1, [], [], None, None, None, "execution_error", (False, False, False, "execution_error")),
}


def scored_cases(spark):
    citation = "struct<evidence_id string, chunk_id string, paper_id string, relationship_ids array<string>, entity_ids array<string>, source_chunk_ids array<string>, provenance_complete boolean>"
    schema = f"case_id string, system string, category string, expected_abstention boolean, expected_disambiguation boolean, answer_status string, answer string, facts array<string>, relevant_count int, n_targets int, evidence_recall double, required_citations array<string>, citations array<{citation}>, citation_status string, valid_markers int, invalid_markers int, trusted_citations int, failure_reason string, selected_strategy string, planner_intent string, graph_operation string, expected_plan struct<strategy string, intent string, operation string>, refined boolean, refinement_success boolean, latency_ms double, llm_calls int, confidence string, token_usage map<string,bigint>"
    rows = []
    for name, (category, status, answer, facts, relevant, targets, required, cited, check, valid, bad, given, _) in CASES.items():
        citations = [(c, None, None, None, [], None, None if n == 0 else False) for n, c in enumerate([*cited, *cited])]
        rows.append((name, "agentic_hybrid_rag", category, category == "unanswerable", category == "ambiguous", status, answer, facts, relevant, targets, relevant / 2, required, citations, check, valid, bad, valid and 1, given, "hybrid", "mixed", None, ("hybrid", "other", None) if targets else None, name == "right", name == "right", float(len(name)), 2, "high" if name in ("right", "fact lacks") else None, {"prompt": 3} if targets else None))
    return metrics.end_to_end_scores(spark.createDataFrame(rows, schema))


def test_end_to_end_scores(spark):
    """Worked by hand: answers, abstentions and disambiguations apart, the first failure reason that fits, no scores for what didn't run."""
    got = {r.case_id: r for r in scored_cases(spark).collect()}
    assert {k: (r.answer_correct, r.abstention_correct, r.disambiguation_correct, r.failure_reason) for k, r in got.items()} == {k: v[-1] for k, v in CASES.items()}
    assert (got["citation lacks"].citation_validity_rate, got["citation lacks"].trusted_citation_rate, got["right"].provenance_completeness) == (0.5, 0.5, 0.5)
    assert (got["right"].strategy_correct, got["right"].planning_correct, got["abstains"].planning_correct, got["broken"].planning_correct) == (True, False, None, None)
    assert got["broken"].evidence_recall == 0 and not got["not applicable"].expected_disambiguation


def test_end_to_end_aggregate(spark):
    rows = scored_cases(spark)
    r = metrics.end_to_end_aggregate(rows).first()
    # asked: right, no target found, no target set, fact lacks, citation lacks, needless; unanswerable and applicable: three
    assert (r.cases, r.answer_accuracy, r.correct_abstention_rate, r.false_answer_rate) == (11, pytest.approx(2 / 6), pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert r.grounded_answer_rate == pytest.approx(2 / 6) and r.evidence_recall == pytest.approx(5 * 0.5 / 9) and r.high_confidence_error_rate == 0.5
    assert (r.planning_accuracy, r.strategy_accuracy, r.refinement_rate, r.refinement_success_rate) == (0.0, 1.0, pytest.approx(1 / 11), 1.0)
    assert (r.high_cases, r.insufficient_evidence_cases, r.llm_calls_per_query) == (2, 9, 2.0)
    latencies = sorted(len(k) for k in CASES if k != "not applicable")
    assert r.median_latency_ms == (latencies[4] + latencies[5]) / 2 and r.p95_latency_ms == pytest.approx(latencies[8] + 0.55 * (latencies[9] - latencies[8]))
    assert list(map(tuple, metrics.token_totals(rows).collect())) == [("agentic_hybrid_rag", "prompt", 21)]
    empty = metrics.end_to_end_aggregate(rows.where("case_id = 'not applicable'")).first()
    assert (empty.cases, empty.answer_accuracy, empty.planning_accuracy, empty.p95_latency_ms) == (1, 0.0, None, 0.0)


def test_planning_accuracy(spark):
    acc = metrics.planning_accuracy(spark.createDataFrame([("a", "b", None, "paper", "a", "c", None, "paper")], ", ".join(f"{p}_{n} string" for p in ("expected", "planned") for n in ("intent", "strategy", "operation", "entity_type")))).first()
    assert tuple(acc) == (1.0, 0.0, 1.0, 1.0)


def test_evidence_is_counted_by_kind(spark):
    items = spark.createDataFrame([(1, "text"), (1, "graph_path"), (1, "graph_relationship"), (1, "metadata"), (2, "text")], "q int, evidence_type string")
    assert sorted(map(tuple, decisions.evidence_summary(items, ["q"]).collect())) == [(1, 4, 1, 2, 1), (2, 1, 1, 0, 0)]
