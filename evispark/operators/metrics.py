"""Evaluation: ranking and structural metrics, aggregates by strategy, case comparison, wins and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def target_matches(items: DataFrame, targets: DataFrame) -> DataFrame:
    """items(case_id, strategy, rank, chunk_id, paper_id, entity_ids, relationship_ids, signature) met with targets(case_id, target_type, target_id, signature): one row for each match.

    An item's ids become rows of kind and key, so that the join is on case, kind and key.
    """
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("key"))
    keys = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: key(kind, x))
    own = F.array(key("chunk", F.col("chunk_id")), key("paper", F.col("paper_id")), key("path", F.to_json("signature")))
    every = F.array_distinct(F.concat(own, keys("entity", F.col("entity_ids")), keys("relationship", F.col("relationship_ids"))))
    held = items.select("case_id", "strategy", "rank", F.inline(every))
    wanted = F.when(F.col("target_type") == "path", F.to_json("signature")).otherwise(F.col("target_id"))
    return held.join(targets.select("case_id", F.col("target_type").alias("kind"), wanted.alias("key"), "target_id"), ["case_id", "kind", "key"]).select("case_id", "strategy", "rank", "target_id")


def path_signature(nodes: Column, rels: Column) -> Column:
    """Node and edge ids by turns, from the first node to the last."""
    pairs = F.transform(nodes, lambda n, i: F.array(n, F.get(rels, i)))
    return F.filter(F.flatten(pairs), lambda x: x.isNotNull())


def ranking_metrics(returned: DataFrame, targets: DataFrame, matches: DataFrame, k: int) -> DataFrame:
    """For each (case_id, strategy) of returned(case_id, strategy, rank): hit@k, reciprocal rank, precision@k, recall@k, nDCG@k.

    Precision counts targets, over the items returned within k, and so may pass 1; the ideal gain ends at the number
    of items returned within k too.
    """
    first = matches.groupBy("case_id", "strategy", "target_id").agg(F.min("rank").alias("first"))
    sums = first.groupBy("case_id", "strategy").agg(F.min("first").alias("best"), F.count_if(F.col("first") <= k).alias("found"), F.sort_array(F.collect_set(F.when(F.col("first") <= k, F.col("first")))).alias("places"))
    sizes = returned.groupBy("case_id", "strategy").agg(F.count_if(F.col("rank") <= k).alias("within"))
    wanted = targets.groupBy("case_id").agg(F.count_distinct("target_id").alias("targets"))
    met = sizes.join(wanted, "case_id", "left").join(sums, ["case_id", "strategy"], "left")
    found, targets_n = F.coalesce("found", F.lit(0)), F.coalesce("targets", F.lit(0))
    gain = lambda ranks: F.aggregate(ranks, F.lit(0.0), lambda s, r: s + 1 / (F.log(r + 1) / F.log(F.lit(2.0))))
    ideal_n = F.least(F.lit(k), targets_n, F.col("within"))
    ideal = F.when(ideal_n > 0, gain(F.transform(F.sequence(F.lit(1), F.greatest(ideal_n, F.lit(1)).cast("int")), lambda r: r.cast("double")))).otherwise(0.0)
    actual = F.coalesce(gain(F.transform("places", lambda r: r.cast("double"))), F.lit(0.0))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return met.select("case_id", "strategy", F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias("hit"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"), share(found, F.col("within")).alias("precision"), share(found, targets_n).alias("recall"), share(actual, ideal).alias("ndcg"))


def endpoint(ordered_entity_ids: Column, path_node_ids: Column, entity_ids: Column) -> Column:
    """The entity that an item ends at: the last of the first of these lists that isn't empty."""
    return F.coalesce(*[F.when(F.size(c) > 0, F.element_at(c, -1)) for c in (ordered_entity_ids, path_node_ids, entity_ids)])


def structural_metrics(items: DataFrame, targets: DataFrame, matches: DataFrame) -> DataFrame:
    """Entity and edge recall, exact path rate and endpoint accuracy of each (case_id, strategy), null where a case has no such target; provenance rate of its items.

    A path target's endpoint is met by an item whose `endpoint` is the target's id, or by the path itself.
    """
    wanted = targets.select("case_id", "target_id", "target_type").distinct()
    pairs = items.groupBy("case_id", "strategy").agg(F.avg(F.col("provenance_complete").cast("double")).alias("provenance_rate"))
    found = matches.select("case_id", "strategy", "target_id", F.lit(True).alias("hit"), F.lit(False).alias("ends"))
    ends = items.where(F.col("endpoint").isNotNull()).select("case_id", "strategy", F.col("endpoint").alias("target_id"), F.lit(False).alias("hit"), F.lit(True).alias("ends"))
    hit = found.unionByName(ends).groupBy("case_id", "strategy", "target_id").agg(F.bool_or("hit").alias("hit"), F.bool_or("ends").alias("ends"))
    met = pairs.join(wanted, "case_id", "left").join(hit, ["case_id", "strategy", "target_id"], "left")
    rate = lambda kind, c: F.avg(F.when(F.col("target_type") == kind, F.coalesce(c, F.lit(False)).cast("double")))
    rates = [rate(kind, F.col("hit")).alias(n) for kind, n in (("entity", "entity_recall"), ("relationship", "relationship_recall"), ("path", "exact_path_match"))]
    return met.groupBy("case_id", "strategy").agg(*rates, rate("path", F.col("hit") | F.col("ends")).alias("endpoint_accuracy"), F.max("provenance_rate").alias("provenance_rate"))


def strategy_aggregate(results: DataFrame) -> DataFrame:
    """results(strategy, category, applicable, hit, recall, reciprocal_rank, latency_ms): means over applicable cases, latencies over all; by strategy, and by category and strategy (category null: all)."""
    of = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("applicable"), F.col(c))), F.lit(0.0)), 9).alias(c)
    lat = F.col("latency_ms")
    return results.groupingSets([("strategy",), ("category", "strategy")], "category", "strategy").agg(F.count("*").alias("cases"), F.count_if("applicable").alias("applicable_cases"), of("hit"), of("recall"), of("reciprocal_rank"), F.round(F.avg(lat), 6).alias("latency_mean"), F.round(F.percentile(lat, F.lit(0.5)), 6).alias("latency_median"), F.round(F.percentile(lat, F.lit(0.95)), 6).alias("latency_p95"))


def latency_percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Percentiles by linear interpolation at (n - 1) * p."""
    at = lambda p: F.round(F.percentile(value, F.lit(p)), 6)
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def case_comparison(results: DataFrame) -> DataFrame:
    """results(case_id, strategy, applicable, hit, reciprocal_rank), a row a strategy: who wins each case.

    An inapplicable strategy has no hit. Hybrid, then graph, win what vector misses; vector wins what it hits unless an
    applicable hybrid hits it too with a greater reciprocal rank.
    """
    of = lambda s, value: F.max(F.when(F.col("strategy") == s, value))
    hits = [F.coalesce(of(s, F.col("applicable") & (F.col("hit") > 0)), F.lit(False)).alias(s) for s in ("vector", "graph", "hybrid")]
    ranks = [F.coalesce(of(s, F.col("reciprocal_rank")), F.lit(0.0)).alias(f"{s}_rank") for s in ("vector", "hybrid")]
    vector, graph, hybrid = map(F.col, ("vector", "graph", "hybrid"))
    verdict = F.when(hybrid & ~vector, "HYBRID_WINS").when(graph & ~vector, "GRAPH_WINS").when(~vector, "ALL_FAIL").when(~hybrid | (F.col("vector_rank") >= F.col("hybrid_rank")), "VECTOR_WINS").otherwise("NO_CLEAR_WIN")
    return results.groupBy("case_id").agg(*hits, *ranks).select("case_id", verdict.alias("comparison"))


def win_lists(comparisons: DataFrame) -> DataFrame:
    """case_comparison() rows as one row a verdict: how many cases, and a list of them in order (as large as the benchmark)."""
    return comparisons.groupBy("comparison").agg(F.count("*").alias("cases"), F.sort_array(F.collect_list("case_id")).alias("case_ids"))


def quality() -> Column:
    """What results(applicable, correct, citations_ok, recall, latency_ms) are compared by, in this order; zeros where a system doesn't apply, which beat a miss that took time."""
    number = lambda c, kind: F.when(F.col("applicable"), c.cast(kind)).otherwise(F.lit(0).cast(kind))
    return F.struct(number(F.col("correct"), "int").alias("a"), number(F.col("citations_ok"), "int").alias("b"), number(F.col("recall"), "double").alias("c"), number(-F.col("latency_ms"), "double").alias("d"))


def pairwise_wins(results: DataFrame) -> DataFrame:
    """results(case_id, system, applicable, correct, citations_ok, recall, latency_ms): wins, ties and losses of each pair of systems by quality()."""
    left = results.select("case_id", F.col("system").alias("left_system"), quality().alias("x"))
    right = results.select("case_id", F.col("system").alias("right_system"), quality().alias("y"))
    met = left.join(right, "case_id").where("left_system < right_system")
    return met.groupBy("left_system", "right_system").agg(F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses"))


def outcomes(results: DataFrame, system: str, others: list[str]) -> DataFrame:
    """Cases where quality() of `system` is above (`win`) or below (`loss`) that of the best of the others; one aggregate. Cases that lack either give no row."""
    best = results.groupBy("case_id").agg(F.max(F.when(F.col("system") == system, quality())).alias("x"), F.max(F.when(F.col("system").isin(others), quality())).alias("y"))
    return best.where(F.col("x") != F.col("y")).select("case_id", F.when(F.col("x") > F.col("y"), "win").otherwise("loss").alias("outcome"))


def failure_reason(returned: Column, provenance_gap: Column, relevant: Column) -> Column:
    return F.when(returned == 0, "no_results").when(provenance_gap, "provenance_gap").when(~relevant, "nothing_relevant")


def failure_histogram(results: DataFrame) -> DataFrame:
    """Cases by system and reason; those without a reason count as `none`."""
    return results.groupBy("system", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("failures"))


CONFIDENCES = ("high", "medium", "low", "insufficient_evidence")


def end_to_end_aggregate(results: DataFrame, by: str = "system") -> DataFrame:
    """end_to_end_scores() rows with (refined, refinement_success, latency_ms, llm_calls, confidence), a row for each `by`.

    Rates have their own denominators, 0 where nothing is in them (planning and strategy: null); answerable are
    applicable cases that expect no disambiguation, of which answers and grounding leave out the unanswerable category.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    rate = lambda c, where: F.coalesce(F.avg(F.when(where, c.cast("double"))), F.lit(0.0))
    status, confidence = F.col("answer_status"), F.coalesce("confidence", F.lit("insufficient_evidence"))
    applies, answered = status != "not_applicable", status == "answered"
    answerable, unanswerable = applies & ~F.col("expected_disambiguation"), applies & (F.col("category") == "unanswerable")
    asked = answerable & (F.col("category") != "unanswerable")
    latency = F.when(applies, F.col("latency_ms"))
    at = lambda p: F.coalesce(F.percentile(latency, F.lit(p)), F.lit(0.0))
    rates = {
        "answer_accuracy": rate(F.col("answer_correct"), asked),
        "correct_abstention_rate": rate(F.col("abstention_correct"), unanswerable),
        "false_answer_rate": rate(answered, unanswerable),
        "grounded_answer_rate": rate(answered & (F.coalesce("trusted_citations", F.lit(0)) > 0) & (confidence != "insufficient_evidence"), asked),
        "evidence_recall": rate(F.col("evidence_recall"), answerable),
        "citation_validity_rate": rate(F.col("citation_validity_rate"), answered),
        "trusted_citation_rate": rate(F.col("trusted_citation_rate"), answered),
        "planning_accuracy": F.avg(F.col("planning_correct").cast("double")),
        "strategy_accuracy": F.avg(F.col("strategy_correct").cast("double")),
        "refinement_rate": rate(yes(F.col("refined")), F.lit(True)),
        "refinement_success_rate": rate(yes(F.col("refinement_success")), F.col("refined")),
        "high_confidence_error_rate": rate(~F.col("answer_correct"), answered & (confidence == "high")),
        "provenance_completeness": rate(F.col("provenance_completeness"), answered),
        "mean_latency_ms": F.coalesce(F.avg(latency), F.lit(0.0)),
        "median_latency_ms": at(0.5),
        "p95_latency_ms": at(0.95),
        "llm_calls_per_query": F.avg("llm_calls"),
    }
    counts = [F.count_if(confidence == c).alias(f"{c}_cases") for c in CONFIDENCES]
    return results.groupBy(by).agg(F.count("*").alias("cases"), *[c.alias(n) for n, c in rates.items()], *counts)


def token_totals(results: DataFrame, by: str = "system") -> DataFrame:
    """results(token_usage map of counts): sums by kind of token; rows without usage add nothing."""
    return results.select(by, F.explode("token_usage").alias("token_kind", "n")).groupBy(by, "token_kind").agg(F.sum("n").alias("tokens"))


def ranked_within(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def planning_accuracy(cases: DataFrame) -> DataFrame:
    """cases(expected_*, planned_* of intent, strategy, operation and entity_type): the share of each that agrees."""
    same = lambda n: F.avg(F.col(f"expected_{n}").eqNullSafe(F.col(f"planned_{n}")).cast("double")).alias(f"{n}_accuracy")
    return cases.agg(*[same(n) for n in ("intent", "strategy", "operation", "entity_type")])


#: What a system that couldn't run gives as its reason; such a row has no scores.
EXECUTION_ERROR = "execution_error"
CITATION_FAULTS = ("invalid", "no_citations", "partially_valid")


def cited_ids(citations: Column) -> Column:
    """Every id that a list of citations holds."""
    none = F.array().cast("array<string>")
    many = lambda c, n: F.coalesce(c[n], none)
    return F.flatten(F.transform(citations, lambda c: F.concat(F.array(c["evidence_id"], c["chunk_id"], c["paper_id"]), many(c, "relationship_ids"), many(c, "entity_ids"), many(c, "source_chunk_ids"))))


def end_to_end_scores(results: DataFrame, planned_system: str = "agentic_hybrid_rag") -> DataFrame:
    """Case results of systems with their scores.

    results: case_id, system, category, expected_abstention, expected_disambiguation; answer_status, answer, citations
    (evidence_id, chunk_id, paper_id, relationship_ids, entity_ids, source_chunk_ids, provenance_complete);
    citation_status, valid_markers, invalid_markers, trusted_citations (null: no validation); relevant_count, n_targets,
    evidence_recall; facts (null: any text will do), required_citations; selected_strategy, planner_intent,
    graph_operation, expected_plan (strategy, intent, operation; null: none); failure_reason where the system gave one.

    An answer is correct if the case wants one, it was answered, a target was found (or none was set), the answer holds
    every fact in any case of letters and every required id is cited. Expected abstentions and disambiguations are kept
    apart from it. Rows of systems that don't apply or that failed to run score nothing.
    """
    none, no = F.array().cast("array<string>"), F.lit(False)
    status, valid, bad = F.col("answer_status"), F.coalesce("valid_markers", F.lit(0)), F.coalesce("invalid_markers", F.lit(0))
    citations = F.col("citations")
    scored = (status != "not_applicable") & ~F.col("failure_reason").eqNullSafe(EXECUTION_ERROR)
    held = F.forall(F.coalesce("facts", none), lambda f: f.isNull() | F.contains(F.lower(F.col("answer")), F.lower(f)))
    cited = F.size(F.array_except(F.coalesce("required_citations", none), F.coalesce(cited_ids(citations), none))) == 0
    answerable = ~F.col("expected_abstention") & ~F.col("expected_disambiguation")
    abstained = status.isin("abstained", "requires_disambiguation", "failed")
    target = (F.col("relevant_count") > 0) | (F.col("n_targets") == 0)
    share = lambda n: F.when(scored & (valid + bad > 0), n / (valid + bad)).otherwise(0.0)
    whole = F.size(F.filter(citations, lambda c: F.coalesce(c["provenance_complete"], F.lit(True))))
    plan, agrees = F.col("expected_plan"), lambda n, c: F.col("expected_plan")[n].isNull() | F.coalesce(F.col("expected_plan")[n] == F.col(c), F.lit(False))
    planned = scored & (F.col("system") == planned_system) & plan.isNotNull()
    out = results.withColumns(
        {
            "abstained": abstained,
            "facts_ok": F.coalesce(held, no),
            "citations_ok": cited,
            "answer_correct": F.coalesce(scored & answerable & (status == "answered") & target & held & cited, no),
            "abstention_correct": F.coalesce(scored & F.col("expected_abstention") & abstained, no),
            "disambiguation_correct": F.coalesce(scored & F.col("expected_disambiguation") & (status == "requires_disambiguation"), no),
            "citation_validity_rate": share(valid),
            "trusted_citation_rate": share(F.coalesce("trusted_citations", F.lit(0))),
            "provenance_completeness": F.when(scored & (F.size(citations) > 0), whole / F.size(citations)).otherwise(0.0),
            "evidence_recall": F.when(scored, F.coalesce("evidence_recall", F.lit(0.0))).otherwise(0.0),
            "strategy_correct": F.when(planned, agrees("strategy", "selected_strategy")),
            "planning_correct": F.when(planned, agrees("strategy", "selected_strategy") & agrees("intent", "planner_intent") & agrees("operation", "graph_operation")),
        }
    )
    fine = F.col("answer_correct") | F.col("abstention_correct") | F.col("disambiguation_correct")
    reason = F.when(fine, F.lit(None)).when(F.col("citation_status").isin(*CITATION_FAULTS), F.concat(F.lit("citation_"), "citation_status")).when(F.col("evidence_recall") == 0, "retrieval_miss").when(answerable & F.col("abstained"), "unnecessary_abstention").otherwise("answer_incorrect")
    return out.withColumn("failure_reason", F.coalesce("failure_reason", reason)).withColumn("expected_disambiguation", scored & F.col("expected_disambiguation"))


def compared(scores: DataFrame) -> DataFrame:
    """end_to_end_scores() rows with latency_ms as pairwise_wins() and outcomes() take them."""
    fine = F.col("answer_correct") | F.col("abstention_correct") | F.col("disambiguation_correct")
    cited = F.coalesce((F.col("citation_status") == "valid") & (F.col("trusted_citations") > 0), F.lit(False))
    return scores.select("case_id", "system", (F.col("answer_status") != "not_applicable").alias("applicable"), fine.alias("correct"), cited.alias("citations_ok"), F.col("evidence_recall").alias("recall"), "latency_ms")
