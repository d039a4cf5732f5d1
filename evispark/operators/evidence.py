"""Evidence algebra: adapters, the provenance bridge, reciprocal-rank fusion, pools and round merges, for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import evidence_id

NO_RANK, ROUNDING = 1_000_000, 1e-9


def text_evidence_id(chunk: Column | str, generation: Column | str, store: str = "qdrant") -> Column:
    return evidence_id(F.lit("text"), F.lit(store), chunk, generation)


def text_evidence(hits: DataFrame, *, on_invalid: str = "raise") -> DataFrame:
    """Vector hits (chunk_id, vector_generation_fingerprint, score, ...) as evidence; similarities outside [0, 1] raise, or (on_invalid="mark") stay as rows without evidence that `valid` marks."""
    # a cosine of equal vectors may pass 1 by rounding
    near = F.when(F.col("score").between(-ROUNDING, 1 + ROUNDING), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).otherwise(F.col("score"))
    hits = hits.withColumn("score", near)
    fits = F.col("score").isNull() | F.col("score").between(0, 1)
    made = text_evidence_id("chunk_id", "vector_generation_fingerprint")
    if on_invalid == "mark":
        hits, made = hits.withColumn("valid", fits), F.when(fits, made)
    else:
        hits = hits.withColumn("score", F.when(fits, F.col("score")).otherwise(F.raise_error(F.lit("similarity outside [0, 1]")).cast("double")))
    kind = F.when(F.col("score").isNotNull() & fits, "vector_similarity")
    return hits.withColumn("evidence_id", made).withColumn("evidence_type", F.lit("text")).withColumn("score_kind", kind)


def chunk_evidence(chunks: DataFrame) -> DataFrame:
    """Chunks that were looked up by id as evidence: the ids that hits have, and no score."""
    return text_evidence(chunks.withColumn("score", F.lit(None).cast("double"))).withColumn("exact_lookup", F.lit(True))


def graph_provenance(rels: Column | str) -> dict[str, Column]:
    """From rels, an array of edges in path order: chunk ids (primary first, then sorted supporting ones), provenance type, first version and generation."""
    rels = F.col(rels) if isinstance(rels, str) else rels
    none = F.array().cast("array<string>")
    chunks = F.array_distinct(F.filter(F.flatten(F.transform(rels, lambda r: F.concat(F.array(r["source_chunk_id"]), F.array_sort(F.coalesce(r["supporting_chunk_ids"], none))))), lambda c: F.coalesce(c, F.lit("")) != ""))
    kinds = F.array_distinct(F.filter(F.transform(rels, lambda r: r["provenance_type"]), lambda p: F.coalesce(p, F.lit("")) != ""))
    kind = F.when(F.size(kinds) == 0, "graph").when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("mixed")
    return {"source_chunk_ids": chunks, "provenance_type": kind}


def chunk_versions(rels: Column | str, chunks: Column) -> Column:
    """The paper version that each of `chunks` (distinct, some few) should be of: that of the last edge with a version that names the chunk."""
    rels = F.col(rels) if isinstance(rels, str) else rels
    versioned = F.filter(rels, lambda r: F.coalesce(r["paper_version_id"], F.lit("")) != "")
    names = lambda r, c: F.coalesce(r["source_chunk_id"] == c, F.lit(False)) | F.coalesce(F.array_contains(r["supporting_chunk_ids"], c), F.lit(False))
    return F.map_from_arrays(chunks, F.transform(chunks, lambda c: F.try_element_at(F.filter(versioned, lambda r: names(r, c)), F.lit(-1))["paper_version_id"]))


def bridge(graph: DataFrame, chunks: DataFrame, most: int = 5, *, generation: str | None = None, strict: bool = True) -> DataFrame:
    """graph(query_id, evidence_id, source_chunk_ids, provenance_type) with the text evidence of its first `most` chunks.

    Support ids stand in list order; a missing chunk is a warning; evidence without chunks is complete unless it is
    metadata. chunks(chunk_id, vector_generation_fingerprint) are met in one join instead of a lookup an item.

    A chunk of another vector generation than `generation`, or of another paper version than expected, is foreign: it
    fails the job, or where `strict` is off gives a warning and no support. The expected version is the chunk's in graph's
    chunk_versions (a map), else graph's paper_version_id; each is compared if its column is there and not null, and
    chunks have a paper_version_id.
    """
    versions = "paper_version_id" in chunks.columns
    nothing = F.lit(None).cast("string")
    listed = F.col("chunk_versions") if "chunk_versions" in graph.columns else F.lit(None).cast("map<string,string>")
    wanted = graph.select("query_id", "evidence_id", listed.alias("listed"), (F.col("paper_version_id") if "paper_version_id" in graph.columns else nothing).alias("version"), F.posexplode(F.slice("source_chunk_ids", 1, most)).alias("at", "chunk_id"))
    wanted = wanted.select("query_id", "evidence_id", "at", "chunk_id", F.coalesce(F.try_element_at("listed", F.col("chunk_id")), "version").alias("expected"))
    store = chunks.select("chunk_id", text_evidence_id("chunk_id", "vector_generation_fingerprint").alias("text_id"), F.col("vector_generation_fingerprint").alias("held_generation"), (F.col("paper_version_id") if versions else nothing).alias("held_version"))
    foreign = F.lit(False)
    if versions:
        foreign = foreign | (F.col("text_id").isNotNull() & F.col("expected").isNotNull() & ~F.col("held_version").eqNullSafe(F.col("expected")))
    if generation is not None:
        foreign = foreign | (F.col("text_id").isNotNull() & ~F.col("held_generation").eqNullSafe(generation))
    met = wanted.join(store, "chunk_id", "left").withColumn("foreign", foreign)
    if strict:
        # the check stands in the id that is used, so that no column pruning can take it away
        fault = F.raise_error(F.concat(F.lit("foreign chunk "), "chunk_id", F.lit(": paper version "), F.coalesce("held_version", F.lit("unknown")), F.lit(", vector generation "), F.coalesce("held_generation", F.lit("unknown"))))
        met = met.withColumn("text_id", F.when(F.col("foreign"), fault).otherwise(F.col("text_id")))
    met = met.groupBy("query_id", "evidence_id").agg(F.array_sort(F.collect_list(F.struct("at", "text_id", "chunk_id", "foreign"))).alias("each"))
    found = F.transform(F.filter("each", lambda e: e["text_id"].isNotNull() & ~e["foreign"]), lambda e: e["text_id"])
    lost = F.transform(F.filter("each", lambda e: e["text_id"].isNull() | e["foreign"]), lambda e: F.concat(F.when(e["foreign"], "foreign chunk ").otherwise("missing chunk "), e["chunk_id"]))
    met = met.select("query_id", "evidence_id", found.alias("supporting_text_evidence_ids"), lost.alias("lost"))
    none = F.array().cast("array<string>")
    out = graph.join(met, ["query_id", "evidence_id"], "left")
    bare = (F.size("source_chunk_ids") == 0) & (F.col("provenance_type") == "metadata")
    warnings = F.when(bare, F.array(F.lit("metadata evidence has no chunk"))).otherwise(F.coalesce("lost", none))
    return out.withColumn("warnings", warnings).withColumn("supporting_text_evidence_ids", F.coalesce("supporting_text_evidence_ids", none)).withColumn("provenance_complete", F.size("warnings") == 0).drop("lost")


def ranked(items: DataFrame, branch: str) -> DataFrame:
    """items(query_id, evidence_id, pos) as a branch with ranks from 1."""
    return items.withColumn("branch", F.lit(branch)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")))


def fused(vector: DataFrame, graph: DataFrame, support: DataFrame, *, k: int = 60, top_k: int | None = 10) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, evidence_id, pos) branches, graph with supporting_text_evidence_ids.

    Support joins with score 0 and no rank. Sums are exact in any order: a branch's share is added by rank. A graph
    item is cross-store supported if the vector branch holds one of its support ids.
    """
    share = lambda df, name: ranked(df.select("query_id", "evidence_id", "pos"), name)
    rows = share(vector, "vector").unionByName(share(graph, "graph")).unionByName(support.select("query_id", "evidence_id", "pos").withColumn("branch", F.lit("graph_support")).withColumn("rank", F.lit(None).cast("int")))
    one = rows.groupBy("query_id", "evidence_id", "branch").agg(F.sum(F.coalesce(1 / (k + F.col("rank")), F.lit(0.0))).alias("score"), F.max("rank").alias("rank"))
    of = lambda b: F.coalesce(F.max(F.when(F.col("branch") == b, F.col("score"))), F.lit(0.0))
    out = one.groupBy("query_id", "evidence_id").agg((of("vector") + of("graph")).alias("fusion_score"), F.min("rank").alias("best_rank"), F.array_sort(F.collect_set("branch")).alias("branches"))
    linked = graph.select("query_id", "evidence_id", F.explode("supporting_text_evidence_ids").alias("text_id")).join(vector.select("query_id", F.col("evidence_id").alias("text_id")), ["query_id", "text_id"], "left_semi").select("query_id", "evidence_id").distinct().withColumn("linked", F.lit(True))
    out = out.join(linked, ["query_id", "evidence_id"], "left").withColumn("cross_store_supported", F.coalesce("linked", F.lit(False))).drop("linked")
    order = Window.partitionBy("query_id").orderBy(F.desc("fusion_score"), F.coalesce("best_rank", F.lit(NO_RANK)), "evidence_id")
    out = out.withColumn("position", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("position") <= top_k)


def fusion_diagnostics(vector: DataFrame, graph: DataFrame, support: DataFrame, whole: DataFrame) -> DataFrame:
    """One row a query: candidates of each branch, unique items, duplicates, cross-store links."""
    n = lambda df, name: df.select("query_id", F.lit(name).alias("branch"))
    counts = n(vector, "vector").union(n(graph, "graph")).union(n(support, "support")).groupBy("query_id").agg(*[F.count_if(F.col("branch") == b).alias(f"{b}_candidates") for b in ("vector", "graph", "support")])
    own = whole.groupBy("query_id").agg(F.count("*").alias("unique_items"), F.count_if("cross_store_supported").alias("cross_store_links"))
    out = counts.join(own, "query_id")
    return out.withColumn("duplicates", F.col("vector_candidates") + F.col("graph_candidates") + F.col("support_candidates") - F.col("unique_items"))


def pool(items: DataFrame) -> DataFrame:
    """items(query_id, evidence_id, pos): the first of equal ids, labelled E1, E2, ... in order."""
    first = items.groupBy("query_id", "evidence_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("label", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("string")))


def merged_rounds(rounds: DataFrame) -> DataFrame:
    """rounds(query_id, evidence_id, round, pos): rounds of each item, first round's place first."""
    return rounds.groupBy("query_id", "evidence_id").agg(F.array_sort(F.collect_set("round")).alias("retrieval_rounds"), F.min("round").alias("first_seen_round"), F.min(F.struct("round", "pos"))["pos"].alias("pos"))


def new_evidence(refined: DataFrame, known: DataFrame) -> DataFrame:
    """A count for each refined query of items that the pool lacks; 0 ends the refinement."""
    fresh = refined.select("query_id", "evidence_id").distinct().join(known.select("query_id", "evidence_id"), ["query_id", "evidence_id"], "left_anti").groupBy("query_id").agg(F.count("*").alias("n"))
    return refined.select("query_id").distinct().join(fresh, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("new_items"))
