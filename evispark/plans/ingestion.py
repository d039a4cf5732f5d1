"""Pages to sections, chunks, vectors and graph, stage by stage; a stage runs only for versions whose generation changed.

Each stage is a plan over all versions at once. Its output carries the generation it was made under, so stale rows are
those whose generation differs, and running again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.ids import section_id
from ..functions.lineage import generation_of
from ..operators import chunking, control, graph_build, text_etl, vectors
from ..providers import EmbeddingProvider, StructuredModel, embedded, embedding_fingerprint, extracted


def parse(pages: DataFrame) -> DataFrame:
    """pages(paper_id, paper_version_id, page_number, text) -> sections: cleanup, headers and footers, headings."""
    papers = pages.select("paper_version_id", "paper_id").distinct()
    clean = text_etl.without_headers_footers(text_etl.clean_pages(pages.select("paper_version_id", "page_number", "text")))
    found = text_etl.sections(clean).join(papers, "paper_version_id")
    return found.withColumn("section_id", section_id("paper_version_id", "section_type", "order"))


def artifact_checksums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(paper_version_id, checksum): one digest of a version's rows, in any order of rows."""
    each = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    return rows.groupBy("paper_version_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(each)), ""), 256).alias("checksum"))


def chunk(sections: DataFrame, settings: Settings) -> DataFrame:
    return chunking.chunks(sections.select("section_id", "paper_id", "paper_version_id", "section_type", F.col("title").alias("section_title"), "page_start", "page_end", "text"), settings)


def vector_generations(chunks: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """(paper_version_id, generation): exactly these chunks under exactly this embedding."""
    sums = artifact_checksums(chunks, ["chunk_id", "text"])
    return sums.select("paper_version_id", generation_of("vector_generation", F.col("checksum"), F.lit(embedding_fingerprint(provider))).alias("generation"))


def index(chunks: DataFrame, stored: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """The vector table after a run: stale and new versions embedded, others kept as they are, stale points gone.

    stored has chunks' columns, vector and vector_generation_fingerprint. Only versions with work to do are embedded.
    """
    now = vector_generations(chunks, provider)
    have = stored.select("paper_version_id", F.col("vector_generation_fingerprint").alias("generation")).distinct()
    points = stored.groupBy("paper_version_id").agg(F.count("*").alias("points"))
    expected = chunks.groupBy("paper_version_id").agg(F.count("*").alias("expected"))
    short = expected.join(points, "paper_version_id", "left").where("points is null or points <> expected").select("paper_version_id")
    todo = now.join(have, ["paper_version_id", "generation"], "left_anti").select("paper_version_id").union(short).distinct()
    fresh = embedded(chunks.join(todo, "paper_version_id", "left_semi"), provider).join(now.withColumnRenamed("generation", "vector_generation_fingerprint"), "paper_version_id")
    merged = vectors.upsert_points(stored, fresh.select(*stored.columns).withColumn("pos", F.lit(1)))
    return vectors.delete_stale(merged, now).join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def verified(table: DataFrame, chunks: DataFrame) -> None:
    """Every version must hold as many points as chunks before it is published."""
    a = table.groupBy("paper_version_id").agg(F.count("*").alias("n"))
    b = chunks.groupBy("paper_version_id").agg(F.count("*").alias("n"))
    if not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()):
        raise ValueError("points and chunks differ in number")


def reuse_or_run(inputs: DataFrame, stored: DataFrame, now: DataFrame, make: Callable[[DataFrame], DataFrame], generation: str) -> tuple[DataFrame, DataFrame]:
    """A stage's table after a run, and the versions that had work to do.

    now(paper_version_id, generation) names what each version's output must be made of and how; stored rows of that
    generation (in the column `generation` names) are reused, versions without any run through make(), and rows of other
    generations, or of versions that are gone, are left out. Running again changes nothing.
    """
    current = now.select("paper_version_id", F.col("generation").alias(generation))
    kept = stored.join(current, ["paper_version_id", generation], "left_semi")
    todo = current.join(stored.select("paper_version_id", generation).distinct(), ["paper_version_id", generation], "left_anti")
    fresh = make(inputs.join(todo, "paper_version_id", "left_semi")).join(todo, "paper_version_id")
    return kept.unionByName(fresh.select(*stored.columns)), todo.select("paper_version_id")


def parse_stage(pages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections of pages, reused while a version's pages are the same."""
    now = artifact_checksums(pages, ["page_number", "text"]).withColumnRenamed("checksum", "generation")
    return reuse_or_run(pages, stored, now, parse, "parsed_checksum")


def chunk_stage(sections: DataFrame, stored: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Chunks of sections, reused while a version's sections and the chunking are the same."""
    sums = artifact_checksums(sections, ["section_id", "title", "text"])
    now = sums.select("paper_version_id", F.sha2(F.concat_ws("|", "checksum", F.lit(chunking.config_fingerprint(settings))), 256).alias("generation"))
    return reuse_or_run(sections, stored, now, lambda rows: chunk(rows, settings), "chunk_generation")


def extract_stage(chunks: DataFrame, stored: DataFrame, model: StructuredModel, config: str, retries: int = 2) -> tuple[DataFrame, DataFrame]:
    """Candidates of the sections that are asked for knowledge, reused while a version's chunks and the extraction's configuration are the same."""
    asked = graph_build.extractable(chunks)
    now = artifact_checksums(asked, ["chunk_id", "text"]).select("paper_version_id", generation_of("extraction_generation", F.col("checksum"), F.lit(config)).alias("generation"))
    return reuse_or_run(asked, stored, now, lambda rows: extracted(rows, model, retries), "extraction_generation_fingerprint")


def graph_of(candidates: DataFrame) -> DataFrame:
    """Candidates as edges from their papers: checked against the ontology, grouped by paper, type and target."""
    entities = candidates.where((F.col("kind") == "entity") & graph_build.entity_rejection().isNull())
    known = graph_build.entity_supports(entities.withColumn("entity_type", F.lower("entity_type"))).select("entity_type", "key").distinct()
    sound = graph_build.validated_relationships(candidates.where("kind = 'relationship'")).where("reject_reason is null")
    rows = sound.withColumn("relationship_type", F.lower("relationship_type")).withColumn("target_type", F.lower("target_type"))
    versions = candidates.select("paper_id", "paper_version_id").distinct()
    edges = graph_build.group_relationships(rows, known).join(versions, "paper_id")
    return graph_build.edge_rows(edges.select("relationship_id", F.col("paper_id").alias("source_entity_id"), "relationship_type", "target_entity_id", "confidence", "source_chunk_id", "supporting_chunk_ids", "paper_version_id"))


def graph_stage(candidates: DataFrame, stored: DataFrame, config: str) -> tuple[DataFrame, DataFrame]:
    """Edges of candidates, reused while a version's candidates and the canonicalisation are the same."""
    own = ["chunk_id", "pos", "kind", "entity_type", "name", "relationship_type", "target_type", "target_name", "usage", "confidence"]
    now = artifact_checksums(candidates, own).select("paper_version_id", generation_of("graph_index_generation", F.col("checksum"), F.lit(config)).alias("generation"))
    return reuse_or_run(candidates, stored, now, graph_of, "graph_index_generation_fingerprint")


def work_left(jobs: DataFrame) -> DataFrame:
    """Active jobs by the stage that they run next."""
    return control.resume_points(control.active_jobs(jobs)).groupBy("next_stage").agg(F.count("*").alias("jobs"))
