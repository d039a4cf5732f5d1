"""Schemas of the engine's tables and its closed vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

PAPERS = "paper_id string, source string, source_id string, title string, abstract string, authors array<string>, categories array<string>, published_at timestamp, updated_at timestamp, pdf_url string"
PAGES = "paper_version_id string, page_number int, text string"
SECTIONS = "section_id string, paper_id string, paper_version_id string, section_type string, title string, `order` int, page_start int, page_end int, text string"
CHUNKS = "chunk_id string, paper_id string, paper_version_id string, section_id string, section_type string, section_title string, chunk_index int, text string, token_count int, page_start int, page_end int, chunking_version string, overlap_tokens int, chunk_config_fingerprint string"
NODES = "entity_id string, entity_type string, canonical_name string, aliases array<string>, properties map<string,string>"
EDGES = "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, extraction_version string, source_chunk_id string, supporting_chunk_ids array<string>, provenance_type string, paper_version_id string, graph_index_generation_fingerprint string"

# The closed vocabularies.
SECTION_TYPES = ["abstract", "introduction", "related_work", "methodology", "experiments", "results", "discussion", "limitations", "conclusion", "references", "other"]
ENTITY_TYPES = ["paper", "author", "method", "dataset", "task"]
RELATIONSHIPS = ["authored_by", "cites", "uses_method", "evaluated_on", "addresses"]
#: Relationship type, source type, target type.
ONTOLOGY = [("authored_by", "paper", "author"), ("cites", "paper", "paper"), ("uses_method", "paper", "method"), ("evaluated_on", "paper", "dataset"), ("addresses", "paper", "task")]
#: Status, next status; any active status may also fail.
STATUS_CHAIN = ["discovered", "downloading", "downloaded", "parsing", "parsed", "chunking", "chunked", "vector_indexing", "vector_indexed", "graph_indexing", "graph_indexed", "ready"]
EVIDENCE_TYPES = ["text", "graph_entity", "graph_relationship", "graph_path"]


def ontology(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ONTOLOGY, "relationship_type string, source_type string, target_type string")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """df with exactly the schema's columns and types."""
    schema = StructType.fromDDL(ddl)
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])
