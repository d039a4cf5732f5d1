"""Fingerprints of configurations and generations: SHA-256 of canonical JSON over fixed fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import fingerprint

# The fields of each fingerprint. Generations name what they were made from and how.
FIELDS = {
    "chunk_config": ["chunking_version", "chunk_size_tokens", "chunk_overlap_tokens", "min_chunk_tokens", "tokenizer_name", "tokenizer_version"],
    "embedding_config": ["provider", "model", "dimension", "normalize", "provider_version"],
    "extraction_config": ["extraction_version", "llm_provider", "llm_model", "llm_provider_version", "prompt_version", "schema_version", "temperature"],
    "canonicalization_config": ["canonicalization_version", "normalization_algorithm_version", "alias_registry_version", "alias_registry_checksum", "ontology_version"],
    "vector_generation": ["chunk_artifact_checksum", "embedding_config_fingerprint"],
    "extraction_generation": ["chunk_artifact_checksum", "extraction_config_fingerprint"],
    "graph_index_generation": ["graph_extraction_artifact_checksum", "canonicalization_config_fingerprint"],
}


def fingerprint_of(kind: str, **values) -> str:
    """Exactly the kind's fields must be given."""
    if set(values) != set(FIELDS[kind]):
        raise ValueError(f"{kind} needs {', '.join(FIELDS[kind])}")
    return fingerprint(values)


# The settings that a benchmark run is named by, beside its dataset's checksum and its cut-offs.
RUN_FIELDS = ["embedding_model", "embedding_provider", "embedding_normalize", "canonicalization_version", "extraction_version", "rrf_k", "vector_top_k", "graph_limit", "hybrid_top_k"]


def dataset_checksum(dataset) -> str:
    """SHA-256 of a benchmark's canonical JSON."""
    return fingerprint(dataset)


def run_fingerprint(checksum: str, k_values: list[int], **settings) -> str:
    """Exactly RUN_FIELDS must be given."""
    if set(settings) != set(RUN_FIELDS):
        raise ValueError(f"a run needs {', '.join(RUN_FIELDS)}")
    return fingerprint({"benchmark_checksum": checksum, "k_values": k_values, **settings})


def generation_of(kind: str, checksum: Column, config: Column) -> Column:
    """A generation fingerprint as a column, from string columns in the order of its fields."""
    names = FIELDS[kind]
    pairs = sorted(zip(names, (checksum, config)))
    quoted = [F.concat(F.lit(f'"{n}":"'), c, F.lit('"')) for n, c in pairs]
    return F.sha2(F.concat(F.lit("{"), quoted[0], F.lit(","), quoted[1], F.lit("}")), 256)
