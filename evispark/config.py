"""Settings that define semantics, with their bounds."""

from __future__ import annotations

from dataclasses import dataclass


class BoundError(ValueError):
    """A request outside its bounds; requests are refused, never clamped."""


@dataclass(frozen=True)
class Settings:
    discovery_results: int = 20
    discovery_limit: int = 100
    chunk_size: int = 700
    chunk_overlap: int = 100
    chunk_min_tokens: int = 80
    embedding_batch: int = 32
    vector_top_k: int = 5
    vector_top_k_max: int = 50
    graph_depth_max: int = 3
    graph_limit: int = 20
    graph_limit_max: int = 100
    supporting_chunks: int = 5
    rrf_k: int = 60
    hybrid_top_k: int = 10
    hybrid_top_k_max: int = 50
    retrieval_rounds: int = 2
    answer_items: int = 10
    answer_chars: int = 30_000
    llm_retries: int = 2

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise BoundError("overlap must be below the chunk size")


def bounded(name: str, value: int | None, default: int, most: int) -> int:
    """The value, or the default for None; an error outside 1..most."""
    value = default if value is None else value
    if not 1 <= value <= most:
        raise BoundError(f"{name} must be between 1 and {most}, not {value}")
    return value
