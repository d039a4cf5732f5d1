"""Explicit retrieval for one question: vector, graph or hybrid, fused into a labelled pool. Results are bounded by the settings' limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import BoundError, Settings, bounded
from ..operators import evidence as E
from ..operators import graph_paths as G
from ..operators import vectors as V
from ..providers import EmbeddingProvider


class EntityNotFound(LookupError):
    pass


class EntityAmbiguous(LookupError):
    def __init__(self, name: str, candidates: list[str]):
        super().__init__(f"{name} has several candidates")
        self.candidates = candidates


@dataclass
class Store:
    """The tables of a corpus: vectors also hold the chunks' text and paper_id."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame


@dataclass
class Result:
    items: list[dict[str, Any]] = field(default_factory=list)
    vector: list[dict[str, Any]] = field(default_factory=list)
    graph: list[dict[str, Any]] = field(default_factory=list)
    diagnostics: dict[str, Any] = field(default_factory=dict)

    def pool(self) -> list[tuple[str, dict[str, Any]]]:
        """First-wins by id, labelled E1, E2, ..."""
        first = {i["evidence_id"]: i for i in reversed(self.items)}
        order = dict.fromkeys(i["evidence_id"] for i in self.items)
        return [(f"E{n}", first[e]) for n, e in enumerate(order, 1)]


def _text_item(r: Row) -> dict[str, Any]:
    """A text evidence row as an item; what the vector table doesn't hold is None."""
    own = r.asDict()
    return {"evidence_id": r.evidence_id, "evidence_type": "text", "chunk_id": r.chunk_id, "paper_id": r.paper_id, "text": r.text, "score": r.score, "score_kind": r.score_kind, "entity_ids": [], "relationship_ids": [], "source_chunk_ids": [r.chunk_id], "support": [], "warnings": [], "provenance_complete": True, **{c: own.get(c) for c in ("paper_version_id", "section_type", "page_start", "page_end")}}


class Retriever:
    def __init__(self, store: Store, provider: EmbeddingProvider, settings: Settings | None = None):
        self.store, self.provider, self.settings = store, provider, settings or Settings()
        self.spark: SparkSession = store.nodes.sparkSession

    def resolve(self, entity_id: str | None = None, name: str | None = None, entity_type: str | None = None) -> str:
        """An id wins; else a name, of a type if one is given, must have exactly one node."""
        nodes = self.store.nodes
        if entity_id is not None:
            if nodes.where(F.col("entity_id") == entity_id).isEmpty():
                raise EntityNotFound(entity_id)
            return entity_id
        if not name or not name.strip():
            raise BoundError("an entity id or a name is needed")
        asked = self.spark.createDataFrame([(name, entity_type)], "name string, entity_type string")
        found = [r.entity_id for r in G.lookup_by_name(asked, nodes, 2).orderBy("place").collect()]
        if not found:
            raise EntityNotFound(name)
        if len(found) > 1:
            raise EntityAmbiguous(name, found)
        return found[0]

    def vector_search(self, query: str, top_k: int | None = None, filters: dict[str, str] | None = None) -> list[dict[str, Any]]:
        s = self.settings
        if not query.strip():
            raise BoundError("a query must not be blank")
        k = bounded("top_k", top_k, s.vector_top_k, s.vector_top_k_max)
        hits = V.top_k(self.store.vectors, self.provider.embed_query(query), k, filters)
        return [_text_item(r) for r in E.text_evidence(hits).orderBy(F.desc("score"), "chunk_id").collect()]

    def graph_search(self, operation: str, *, entity_id: str | None = None, canonical_name: str | None = None, entity_type: str | None = None, depth: int | None = None, limit: int | None = None) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
        """Graph evidence in rank order, and the text evidence that supports it."""
        s = self.settings
        if operation not in G.OPERATIONS:
            raise BoundError(f"unknown operation {operation}")
        depth = bounded("depth", depth, 1, s.graph_depth_max)
        limit = bounded("limit", limit, s.graph_limit, s.graph_limit_max)
        start = self.resolve(entity_id, canonical_name, entity_type)
        requests = self.spark.createDataFrame([(start,)], "start string")
        found = G.evidence(operation, G.paths(operation, requests, self.store.nodes, self.store.edges, depth=depth, limit=limit))
        version = F.col("paper_version_id") if "paper_version_id" in self.store.edges.columns else F.lit(None).cast("string")
        kinds = self.store.edges.select("relationship_id", "provenance_type", version.alias("paper_version_id"))
        rels = found.select("evidence_id", F.posexplode("rels").alias("at", "r")).select("evidence_id", "at", "r.*").join(kinds, "relationship_id")
        rels = rels.groupBy("evidence_id").agg(F.array_sort(F.collect_list(F.struct("at", "source_chunk_id", "supporting_chunk_ids", "provenance_type", "paper_version_id"))).alias("own"), F.min_by("paper_version_id", F.when(F.col("paper_version_id").isNotNull(), F.col("at"))).alias("paper_version_id"))
        made = E.graph_provenance("own")
        rows = found.drop("source_chunk_ids").join(rels, "evidence_id").withColumn("source_chunk_ids", made["source_chunk_ids"]).withColumn("provenance_type", made["provenance_type"]).withColumn("query_id", F.col("start"))
        rows = rows.withColumn("chunk_versions", E.chunk_versions("own", F.slice("source_chunk_ids", 1, s.supporting_chunks)))
        chunks = self.store.vectors.select("chunk_id", "vector_generation_fingerprint", *[c for c in ("paper_version_id",) if c in self.store.vectors.columns])
        rows = E.bridge(rows, chunks, s.supporting_chunks).orderBy("rank").collect()
        graph = [{"evidence_id": r.evidence_id, "evidence_type": r.evidence_type, "chunk_id": r.chunk_id, "paper_id": r.paper_id, "paper_version_id": r.paper_version_id, "section_type": None, "page_start": None, "page_end": None, "text": r.text, "score": r.path_confidence, "score_kind": "path_confidence", "entity_ids": r.entity_ids, "relationship_ids": r.relationship_ids, "source_chunk_ids": r.source_chunk_ids, "support": r.supporting_text_evidence_ids, "warnings": r.warnings, "provenance_complete": r.provenance_complete} for r in rows]
        wanted = [c for g in graph for c in g["source_chunk_ids"][: s.supporting_chunks]]
        ids = self.spark.createDataFrame([(c,) for c in dict.fromkeys(wanted)], "chunk_id string")
        by_id = {r.evidence_id: r for r in E.text_evidence(V.lookup(self.store.vectors, ids).withColumn("score", F.lit(None).cast("double"))).collect()}
        support = [_text_item(by_id[i]) for g in graph for i in g["support"]]
        return graph, support

    def retrieve(self, query: str, strategy: str, *, vector_top_k: int | None = None, filters: dict[str, str] | None = None, graph_request: dict[str, Any] | None = None, top_k: int | None = None) -> Result:
        """One branch or both, fused by reciprocal ranks; the cut at top_k comes after the diagnostics."""
        s = self.settings
        top_k = bounded("top_k", top_k, s.hybrid_top_k, s.hybrid_top_k_max)
        if strategy not in ("vector", "graph", "hybrid"):
            raise BoundError(f"unknown strategy {strategy}")
        if strategy == "graph" and filters:
            raise BoundError("the graph strategy takes no vector filters")
        if strategy != "vector" and not graph_request:
            raise BoundError("this strategy needs a graph operation")
        vector = self.vector_search(query, vector_top_k, filters) if strategy != "graph" else []
        graph, support = self.graph_search(**graph_request) if strategy != "vector" else ([], [])
        frame = lambda items: self.spark.createDataFrame([(0, i["evidence_id"], n, i["support"]) for n, i in enumerate(items, 1)], "query_id int, evidence_id string, pos int, supporting_text_evidence_ids array<string>")
        order = E.fused(frame(vector), frame(graph), frame(support), k=s.rrf_k, top_k=None).orderBy("position").collect()
        known = {i["evidence_id"]: i for i in [*support[::-1], *graph[::-1], *vector[::-1]]}
        items = [known[r.evidence_id] | {"fusion_score": r.fusion_score, "branches": r.branches, "cross_store_supported": r.cross_store_supported} for r in order]
        total = len(vector) + len(graph) + len(support)
        notes = {"unique": len(items), "duplicates": total - len(items), "cross_store_links": sum(i["cross_store_supported"] for i in items), "vector_empty": strategy != "graph" and not vector, "graph_empty": strategy != "vector" and not graph}
        return Result(items[:top_k], vector, graph, notes)
