"""The ten-case retrieval benchmark and the answer workflow over its controlled corpus."""

import json
from dataclasses import replace

import pytest

from evispark.functions.ids import fingerprint
from evispark.plans.retrieval import EntityAmbiguous, EntityNotFound, Retriever, Store
from evispark.plans.workflow import Workflow
from evispark.providers import CallableModel

# The controlled corpus and its ten cases.
CHUNKS = {"a-method": ("a", [1.0, 0.01, 0, 0]), "a-limit": ("a", [0.02, 1.0, 0, 0]), "a-dataset": ("a", [0.90, 0.02, 1.0, 0]), "a-task": ("a", [0.70, 0.03, 1.0, 0]), "b-dataset": ("b", [0.50, 0.04, 1.0, 0]), "b-cite": ("b", [0.30, 0.05, 1.0, 0]), "c-method": ("c", [0.10, 0.06, 1.0, 0]), "b-method": ("b", [0.01, 0.07, 1.0, 0])}
PAPER = {k: f"paper:arxiv:eval-{k}" for k in "abc"}
OTHER = {"entity:dataset:eval-shared": ("dataset", "EvalSet"), "entity:method:eval-graphrag": ("method", "GraphRAG"), "entity:task:eval-reconstruction": ("task", "Reconstruction"), "entity:method:eval-baseline": ("method", "Baseline")}
EDGES = [("a-dataset", "evaluated_on", "a", "entity:dataset:eval-shared"), ("a-method", "uses_method", "a", "entity:method:eval-graphrag"), ("a-task", "addresses", "a", "entity:task:eval-reconstruction"), ("b-dataset", "evaluated_on", "b", "entity:dataset:eval-shared"), ("b-cites-a", "cites", "b", PAPER["a"]), ("c-method", "uses_method", "c", "entity:method:eval-graphrag"), ("b-method", "uses_method", "b", "entity:method:eval-baseline")]
E, D = "entity:dataset:eval-shared", "rel:eval:"
CASES = [
    ("sem-method-a", "graph reconstruction method", None, ("chunk", "chunk:eval:a-method"), 1, None),
    ("sem-limit-a", "a limitation", None, ("chunk", "chunk:eval:a-limit"), 1, None),
    ("struct-datasets-a", "datasets", ("paper_datasets", PAPER["a"]), ("relationship", D + "a-dataset"), 0, 1),
    ("struct-methods-a", "methods", ("paper_methods", PAPER["a"]), ("relationship", D + "a-method"), 0, 1),
    ("struct-tasks-a", "tasks", ("paper_tasks", PAPER["a"]), ("entity", "entity:task:eval-reconstruction"), 0, 1),
    ("shared-dataset-a", "shared", ("shared_datasets", PAPER["a"]), ("entity", PAPER["b"]), 0, 1),
    ("shared-method-a", "shared", ("shared_methods", PAPER["a"]), ("entity", PAPER["c"]), 0, 1),
    ("multi-hop-citing", "citing", ("datasets_from_citing_papers", PAPER["a"]), ("path", [PAPER["a"], D + "b-cites-a", PAPER["b"], D + "b-dataset", E]), 0, 1),
    ("multi-hop-methods", "methods", ("methods_for_dataset", E), ("path", [E, D + "a-dataset", PAPER["a"], D + "a-method", "entity:method:eval-graphrag"]), 0, 1),
    ("mixed-dataset", "graph reconstruction attack", ("papers_for_dataset", E), ("paper", PAPER["a"]), 1, 0.5),
]


class Fake:
    name, model, dimension, normalize = "fake", "fake", 4, False

    def embed_query(self, text):
        return [0.0, 1.0, 0, 0] if "limitation" in text else [1.0, 0, 0, 0] if "graph reconstruction" in text else [0, 0, 1.0, 0]


@pytest.fixture(scope="module")
def retriever(spark):
    nodes = [(i, "paper", f"Paper {k}", [], {"title": f"Paper {k}"}) for k, i in PAPER.items()] + [(i, k, n, [], {}) for i, (k, n) in OTHER.items()] + [("entity:task:twin", "task", "Reconstruction", [], {})]
    edges = [(D + r, PAPER[s], t, k, 0.9, "chunk:eval:" + ("b-cite" if r == "b-cites-a" else r), ["chunk:eval:" + ("b-cite" if r == "b-cites-a" else r)], "chunk") for r, k, s, t in EDGES]
    vectors = [(f"chunk:eval:{c}", PAPER[p], [float(x) for x in v], f"text of {c}", "vector-current", "methodology") for c, (p, v) in CHUNKS.items()]
    return Retriever(
        Store(
            spark.createDataFrame(nodes, "entity_id string, entity_type string, canonical_name string, aliases array<string>, properties map<string,string>"),
            spark.createDataFrame(edges, "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, source_chunk_id string, supporting_chunk_ids array<string>, provenance_type string"),
            spark.createDataFrame(vectors, "chunk_id string, paper_id string, vector array<float>, text string, vector_generation_fingerprint string, section_type string"),
        ),
        Fake(),
    )


def matches(item, target):
    kind, want = target
    if kind == "path":
        return [x for pair in zip(item["entity_ids"], [*item["relationship_ids"], None]) for x in pair if x] == want
    return {"chunk": item["chunk_id"] == want, "paper": item["paper_id"] == want, "entity": want in item["entity_ids"], "relationship": want in item["relationship_ids"]}[kind]


def reciprocal(items, target):
    return next((1 / n for n, i in enumerate(items, 1) if matches(i, target)), 0)


def test_ten_cases(retriever):
    rr = {"vector": [], "graph": [], "hybrid": []}
    for _, question, graph, target, vector_rr, graph_rr in CASES:
        request = graph and {"operation": graph[0], "entity_id": graph[1], "limit": 5}
        for strategy in rr if graph else ["vector"]:
            out = retriever.retrieve(question, strategy, graph_request=request if strategy != "vector" else None)
            got = reciprocal(out.items[:5], target)
            rr[strategy].append(got)
            assert got == pytest.approx(vector_rr if strategy == "vector" else graph_rr), (strategy, question)
    mean = lambda x: sum(x) / len(x)
    assert mean(rr["vector"]) == pytest.approx(0.3) and mean(rr["graph"]) == mean(rr["hybrid"]) == pytest.approx(0.9375)


def test_golden_evidence_order(retriever):
    graph, _ = retriever.graph_search("papers_for_dataset", entity_id=E, limit=5)
    assert [g["evidence_id"] for g in graph] == ["evidence:141f254a712b73aa", "evidence:21b71ae2d92b7387"]


def test_resolution_and_bounds(retriever):
    assert retriever.resolve(name="graphrag", entity_type="method") == "entity:method:eval-graphrag"
    with pytest.raises(EntityAmbiguous):
        retriever.resolve(name="reconstruction")
    with pytest.raises(EntityNotFound):
        retriever.resolve(name="nothing")
    for bad in ({"strategy": "graph"}, {"strategy": "graph", "filters": {"paper_id": "x"}, "graph_request": {"operation": "paper_tasks"}}, {"strategy": "nearest"}, {"strategy": "vector", "top_k": 0}, {"strategy": "vector", "vector_top_k": 51}):
        with pytest.raises(ValueError):
            retriever.retrieve("q", **bad)
    with pytest.raises(ValueError):
        retriever.retrieve(" ", "vector")


def scripted(intent, entities=(), cites="[E1]", sufficient=True):
    def answer(system, prompt):
        if system.startswith("analyse"):
            return json.dumps({"intent": intent, "entities": list(entities)})
        if system.startswith("judge"):
            return json.dumps({"sufficient": sufficient, "coverage": "complete" if sufficient else "partial", "refinement": "vector_expansion", "missing": [] if sufficient else ["x"]})
        return json.dumps({"text": f"It is so {cites} ."})

    return CallableModel(answer)


PAPER_A = {"name": "Paper a", "type": "paper", "source": "arxiv", "source_id": "eval-a"}


def test_workflow_answers_with_citations(retriever):
    out = Workflow(retriever, scripted("paper_datasets", [PAPER_A])).run("datasets of a?")
    assert (out.status, out.text, out.confidence, out.rounds) == ("answered", "It is so [1].", "high", 1) and out.citations[0]["relationship_ids"] == [D + "a-dataset"]
    partly = Workflow(retriever, scripted("paper_datasets", [PAPER_A], "[E1] [E9]")).run("datasets of a?")
    assert (partly.confidence, partly.reasons[0]) == ("medium", "partial_citation_validation")


def test_workflow_abstains(retriever):
    gate = lambda *a, **k: Workflow(retriever, scripted(*a, **k)).run("q?")
    assert gate("unknown").reasons == ["unsupported_operation"]
    assert gate("paper_datasets", [{"name": "nobody", "type": "paper"}]).reasons == ["entity_not_found"]
    assert gate("papers_for_task", [{"name": "Reconstruction", "type": "task"}]).status == "requires_disambiguation"
    assert gate("paper_datasets", [PAPER_A], "no marker").reasons == ["citation_validation_failed"]
    assert gate("paper_citations", [PAPER_A]).status == "abstained"  # a cites nothing
    broken = Workflow(retriever, CallableModel(lambda s, p: "nonsense")).run("q?")
    assert broken.reasons == ["planning_failed"] and broken.confidence == "insufficient_evidence"


def test_workflow_keeps_the_first_evidence_if_the_refinement_fails(retriever, monkeypatch):
    """A store that fails in the second round ends the run; a fault of the program is no store error."""
    flow = Workflow(retriever, scripted("semantic_explanation", sufficient=False))
    calls, real = [], retriever.vector_search

    def failing(error):
        def search(*a, **k):
            calls.append(1)
            if len(calls) > 1:
                raise error
            return real(*a, **k)

        calls.clear()
        return search

    monkeypatch.setattr(retriever, "vector_search", failing(ConnectionError("down")))
    out = flow.run("graph reconstruction?")
    assert (out.status, out.internal_status, out.reasons) == ("abstained", "REFINEMENT_FAILED", ["refinement_failed"]) and len(out.items) == 5
    assert [(r.number, r.strategy, r.evidence) for r in out.trace.rounds] == [(1, "vector", 5)] and out.trace.errors == [("refine", "ConnectionError: down")]
    assert [(s.node, s.status) for s in out.trace.steps] == [("plan", "ok"), ("retrieve", "ok"), ("assess", "insufficient"), ("refine", "error")]
    monkeypatch.setattr(retriever, "vector_search", failing(AttributeError("a fault")))
    with pytest.raises(AttributeError):
        flow.run("graph reconstruction?")
    monkeypatch.setattr(retriever, "vector_search", lambda *a, **k: (_ for _ in ()).throw(TimeoutError("slow")))
    assert flow.run("graph reconstruction?").reasons == ["retrieval_failed"]


def test_workflow_context_is_rendered_within_its_budget(retriever):
    seen = []

    def model(system, prompt):
        seen.append((system, prompt))
        return scripted("semantic_explanation", cites="[E2] [E1]").generate(system, prompt)

    out = Workflow(retriever, CallableModel(model)).run("graph reconstruction?")
    assert out.context.count("<EVIDENCE id=") == 5 and seen[-1][1].endswith(out.context) and "text of a-method\n</EVIDENCE>" in out.context
    assert [c["label"] for c in out.citations] == ["E2", "E1"] and out.uncited == ["E3", "E4", "E5"] and not out.context_truncated
    critic = json.loads(next(p for s, p in seen if s.startswith("judge")))
    assert critic["diagnostics"] == {"evidence_count": 5, "text_evidence_count": 5, "graph_evidence_count": 0} and critic["evidence"][0]["pool_id"] == "E1"
    small = Retriever(retriever.store, retriever.provider, replace(retriever.settings, answer_chars=740))
    cut = Workflow(small, scripted("semantic_explanation")).run("graph reconstruction?")
    assert cut.context_truncated and len(cut.context) <= 760 and cut.context.endswith("[truncated]\n</EVIDENCE>")


def test_analysis_outside_the_vocabularies_fails(retriever):
    for said in ({"intent": "guess"}, {"intent": "paper_datasets", "entities": [{"name": "x", "type": "robot"}]}, {"intent": "paper_datasets", "entities": [{"name": " ", "type": "paper"}]}, {"entities": []}):
        assert Workflow(retriever, CallableModel(lambda s, p, said=said: json.dumps(said))).run("q?").reasons == ["planning_failed"]


def test_workflow_refines_once(retriever):
    model = scripted("semantic_explanation", sufficient=False)
    out = Workflow(retriever, model).run("graph reconstruction?")
    assert out.rounds == 2 and out.internal_status == "INSUFFICIENT_EVIDENCE" and len(out.items) == 8
    assert [(r.evidence, r.new, r.refinement) for r in out.trace.rounds] == [(5, 5, None), (8, 3, "vector_expansion")]
    found = Workflow(retriever, scripted("mixed_semantic_structural", [PAPER_A], "[E1] [E2]")).run("graph reconstruction?", generate=False)
    assert found.status == "retrieved" and {"text", "graph_relationship"} <= {i["evidence_type"] for i in found.items}
    assert fingerprint({"a": 1}) == fingerprint({"a": 1})
