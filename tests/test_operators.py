"""Literal expectations over tiny tables, and properties."""

import json
import random
import uuid
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark import providers as P
from evispark.config import BoundError, Settings, bounded
from evispark.functions import ids, lineage
from evispark.operators import chunking, control, decisions, evidence, graph_build, graph_paths, metrics, references, text_etl, vectors
from evispark.sources import artifacts, feed, reports
from evispark.streaming import ingest


def first(spark, column):
    return spark.range(1).select(column).first()[0]


# --- identity


def test_golden_ids(spark):
    lit = F.lit
    assert first(spark, ids.entity_id(lit("method"), lit(" graphRAG "))) == "entity:method:858edf720f19ac91"
    assert first(spark, ids.entity_id(lit("dataset"), lit("GraphRAG"))) == "entity:dataset:91b2cb6e9a34e0e1"
    assert first(spark, ids.section_id(lit("paper-version:arxiv:2401.12345:v2"), lit("introduction"), lit(1))) == "section:b0446d994973a803"
    assert first(spark, ids.relationship_id(lit("paper:arxiv:2401.12345"), lit("uses_method"), lit("entity:method:858edf720f19ac91"))) == "relationship:cd6d597c73b4cf54"
    assert first(spark, evidence.text_evidence_id(lit("chunk:eval:a-method"), lit("vector-current"))) == "evidence:4a1a866dc5f4dccd"
    assert first(spark, ids.version_id(lit("paper:arxiv:2401.12345"), lit("2"))) == "paper-version:arxiv:2401.12345:v2"
    assert first(spark, ids.paper_id(lit(" ArXiv "), lit("2401.1"))) == "paper:arxiv:2401.1"
    assert first(spark, ids.short_hash(lit("a"), lit(None).cast("string"))) is None


def test_identity_key_is_exact(spark):
    odd = ["Straße", "ﬁne　 X", "a\x1cb", "ABC  def", None, ""]
    rows = spark.createDataFrame([(s,) for s in odd], "s string")
    import unicodedata

    assert [r[0] for r in rows.select(ids.identity_key("s")).collect()] == [None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).casefold() for s in odd]


def test_generations_agree_on_driver_and_executors(spark):
    own = lineage.fingerprint_of("vector_generation", chunk_artifact_checksum="ab", embedding_config_fingerprint="cd")
    assert first(spark, lineage.generation_of("vector_generation", F.lit("ab"), F.lit("cd"))) == own
    with pytest.raises(ValueError):
        lineage.fingerprint_of("vector_generation", chunk_artifact_checksum="ab")
    assert first(spark, ids.point_id(F.lit("chunk:x"))) == str(uuid.uuid5(ids.POINTS, "chunk:x"))


def test_fingerprints_keep_separators_apart():
    assert ids.fingerprint({"b": 1, "a": 2}) == ids.fingerprint({"a": 2, "b": 1}) != ids.fingerprint({"a": 2, "b": 1}, compact=False)
    with pytest.raises(ValueError):
        ids.json_safe({"x": object()})


# --- text


def reference_clean(text):
    import re
    import unicodedata

    text = re.sub(r"\r\n?", "\n", unicodedata.normalize("NFKC", text))
    text = re.sub("([a-z])-\n([a-z])", r"\1\2", text)
    out, blank = [], False
    for line in text.split("\n"):
        now = not line.strip()
        if not (now and blank):
            out.append(re.sub("[ \t]+", " ", line).strip())
        blank = now
    return "\n".join(out)


def test_clean_pages(spark):
    texts = ["ﬁrst  line \r\nsec-\nond\r\n\r\n \t\r\n\nend", "", "\n\n\na", "A-\nb", "x  y\n \n\nz", "co-\nop-\ner", "a\tb"]
    rows = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "paper_version_id string, page_number int, text string")
    assert [r.text for r in text_etl.clean_pages(rows).orderBy("page_number").collect()] == [reference_clean(t) for t in texts]


def test_headings(spark):
    cases = {"1. Introduction": "introduction", "I. INTRODUCTION": "introduction", "3 Methodology": "methodology", "1.1 Background": None, "Overview": None, "Background": "other", "4 Strange Things": "other", "II Methods": None, "references": "references", "": None}
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", text_etl.heading("line").alias("h")).collect()
    assert {r.line: r.h and r.h.section_type for r in rows} == cases


def test_headers_and_footers(spark):
    make = lambda n: spark.createDataFrame([("v", i, f"Running Title\nbody {i} text\nPage {i} of {n}") for i in range(1, n + 1)], "paper_version_id string, page_number int, text string")
    assert {(r.place, r.key) for r in text_etl.header_footer_lines(make(5)).collect()} == {("header", "running title"), ("footer", "page # of #")}
    assert text_etl.header_footer_lines(make(2)).isEmpty()
    assert [r.text for r in text_etl.without_headers_footers(make(3)).orderBy("page_number").collect()] == [f"\nbody {i} text\n" for i in (1, 2, 3)]


def test_sections(spark):
    pages = [("v", 1, "Title\n1. Introduction\nhello\n\nworld"), ("v", 2, "more\n2. Methods\nReferences\n[1] x"), ("w", 1, "no headings\nhere"), ("e", 1, " ")]
    rows = spark.createDataFrame(pages, "paper_version_id string, page_number int, text string")
    out = {(r.paper_version_id, r.order): (r.section_type, r.title, r.page_start, r.page_end, r.text) for r in text_etl.sections(rows).collect()}
    assert out == {("v", 0): ("introduction", "Introduction", 1, 2, "hello\n\nworld\nmore"), ("v", 1): ("references", "References", 2, 2, "[1] x"), ("w", 0): ("other", None, 1, 1, "no headings\nhere")}
    warned = {r.paper_version_id: r.warnings for r in text_etl.warnings(rows, text_etl.sections(rows)).collect()}
    assert warned["v"] == ["low_text_density", "no_abstract_detected"] and "empty_page_detected" in warned["e"] and "no_section_headings_detected" in warned["w"]


def test_two_columns(spark):
    blocks = [(1, 0, 90, 200), (1, 5, 80, 200), (1, 110, 190, 200), (1, 120, 195, 200), (2, 0, 190, 200), (2, 0, 10, 200)]
    assert {r.page: r.two_columns for r in text_etl.two_columns(spark.createDataFrame(blocks, "page int, x0 int, x1 int, page_width int")).collect()} == {1: True, 2: False}


def test_packing_rules():
    s = Settings(chunk_size=10, chunk_overlap=3, chunk_min_tokens=3)
    assert chunking.packed("a b c", s) == ["a b c"] and chunking.packed(" ", s) == []
    assert chunking.packed("1 2 3 4 5 6\n\n7 8 9\n\na b c d e", s) == ["1 2 3 4 5 6 7 8 9", "7 8 9 a b c d e"]  # whole trailing units overlap
    assert chunking.packed("a b c d e f g h i j\n\nk l", s) == ["a b c d e f g h i j\n\nk l"]  # a tiny tail joins
    assert chunking.packed(" ".join(map(str, range(25))), s)[:2] == ["0 1 2 3 4 5 6 7 8 9", "10 11 12 13 14 15 16 17 18 19"]
    with pytest.raises(BoundError):
        Settings(chunk_size=5, chunk_overlap=5)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=9), max_size=12), st.integers(4, 12), st.integers(0, 3))
def test_chunks_cover_all_words_in_order(paragraphs, size, overlap):
    text = "\n\n".join(" ".join(f"p{k}w{i}" for i, _ in enumerate(p)) for k, p in enumerate(paragraphs))
    seen = [w for c in chunking.packed(text, Settings(chunk_size=size, chunk_overlap=overlap, chunk_min_tokens=1)) for w in c.split()]
    assert list(dict.fromkeys(seen)) == text.split()


def test_chunks_have_ids_and_no_problems(spark):
    rows = spark.createDataFrame([("s1", "p", "v", "other", 1, 2, "one two. " * 50), ("s2", "p", "v", "other", 2, 2, "x"), ("s3", "p", "v", "other", 2, 2, None)], "section_id string, paper_id string, paper_version_id string, section_type string, page_start int, page_end int, text string")
    out = chunking.chunks(rows, Settings(chunk_size=20, chunk_overlap=4, chunk_min_tokens=5))
    assert chunking.problems(out, rows).isEmpty() and out.where("section_id = 's2'").count() == 1
    again = chunking.chunks(rows.repartition(3), Settings(chunk_size=20, chunk_overlap=4, chunk_min_tokens=5))
    assert {r.chunk_id for r in out.collect()} == {r.chunk_id for r in again.collect()}


def test_references(spark):
    cases = {"[1] First  entry arXiv:2401.00001v3\n[2] Second cs/0501001": ["First entry arXiv:2401.00001v3", "Second cs/0501001"], "Block one\nstill\n\n \nBlock two": ["Block one still", "Block two"], "1. only one marker": ["1. only one marker"], "": []}
    for text, want in cases.items():
        assert first(spark, references.entries(F.lit(text))) == want
    out = references.resolved(spark.createDataFrame([("v", next(iter(cases)) + "\n[3] unknown " + "x" * 400)], "paper_version_id string, text string")).orderBy("position").collect()
    assert [r.target_paper_id for r in out] == ["paper:arxiv:2401.00001", "paper:arxiv:cs/0501001", None] and len(out[2].unresolved_text) == 300


# --- graph


@pytest.fixture(scope="module")
def corpus_g(spark):
    kinds = {"a": "paper", "b": "paper", "c": "paper", "d": "paper", "ada": "author", "m1": "method", "m2": "method", "d1": "dataset", "d2": "dataset", "t1": "task"}
    edges = [("rel-author", "authored_by", "a", "ada", 1.0), ("rel-a-m1", "uses_method", "a", "m1", 0.95), ("rel-a-d1", "evaluated_on", "a", "d1", 0.91), ("rel-a-t1", "addresses", "a", "t1", 0.88), ("rel-a-c", "cites", "a", "c", 1.0), ("rel-c-d", "cites", "c", "d", 1.0), ("rel-b-cites-a", "cites", "b", "a", 1.0), ("rel-b-d1", "evaluated_on", "b", "d1", 0.87), ("rel-b-m2", "uses_method", "b", "m2", 0.89), ("rel-c-d2", "evaluated_on", "c", "d2", 0.86)]
    nodes = spark.createDataFrame([(i, k, i.upper(), [], {}) for i, k in kinds.items()], "entity_id string, entity_type string, canonical_name string, aliases array<string>, properties map<string,string>")
    rows = spark.createDataFrame([(r, s, t, k, c, None if k == "authored_by" else f"chunk-{r}", []) for r, k, s, t, c in edges], "relationship_id string, source_entity_id string, target_entity_id string, relationship_type string, confidence double, source_chunk_id string, supporting_chunk_ids array<string>")
    return nodes, rows


def paths(spark, corpus, operation, start, **how):
    out = graph_paths.paths(operation, spark.createDataFrame([(start,)], "start string"), *corpus, **how).orderBy("place").collect()
    return [(tuple(n.entity_id for n in r.nodes), tuple(e.relationship_id for e in r.rels)) for r in out]


def test_paths(spark, corpus_g):
    assert paths(spark, corpus_g, "shared_datasets", "a") == [(("a", "d1", "b"), ("rel-a-d1", "rel-b-d1"))]
    assert paths(spark, corpus_g, "datasets_from_citing_papers", "a") == [(("a", "b", "d1"), ("rel-b-cites-a", "rel-b-d1"))]
    assert {p[0][2] for p in paths(spark, corpus_g, "methods_for_dataset", "d1")} == {"m1", "m2"}
    assert [p[0][1] for p in paths(spark, corpus_g, "citation_neighborhood", "a")] == ["c", "b"]
    assert (("a", "c", "d"), ("rel-a-c", "rel-c-d")) in paths(spark, corpus_g, "citation_neighborhood", "a", depth=2)
    assert paths(spark, corpus_g, "papers_for_dataset", "d1", limit=1) == [(("d1", "a"), ("rel-a-d1",))]
    with pytest.raises(ValueError):
        paths(spark, corpus_g, "citation_neighborhood", "a", depth=3)


def test_path_evidence(spark, corpus_g):
    found = graph_paths.paths("paper_authors", spark.createDataFrame([("a",)], "start string"), *corpus_g)
    out = graph_paths.evidence("paper_authors", found).first()
    assert (out.evidence_type, out.text, out.chunk_id, out.path_confidence) == ("graph_relationship", "Paper 'A' authored by author 'ADA'.", None, 1.0)


def test_resolver_merges_no_other_names(spark):
    rows = [("method", "GraphRAG", 0), ("method", " graphrag", 1), ("dataset", "GraphRAG", 2), ("dataset", "MIMIC", 3), ("dataset", "MIMIC-IV", 4)]
    c = spark.createDataFrame([(k, n, 0.5 + i / 10, f"c{i}", None, i) for k, n, i in rows], "entity_type string, name string, confidence double, chunk_id string, quote string, pos int")
    groups, supports = graph_build.group_entities(c), graph_build.entity_supports(c)
    out = {(r.entity_type, r.key): (r.name, r.chunk_ids) for r in graph_build.with_supports(groups, supports).collect()}
    assert all(len(r.chunk_ids) == min(1, r.n_chunks) for r in graph_build.with_supports(groups, supports, 1).collect())
    assert len(out) == 4 and out["method", "graphrag"] == ("GraphRAG", ["c0", "c1"])


def test_node_upsert_keeps_placeholder_name(spark):
    schema = "entity_type string, entity_id string, canonical_name string, aliases array<string>, properties map<string,string>"
    old = spark.createDataFrame([("paper", "p", "arxiv:1", ["x"], {"is_placeholder": "true"})], schema)
    new = spark.createDataFrame([("paper", "p", "Real", ["x", "y"], {"title": "Real"}), ("paper", "q", "Q", [], {})], schema)
    out = {r.entity_id: r for r in graph_build.upsert_nodes(old, new).collect()}
    assert (out["p"].canonical_name, out["p"].aliases, out["p"].properties) == ("arxiv:1", ["x", "y"], {"is_placeholder": "true", "title": "Real"}) and out["q"].canonical_name == "Q"
    twice = graph_build.upsert_nodes(graph_build.upsert_nodes(old, new), new)
    assert sorted(map(str, twice.collect())) == sorted(map(str, out.values()))  # writing again changes nothing


def test_generation_swap_is_verified(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "relationship_id string") for xs in (["r1", "r2"], ["r1"]))
    graph_build.verify_generation(a, a)
    with pytest.raises(ValueError):
        graph_build.verify_generation(a, b)


def test_author_facts(spark):
    out = graph_build.author_facts(spark.createDataFrame([("p", ["Ada", "ADA ", "Bob"])], "paper_id string, authors array<string>")).orderBy("pos").collect()
    assert [(r.name, r.confidence, r.source_chunk_id) for r in out] == [("Ada", 1.0, None), ("Bob", 1.0, None)]


# --- evidence


def fuse(spark, vec, graph, support=(), **how):
    frame = lambda xs: spark.createDataFrame([(0, x, n, []) for n, x in enumerate(xs, 1)], "query_id int, evidence_id string, pos int, supporting_text_evidence_ids array<string>")
    return evidence.fused(frame(vec), frame(graph), frame(support), **how).orderBy("position").collect()


def test_rrf(spark):
    out = fuse(spark, "abc", "bda")
    assert [r.evidence_id for r in out] == list("badc") and out[0].fusion_score == pytest.approx(1 / 62 + 1 / 61)
    s = fuse(spark, "a", [], "xy")
    assert [(r.evidence_id, r.best_rank, r.branches) for r in s[1:]] == [("x", None, ["graph_support"]), ("y", None, ["graph_support"])]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(list("abcdef")), st.permutations(list("cdefgh")))
def test_rrf_is_symmetric_in_scores(spark, a, b):
    one, two = ({r.evidence_id: round(r.fusion_score, 12) for r in fuse(spark, *x)} for x in ((a, b), (b, a)))
    assert one == two


def test_text_evidence_bounds(spark):
    hits = spark.createDataFrame([("c1", "g", 0.5), ("c2", "g", -0.2), ("c3", "g", 1.0 + 1e-12)], "chunk_id string, vector_generation_fingerprint string, score double")
    marked = {r.chunk_id: r for r in evidence.text_evidence(hits, on_invalid="mark").collect()}
    assert {c for c, r in marked.items() if r.valid} == {"c1", "c3"} and all((r.evidence_id is None) == (not r.valid) for r in marked.values())
    with pytest.raises(Exception, match="outside"):
        evidence.text_evidence(hits).collect()


def test_bridge(spark):
    graph = spark.createDataFrame([(0, "g1", ["c2", "c1", "cx"], "chunk"), (0, "g2", [], "metadata"), (0, "g3", [], "graph"), (0, "g4", [f"c{i}" for i in range(9)], "chunk")], "query_id int, evidence_id string, source_chunk_ids array<string>, provenance_type string")
    chunks = spark.createDataFrame([(f"c{i}", "g") for i in range(9)], "chunk_id string, vector_generation_fingerprint string")
    out = {r.evidence_id: r for r in evidence.bridge(graph, chunks).collect()}
    assert len(out["g1"].supporting_text_evidence_ids) == 2 and out["g1"].warnings == ["missing chunk cx"] and not out["g1"].provenance_complete
    assert not out["g2"].provenance_complete and out["g3"].provenance_complete and len(out["g4"].supporting_text_evidence_ids) == 5


def test_bridge_marks_or_refuses_foreign_chunks(spark):
    """A chunk of another generation or of another version than its edge says is no support; an edge's version goes before the item's."""
    rels = "array<struct<source_chunk_id string, supporting_chunk_ids array<string>, paper_version_id string>>"
    rows = [(0, "own", ["c1", "c2"], "chunk", "v1", [("c1", ["c2"], None)]), (0, "edge", ["c3"], "chunk", "v1", [("c3", None, "v1"), ("x", ["c3"], "v2")]), (0, "version", ["c3", "c1"], "chunk", "v1", []), (0, "generation", ["c4"], "chunk", None, [])]
    graph = spark.createDataFrame(rows, f"query_id int, evidence_id string, source_chunk_ids array<string>, provenance_type string, paper_version_id string, own {rels}")
    graph = graph.withColumn("chunk_versions", evidence.chunk_versions("own", F.slice("source_chunk_ids", 1, 5)))
    chunks = spark.createDataFrame([("c1", "g", "v1"), ("c2", "g", "v1"), ("c3", "g", "v2"), ("c4", "old", "v1")], "chunk_id string, vector_generation_fingerprint string, paper_version_id string")
    out = {r.evidence_id: r for r in evidence.bridge(graph, chunks, generation="g", strict=False).collect()}
    assert {k: r.warnings for k, r in out.items()} == {"own": [], "edge": [], "version": ["foreign chunk c3"], "generation": ["foreign chunk c4"]}
    assert len(out["version"].supporting_text_evidence_ids) == 1 and not out["version"].provenance_complete and out["edge"].provenance_complete
    for bad in ("version", "generation"):
        with pytest.raises(Exception, match="foreign chunk"):
            evidence.bridge(graph.where(F.col("evidence_id") == bad), chunks, generation="g").collect()
    assert evidence.bridge(graph.where("evidence_id in ('own', 'edge')"), chunks, generation="g").where("provenance_complete").count() == 2


# --- vectors


def test_batch_search_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (120, 6)).astype(float)  # many equal scores
    rows = spark.createDataFrame([(f"c{i:03}", v[i].tolist()) for i in range(120)], "chunk_id string, vector array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 120, 20)], "query_id int, query array<double>")
    unit = v / np.where(np.linalg.norm(v, axis=1) == 0, 1, np.linalg.norm(v, axis=1))[:, None]
    for size in (1 << 20, 1):
        got = {}
        for r in vectors.top_k_batch(rows, q, 7, size).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.chunk_id, round(r.score, 9))
        for i in range(0, 120, 20):
            s = unit @ unit[i]
            assert sorted(x[1] for x in got[i].values()) == sorted(round(x, 9) for x in sorted(s)[-7:])


def test_compatibility_and_prechecks(spark):
    with pytest.raises(ValueError):
        vectors.check_compatible(8, "cosine", 4)
    c = spark.createDataFrame([("a", "x"), ("a", " ")], "chunk_id string, text string")
    r = vectors.check_chunks(c, 2).first()
    assert (r.rows, r.duplicates, r.blank, r.ok) == (2, 1, 1, False)


# --- metrics


def rank(spark, items, targets, k):
    i = spark.createDataFrame([("q", "s", n, x, None, [], [], None) for n, x in enumerate(items, 1)], "case_id string, strategy string, rank int, chunk_id string, paper_id string, entity_ids array<string>, relationship_ids array<string>, signature array<string>")
    t = spark.createDataFrame([("q", "chunk", x, None) for x in targets], "case_id string, target_type string, target_id string, signature array<string>")
    return metrics.ranking_metrics(i, t, metrics.target_matches(i, t), k).first()


def test_ranking_metrics(spark):
    r1, r3 = rank(spark, ["noise", "target", "other"], ["target"], 1), rank(spark, ["noise", "target", "other"], ["target"], 3)
    assert r1.hit == 0 and r3.hit == 1 and r3.precision == pytest.approx(1 / 3) and r3.reciprocal_rank == 0.5 and r3.ndcg == pytest.approx(1 / 1.584962500721156)
    twice = rank(spark, ["target", "target"], ["target"], 2)
    assert twice.precision == 0.5 and twice.recall == 1


def test_percentile_interpolates(spark):
    r = metrics.latency_percentiles(spark.createDataFrame([("s", x) for x in (1.0, 2.0, 10.0)], "s string, v double"), ["s"], "v").first()
    assert r.p95 == 9.2 and r.p50 == 2.0


# --- decisions


def test_answer_rewrite(spark):
    answers = spark.createDataFrame([(1, "A [E2] , b [E1][E2] c [E0] [E1-E2] [E9] ."), (2, "none"), (3, "[E0]")], "answer_id int, text string")
    context = spark.createDataFrame([(1, f"E{i}", f"e{i}") for i in (1, 2)], "answer_id int, label string, evidence_id string")
    out = decisions.resolved_markers(decisions.markers(answers), context, context.withColumn("fatal", F.lit(False)))
    got = {r.answer_id: (r.text, r.validation_status) for r in decisions.rewritten(answers, out).collect()}
    assert got == {1: ("A [1], b [2][1] c.", "partially_valid"), 2: ("none", "no_citations"), 3: ("", "invalid")}


def test_context_selection_puts_support_next(spark):
    pool = spark.createDataFrame([(1, 0, "g", ["t2"]), (1, 1, "t1", []), (1, 2, "t2", [])], "answer_id int, pos int, evidence_id string, supporting_text_evidence_ids array<string>")
    assert [r.evidence_id for r in decisions.selected_context(pool).orderBy("place").collect()] == ["g", "t2", "t1"]


def test_budget_cuts_once(spark):
    foot = len("\n</EVIDENCE>")
    rows = [(1, 1, "h" * 10, "a" * 100), (1, 2, "h" * 10, "b" * 200), (1, 3, "h" * 10, "c" * 10), (2, 1, "h" * 30, "x")]
    out = decisions.budgeted(spark.createDataFrame(rows, "answer_id int, place int, head string, body string"), 250).orderBy("answer_id", "place").collect()
    assert [(r.answer_id, r.place, len(r.rendered), r.truncated) for r in out] == [(1, 1, 110 + foot, False), (1, 2, 250 - 110 - foot, True), (2, 1, 31 + foot, False)]
    assert out[1].rendered.endswith("b\n[truncated]\n</EVIDENCE>")
    assert decisions.budgeted(spark.createDataFrame(rows[:1], "answer_id int, place int, head string, body string"), 10 + foot).collect() == []


def test_rendered_blocks(spark):
    schema = "label string, evidence_type string, evidence_id string, paper_id string, paper_version_id string, section_type string, page_start int, page_end int, provenance_complete boolean, warnings array<string>, text string, entity_ids array<string>, relationship_ids array<string>, supporting_text_evidence_ids array<string>"
    rows = [("E1", "text", "ev1", "p", "pv", "methods", 3, 5, True, [], "some text", [], [], []), ("E2", "graph_path", "ev2", "p", None, None, None, None, False, ["w1", "w2", "w3", "w4"], "said", ["a", "b", "c"], ["r", "s"], ["t1", "t2"])]
    out = {r.label: r.head + r.body for r in decisions.rendered(spark.createDataFrame(rows, schema)).collect()}
    assert out["E1"] == '<EVIDENCE id="E1" type="TEXT">\nstable_evidence_id: ev1\npaper_id: p\npaper_version_id: pv\nsection: methods\npages: 3-5\nprovenance_complete: True\nprovenance_warnings: []\nContent:\nsome text'
    assert out["E2"] == "<EVIDENCE id=\"E2\" type=\"GRAPH_PATH\">\nstable_evidence_id: ev2\npaper_id: p\npaper_version_id: None\nsection: None\npages: None\nprovenance_complete: False\nprovenance_warnings: ['w1', 'w2', 'w3']\nContent:\nGraph path:\nnodes: a -> b -> c\nrelationships: r -> s\nsupporting_text_evidence_ids: t1, t2"


# --- control plane, sources


def test_transitions_and_versions(spark):
    assert first(spark, control.transition_allowed(F.lit("parsed"), F.lit("chunking"))) and first(spark, control.transition_allowed(F.lit("parsing"), F.lit("failed")))
    assert not first(spark, control.transition_allowed(F.lit("ready"), F.lit("failed"))) and not first(spark, control.transition_allowed(F.lit("parsed"), F.lit("ready")))
    assert [first(spark, control.version_rank(F.lit(v))) for v in ("v1.2", "draft", "v7")] == [12, -1, 7]
    assert first(spark, control.safe_segment(F.lit("a.b-c"))) and not first(spark, control.safe_segment(F.lit("../x")))
    assert control.search_query(" graph  rag ", ["cs.IR"]) == 'all:"graph rag" AND cat:cs.IR'
    assert bounded("k", None, 5, 50) == 5
    for bad in (0, 51):
        with pytest.raises(BoundError):
            bounded("k", bad, 5, 50)


def test_upserted_papers_keep_identity(spark):
    schema = "paper_id string, source string, title string"
    out = control.upserted_papers(spark.createDataFrame([("p", "a", "old")], schema), spark.createDataFrame([("p", "b", "new"), ("q", "c", "q")], schema), ["title"])
    assert {tuple(r) for r in out.collect()} == {("p", "a", "new"), ("q", "c", "q")}
    with pytest.raises(ValueError):
        control.in_dates(spark.range(1).withColumn("published_at", F.current_timestamp()), datetime(2025, 1, 1), datetime(2024, 1, 1))


def test_json_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "x", "n": 1}\n{"id": 5, "n": "bad"}\nnot json\n')
    assert [r.id for r in artifacts.read_json(spark, str(tmp_path), "id string, n int").collect()] == ["x"]
    out = str(tmp_path / "out")
    artifacts.write_json(spark.createDataFrame([("v1", 1), ("v2", 2)], "version string, n int"), out, ["version"])
    artifacts.write_json(spark.createDataFrame([("v2", 3)], "version string, n int"), out, ["version"])
    assert {(r.version, r.n) for r in spark.read.json(out).collect()} == {("v1", 1), ("v2", 3)}


def test_pdfs_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 one|two")
    (tmp_path / "b.pdf").write_bytes(b"html")
    (tmp_path / "c.pdf").write_bytes(b"")
    files = artifacts.landed_pdfs(spark, str(tmp_path))
    assert {r.path[-5]: r.verdict for r in files.collect()} == {"a": "ok", "b": "not_pdf"}
    pages = artifacts.pages_of(files, lambda b: b.decode().split("|") if b.startswith(b"%PDF") else [" "]).orderBy("path", "page_number").collect()
    assert [r.text for r in pages if r.error is None] == ["%PDF-1.7 one", "two"] and sum(r.error is not None for r in pages) == 1


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("""<feed><entry><id>http://arxiv.org/abs/2401.12345v2</id><title> A
      title </title><summary>s</summary><published>2024-01-02T03:04:05Z</published><author><name>Ada</name></author><author><name>Ada</name></author><author><name>Bob</name></author>
      <category term="cs.IR"/><category term="cs.AI"/><link href="http://arxiv.org/pdf/2401.12345v2" rel="related" title="pdf"/></entry><entry><title>no id</title></entry></feed>""")
    rows = {r.title: r for r in feed.read_feed(spark, str(tmp_path)).collect()}
    r = rows["A title"]
    assert (r.paper_id, r.version, r.authors, r.categories, r.published_at, r.error) == ("paper:arxiv:2401.12345", "v2", ["Ada", "Bob"], ["cs.AI", "cs.IR"], datetime(2024, 1, 2, 3, 4, 5), None)
    assert rows["no id"].error and r.pdf_url.endswith("v2")
    calls = iter([(503, b""), (429, b""), (200, b"ok")])
    waits = []
    assert feed.with_retries(lambda: next(calls), sleep=waits.append) == b"ok" and waits == [1.0, 2.0]
    with pytest.raises(ConnectionError):
        feed.with_retries(lambda: (404, b""), sleep=waits.append)


def test_reports(spark, tmp_path):
    reports.write({"Totals": spark.createDataFrame([("v", 0.5)], "system string, rate double")}, str(tmp_path))
    assert json.loads((tmp_path / "report.json").read_text()) == {"Totals": [{"system": "v", "rate": 0.5}]} and "| v | 0.500 |" in (tmp_path / "report.md").read_text()


def test_incremental_ingestion(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    page = lambda n, t: spark.createDataFrame([("v", n, t)], "paper_version_id string, page_number int, text string")
    page(1, "a  b").write.json(landing)
    ingest.ingest(spark, landing, out, state).awaitTermination()
    page(2, "c").write.mode("append").json(landing)
    page(1, "new").write.mode("append").json(landing)
    ingest.ingest(spark, landing, out, state).awaitTermination()
    assert {(r.page_number, r.text) for r in ingest.current_pages(spark, out).collect()} == {(1, "new"), (2, "c")}


# --- model output


def test_structured_output():
    assert P.single_object(P.without_fence('```json\n{"a": "}"}\n```')) == {"a": "}"}
    assert P.single_object(P.without_fence('```\n{"a": [1, {}]}\n```')) == {"a": [1, {}]}
    assert P.without_fence('```python\n{"a": 1}\n```').startswith("```python")  # a fence of another language is text
    assert P.single_object('Here it is: {"a": {"b": "\\""}} done') == {"a": {"b": '"'}}
    assert P.single_object("x" * 160 + '{"a": 1}') == {"a": 1}
    for bad in ("none", '{"a": 1} {"b": 2}', '{"a": 1', "x" * 161 + '{"a": 1}', '[1] {"a": 1}', '{"a": 1} [2]'):
        with pytest.raises(P.OutputError):
            P.single_object(bad)
    model = P.ScriptedModel({"q": '{"x": 1}'}, fail_on=1)
    assert P.structured(model, "", "q", lambda x: x["x"]) == 1 and model.calls == 2


def test_embedding_providers(spark):
    e = P.HashEmbedding(8)
    assert sum(x * x for x in e.embed_query("a")) == pytest.approx(1) and e.embed_query("a") == e.embed_documents(["a"])[0]
    assert P.VocabularyEmbedding(["graph", "rag"]).embed_query("Graph, graph!") == [1.0, 0.0]
    rows = P.embedded(spark.createDataFrame([(i, f"t{i}") for i in range(70)], "i int, text string"), e).collect()
    assert all(r.vector == pytest.approx(e.embed_query(r.text), abs=1e-6) for r in rows)
    with pytest.raises(ValueError):
        P.checked_vectors([[1.0, float("nan")]], 1, 2)


random.seed(0)


def test_case_comparison_follows_ranks_and_applicability(spark):
    rows = []
    cases = {
        "all hit, vector first": [(True, 1, 1.0), (True, 1, 0.5), (True, 1, 0.5)],
        "all hit, hybrid first": [(True, 1, 0.5), (True, 1, 1.0), (True, 1, 1.0)],
        "hybrid misses": [(True, 1, 0.2), (True, 1, 1.0), (True, 0, 0.0)],
        "hybrid doesn't apply": [(True, 1, 0.2), (False, 0, 0.0), (False, 1, 1.0)],
        "hybrid alone": [(True, 0, 0.0), (True, 1, 1.0), (True, 1, 0.5)],
        "graph alone": [(True, 0, 0.0), (True, 1, 1.0), (True, 0, 0.0)],
        "none": [(True, 0, 0.0), (False, 1, 1.0), (True, 0, 0.0)],
    }
    for name, found in cases.items():
        rows += [(name, s, *x) for s, x in zip(("vector", "graph", "hybrid"), found)]
    out = metrics.case_comparison(spark.createDataFrame(rows, "case_id string, strategy string, applicable boolean, hit int, reciprocal_rank double"))
    got = dict(map(tuple, out.collect()))
    assert [got[c] for c in cases] == ["VECTOR_WINS", "NO_CLEAR_WIN", "VECTOR_WINS", "VECTOR_WINS", "HYBRID_WINS", "GRAPH_WINS", "ALL_FAIL"]
    assert {r["comparison"]: (r["cases"], r["case_ids"][0]) for r in metrics.win_lists(out).collect()}["VECTOR_WINS"] == (3, "all hit, vector first")


def test_failures_without_a_reason_count(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", None), ("a", None)], "system string, reason string")
    assert sorted(map(tuple, metrics.failure_histogram(rows).collect())) == [("a", "none", 2), ("a", "x", 1)]


def test_inapplicable_systems_compare_as_zeros(spark):
    """A system that doesn't apply ties with one that doesn't either and beats a miss that took time."""
    schema = "case_id int, system string, applicable boolean, correct boolean, citations_ok boolean, recall double, latency_ms double"
    rows = [(1, "a", False, True, True, 1.0, 0.0), (1, "b", True, False, False, 0.0, 5.0), (2, "a", False, False, False, 0.0, 9.0), (2, "b", False, True, True, 1.0, 1.0), (3, "a", False, True, True, 1.0, 0.0), (3, "b", True, True, False, 0.0, 5.0)]
    results = spark.createDataFrame(rows, schema)
    assert tuple(metrics.pairwise_wins(results).first()) == ("a", "b", 1, 1, 1)
    assert sorted(map(tuple, metrics.outcomes(results, "a", ["b"]).collect())) == [(1, "win"), (3, "loss")]


def test_endpoints_count_beside_exact_paths(spark):
    items = spark.createDataFrame([(1, "s", 1, "e1", True), (1, "s", 2, "p9", True), (1, "t", 1, None, False)], "case_id int, strategy string, rank int, endpoint string, provenance_complete boolean")
    targets = spark.createDataFrame([(1, "path", "p9"), (1, "path", "q"), (1, "path", "r")], "case_id int, target_type string, target_id string")
    matches = spark.createDataFrame([(1, "s", 2, "q")], "case_id int, strategy string, rank int, target_id string")
    out = {r.strategy: (round(r.exact_path_match, 3), round(r.endpoint_accuracy, 3)) for r in metrics.structural_metrics(items, targets, matches).collect()}
    assert out == {"s": (0.333, 0.667), "t": (0.0, 0.0)}
    ends = spark.createDataFrame([(["a", "b"], ["c"], ["d"]), ([], ["c"], ["d"]), (None, None, ["d"]), ([], [], [])], "x array<string>, y array<string>, z array<string>")
    assert [r[0] for r in ends.select(metrics.endpoint(F.col("x"), F.col("y"), F.col("z"))).collect()] == ["b", "c", "d", None]
