"""Fetching over a local server, finalised files, staged reuse, run fingerprints and error statuses."""

import hashlib
import importlib.util
import json
import shutil
import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from evispark.config import BoundError, Settings
from evispark.functions import lineage
from evispark.operators import control
from evispark.plans import ingestion, service
from evispark.plans.retrieval import EntityAmbiguous, EntityNotFound, Store
from evispark.providers import CANDIDATES, OutputError, ScriptedModel
from evispark.sources import artifacts, feed

PDF = b"%PDF-1.7 " + b"x" * 200_000
FEED = b"""<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/2401.00001v2</id><title>One
 title</title><summary>s</summary><published>2024-01-02T03:04:05Z</published><updated>2024-01-03T00:00:00Z</updated><author><name>Ada  L</name></author>
<category term="cs.LG"/><link title="pdf" href="http://arxiv.org/pdf/2401.00001v2" rel="related"/></entry></feed>"""


@pytest.fixture(scope="module")
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            path = urlparse(self.path).path
            tries = sum(urlparse(p).path == path for p in seen)
            status, body = {"/api/query": (200, FEED), "/ok.pdf": (200, PDF), "/html.pdf": (200, b"<html>"), "/missing.pdf": (404, b""), "/moved.pdf": (302, b""), "/busy.pdf": (503, b"") if tries < 3 else (200, PDF), "/down.pdf": (500, b"")}[path]
            self.send_response(status)
            if status == 302:
                self.send_header("Location", "/ok.pdf")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", seen
    http.shutdown()


def test_search_lands_a_feed(spark, server):
    address, seen = server
    request = feed.SearchRequest(" graph  rag ", categories=("cs.IR", " "), start=20, sort_by="submitted_date")
    rows = feed.search(spark, request, endpoint=f"{address}/api/query").collect()
    asked = {k: v[0] for k, v in parse_qs(urlparse(seen[-1]).query).items()}
    assert asked == {"search_query": 'all:"graph rag" AND cat:cs.IR', "start": "20", "max_results": "20", "sortBy": "submittedDate", "sortOrder": "descending"}
    assert [(r.paper_id, r.version, r.title, r.authors, r.pdf_url) for r in rows] == [("paper:arxiv:2401.00001", "v2", "One title", ["Ada L"], "http://arxiv.org/pdf/2401.00001v2")]


def test_requests_are_checked():
    for bad in ({"query": " "}, {"query": "q", "start": -1}, {"query": "q", "max_results": 0}, {"query": "q", "sort_by": "age"}, {"query": "q", "published_after": datetime(2024, 1, 2), "published_before": datetime(2024, 1, 1)}):
        with pytest.raises(BoundError):
            feed.SearchRequest(**bad)
    with pytest.raises(BoundError):  # refused, not clamped
        feed.SearchRequest("q", max_results=101).parameters(Settings())
    assert feed.SearchRequest("q").parameters(Settings())["max_results"] == "20"


def test_download_rules(spark, server, tmp_path):
    address, _ = server
    get = lambda path, **how: artifacts.download(spark, f"{address}{path}", hosts=["127.0.0.1"], sleep=lambda s: None, **how)
    path, size, checksum = get("/ok.pdf")
    assert (size, checksum) == (len(PDF), hashlib.sha256(PDF).hexdigest())
    assert get("/busy.pdf")[1] == len(PDF)  # tried again
    for bad, error in (("/missing.pdf", FileNotFoundError), ("/moved.pdf", artifacts.DownloadError), ("/down.pdf", artifacts.DownloadError), ("/html.pdf", ValueError)):
        with pytest.raises(error):
            get(bad)
    with pytest.raises(ValueError, match="larger"):
        get("/ok.pdf", most_bytes=1000)
    with pytest.raises(ValueError, match="trusted"):
        artifacts.download(spark, f"{address}/ok.pdf")
    final = artifacts.finalised(spark, path, str(tmp_path / "papers"), "arxiv", "cs/0101001", "v1")
    assert final.endswith("papers/arxiv/cs_0101001/v1/paper.pdf") and open(final, "rb").read() == PDF
    again, *_ = get("/ok.pdf")
    assert artifacts.finalised(spark, again, str(tmp_path / "papers"), "arxiv", "cs/0101001", "v1") == final  # replaced in one step
    assert [r.verdict for r in artifacts.landed_pdfs(spark, str(tmp_path / "papers/arxiv/*/*/*.pdf")).collect()] == ["ok"]
    with pytest.raises(ValueError):
        artifacts.finalised(spark, final, str(tmp_path), "arxiv", "../x", "v1")


def test_stages_reuse_what_is_current(spark):
    page = "paper_id string, paper_version_id string, page_number int, text string"
    body = lambda n: "1. Introduction\n" + f"some words of version {n} " * 30
    pages = spark.createDataFrame([(f"p{n}", f"v{n}", 1, body(n)) for n in range(3)], page)
    none = ingestion.parse(pages).withColumn("parsed_checksum", F.lit("")).limit(0)
    first, todo = ingestion.parse_stage(pages, none)
    assert {r[0] for r in todo.collect()} == {"v0", "v1", "v2"} and first.select("paper_version_id").distinct().count() == 3
    first = spark.createDataFrame(first.collect(), first.schema)
    again, todo = ingestion.parse_stage(pages, first)
    assert todo.isEmpty() and sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    changed = spark.createDataFrame([("p0", "v0", 1, body(0)), ("p1", "v1", 1, body(9))], page)  # v1 anew, v2 gone
    after, todo = ingestion.parse_stage(changed, first)
    assert [r[0] for r in todo.collect()] == ["v1"] and {r.paper_version_id for r in after.collect()} == {"v0", "v1"} and "version 9" in " ".join(r.text for r in after.collect())
    small = Settings(chunk_size=40, chunk_overlap=5, chunk_min_tokens=5)
    empty = ingestion.chunk(first, small).withColumn("chunk_generation", F.lit("")).limit(0)
    chunks, todo = ingestion.chunk_stage(first, empty, small)
    chunks = spark.createDataFrame(chunks.collect(), chunks.schema)
    assert todo.count() == 3 and ingestion.chunk_stage(first, chunks, small)[1].isEmpty()
    assert ingestion.chunk_stage(first, chunks, Settings(chunk_size=30, chunk_overlap=5, chunk_min_tokens=5))[1].count() == 3  # another chunking


def test_extraction_and_graph_stages(spark):
    """Chunks to candidates to edges, by a model that is asked again only for versions whose chunks changed."""
    said = {"entities": [{"entity_type": "Dataset", "name": "EvalSet", "confidence": 0.9}], "relationships": [{"relationship_type": "evaluated_on", "source_type": "paper", "source_name": "x", "target_type": "dataset", "target_name": " evalset", "usage": "used_by_this_paper", "confidence": 0.8}, {"relationship_type": "likes", "source_type": "paper", "source_name": "x", "target_type": "dataset", "target_name": "y", "confidence": 0.8}]}
    model = ScriptedModel({"good": "```json\n" + json.dumps(said) + "\n```", "bad": "no object"})
    chunk = "paper_id string, paper_version_id string, chunk_id string, section_type string, text string"
    chunks = spark.createDataFrame([("p1", "v1", "c1", "results", "good one"), ("p1", "v1", "c2", "references", "good two"), ("p2", "v2", "c3", "abstract", "a bad one"), ("p2", "v2", "c4", "other", "good")], chunk)
    none = spark.createDataFrame([], CANDIDATES + ", extraction_generation_fingerprint string")
    found, todo = ingestion.extract_stage(chunks, none, model, "config", 0)
    found = spark.createDataFrame(found.collect(), found.schema)
    assert sorted((r.chunk_id, r.kind) for r in found.collect()) == [("c1", "entity"), ("c1", "relationship"), ("c1", "relationship"), ("c3", "error"), ("c4", "entity"), ("c4", "relationship"), ("c4", "relationship")]
    assert todo.count() == 2 and ingestion.extract_stage(chunks, found, model, "config", 0)[1].isEmpty() and ingestion.extract_stage(chunks, found, model, "another", 0)[1].count() == 2
    edges = ingestion.graph_of(found).withColumn("graph_index_generation_fingerprint", F.lit("")).limit(0)
    made, todo = ingestion.graph_stage(found, edges, "rules")
    made = spark.createDataFrame(made.collect(), made.schema)
    assert sorted((r.source_entity_id, r.relationship_type, r.source_chunk_id, r.provenance_type) for r in made.collect()) == [("p1", "evaluated_on", "c1", "chunk"), ("p2", "evaluated_on", "c4", "chunk")]
    assert len({r.target_entity_id for r in made.collect()}) == 1 and ingestion.graph_stage(found, made, "rules")[1].isEmpty()


def test_page_extraction_needs_a_library(spark):
    files = spark.createDataFrame([("a", bytearray(b"x"))], "path string, content binary")
    if importlib.util.find_spec("pymupdf") is None:
        with pytest.raises(RuntimeError, match="no PDF library"):
            artifacts.pages_of(files)
    assert [(r.page_number, r.text) for r in artifacts.pages_of(files, lambda content: ["one", ""]).collect()] == [(1, "one"), (2, "")]


def test_stale_jobs_are_replaced(spark):
    jobs = spark.createDataFrame([("a", "v1", "chunked", None, None, 0), ("b", "v2", "ready", None, None, 1), ("c", "v3", "parsed", None, None, 2)], "job_id string, paper_version_id string, status string, failed_stage string, failure_reason string, retry_count int")
    stale = spark.createDataFrame([("v1", "gone"), ("v1", "gone"), ("v2", "gone")], "paper_version_id string, reason string")
    out = {r.job_id: tuple(r)[2:] for r in control.replaced_jobs(jobs, stale, "parsed", F.concat("job_id", F.lit("2"))).collect()}
    assert out == {"a": ("failed", "chunked", "gone", 1), "a2": ("parsed", None, None, 0), "b": ("ready", None, None, 1), "c": ("parsed", None, None, 2)}


def test_rows_by_key(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "paper_id int, version string, title string")
    assert [r.title for r in control.by_key(rows, paper_id=1, version="b").collect()] == ["y"]


def test_run_fingerprints():
    settings = dict.fromkeys(lineage.RUN_FIELDS, 1)
    checksum = lineage.dataset_checksum({"cases": [{"id": "a"}]})
    assert checksum == lineage.dataset_checksum({"cases": [{"id": "a"}]}) != lineage.dataset_checksum({"cases": []})
    one = lineage.run_fingerprint(checksum, [1, 3, 5], **settings)
    assert one != lineage.run_fingerprint(checksum, [1, 3], **settings) and one != lineage.run_fingerprint(checksum, [1, 3, 5], **settings | {"rrf_k": 61})
    with pytest.raises(ValueError):
        lineage.run_fingerprint(checksum, [1], rrf_k=1)


def test_statuses_and_probes(spark, tmp_path):
    errors = [(EntityNotFound("x"), 404), (EntityAmbiguous("x", []), 409), (BoundError("x"), 400), (OutputError("x"), 502), (TimeoutError(), 504), (artifacts.DownloadError(), 502), (ConnectionError(), 503), (FileNotFoundError(), 404), (AnalysisException("x"), 503), (KeyError("x"), 500)]
    assert [service.status_of(e) for e, _ in errors] == [s for _, s in errors]
    there = spark.range(3)
    assert service.health(spark) == {"status": "healthy"}
    there.write.parquet(str(tmp_path / "vectors"))
    lost = spark.read.parquet(str(tmp_path / "vectors"))
    shutil.rmtree(tmp_path / "vectors")
    assert service.health(spark, Store(there, there, lost)) == {"status": "healthy", "vectors": "unreachable", "nodes": "connected", "edges": "connected"}
