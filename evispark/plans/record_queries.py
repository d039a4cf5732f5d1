"""The control plane, sources, identities and graph bookkeeping over records made from the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.lineage import generation_of
from ..operators import chunking, control, evidence, graph_build, references, text_etl, vectors
from ..sources.artifacts import read_json, write_json
from ..sources.feed import read_feed
from ..storage import new_path
from . import vector_queries
from .projections import GRAPH_SQL, _entity, _hash, edges, nodes, paper_of, table

PAGE = {"offset": 100, "limit": 50}


def text(column: str):
    return F.col(column).cast("string")


# --- papers and versions


def paper_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Stored: customers; written: those of an even key with another segment, and suppliers."""
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), text("c_custkey")).alias("paper_id"), F.col("c_name").alias("source_id"), F.col("c_mktsegment").alias("title"), F.col("c_custkey").alias("k"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), text("s_suppkey")).alias("paper_id"), F.col("s_name").alias("source_id"), F.lit("supplier").alias("title"))
    new = c.where("k % 2 = 0").select("paper_id", F.lit("another id").alias("source_id"), F.lower("title").alias("title")).unionByName(s)
    return control.upserted_papers(c.drop("k"), new, ["title"])


def version_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Lines are asked versions of their order, with their status as checksum; orders store the first version's."""
    asked = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("v"), text("l_linenumber")).alias("version"), F.col("l_linestatus").alias("checksum")).distinct()
    stored = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit("v1").alias("version"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("checksum"))
    insert, conflict = control.new_versions(asked, stored)
    return insert.select("paper_id", "version", "checksum", F.lit("insert").alias("verdict")).unionByName(conflict.select("paper_id", "version", "checksum", F.lit("conflict").alias("verdict")))


def stage_update(spark: SparkSession, d: str) -> DataFrame:
    """Orders are versions; finished ones get the checksum and count of their lines."""
    versions = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_version_id"), F.col("o_orderstatus").alias("checksum"), F.lit(None).cast("long").alias("chunk_count"))
    done = table(spark, d, "lineitem").where("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("paper_version_id")).agg(F.max("l_returnflag").alias("checksum"), F.count("*").alias("chunk_count"))
    return control.stage_results(versions, done).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(-1)))


def known_papers(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").select(F.concat(F.lit("c"), text("user_id")).alias("paper_id")).distinct()
    stored = table(spark, d, "customer").select(F.concat(F.lit("c"), text("c_custkey")).alias("paper_id"))
    return control.known_flags(found, stored)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders as documents, lines as their sections."""
    key = F.concat_ws(":", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return table(spark, d, "lineitem").select(text("l_orderkey").alias("paper_version_id"), F.concat(F.lit("section:"), key).alias("section_id"), F.lower("l_returnflag").alias("section_type"), F.lit(None).cast("string").alias("title"), F.col("l_linenumber").cast("long").alias("order"), F.col("l_linenumber").cast("long").alias("page_start"), (F.col("l_linenumber") + 1).cast("long").alias("page_end"), F.concat(F.lit("line "), key).alias("text"))


def document_listing(spark: SparkSession, d: str) -> DataFrame:
    """Texts are shown for sections of type a, asked for by themselves."""
    rows = documents(spark, d).distinct()
    return control.document_listing(rows.where("section_type = 'a'"), True).unionByName(control.document_listing(rows.where("section_type <> 'a'")))


def chunk_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of the chunks of returned lines, with the count of all."""
    rows = documents(spark, d).distinct()
    chunks = rows.select(F.regexp_replace("section_id", "section", "chunk").alias("chunk_id"), "section_id", "section_type", F.lit(0).alias("chunk_index"))
    total, page = control.chunk_listing(chunks, rows.select("section_id", "order"), section_type="r", **PAGE)
    return page.select("chunk_id", "order", F.lit(total.first()["total"]).alias("total"))


# --- jobs


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Events are jobs of their user's version, their number the status."""
    chain = [*control.STATUS_CHAIN, "failed"]
    status = F.element_at(F.array(*[F.lit(s) for s in chain]), (F.col("event_id") % len(chain) + 1).cast("int"))
    none = F.lit(None).cast("string")
    return table(spark, d, "events").select(F.concat(F.lit("job:"), text("event_id")).alias("job_id"), F.concat(F.lit("pv:"), text("user_id")).alias("paper_version_id"), status.alias("status"), F.when(status == "failed", "chunking").alias("failed_stage"), none.alias("failure_reason"), (F.col("event_id") % 3).cast("int").alias("retry_count"), F.col("ts").alias("started_at"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.concat(F.lit("pv:"), text("c_custkey")).alias("paper_version_id"))


def active_jobs(spark: SparkSession, d: str) -> DataFrame:
    return control.active_jobs(_jobs(spark, d)).select("job_id", "paper_version_id", "status")


def ready_versions(spark: SparkSession, d: str) -> DataFrame:
    return control.ready_versions(_versions(spark, d), _jobs(spark, d))


def jobs_to_open(spark: SparkSession, d: str) -> DataFrame:
    return control.jobs_to_open(_versions(spark, d), _jobs(spark, d))


def job_moves(spark: SparkSession, d: str) -> DataFrame:
    """Jobs at `parsed` go on to `chunking`, those at `graph_indexed` to `ready`."""
    at = datetime(2030, 1, 2)
    jobs = _jobs(spark, d).withColumn("started_at", F.when(F.col("retry_count") > 0, F.col("started_at"))).withColumn("completed_at", F.lit(None).cast("timestamp"))
    out = control.moved(jobs.where("status = 'parsed'"), "chunking", at).unionByName(control.moved(jobs.where("status = 'graph_indexed'"), "ready", at))
    return out.select("job_id", "status", (F.col("started_at") == F.lit(at)).alias("started_now"), F.col("completed_at").isNotNull().alias("completed"))


def job_failures(spark: SparkSession, d: str) -> DataFrame:
    out = control.failed_job(control.active_jobs(_jobs(spark, d)), "x" * 2500)
    return out.select("job_id", "status", "failed_stage", F.length("failure_reason").cast("long").alias("reason_length"), F.col("retry_count").cast("long").alias("retry_count"))


def job_replacement(spark: SparkSession, d: str) -> DataFrame:
    """Versions of users of an even number have stale chunks."""
    stale = _versions(spark, d).where("cast(substring(paper_version_id, 4) AS bigint) % 2 = 0").withColumn("reason", F.lit("stale chunks"))
    out = control.replaced_jobs(_jobs(spark, d).drop("started_at"), stale, "parsed", F.concat("job_id", F.lit(":again")))
    return out.withColumn("retry_count", F.col("retry_count").cast("long"))


def step_listing(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("step_id"), F.col("event_type").alias("stage"))
    return control.step_listing(steps).withColumn("place", F.col("place").cast("long"))


# --- sources


def source_names(spark: SparkSession, d: str) -> DataFrame:
    """Authors, categories, URLs and path segments of every page, put together from its number."""
    k = F.col("page_id")
    authors = F.array(F.concat(F.lit(" Ada  L"), (k % 3).cast("string")), F.lit("  "), F.lit("Bob"), F.concat(F.lit("Ada L"), (k % 2).cast("string")), F.lit("Bob "))
    categories = F.array(F.lit("cs.LG"), F.lit(" cs.CL"), F.concat(F.lit("cs.A"), (k % 4).cast("string")), F.lit("cs.CL"))
    host = F.element_at(F.array(*[F.lit(h) for h in ("arxiv.org", "WWW.arxiv.org", "export.arxiv.org:443", "arxiv.org.evil.net", "example.com")]), (k % 5 + 1).cast("int"))
    url = F.concat(F.when(k % 7 == 0, "ftp").when(k % 2 == 0, "HTTPS").otherwise("http"), F.lit("://"), host, F.lit("/pdf/1"))
    segment = F.concat(F.when(k % 6 == 0, ".").otherwise("a"), text("page_id"), F.when(k % 5 == 0, "/x").when(k % 4 == 0, "_").otherwise(".v1"))
    return table(spark, d, "pages").select("page_id", F.array_join(control.clean_authors(authors), "|").alias("authors"), F.array_join(control.clean_categories(categories), "|").alias("categories"), control.trusted_url(url).alias("trusted"), control.safe_segment(segment).alias("safe")).distinct()


def feed_papers(spark: SparkSession, d: str) -> DataFrame:
    """Orders as entries of landed feeds, read back."""
    k = text("o_orderkey")
    link = F.concat(F.lit('<link title="pdf" href="http://arxiv.org/pdf/2401.'), k, F.lit('"/><link href="http://x" rel="alternate"/>'))
    name = F.when(F.col("o_orderkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.lit("<id>http://arxiv.org/abs/2401."), k, F.lit("v2</id>")))
    entry = F.concat(F.lit("<entry>"), name, F.lit("<title>A  title\tof "), k, F.lit("</title><summary> s </summary><published>"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published><updated>2020-01-02T03:04:05Z</updated><author><name> Ann  "), F.lower("o_orderstatus"), F.lit("</name></author><author><name>Bob</name></author><author><name>Bob </name></author>"), F.lit('<category term="cs.LG"/><category term="cs.CL"/>'), link, F.lit("</entry>"))
    path = f"{new_path(spark, 'feeds')}/landed"
    feeds = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 200).alias("feed"), entry.alias("entry")).groupBy("feed").agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list("entry"), ""), F.lit("</feed>")).alias("value"))  # 200 entries a feed at most
    feeds.write.partitionBy("feed").text(path)
    out = read_feed(spark, path)
    return out.select("paper_id", "source_id", "version", "title", "abstract", F.array_join("authors", "|").alias("authors"), F.array_join("categories", "|").alias("categories"), F.year("published_at").cast("long").alias("published_year"), F.hour("updated_at").cast("long").alias("updated_hour"), "pdf_url", "error")


def json_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Supplier artifacts by nation, of which one nation's are written again; a line that is no artifact is missing."""
    path = f"{new_path(spark, 'artifacts')}/rows"
    rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    write_json(rows, path, ["s_nationkey"])
    write_json(rows.where("s_nationkey = 3").withColumn("s_name", F.upper("s_name")), path, ["s_nationkey"])
    spark.createDataFrame([('{"s_suppkey": "no number", "s_name": 1',)], "value string").write.mode("append").text(f"{path}/s_nationkey=3")
    return read_json(spark, path, "s_suppkey long, s_name string").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))


def two_column_pages(spark: SparkSession, d: str) -> DataFrame:
    """Lines are blocks of their order's page."""
    x0 = (F.col("l_partkey") * 37 % 500).cast("double")
    blocks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), F.lit(600.0).alias("page_width"))
    return text_etl.two_columns(blocks)


# --- identities


def unicode_keys(spark: SparkSession, d: str) -> DataFrame:
    """Part names in full-width letters, with a ligature, sharp s and odd blanks: one identity with their plain forms."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    name = F.concat(F.lit(" Straße　ﬁne  "), wide, F.lit(" ① "))
    return table(spark, d, "part").select("p_partkey", ids.identity_key(name).alias("key"), ids.entity_id(F.lit("dataset"), name).alias("entity_id"))


def unicode_pages(spark: SparkSession, d: str) -> DataFrame:
    """Page cleanup with its Unicode step: full-width letters, ligatures and a no-break space."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(0xFF21 + i) for i in range(26)))
    rows = table(spark, d, "part").select(text("p_partkey").alias("paper_version_id"), F.lit(1).cast("long").alias("page_number"), F.concat(F.lit("ﬁrst\r\n"), wide, F.lit("  ① x-\ny")).alias("text"))
    return text_etl.clean_pages(rows)


def paper_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    paper = ids.paper_id(F.concat(F.lit(" ArXiv"), F.lower("o_orderstatus")), F.concat(F.lit(" 24 "), text("o_orderkey")))
    version = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("V"), text("o_custkey"))).otherwise(text("o_custkey"))
    return o.select("o_orderkey", paper.alias("paper_id"), ids.version_id(paper, version).alias("paper_version_id"), ids.collection_id(F.concat(F.lit("My  "), text("o_custkey"))).alias("collection_id"))


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    return vector_queries.vectors(spark, d).select("chunk_id", ids.point_id("chunk_id").alias("point_id"))


def generation_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    checksum, config = F.sha2(text("o_orderkey"), 256), F.sha2("o_orderstatus", 256)
    kinds = ("vector_generation", "extraction_generation", "graph_index_generation")
    return table(spark, d, "orders").select("o_orderkey", *[generation_of(k, checksum, config).alias(k) for k in kinds])


# --- graph bookkeeping


def entity_validation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", F.when(k % 5 == 0, " DataSet ").when(k % 5 == 1, "robot").otherwise("method").alias("entity_type"), F.when(k % 7 == 0, " \t").otherwise(F.col("p_name")).alias("name"), F.when(k % 11 == 0, F.lit(None).cast("double")).when(k % 4 == 0, F.lit(1.25)).otherwise(F.lit(0.5)).alias("confidence"))
    return rows.select("p_partkey", graph_build.entity_rejection().alias("reason"))


def section_gate(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["abstract", "references", "methodology", "related_work", "other", "limitations", "results"]
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("p_partkey") % len(kinds) + 1).cast("int")).alias("section_type"))
    return graph_build.extractable(rows)


def author_facts(spark: SparkSession, d: str) -> DataFrame:
    authors = F.array(F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string")), F.lit(" "), F.upper(F.concat(F.lit("clerk  "), (F.col("o_custkey") % 7).cast("string"))), F.concat(F.lit("Aide "), F.lower("o_orderstatus")))
    out = graph_build.author_facts(table(spark, d, "orders").select(paper_of(F.col("o_orderkey")).alias("paper_id"), authors.alias("authors")))
    return out.select("paper_id", "name", "target_entity_id", "relationship_id", "confidence")


def citation_edges(spark: SparkSession, d: str) -> DataFrame:
    """Each order's reference list names the next two orders, the second twice, and something else."""
    k = F.col("o_orderkey")
    number = lambda n: F.lpad((k + n).cast("string"), 9, F.lit("0"))
    entry = lambda i, n: F.concat(F.lit(f"[{i}] A. Author. arXiv:"), F.substring(number(n), 1, 4), F.lit("."), F.substring(number(n), 5, 5), F.lit("v3\n"))
    refs = table(spark, d, "orders").select(paper_of(k).alias("paper_version_id"), F.concat(F.lit("References\n"), entry(1, 1), entry(2, 2), entry(3, 2), F.lit("[4] No id at all")).alias("text"))
    return graph_build.citation_edges(references.resolved(refs).withColumnRenamed("paper_version_id", "paper_id"))


def edge_provenance(spark: SparkSession, d: str) -> DataFrame:
    out = graph_build.edge_rows(edges(spark, d).drop("provenance_type"))
    return out.select("relationship_id", "provenance_type", F.size("supporting_chunk_ids").cast("long").alias("supports"))


def generation_members(spark: SparkSession, d: str) -> DataFrame:
    """One version's edges of its generation."""
    rows = edges(spark, d).select("relationship_id", F.lit("pv").alias("paper_version_id"), F.when(F.col("confidence") >= 0.95, "g1").otherwise("g2").alias("graph_index_generation_fingerprint"))
    return graph_build.generation_ids(rows, "pv", "g1")


def graph_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The graph's nodes with some told twice, unnamed or of an unknown type."""
    n = nodes(spark, d).select("entity_type", "entity_id")
    bad = table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, "robot").otherwise("dataset").alias("entity_type"), F.when(F.col("p_partkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("entity:"), text("p_size"))).alias("entity_id"))
    return graph_build.schema_violations(n.unionByName(bad))


def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of asked ids of any type, some of which are unknown."""
    asked = table(spark, d, "events").select(F.concat(F.lit("paper:tpch:"), text("event_id")).alias("entity_id")).distinct()
    return nodes(spark, d).join(asked, "entity_id", "left_semi").select("entity_id", "entity_type", "canonical_name")


# --- chunks and vectors


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("vec_id")
    name = F.concat(F.lit("chunk:"), F.when(k % 50 == 0, F.lit("twice")).otherwise(k.cast("string")))
    return table(spark, d, "embeddings").select(name.alias("chunk_id"), F.concat(F.lit("section:"), (k % 40).cast("string")).alias("section_id"), F.when(k % 31 == 0, F.lit(-1)).otherwise(F.lit(0)).alias("chunk_index"), F.when(k % 17 == 0, F.lit("  ")).otherwise(F.lit("some text")).alias("text"), F.when(k % 13 == 0, F.lit(0)).otherwise(F.lit(2)).alias("token_count"))


def chunk_validation(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "nation").select(F.concat(F.lit("section:"), text("n_nationkey")).alias("section_id"))
    return chunking.problems(_chunks(spark, d), sections).groupBy("chunk_id", "problem").agg(F.count("*").alias("rows"))


def chunk_precheck(spark: SparkSession, d: str) -> DataFrame:
    return vectors.check_chunks(_chunks(spark, d), 2000)


def chunk_evidence(spark: SparkSession, d: str) -> DataFrame:
    out = evidence.chunk_evidence(vector_queries.vectors(spark, d).select("chunk_id", "vector_generation_fingerprint"))
    return out.select("chunk_id", "evidence_id", "exact_lookup", F.col("score_kind").isNull().alias("no_score"))


def point_upsert(spark: SparkSession, d: str) -> DataFrame:
    """All points, of which every third is written again, and every sixth twice."""
    old = vector_queries.vectors(spark, d).select("chunk_id", F.col("label").cast("long").alias("label"), "vec_id")
    again = old.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100).withColumn("pos", F.lit(1))
    more = old.where("vec_id % 6 = 0").withColumn("label", F.col("label") + 200).withColumn("pos", F.lit(2))
    return vectors.upsert_points(old, again.unionByName(more)).select("chunk_id", "label")


def vector_payloads(spark: SparkSession, d: str) -> DataFrame:
    chunks = documents(spark, d).distinct().select(F.concat(F.lit("p"), F.col("paper_version_id")).alias("paper_id"), F.col("section_id").alias("chunk_id"))
    papers = table(spark, d, "orders").select(F.concat(F.lit("p"), text("o_orderkey")).alias("paper_id"), F.concat(F.lit("Order "), text("o_orderkey")).alias("title"), F.lit("tpch").alias("source"), text("o_orderkey").alias("source_id"), F.array("o_orderpriority", "o_orderstatus").alias("categories"), F.col("o_orderdate").alias("published_at"))
    return vectors.payloads(chunks, papers).withColumn("categories", F.array_join("categories", "|")).withColumn("published_year", F.col("published_year").cast("long"))


NAMES = ["paper_upsert", "version_conflicts", "stage_update", "known_papers", "document_listing", "chunk_page", "active_jobs", "ready_versions", "jobs_to_open", "job_moves", "job_failures", "job_replacement", "step_listing", "source_names", "feed_papers", "json_artifacts", "two_column_pages", "unicode_keys", "unicode_pages", "paper_ids", "point_ids", "generation_fingerprints", "entity_validation", "section_gate", "author_facts", "citation_edges", "edge_provenance", "generation_members", "graph_constraints", "node_by_id", "chunk_validation", "chunk_precheck", "chunk_evidence", "point_upsert", "vector_payloads"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    chain = [*control.STATUS_CHAIN, "failed"]
    status = "([" + ", ".join(f"'{s}'" for s in chain) + f"])[event_id % {len(chain)} + 1]"
    jobs = f"j AS (SELECT 'job:' || event_id AS job_id, 'pv:' || user_id AS pv, user_id, {status} AS status, event_id % 3 AS retry FROM events), active AS (SELECT * FROM j WHERE status NOT IN ('ready', 'failed'))"
    line = "l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey"
    docs = f"s AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS pv, 'section:' || {line} AS section_id, lower(l_returnflag) AS section_type, l_linenumber::BIGINT AS \"order\", 'line ' || {line} AS body FROM lineitem)"
    uuid = ids.POINTS.hex
    generations = ", ".join(f"sha256('{{\"{a}\":\"' || {x} || '\",\"{b}\":\"' || {y} || '\"}}') AS {kind}" for kind, ((a, x), (b, y)) in {
        "vector_generation": (("chunk_artifact_checksum", "k"), ("embedding_config_fingerprint", "c")),
        "extraction_generation": (("chunk_artifact_checksum", "k"), ("extraction_config_fingerprint", "c")),
        "graph_index_generation": (("canonicalization_config_fingerprint", "c"), ("graph_extraction_artifact_checksum", "k")),
    }.items())
    chunks = "c AS (SELECT 'chunk:' || CASE WHEN vec_id % 50 = 0 THEN 'twice' ELSE CAST(vec_id AS VARCHAR) END AS chunk_id, vec_id % 40 AS section, vec_id FROM embeddings)"
    arxiv = "substr(lpad(CAST(o_orderkey + {0} AS VARCHAR), 9, '0'), 1, 4) || '.' || substr(lpad(CAST(o_orderkey + {0} AS VARCHAR), 9, '0'), 5, 5)"
    return {
        "paper_upsert": "SELECT 'c' || c_custkey AS paper_id, c_name AS source_id, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS title FROM customer UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier' FROM supplier",
        "version_conflicts": "WITH a AS (SELECT DISTINCT l_orderkey AS paper_id, 'v' || l_linenumber AS version, l_linestatus AS checksum FROM lineitem), m AS (SELECT a.*, o_orderkey IS NOT NULL AS there, CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS stored FROM a LEFT JOIN orders ON o_orderkey = paper_id AND version = 'v1') SELECT paper_id, version, checksum, CASE WHEN there THEN 'conflict' ELSE 'insert' END AS verdict FROM m WHERE NOT there OR checksum <> stored",
        "stage_update": "WITH r AS (SELECT l_orderkey AS k, max(l_returnflag) AS f, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) SELECT o_orderkey AS paper_version_id, coalesce(f, o_orderstatus) AS checksum, coalesce(n, -1) AS chunk_count FROM orders LEFT JOIN r ON k = o_orderkey",
        "known_papers": "SELECT DISTINCT 'c' || user_id AS paper_id, user_id IN (SELECT c_custkey FROM customer) AS already_known FROM events",
        "document_listing": f"WITH {docs} SELECT pv AS paper_version_id, section_id, section_type, NULL::VARCHAR AS title, \"order\", \"order\" AS page_start, \"order\" + 1 AS page_end, CASE WHEN section_type = 'a' THEN body END AS text FROM s",
        "chunk_page": f"WITH {docs}, r AS (SELECT replace(section_id, 'section', 'chunk') AS chunk_id, \"order\" FROM s WHERE section_type = 'r') SELECT *, (SELECT count(*) FROM r) AS total FROM r ORDER BY \"order\", chunk_id LIMIT {PAGE['limit']} OFFSET {PAGE['offset']}",
        "active_jobs": f"WITH {jobs} SELECT job_id, pv AS paper_version_id, status FROM active",
        "ready_versions": f"WITH {jobs} SELECT 'pv:' || c_custkey AS paper_version_id FROM customer WHERE c_custkey IN (SELECT user_id FROM j WHERE status = 'ready')",
        "jobs_to_open": f"WITH {jobs} SELECT 'pv:' || c_custkey AS paper_version_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM active)",
        "job_moves": f"WITH {jobs} SELECT job_id, CASE status WHEN 'parsed' THEN 'chunking' ELSE 'ready' END AS status, retry = 0 AS started_now, status = 'graph_indexed' AS completed FROM j WHERE status IN ('parsed', 'graph_indexed')",
        "job_failures": f"WITH {jobs} SELECT job_id, 'failed' AS status, status AS failed_stage, 2000::BIGINT AS reason_length, (retry + 1)::BIGINT AS retry_count FROM active",
        "job_replacement": f"""WITH {jobs}, m AS (SELECT j.*, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) AND status NOT IN ('ready', 'failed') AS hit FROM j)
          SELECT job_id, pv AS paper_version_id, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN status WHEN status = 'failed' THEN 'chunking' END AS failed_stage, CASE WHEN hit THEN 'stale chunks' END AS failure_reason, (retry + CASE WHEN hit THEN 1 ELSE 0 END)::BIGINT AS retry_count FROM m
          UNION ALL SELECT job_id || ':again', pv, 'parsed', NULL, NULL, 0 FROM m WHERE hit""",
        "step_listing": "SELECT user_id AS job_id, event_id AS step_id, event_type AS stage, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events",
        "source_names": """SELECT DISTINCT page_id, CASE WHEN page_id % 3 = page_id % 2 THEN 'Ada L' || (page_id % 3) || '|Bob' ELSE 'Ada L' || (page_id % 3) || '|Bob|Ada L' || (page_id % 2) END AS authors, 'cs.A' || (page_id % 4) || '|cs.CL|cs.LG' AS categories,
          page_id % 7 <> 0 AND page_id % 5 < 3 AS trusted, page_id % 6 <> 0 AND page_id % 5 <> 0 AND page_id % 4 <> 0 AS safe FROM pages""",
        "feed_papers": """WITH o AS (SELECT *, o_orderkey % 50 <> 0 AS named, CAST(o_orderkey AS VARCHAR) AS k FROM orders) SELECT CASE WHEN named THEN 'paper:arxiv:2401.' || k END AS paper_id, CASE WHEN named THEN '2401.' || k END AS source_id, CASE WHEN named THEN 'v2' END AS version, 'A title of ' || k AS title, 's' AS abstract, 'Ann ' || lower(o_orderstatus) || '|Bob' AS authors,
          'cs.CL|cs.LG' AS categories, year(o_orderdate) AS published_year, 3::BIGINT AS updated_hour, 'http://arxiv.org/pdf/2401.' || k AS pdf_url, CASE WHEN NOT named THEN 'entry without id' END AS error FROM o""",
        "json_artifacts": "SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN upper(s_name) ELSE s_name END AS s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier",
        "two_column_pages": "WITH b AS (SELECT l_orderkey AS page, l_partkey * 37 % 500 AS x0, l_quantity AS w FROM lineitem) SELECT page, count(*) FILTER (w >= 20 AND x0 + w / 2 < 270) >= 2 AND count(*) FILTER (w >= 20 AND x0 + w / 2 > 330) >= 2 AS two_columns FROM b GROUP BY 1",
        "unicode_keys": f"WITH k AS (SELECT p_partkey, 'strasse fine ' || lower(p_name) || ' 1' AS key FROM part) SELECT p_partkey, key, 'entity:dataset:' || {_hash("'dataset'", 'key')} AS entity_id FROM k",
        "unicode_pages": "SELECT CAST(p_partkey AS VARCHAR) AS paper_version_id, 1::BIGINT AS page_number, 'first' || chr(10) || upper(p_name) || ' 1 xy' AS text FROM part",
        "paper_ids": f"WITH p AS (SELECT o_orderkey, 'arxiv' || lower(o_orderstatus) || ':24 ' || o_orderkey AS own, CASE WHEN o_orderkey % 2 = 0 THEN 'V' ELSE 'v' END || o_custkey AS v, 'my ' || o_custkey AS c FROM orders) SELECT o_orderkey, 'paper:' || own AS paper_id, 'paper-version:' || own || ':' || v AS paper_version_id, 'collection:' || {_hash('c')} AS collection_id FROM p",
        "point_ids": f"WITH h AS (SELECT 'chunk:vec:' || vec_id AS chunk_id, sha1(unhex('{uuid}') || encode('chunk:vec:' || vec_id)) AS h FROM embeddings) SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h",
        "generation_fingerprints": f"WITH o AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS k, sha256(o_orderstatus) AS c FROM orders) SELECT o_orderkey, {generations} FROM o",
        "entity_validation": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN 'unknown_entity_type' WHEN p_partkey % 7 = 0 THEN 'blank_name' WHEN p_partkey % 11 = 0 OR p_partkey % 4 = 0 THEN 'confidence_out_of_range' END AS reason FROM part",
        "section_gate": "SELECT p_partkey, (['abstract', 'references', 'methodology', 'related_work', 'other', 'limitations', 'results'])[p_partkey % 7 + 1] AS section_type FROM part WHERE p_partkey % 7 IN (0, 2, 4, 6)",
        "author_facts": f"""WITH a AS (SELECT 'paper:tpch:' || o_orderkey AS paper_id, unnest(['Clerk ' || (o_custkey % 7), 'Aide ' || lower(o_orderstatus)]) AS name FROM orders), t AS (SELECT *, {_entity('author', 'name')} AS target_entity_id FROM a)
          SELECT paper_id, name, target_entity_id, 'relationship:' || {_hash('paper_id', "'authored_by'", 'target_entity_id')} AS relationship_id, 1.0::DOUBLE AS confidence FROM t""",
        "citation_edges": f"WITH r AS (SELECT 'paper:tpch:' || o_orderkey AS src, unnest(['paper:arxiv:' || {arxiv.format(1)}, 'paper:arxiv:' || {arxiv.format(2)}, 'paper:arxiv:' || {arxiv.format(2)}]) AS dst FROM orders) SELECT src AS source_entity_id, 'cites' AS relationship_type, dst AS target_entity_id, 1.0::DOUBLE AS confidence, 'relationship:' || {_hash('src', "'cites'", 'dst')} AS relationship_id FROM r",
        "edge_provenance": f"{GRAPH_SQL} SELECT rid AS relationship_id, CASE WHEN type = 'authored_by' THEN 'metadata' ELSE 'chunk' END AS provenance_type, coalesce(len(chunks), 0)::BIGINT AS supports FROM edges",
        "generation_members": f"{GRAPH_SQL} SELECT rid AS relationship_id FROM edges WHERE conf >= 0.95",
        "graph_constraints": f"{GRAPH_SQL}, n AS (SELECT kind, id FROM nodes UNION ALL SELECT CASE WHEN p_partkey % 3 = 0 THEN 'robot' ELSE 'dataset' END, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE 'entity:' || p_size END FROM part) SELECT kind AS entity_type, id AS entity_id, CASE WHEN kind = 'robot' THEN 'unknown_type' WHEN trim(id) = '' THEN 'missing_id' ELSE 'repeated_id' END AS violation FROM n GROUP BY ALL HAVING kind = 'robot' OR trim(id) = '' OR count(*) > 1",
        "node_by_id": f"{GRAPH_SQL} SELECT id AS entity_id, kind AS entity_type, name AS canonical_name FROM nodes WHERE id IN (SELECT 'paper:tpch:' || event_id FROM events)",
        "chunk_validation": f"WITH {chunks}, m AS (SELECT c.*, count(*) OVER (PARTITION BY chunk_id) AS copies FROM c), p AS (SELECT chunk_id, CASE WHEN copies > 1 THEN 'duplicate_id' WHEN vec_id % 31 = 0 THEN 'negative_index' WHEN vec_id % 17 = 0 THEN 'blank_text' WHEN vec_id % 13 = 0 THEN 'no_tokens' WHEN section >= 25 THEN 'unknown_section' END AS problem FROM m) SELECT chunk_id, problem, count(*) AS rows FROM p WHERE problem IS NOT NULL GROUP BY ALL",
        "chunk_precheck": f"WITH {chunks} SELECT count(*) AS rows, count(*) - count(DISTINCT chunk_id) AS duplicates, count(*) FILTER (vec_id % 17 = 0) AS blank, false AS ok FROM c",
        "chunk_evidence": "SELECT 'chunk:vec:' || vec_id AS chunk_id, 'evidence:' || substr(sha256('text|qdrant|chunk:vec:' || vec_id || '|' || CASE WHEN vec_id % 7 = 0 THEN 'old' ELSE 'current' END), 1, 16) AS evidence_id, true AS exact_lookup, true AS no_score FROM embeddings",
        "point_upsert": "SELECT 'chunk:vec:' || vec_id AS chunk_id, label::BIGINT + CASE WHEN vec_id % 6 = 0 THEN 200 WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END AS label FROM embeddings",
        "vector_payloads": f"WITH {docs} SELECT 'p' || pv AS paper_id, section_id AS chunk_id, 'Order ' || pv AS paper_title, 'tpch' AS source, pv AS source_id, o_orderpriority || '|' || o_orderstatus AS categories, year(o_orderdate) AS published_year FROM s JOIN orders ON CAST(o_orderkey AS VARCHAR) = pv",
    }
