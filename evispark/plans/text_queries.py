"""Text operators and identities over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import ids
from ..operators import chunking, control, references, text_etl
from .projections import GRAPH_SQL, _entity, _hash, edges, part_name, table

SMALL = Settings(chunk_size=60, chunk_overlap=12, chunk_min_tokens=10)
# What a line of a document has in front of it, by its number.
HEADINGS = ["1. Introduction", "II. METHODS", "Background", "Overview", "3 Custom Title", "1.1 Background", "Abstract", "References"]


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Each line of a document is a page, with a running title and a page number around it."""
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    text = F.concat(F.lit("Running Title "), F.col("doc_id").cast("string"), F.lit("\n"), "line", F.lit("\nPage "), (F.col("i") + 1).cast("string"))
    return rows.select(F.concat(F.lit("paper-version:doc:"), F.col("doc_id").cast("string"), F.lit(":v1")).alias("paper_version_id"), (F.col("i") + 1).cast("long").alias("page_number"), text.alias("text"), "line", "i")


def headed(spark: SparkSession, d: str) -> DataFrame:
    """The same lines as pages, each under a line of HEADINGS."""
    head = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), (F.col("i") % len(HEADINGS) + 1).cast("int"))
    return pages(spark, d).withColumn("text", F.concat(head, F.lit("\n"), "line")).drop("line", "i")


def clean_pages(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.regexp_replace("line", " ", "  "), F.lit(" \t\r\n\n \r\nend-\nword "))
    return text_etl.clean_pages(pages(spark, d).select("paper_version_id", "page_number", raw.alias("text")))


def line_keys(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("paper_version_id", "page_number", text_etl.line_key("line").alias("key"))


def header_footer_detect(spark: SparkSession, d: str) -> DataFrame:
    return text_etl.header_footer_lines(pages(spark, d).select("paper_version_id", "page_number", "text"))


def header_footer_remove(spark: SparkSession, d: str) -> DataFrame:
    return text_etl.without_headers_footers(pages(spark, d).select("paper_version_id", "page_number", "text"))


def heading_detect(spark: SparkSession, d: str) -> DataFrame:
    lines = headed(spark, d).select("paper_version_id", "page_number", F.explode(F.split("text", "\n")).alias("line"))
    return lines.withColumn("h", text_etl.heading("line")).where("h is not null").select("paper_version_id", "page_number", "h.title", "h.section_type")


def section_assembly(spark: SparkSession, d: str) -> DataFrame:
    out = text_etl.sections(headed(spark, d))
    return out.withColumn("section_id", ids.section_id("paper_version_id", "section_type", "order")).withColumn("order", F.col("order").cast("long"))


def quality_warnings(spark: SparkSession, d: str) -> DataFrame:
    p = headed(spark, d)
    return text_etl.warnings(p, text_etl.sections(p)).select("paper_version_id", F.array_join("warnings", ",").alias("warnings"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", chunking.token_count("text").cast("long").alias("tokens"))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.word_windows("text", 60)).alias("chunk_index", "text"))


def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    own = ids.chunk_id("doc_id", F.lit("s"), "chunk_index", F.lit("f"))
    return _windows(spark, d).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "text", own.alias("chunk_id"))


def sections_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document is a section whose lines are paragraphs."""
    name = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(F.concat(F.lit("section:"), name).alias("section_id"), F.concat(F.lit("paper:doc:"), name).alias("paper_id"), F.concat(F.lit("paper-version:doc:"), name, F.lit(":v1")).alias("paper_version_id"), F.lit("other").alias("section_type"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


def packed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(sections_of_documents(spark, d), SMALL).select("chunk_id", "section_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("token_count").cast("long").alias("token_count"), "text")


def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    rows = _windows(spark, d).withColumn("token_count", chunking.token_count("text").cast("long"))
    out = chunking.diagnostics(rows, ["doc_id"], SMALL)
    return out.withColumn("average_tokens", F.round("average_tokens", 6))


def reference_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents of an odd id have numbered entries, each with a cited id; others blank lines between entries."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x, F.lit(" arXiv:2401."), F.lpad((i + 1).cast("string"), 5, F.lit("0")), F.lit("v2")))
    text = F.when(F.col("doc_id") % 2 == 1, F.concat(F.lit("preface\n"), F.array_join(lines, "\n"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\n \n")))
    refs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("paper_version_id"), text.alias("text"))
    return references.resolved(refs).select("paper_version_id", F.col("position").cast("long").alias("position"), "target_paper_id", "unresolved_text")


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t, kind, name: table(spark, d, t).select(F.lit(kind).alias("entity_type"), name.alias("name"), ids.entity_id(F.lit(kind), name).alias("entity_id"))
    return one("customer", "author", F.col("c_name")).union(one("supplier", "method", F.col("s_name"))).union(one("part", "dataset", F.upper(part_name()))).distinct()


def relationship_ids(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("source_entity_id", "relationship_type", "target_entity_id", "relationship_id")


def evidence_ids(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.concat(F.lit("chunk:vec:"), F.col("vec_id").cast("string"))
    return table(spark, d, "embeddings").select(chunk.alias("chunk_id"), ids.evidence_id(F.lit("text"), F.lit("qdrant"), chunk, F.lit("g")).alias("evidence_id"))


def latest_version(spark: SparkSession, d: str) -> DataFrame:
    """Users are papers, their events versions named by the event's number; errors have no number."""
    version = F.when(F.col("event_type") == "error", "draft").otherwise(F.concat(F.lit("v"), F.col("event_id").cast("string")))
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("paper_id"), version.alias("version"))
    return control.latest_versions(rows)


NAMES = ["clean_pages", "line_keys", "header_footer_detect", "header_footer_remove", "heading_detect", "section_assembly", "quality_warnings", "token_counts", "word_chunks", "packed_chunks", "chunk_diagnostics", "reference_split", "entity_ids", "relationship_ids", "evidence_ids", "latest_version"]


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


_PAGES = """p AS (SELECT doc_id, 'paper-version:doc:' || doc_id || ':v1' AS version, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
pages AS (SELECT *, 'Running Title ' || doc_id || chr(10) || line || chr(10) || 'Page ' || i AS text FROM p)"""
_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}\\x1c-\\x1f]+|[\\s\\p{{Z}}\\x1c-\\x1f]+$', '', 'g')"
_KEY = "regexp_replace(lower(" + _STRIP + "), '\\p{{Nd}}+', '#', 'g')"
_NUMBERED = r"'^\d{1,2}\.?\s+([A-Z][A-Za-z][A-Za-z\s\-:]{2,60})$'"
_ROMAN = r"'^[IVXLCDM]{1,6}\.\s+([A-Z][A-Za-z][A-Za-z\s\-:]{2,60})$'"


def _lines_sql() -> str:
    words = ", ".join(f"('{k}', '{v}')" for k, v in (text_etl.SECTION_KEYWORDS | dict.fromkeys(text_etl.OTHER_KEYWORDS, "other")).items())
    heads = ", ".join(f"'{h}'" for h in HEADINGS)
    return f"""WITH {_PAGES}, vocabulary(word, type) AS (VALUES {words}),
lines AS (SELECT version, i AS page, 0 AS n, ([{heads}])[(i - 1) % {len(HEADINGS)} + 1] AS line FROM p UNION ALL SELECT version, i, 1, line FROM p),
s AS (SELECT *, {_STRIP.format('line')} AS t FROM lines),
titles AS (SELECT *, regexp_matches(t, {_NUMBERED}) OR regexp_matches(t, {_ROMAN}) AS counted, CASE WHEN regexp_matches(t, {_NUMBERED}) THEN trim(regexp_extract(t, {_NUMBERED}, 1)) WHEN regexp_matches(t, {_ROMAN}) THEN trim(regexp_extract(t, {_ROMAN}, 1)) WHEN length(t) <= 50 THEN t END AS title FROM s),
heads AS (SELECT t.* EXCLUDE (title), CASE WHEN counted OR type IS NOT NULL THEN title END AS title, CASE WHEN counted THEN coalesce(type, 'other') ELSE type END AS section_type FROM titles t LEFT JOIN vocabulary ON word = lower(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ', 'g')))"""


def oracle_sql() -> dict[str, str]:
    key = _KEY.format("line")
    found = f"""counts AS (SELECT version, count(*) AS n_pages FROM pages GROUP BY 1), full_lines AS (SELECT version, i, list_filter(string_split(text, chr(10)), lambda x: {_STRIP.format('x')} <> '') AS l FROM pages),
both_lines AS (SELECT version, 'header' AS place, {_KEY.format('l[1]')} AS key FROM full_lines UNION ALL SELECT version, 'footer', {_KEY.format('l[-1]')} FROM full_lines),
found AS (SELECT version, place, key, count(*) AS n FROM both_lines JOIN counts USING (version) WHERE key <> '' GROUP BY version, place, key, n_pages HAVING n_pages >= 3 AND count(*) >= greatest(3, round_even(n_pages * 0.6, 0)))"""
    sections = f"""{_lines_sql()}, parts AS (SELECT *, sum(CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY version ORDER BY page, n) AS part FROM heads),
bodies AS (SELECT version, part, max(title) AS title, max(section_type) AS section_type, min(page) AS page_start, max(page) AS page_end, {_STRIP.format("coalesce(string_agg(line, chr(10) ORDER BY page, n) FILTER (title IS NULL), '')")} AS text FROM parts GROUP BY 1, 2),
kept AS (SELECT *, max(part) OVER (PARTITION BY version) > 0 AS headed FROM bodies QUALIFY (part > 0 OR NOT headed)),
sections AS (SELECT *, row_number() OVER (PARTITION BY version ORDER BY part) - 1 AS ord FROM kept WHERE text <> '')"""
    text = "CASE WHEN doc_id % 2 = 1 THEN list_transform(string_split(text, chr(10)), lambda x, i: x || ' arXiv:2401.' || lpad(CAST(i AS VARCHAR), 5, '0') || 'v2') ELSE string_split(text, chr(10)) END"
    spaced = "trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x1c-\\x1f]+', ' ', 'g'))"
    words = "list_filter(string_split_regex(text, '[\\s\\p{Z}\\x1c-\\x1f]+'), lambda x: x <> '')"
    windows = f"w AS (SELECT doc_id, {words} AS w FROM documents), c AS (SELECT doc_id, unnest(range(0, len(w), 60)) AS i, w FROM w), chunks AS (SELECT doc_id, i // 60 AS chunk_index, array_to_string(w[i + 1:i + 60], ' ') AS text, len(w[i + 1:i + 60]) AS n FROM c)"
    return {
        "clean_pages": f"""WITH {_PAGES}, r AS (SELECT version, i, regexp_replace(regexp_replace(replace(line, ' ', '  ') || ' ' || chr(9) || chr(13) || chr(10) || chr(10) || ' ' || chr(13) || chr(10) || 'end-' || chr(10) || 'word ', '\\r\\n?', chr(10), 'g'), '([a-z])-\\n([a-z])', '\\1\\2', 'g') AS t FROM p),
          l AS (SELECT *, string_split(t, chr(10)) AS l FROM r), k AS (SELECT version, i, list_filter(l, lambda x, j: {_STRIP.format('x')} <> '' OR j = 1 OR {_STRIP.format('l[j - 1]')} <> '') AS l FROM l)
          SELECT version AS paper_version_id, i AS page_number, array_to_string(list_transform(l, lambda x: {_STRIP.format("regexp_replace(x, '[ \\t]+', ' ', 'g')")}), chr(10)) AS text FROM k""",
        "line_keys": f"WITH {_PAGES} SELECT version AS paper_version_id, i AS page_number, {key} AS key FROM p",
        "header_footer_detect": f"WITH {_PAGES}, {found} SELECT version AS paper_version_id, place, key, n FROM found",
        "header_footer_remove": f"""WITH {_PAGES}, {found}, h AS (SELECT version, max(key) FILTER (place = 'header') AS header, max(key) FILTER (place = 'footer') AS footer FROM found GROUP BY 1)
          SELECT version AS paper_version_id, i AS page_number, CASE WHEN header IS NOT NULL AND {_KEY.format("'Running Title ' || doc_id")} = header THEN '' ELSE 'Running Title ' || doc_id END || chr(10) || line || chr(10) || CASE WHEN footer IS NOT NULL AND {_KEY.format("'Page ' || i")} = footer THEN '' ELSE 'Page ' || i END AS text FROM pages LEFT JOIN h USING (version)""",
        "heading_detect": f"{_lines_sql()} SELECT version AS paper_version_id, page AS page_number, title, section_type FROM heads WHERE title IS NOT NULL",
        "section_assembly": f"{sections} SELECT version AS paper_version_id, ord AS \"order\", coalesce(section_type, 'other') AS section_type, title, page_start, page_end, text, 'section:' || {_hash('version', "coalesce(section_type, 'other')", 'ord')} AS section_id FROM sections",
        "quality_warnings": f"""{sections}, a AS (SELECT version, avg(length(([{", ".join(f"'{h}'" for h in HEADINGS)}])[(i - 1) % {len(HEADINGS)} + 1]) + 1 + length(line)) AS chars FROM p GROUP BY 1),
          k AS (SELECT version, bool_or(section_type = 'abstract') AS abstract, bool_or(section_type = 'references') AS refs FROM sections GROUP BY 1)
          SELECT version AS paper_version_id, array_to_string(list_filter([CASE WHEN chars < 200 THEN 'low_text_density' END, CASE WHEN NOT coalesce(abstract, false) THEN 'no_abstract_detected' END, CASE WHEN NOT coalesce(refs, false) THEN 'no_references_detected' END], lambda x: x IS NOT NULL), ',') AS warnings FROM a LEFT JOIN k USING (version)""",
        "token_counts": f"SELECT doc_id, len({words}) AS tokens FROM documents",
        "word_chunks": f"WITH {windows} SELECT doc_id, chunk_index, text, 'chunk:' || {_hash('doc_id', "'s'", 'chunk_index', "'f'")} AS chunk_id FROM chunks",
        "chunk_diagnostics": f"WITH {windows} SELECT doc_id, count(*) AS chunk_count, min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 6) AS average_tokens, median(n) AS median_tokens, count(*) FILTER (n < 10) AS small_chunk_count, count(*) FILTER (n > 72) AS oversized_chunk_count FROM chunks GROUP BY doc_id",
        "packed_chunks": f"""WITH RECURSIVE w AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text, string_split(text, chr(10)) AS ps FROM documents),
          ps AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM w), ss AS (SELECT doc_id, i, unnest(CASE WHEN len({words.replace("text", "p")}) <= 60 THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END) AS s, generate_subscripts(CASE WHEN len({words.replace("text", "p")}) <= 60 THEN [p] ELSE string_split(regexp_replace(p, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) END, 1) AS j FROM ps),
          sw AS (SELECT doc_id, i, j, s, {words.replace("text", "s")} AS v FROM ss), us AS (SELECT doc_id, i, j, unnest(CASE WHEN len(v) <= 60 THEN [0] ELSE range(0, len(v), 60) END) AS k, s, v FROM sw WHERE len(v) > 0),
          units AS (SELECT doc_id, list({{'u': CASE WHEN len(v) <= 60 THEN {_STRIP.format('s')} ELSE array_to_string(v[k + 1:k + 60], ' ') END, 'n': least(len(v) - k, 60)}} ORDER BY i, j, k) AS us FROM us GROUP BY doc_id),
          pack AS (SELECT doc_id, us, 0 AS k, us[1:0] AS held, CAST([] AS VARCHAR[]) AS done FROM units
            UNION ALL SELECT doc_id, us, k + 1, list_append(CASE WHEN overflow THEN list_filter(held, lambda x, m: list_sum(list_transform(held[m:], lambda y: y.n)) <= 12) ELSE held END, us[k + 1]), CASE WHEN overflow THEN list_append(done, array_to_string(list_transform(held, lambda y: y.u), ' ')) ELSE done END
            FROM (SELECT *, len(held) > 0 AND coalesce(list_sum(list_transform(held, lambda y: y.n)), 0) + us[k + 1].n > 60 AS overflow FROM pack WHERE k < len(us))),
          ends AS (SELECT doc_id, list_append(done, array_to_string(list_transform(held, lambda y: y.u), ' ')) AS c FROM pack WHERE k = len(us)),
          tails AS (SELECT doc_id, CASE WHEN len(c) > 1 AND len(list_filter(string_split_regex(c[-1], '[\\s\\p{{Z}}\\x1c-\\x1f]+'), lambda x: x <> '')) < 10 THEN list_append(c[:len(c) - 2], c[-2] || chr(10) || chr(10) || c[-1]) ELSE c END AS c FROM ends),
          all_chunks AS (SELECT w.doc_id, unnest(CASE WHEN len({words.replace("text", "w.text")}) <= 60 THEN [{_STRIP.format('w.text')}] ELSE c END) AS text, generate_subscripts(CASE WHEN len({words.replace("text", "w.text")}) <= 60 THEN [{_STRIP.format('w.text')}] ELSE c END, 1) - 1 AS chunk_index FROM w LEFT JOIN tails ON tails.doc_id = w.doc_id)
          SELECT 'chunk:' || {_hash("'paper-version:doc:' || doc_id || ':v1'", "'section:' || doc_id", 'chunk_index', f"'{chunking.config_fingerprint(SMALL)}'")} AS chunk_id, 'section:' || doc_id AS section_id, chunk_index, len({words}) AS token_count, text FROM all_chunks WHERE text <> ''""",
        "reference_split": f"""WITH e AS (SELECT doc_id, list_filter(list_transform(CASE WHEN doc_id % 2 = 1 AND len(string_split(text, chr(10))) < 2 THEN ['preface ' || '[1] ' || ({text})[1]] ELSE {text} END, lambda x: {spaced.format('x')}), lambda x: x <> '') AS l FROM documents),
          u AS (SELECT CAST(doc_id AS VARCHAR) AS paper_version_id, unnest(l) AS entry, generate_subscripts(l, 1) - 1 AS position FROM e), i AS (SELECT *, nullif(regexp_replace(regexp_extract(entry, '(?i)(?:arxiv\\s*:\\s*)?(\\d{{4}}\\.\\d{{4,5}}(?:v\\d+)?|[a-z\\-]+(?:\\.[A-Z]{{2}})?/\\d{{7}}(?:v\\d+)?)', 1), '(?i)v\\d+$', ''), '') AS cited FROM u)
          SELECT paper_version_id, position, 'paper:arxiv:' || cited AS target_paper_id, CASE WHEN cited IS NULL THEN entry[1:300] END AS unresolved_text FROM i""",
        "entity_ids": f"SELECT DISTINCT * FROM (SELECT 'author' AS entity_type, c_name AS name, {_entity('author', 'c_name')} AS entity_id FROM customer UNION ALL SELECT 'method', s_name, {_entity('method', 's_name')} FROM supplier UNION ALL SELECT 'dataset', upper(p_name || ' ' || p_partkey), {_entity('dataset', "p_name || ' ' || p_partkey")} FROM part)",
        "relationship_ids": GRAPH_SQL + " SELECT src AS source_entity_id, type AS relationship_type, dst AS target_entity_id, rid AS relationship_id FROM edges",
        "evidence_ids": "SELECT 'chunk:vec:' || vec_id AS chunk_id, 'evidence:' || substr(sha256('text|qdrant|chunk:vec:' || vec_id || '|g'), 1, 16) AS evidence_id FROM embeddings",
        "latest_version": "SELECT CAST(user_id AS VARCHAR) AS paper_id, arg_max(CASE WHEN event_type = 'error' THEN 'draft' ELSE 'v' || event_id END, CASE WHEN event_type = 'error' THEN -1 ELSE event_id END) AS version FROM events GROUP BY user_id",
    }
