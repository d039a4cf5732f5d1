"""Discovery clean-up and the ingestion control plane: versions, job states, resume points, attempts, staleness."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import spaced
from ..schemas import STATUS_CHAIN

TERMINAL = ["ready", "failed"]
REASON_MOST = 2000
# Status -> the stage that runs next; None where nothing is left.
NEXT_STAGE = {
    "discovered": "download",
    "downloading": "download",
    "downloaded": "parse",
    "parsing": "parse",
    "parsed": "chunk",
    "chunking": "chunk",
    "chunked": "vector_index",
    "vector_indexing": "vector_index",
    "vector_indexed": "graph_index",
    "graph_indexing": "graph_index",
    "graph_indexed": None,
    "ready": None,
}
# Hosts that PDFs may come from.
TRUSTED_HOSTS = ["arxiv.org", "www.arxiv.org", "export.arxiv.org"]


def version_rank(version: Column | str) -> Column:
    """All digits of the version put together (v1.2 ranks 12); -1 without digits."""
    version = F.col(version) if isinstance(version, str) else version
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(version, "[^0-9]", ""), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(-1).cast("long"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """versions(paper_id, version): the one of highest rank; equal ranks go by the version's text."""
    return versions.groupBy("paper_id").agg(F.max_by("version", F.struct(version_rank("version"), "version")).alias("version"))


def clean_authors(names: Column | str) -> Column:
    names = F.col(names) if isinstance(names, str) else names
    return F.array_distinct(F.filter(F.transform(names, spaced), lambda n: n != ""))


def clean_categories(names: Column | str) -> Column:
    return F.array_sort(clean_authors(names))


def normalised_id(raw: Column | str) -> Column:
    """STRUCT(source_id, version) of an id or of its abstract or PDF URL; null id for a blank."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    text = F.regexp_replace(spaced(raw), r"(?i)^https?://(?:www\.|export\.)?arxiv\.org/(?:abs|pdf)/", "")
    text = F.regexp_replace(F.regexp_replace(text, r"/+$", ""), r"(?i)\.pdf$", "")
    version = F.nullif(F.regexp_extract(text, r"(v\d+)$", 1), F.lit(""))
    return F.struct(F.nullif(F.regexp_replace(text, r"v\d+$", ""), F.lit("")).alias("source_id"), version.alias("version"))


def trusted_url(url: Column | str) -> Column:
    """Whether a PDF URL is http(s) and of a trusted host."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)).isin("http", "https") & F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/:?#]+)", 1)).isin(TRUSTED_HOSTS), F.lit(False))


def safe_segment(name: Column | str) -> Column:
    """Whether a path segment is alphanumeric at both ends, with ._- inside alone."""
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(name.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?$"), F.lit(False))


def search_query(text: str, categories: list[str] | None = None) -> str:
    """The feed's query: the whole text as one phrase over all fields, and each category."""
    phrase = " ".join(text.split())
    if not phrase:
        raise ValueError("a query must not be blank")
    return " AND ".join([f'all:"{phrase}"', *[f"cat:{c}" for c in categories or []]])


def deduplicated(results: DataFrame) -> DataFrame:
    """results(source_id, version, pos): the highest version of each id, the first of equals; in first-seen order by `first_pos`."""
    best = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc(version_rank("version")), "pos"))
    first = F.min("pos").over(Window.partitionBy("source_id"))
    return results.withColumn("first_pos", first).withColumn("nth", best).where("nth = 1").drop("nth")


def in_dates(papers: DataFrame, after: datetime | None, before: datetime | None) -> DataFrame:
    """Inclusive bounds; papers without a date go where a bound is set."""
    if after is not None and before is not None and after > before:
        raise ValueError("the first date is after the last")
    papers = papers if after is None else papers.where(F.col("published_at") >= F.lit(after))
    return papers if before is None else papers.where(F.col("published_at") <= F.lit(before))


def known_flags(found: DataFrame, stored: DataFrame) -> DataFrame:
    have = stored.select("paper_id", F.lit(True).alias("have")).distinct()
    return found.join(have, "paper_id", "left").withColumn("already_known", F.col("have").isNotNull()).drop("have")


def upserted_papers(old: DataFrame, new: DataFrame, mutable: list[str]) -> DataFrame:
    """By paper_id; a match takes the new mutable columns, and identity stays."""
    rest = [c for c in old.columns if c != "paper_id"]
    a = old.select("paper_id", F.struct(*rest).alias("o"))
    b = new.select("paper_id", F.struct(*rest).alias("n"))
    met = a.join(b, "paper_id", "full")
    pick = lambda c: F.when(F.col("n").isNotNull() & (F.lit(c in mutable) | F.col("o").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return met.select("paper_id", *[pick(c) for c in rest])


def transition_allowed(before: Column | str, after: Column | str) -> Column:
    before, after = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    step = F.lit(False)
    for a, b in zip(STATUS_CHAIN, STATUS_CHAIN[1:]):
        step = step | ((before == a) & (after == b))
    return ~before.isin(TERMINAL) & (step | (after == "failed"))


def illegal_transitions(moves: DataFrame) -> DataFrame:
    """moves(job_id, status, pos): moves from the job's previous status that the chain doesn't allow."""
    last = F.lag("status").over(Window.partitionBy("job_id").orderBy("pos"))
    return moves.withColumn("previous", last).where(F.col("previous").isNotNull() & ~transition_allowed("previous", "status"))


def resume_points(jobs: DataFrame) -> DataFrame:
    """jobs(job_id, status, failed_stage) with the stage to run next; failed jobs go on from where they failed."""
    table = F.create_map(*[F.lit(x) for k, v in NEXT_STAGE.items() if v for x in (k, v)])
    at = F.when(F.col("status") == "failed", F.col("failed_stage")).otherwise(F.col("status"))
    return jobs.withColumn("next_stage", F.try_element_at(table, at))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.where(~F.col("status").isin(TERMINAL))


def jobs_to_open(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions without an active job: one job a version at a time."""
    return versions.join(active_jobs(jobs), "paper_version_id", "left_anti")


def failed_job(jobs: DataFrame, reason: str) -> DataFrame:
    return jobs.withColumn("failed_stage", F.col("status")).withColumn("status", F.lit("failed")).withColumn("failure_reason", F.lit(reason[:REASON_MOST])).withColumn("retry_count", F.col("retry_count") + 1)


def step_attempts(steps: DataFrame) -> DataFrame:
    """steps(job_id, stage, pos) numbered from 1 within each job and stage."""
    return steps.withColumn("attempt", F.row_number().over(Window.partitionBy("job_id", "stage").orderBy("pos")))


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Versions whose stored generation is missing or differs from current(paper_version_id, generation): what a stage has to do again."""
    have = stored.select("paper_version_id", F.col("generation").alias("stored_generation"))
    met = current.join(have, "paper_version_id", "left")
    return met.where(~F.col("stored_generation").eqNullSafe(F.col("generation")))


def chunk_listing(chunks: DataFrame, section_order: DataFrame, *, section_type: str | None = None, offset: int = 0, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(total count before paging, the page of chunks by section order and index)."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    chunks = chunks if section_type is None else chunks.where(F.col("section_type") == section_type)
    page = chunks.join(section_order.select("section_id", "order"), "section_id").orderBy("order", "chunk_index", "chunk_id").offset(offset).limit(limit)
    return chunks.agg(F.count("*").alias("total")), page


def document_listing(sections: DataFrame, include_text: bool = False) -> DataFrame:
    """A document's sections in order; their texts only if asked for."""
    text = F.col("text") if include_text else F.lit(None).cast("string")
    return sections.select("paper_version_id", "section_id", "section_type", "title", "order", "page_start", "page_end", text.alias("text"))


def ready_versions(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Versions that any job has brought to its end."""
    return versions.join(jobs.where(F.col("status") == "ready"), "paper_version_id", "left_semi")


def step_listing(steps: DataFrame) -> DataFrame:
    """steps(job_id, step_id, ...) with their place in their job, by step id."""
    return steps.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("step_id")))


def by_key(rows: DataFrame, **key) -> DataFrame:
    """The rows of a key, whose parts are equalities that reach the scan."""
    for column, value in key.items():
        rows = rows.where(F.col(column) == value)
    return rows


def replaced_jobs(jobs: DataFrame, stale: DataFrame, status: str, job_id: Column) -> DataFrame:
    """jobs(job_id, paper_version_id, status, failed_stage, failure_reason, retry_count): active jobs of the versions in stale(paper_version_id, reason) fail, and each gets a new one that goes on from `status`."""
    met = jobs.join(stale.select("paper_version_id", F.substring("reason", 1, REASON_MOST).alias("why")).dropDuplicates(["paper_version_id"]), "paper_version_id", "left")
    hit = F.col("why").isNotNull() & ~F.col("status").isin(TERMINAL)
    own = ["job_id", "paper_version_id", "status", "failed_stage", "failure_reason", "retry_count"]
    old = met.select("job_id", "paper_version_id", F.when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit, F.col("status")).otherwise(F.col("failed_stage")).alias("failed_stage"), F.when(hit, F.col("why")).otherwise(F.col("failure_reason")).alias("failure_reason"), (F.col("retry_count") + hit.cast("int")).alias("retry_count"))
    none = F.lit(None).cast("string")
    fresh = met.where(hit).select(job_id.alias("job_id"), "paper_version_id", F.lit(status).alias("status"), none.alias("failed_stage"), none.alias("failure_reason"), F.lit(0).alias("retry_count"))
    return old.select(*own).unionByName(fresh.select(*own))


def new_versions(asked: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(versions to insert, conflicts) for asked(paper_id, version, checksum): a stored version with another known checksum conflicts."""
    have = stored.select("paper_id", "version", F.col("checksum").alias("stored_checksum"))
    met = asked.join(have, ["paper_id", "version"])
    differs = F.coalesce(F.col("checksum") != F.col("stored_checksum"), F.lit(False))
    return asked.join(have, ["paper_id", "version"], "left_anti"), met.where(differs)


def stage_results(versions: DataFrame, results: DataFrame) -> DataFrame:
    """versions with the columns of results(paper_version_id, ...) overwritten where a result is given."""
    columns = [c for c in results.columns if c != "paper_version_id"]
    met = versions.join(results.select("paper_version_id", F.struct(*columns).alias("result")), "paper_version_id", "left")
    return met.select(*[F.when(F.col("result").isNotNull(), F.col(f"result.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in versions.columns])


def moved(jobs: DataFrame, target: str, at: datetime) -> DataFrame:
    """Jobs moved to a status; an illegal move raises. started_at is set once, completed_at at the end."""
    legal = transition_allowed("status", F.lit(target))
    status = F.when(legal, F.lit(target)).otherwise(F.raise_error(F.concat(F.lit("illegal move from "), F.col("status"))).cast("string"))
    ended = F.lit(at) if target == "ready" else F.col("completed_at")
    return jobs.withColumn("started_at", F.coalesce("started_at", F.lit(at))).withColumn("completed_at", ended).withColumn("status", status)
