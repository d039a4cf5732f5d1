"""Atom search feeds: landed XML as paper rows, and the retry rule of a client that lands it."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BoundError, Settings, bounded
from ..functions.ids import paper_id, spaced
from ..operators.control import clean_authors, clean_categories, normalised_id, search_query
from ..storage import new_path, write_bytes

ENTRY = "id string, title string, summary string, published string, updated string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_rel:string,_title:string>>"
RETRIED_STATUS = {429, 500, 502, 503, 504}
# The feed's address and its names of orders.
ENDPOINT = "https://export.arxiv.org/api/query"
SORTS = {"relevance": "relevance", "submitted_date": "submittedDate", "last_updated_date": "lastUpdatedDate"}
ORDERS = ("ascending", "descending")


@dataclass(frozen=True)
class SearchRequest:
    """A search, checked when it is made; requests outside their bounds are refused, never clamped."""

    query: str
    max_results: int | None = None
    start: int = 0
    sort_by: str = "relevance"
    sort_order: str = "descending"
    categories: tuple[str, ...] = ()
    published_after: datetime | None = None
    published_before: datetime | None = None

    def __post_init__(self) -> None:
        if not self.query.strip():
            raise BoundError("a query must not be blank")
        if self.start < 0 or (self.max_results is not None and self.max_results <= 0):
            raise BoundError("start must not be negative, and max_results must be above 0")
        if self.sort_by not in SORTS or self.sort_order not in ORDERS:
            raise BoundError("an unknown order")
        if self.published_after and self.published_before and self.published_after > self.published_before:
            raise BoundError("the first date is after the last")

    def parameters(self, settings: Settings) -> dict[str, str]:
        most = bounded("max_results", self.max_results, settings.discovery_results, settings.discovery_limit)
        categories = [" ".join(c.split()) for c in self.categories if c.strip()]
        return {"search_query": search_query(self.query, categories), "start": str(self.start), "max_results": str(most), "sortBy": SORTS[self.sort_by], "sortOrder": self.sort_order}

    def url(self, settings: Settings, endpoint: str = ENDPOINT) -> str:
        return f"{endpoint}?{urllib.parse.urlencode(self.parameters(settings))}"


class _NoRedirects(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs) -> None:
        return None


def http_get(url: str, timeout: float = 30.0):
    """(status, headers, readable body) of a GET that follows no redirect."""
    try:
        answer = urllib.request.build_opener(_NoRedirects).open(url, timeout=timeout)
    except urllib.error.HTTPError as error:
        answer = error
    except urllib.error.URLError as why:
        raise why.reason if isinstance(why.reason, OSError) else ConnectionError(str(why.reason)) from why
    return answer.status, dict(answer.headers), answer


def search(spark: SparkSession, request: SearchRequest, settings: Settings | None = None, get: Callable = http_get, endpoint: str = ENDPOINT, **retries) -> DataFrame:
    """The papers of one search: its feed is fetched with retries, landed in the shared folder and read as rows."""
    url = request.url(settings or Settings(), endpoint)

    def fetch() -> tuple[int, bytes]:
        status, _, body = get(url)
        return status, body.read()

    path = f"{new_path(spark, 'feed')}/feed.xml"
    write_bytes(spark, path, with_retries(fetch, **retries))
    return read_feed(spark, path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of landed Atom files; an entry without an id has `error` set."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    own = normalised_id("id")
    pdf = F.get(F.filter("link", lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    out = rows.select(own["source_id"].alias("source_id"), own["version"].alias("version"), spaced("title").alias("title"), spaced("summary").alias("abstract"), clean_authors(F.transform("author", lambda a: a["name"])).alias("authors"), clean_categories(F.transform("category", lambda c: c["_term"])).alias("categories"), F.to_timestamp("published").alias("published_at"), F.to_timestamp("updated").alias("updated_at"), pdf.alias("pdf_url"))
    return out.withColumn("source", F.lit("arxiv")).withColumn("paper_id", paper_id("source", "source_id", True)).withColumn("error", F.when(F.col("source_id").isNull(), "entry without id"))


def with_retries(fetch: Callable[[], tuple[int, bytes]], attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body of a 200; time-outs, transport errors and some statuses are tried again after pause * attempt seconds."""
    why: object = None
    for n in range(1, attempts + 1):
        try:
            status, body = fetch()
            if status == 200:
                return body
            why = status
            if status not in RETRIED_STATUS:
                break
        except (TimeoutError, ConnectionError) as error:
            why = error
        if n < attempts:
            sleep(pause * n)
    raise ConnectionError(f"no feed after {n} attempts: {why}")
