"""Versioned JSON artifacts, landed PDFs and page extraction."""

from __future__ import annotations

import hashlib
import importlib.util
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.control import TRUSTED_HOSTS
from ..storage import new_path, renamed, write_bytes
from .feed import RETRIED_STATUS, http_get

# What a PDF begins with, the most bytes of one, and the bytes that are read at once.
PDF_MAGIC, PDF_BYTES, BLOCK = b"%PDF-", 50 << 20, 64 << 10
SEGMENT = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._-]*[A-Za-z0-9])?")


class DownloadError(ConnectionError):
    """A file that can't be had from its source."""


def download(spark: SparkSession, url: str, *, get: Callable = http_get, most_bytes: int = PDF_BYTES, attempts: int = 3, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep, hosts: list[str] = TRUSTED_HOSTS) -> tuple[str, int, str]:
    """(path, bytes, SHA-256) of a PDF, landed beside its place: from trusted hosts alone, within a size, no redirect followed; passing errors are tried again."""
    parts = re.match(r"(https?)://([^/:?#]+)", url, re.IGNORECASE)
    if not parts or parts[2].lower() not in hosts:
        raise ValueError(f"{url} is not of a trusted host")
    why: object = None
    for n in range(1, attempts + 1):
        try:
            status, _, body = get(url)
            if status == 404:
                raise FileNotFoundError(url)
            if status not in RETRIED_STATUS:
                if status >= 300:
                    raise DownloadError(f"status {status} of {url}")
                return _landed(spark, body, most_bytes)
            why = status
        except (TimeoutError, ConnectionError) as error:
            if isinstance(error, DownloadError):
                raise
            why = error
        if n < attempts:
            sleep(pause * n)
    raise DownloadError(f"no file after {attempts} attempts: {why}")


def _landed(spark: SparkSession, body, most_bytes: int) -> tuple[str, int, str]:
    data = b""
    while block := body.read(BLOCK):
        data += block
        if len(data) > most_bytes:
            raise ValueError(f"the file is larger than {most_bytes} bytes")
    if not data.startswith(PDF_MAGIC):
        raise ValueError("the file is no PDF")
    path = f"{new_path(spark, 'download')}/paper.pdf.part"
    write_bytes(spark, path, data)
    return path, len(data), hashlib.sha256(data).hexdigest()


def finalised(spark: SparkSession, landed: str, root: str, source: str, source_id: str, version: str) -> str:
    """Move a landed PDF to its place, root/source/source_id/version/paper.pdf, in one step; readers never see a part of it."""
    names = [source, source_id.replace("/", "_"), version]
    if not all(SEGMENT.fullmatch(n) for n in names):
        raise ValueError("a path's parts are letters and digits, with ._- inside")
    target = "/".join([root.rstrip("/"), *names, "paper.pdf"])
    renamed(spark, landed, target)
    return target


def read_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a fixed schema; what doesn't fit it counts as missing, never as an error, and nothing is inferred."""
    schema = StructType([*StructType.fromDDL(ddl), StructField("_corrupt", StringType())])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def write_json(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder a version; the writer's commit protocol shows a version whole or not at all, and other versions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).json(path)


def landed_pdfs(spark: SparkSession, path: str, most_bytes: int = PDF_BYTES) -> DataFrame:
    """PDF files with checksum and a verdict: too_large, not_pdf, or ok. Files of no bytes give no row: the scan leaves them out."""
    files = spark.read.format("binaryFile").load(path)
    verdict = F.when(F.col("length") > most_bytes, "too_large").when(F.substring("content", 1, 5) != F.lit(PDF_MAGIC), "not_pdf").otherwise("ok")
    return files.select("path", "length", F.sha2("content", 256).alias("checksum"), verdict.alias("verdict"), "content")


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page in the file's own order, by the PDF library that is installed."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as document:
        if document.is_encrypted:
            raise ValueError("the file is encrypted")
        return [page.get_text("text") for page in document]


def pages_of(files: DataFrame, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """files(path, content) as (path, page_number, text) by an extractor, pdf_pages() if none is given; an error becomes a row with its message."""
    if extract is None:
        if importlib.util.find_spec("pymupdf") is None:
            raise RuntimeError("there is no PDF library here: install pymupdf, or give an extractor")
        extract = pdf_pages
    schema = "path string, page_number int, text string, error string"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    texts = extract(content)
                    if not any(t.strip() for t in texts):
                        raise ValueError("no text on any page")
                    rows += [(path, n, t, None) for n, t in enumerate(texts, 1)]
                except Exception as why:  # noqa: BLE001  one bad file must not end the job
                    rows.append((path, None, None, str(why)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_number", "text", "error"])

    return files.select("path", "content").mapInArrow(scan, schema)
