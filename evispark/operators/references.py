"""Reference lists: entries, cited ids, and resolution to papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import spaced

# Entry markers and cited ids.
MARKER = r"(?m)^\s*(?:\[\d{1,4}\]|\(\d{1,4}\)|\d{1,4}\.)\s+"
CITED = r"(?i)(?:arxiv\s*:\s*)?(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"
RAW_MOST = 300


def entries(text: Column | str) -> Column:
    """Entries by numbered markers where there are two or more (what stands before the first is dropped), else by blank lines."""
    text = F.col(text) if isinstance(text, str) else text
    numbered = F.split(text, MARKER)
    marked = F.regexp_count(text, F.lit(MARKER)) >= 2
    blocks = F.when(marked, F.slice(numbered, 2, F.greatest(F.size(numbered) - 1, F.lit(0)))).otherwise(F.split(text, r"\n\s*\n"))
    return F.filter(F.transform(blocks, spaced), lambda e: e != "")


def cited_id(entry: Column | str) -> Column:
    """The first cited id without its version, or null."""
    entry = F.col(entry) if isinstance(entry, str) else entry
    found = F.regexp_replace(F.regexp_extract(entry, CITED, 1), r"(?i)v\d+$", "")
    return F.nullif(found, F.lit(""))


def resolved(references: DataFrame, source: str = "arxiv") -> DataFrame:
    """references(paper_version_id, text) as one row an entry: the target paper, or the raw text cut at RAW_MOST; duplicates stay."""
    each = references.select("paper_version_id", F.posexplode(entries("text")).alias("position", "entry"))
    target = cited_id("entry")
    return each.select("paper_version_id", "position", F.concat(F.lit(f"paper:{source}:"), target).alias("target_paper_id"), F.when(target.isNull(), F.substring("entry", 1, RAW_MOST)).alias("unresolved_text"))
