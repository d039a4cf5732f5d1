"""Page cleanup, header and footer removal, section recovery and parse warnings, set-at-a-time over all documents."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.ids import SPACE, strip

ASCII = r"^[\x00-\x7F]*$"

# Heading text -> section type.
SECTION_KEYWORDS = {
    "abstract": "abstract",
    "introduction": "introduction",
    "related work": "related_work",
    "related works": "related_work",
    "method": "methodology",
    "methods": "methodology",
    "methodology": "methodology",
    "approach": "methodology",
    "experiments": "experiments",
    "experiment": "experiments",
    "experimental setup": "experiments",
    "experiment setup": "experiments",
    "evaluation": "experiments",
    "results": "results",
    "discussion": "discussion",
    "limitations": "limitations",
    "limitation": "limitations",
    "conclusion": "conclusion",
    "conclusions": "conclusion",
    "references": "references",
    "bibliography": "references",
}
# Headings that are real, but of no type of their own.
OTHER_KEYWORDS = ["background", "implementation", "implementation details", "ablation study", "ablation studies", "ethics statement", "ethical considerations", "broader impact", "appendix", "acknowledgments", "acknowledgements"]
# Numbered and roman-numbered headings.
NUMBERED = r"^\d{1,2}\.?\s+([A-Z][A-Za-z][A-Za-z\s\-:]{2,60})$"
ROMAN = r"^[IVXLCDM]{1,6}\.\s+([A-Z][A-Za-z][A-Za-z\s\-:]{2,60})$"
BARE_MOST = 50
HEADER_PAGES, HEADER_SHARE, SPARSE_CHARS = 3, 0.6, 200


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def is_blank(line: Column) -> Column:
    return strip(line) == ""


def clean_pages(pages: DataFrame, unicode: bool = True) -> DataFrame:
    """Pages whose texts have gone through NFKC and clean_text(), in that order.

    unicode=False leaves NFKC out, for text that is ASCII or composed already: all is JVM-side then.
    """
    pages = pages.withColumn("text", _nfkc("text")) if unicode else pages
    return pages.withColumn("text", clean_text("text"))


def clean_text(text: Column | str) -> Column:
    """LF line ends, hyphens over line ends repaired, one blank line at most, single blanks within lines."""
    text = F.col(text) if isinstance(text, str) else text
    text = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "([a-z])-\n([a-z])", "$1$2")
    lines = lines_of(text)
    kept = F.filter(lines, lambda l, i: ~is_blank(l) | (i == 0) | ~is_blank(F.get(lines, i - 1)))
    return F.array_join(F.transform(kept, lambda l: strip(F.regexp_replace(l, "[ \t]+", " "))), "\n")


def line_key(line: Column | str) -> Column:
    """What makes lines of different pages equal: lower case, digits as one mark."""
    line = F.col(line) if isinstance(line, str) else line
    return F.regexp_replace(F.lower(strip(line)), r"\p{Nd}+", "#")


def header_footer_lines(pages: DataFrame) -> DataFrame:
    """(paper_version_id, place, key): first (header) and last (footer) lines that recur on enough pages."""
    full = F.filter(lines_of(F.col("text")), lambda l: ~is_blank(l))
    mark = lambda place, key: F.struct(F.lit(place).alias("place"), key.alias("key"))
    marks = F.array(mark("page", F.lit("page")), mark("header", line_key(F.get("full", F.lit(0)))), mark("footer", line_key(F.try_element_at("full", F.lit(-1)))))
    each = pages.select("paper_version_id", full.alias("full")).select("paper_version_id", F.explode(marks).alias("m")).select("paper_version_id", "m.place", "m.key")
    seen = each.where("key <> ''").groupBy("paper_version_id", "place", "key").agg(F.count("*").alias("n"))
    count = F.max(F.when(F.col("place") == "page", F.col("n"))).over(Window.partitionBy("paper_version_id"))
    least = F.greatest(F.lit(HEADER_PAGES), F.bround(F.col("pages") * HEADER_SHARE))
    return seen.withColumn("pages", count).where((F.col("place") != "page") & (F.col("pages") >= HEADER_PAGES) & (F.col("n") >= least)).select("paper_version_id", "place", "key", "n")


def without_headers_footers(pages: DataFrame) -> DataFrame:
    """Pages with a repeated first or last line emptied, not dropped; the header is looked at first.

    More than half of a document's pages share the line, so a document has one header and one footer at most.
    """
    found = header_footer_lines(pages).groupBy("paper_version_id").agg(F.max(F.when(F.col("place") == "header", F.col("key"))).alias("header"), F.max(F.when(F.col("place") == "footer", F.col("key"))).alias("footer"))
    met = pages.join(found, "paper_version_id", "left").withColumn("lines", lines_of(F.col("text")))
    at = F.filter(F.transform("lines", lambda l, i: F.when(~is_blank(l), i)), lambda i: i.isNotNull())
    met = met.withColumn("first", F.array_min(at)).withColumn("last", F.array_max(at))
    same = lambda l, c: F.coalesce(line_key(l) == F.col(c), F.lit(False))
    clear = lambda l, i: F.when((i == F.col("first")) & same(l, "header"), "").when((i == F.col("last")) & same(l, "footer"), "").otherwise(l)
    return met.withColumn("text", F.array_join(F.transform("lines", clear), "\n")).drop("lines", "first", "last", "header", "footer")


def heading(line: Column | str) -> Column:
    """STRUCT(title, section_type) of a heading line, or null."""
    line = strip(line)
    known = F.create_map(*[F.lit(x) for k, v in (SECTION_KEYWORDS | dict.fromkeys(OTHER_KEYWORDS, "other")).items() for x in (k, v)])
    kind = lambda title: F.try_element_at(known, F.lower(strip(F.regexp_replace(title, SPACE, " "))))
    made = lambda title, k: F.struct(title.alias("title"), k.alias("section_type"))
    numbered, roman = strip(F.regexp_extract(line, NUMBERED, 1)), strip(F.regexp_extract(line, ROMAN, 1))
    out = F.when(line.rlike(NUMBERED), made(numbered, F.coalesce(kind(numbered), F.lit("other"))))
    out = out.when(line.rlike(ROMAN), made(roman, F.coalesce(kind(roman), F.lit("other"))))
    return out.when((F.length(line) <= BARE_MOST) & kind(line).isNotNull(), made(line, kind(line)))


def sections(pages: DataFrame) -> DataFrame:
    """(paper_version_id, order, section_type, title, page_start, page_end, text): the text between headings.

    What stands before the first heading is dropped; sections without text take no number; a document without
    headings is one `other` section. Lines meet per document and section only.
    """
    lines = pages.select("paper_version_id", "page_number", F.posexplode(lines_of(F.col("text"))).alias("line_number", "line"))
    lines = lines.withColumn("head", heading("line"))
    place = Window.partitionBy("paper_version_id").orderBy("page_number", "line_number")
    lines = lines.withColumn("part", F.sum(F.col("head").isNotNull().cast("int")).over(place))
    body = F.array_sort(F.collect_list(F.when(F.col("head").isNull(), F.struct("page_number", "line_number", "line"))))
    parts = lines.groupBy("paper_version_id", "part").agg(F.max("head").alias("head"), F.min("page_number").alias("first_page"), F.max("page_number").alias("page_end"), strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text"))
    headed = F.max("part").over(Window.partitionBy("paper_version_id")) > 0
    parts = parts.withColumn("headed", headed).where("(part > 0 or not headed) and text <> ''")
    order = F.row_number().over(Window.partitionBy("paper_version_id").orderBy("part")) - 1
    return parts.select("paper_version_id", order.alias("order"), F.coalesce("head.section_type", F.lit("other")).alias("section_type"), F.col("head.title").alias("title"), F.col("first_page").alias("page_start"), "page_end", "text")


def warnings(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(paper_version_id, warnings): sorted parse warnings of each document."""
    any_heading = F.exists(lines_of(F.col("text")), lambda l: heading(l).isNotNull())
    own = pages.groupBy("paper_version_id").agg(F.bool_or(is_blank(F.col("text"))).alias("blank"), F.avg(F.length("text")).alias("chars"), F.bool_or(any_heading).alias("any_heading"))
    kinds = found.groupBy("paper_version_id").agg(F.bool_or(F.col("title").isNotNull()).alias("headed"), F.bool_or(F.col("section_type") == "abstract").alias("abstract"), F.bool_or(F.col("section_type") == "references").alias("references"))
    met = own.join(kinds, "paper_version_id", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    flags = F.array(
        F.when(F.col("blank"), "empty_page_detected"),
        F.when(F.col("chars") < SPARSE_CHARS, "low_text_density"),
        F.when(no("any_heading"), "no_section_headings_detected"),
        F.when(F.col("any_heading") & no("abstract"), "no_abstract_detected"),
        F.when(F.col("any_heading") & no("references"), "no_references_detected"),
    )
    return met.select("paper_version_id", F.array_sort(F.filter(flags, lambda w: w.isNotNull())).alias("warnings"))


def two_columns(blocks: DataFrame) -> DataFrame:
    """blocks(page, x0, x1, page_width): pages with two wide blocks or more left of 45 % and right of 55 % of the width."""
    center, wide = (F.col("x0") + F.col("x1")) / 2, F.col("x1") - F.col("x0") >= 20
    return blocks.groupBy("page").agg(((F.count_if(wide & (center < 0.45 * F.col("page_width"))) >= 2) & (F.count_if(wide & (center > 0.55 * F.col("page_width"))) >= 2)).alias("two_columns"))
