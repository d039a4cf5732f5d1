"""Section-aware chunking: token counts, units, greedy packing with overlap, tail merge, ids, diagnostics and checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Settings
from ..functions.ids import SPACE, chunk_id, strip
from ..functions.lineage import fingerprint_of

# Where paragraphs and sentences end, how many chunk sizes make an oversized chunk, and the rules' version.
PARAGRAPH, SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")
OVERSIZED = 1.2
VERSION = "v1"


def token_count(text: Column | str) -> Column:
    """Maximal runs of non-white-space."""
    text = strip(text)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SPACE)))


def paragraphs(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.transform(F.split(text, r"\n(?U)\s*\n"), strip), lambda p: p != "")


def sentences(paragraph: Column | str) -> Column:
    paragraph = F.col(paragraph) if isinstance(paragraph, str) else paragraph
    return F.filter(F.split(paragraph, r"(?<=[.!?])(?U)\s+"), lambda s: s != "")


def word_windows(text: Column | str, size: int) -> Column:
    """Windows of `size` words, joined by one blank."""
    words = F.filter(F.split(strip(text), SPACE), lambda w: w != "")
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size)), lambda i: F.array_join(F.slice(words, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def count_words(text: str) -> int:
    return len(text.split())


def stripped(parts: Iterable[str]) -> list[str]:
    return [p for p in map(str.strip, parts) if p]


def units(text: str, size: int, count: Callable[[str], int]) -> list[str]:
    """The pieces of a text that doesn't fit: whatever is too long at one level of breaks is broken at the next."""
    breaks = [PARAGRAPH.split, SENTENCE.split, lambda t: map(" ".join, batched(t.split(), size))]
    pieces = stripped(breaks[0](text))
    for cut in breaks[1:]:
        pieces = [p for whole in pieces for p in ([whole] if count(whole) <= size else stripped(cut(whole)))]
    return pieces


def spans(sizes: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Ranges of units that make chunks, of prefix sums alone: where a chunk ends and where its overlap begins are searches for all units at once, and the walk takes a jump a chunk."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    fits = np.searchsorted(upto, upto + size, side="right") - 1
    tails = np.minimum(np.searchsorted(upto, upto - overlap, side="left"), np.arange(len(upto)))
    out, start, end = [], 0, 0
    while end < len(sizes):
        # The unit that didn't fit opens the next chunk, behind the overlap, even where both exceed the size.
        end = max(end + 1, int(fits[start]))
        out.append((start, end))
        start = max(start, int(tails[end]))
    return out


def packed(text: str, settings: Settings, count: Callable[[str], int] = count_words) -> list[str]:
    """The chunks of a section: whole if it fits, else units packed with whole trailing units as overlap; a tiny last chunk joins its predecessor."""
    if count(text) <= settings.chunk_size:
        return stripped([text])
    pieces = units(text, settings.chunk_size, count)
    made = [" ".join(pieces[a:b]) for a, b in spans(np.array([count(p) for p in pieces], np.int64), settings.chunk_size, settings.chunk_overlap)]
    tiny = len(made) > 1 and count(made[-1]) < settings.chunk_min_tokens
    return [*made[:-2], "\n\n".join(made[-2:])] if tiny else made


def config_fingerprint(settings: Settings, counter: str = "whitespace-v1", counter_version: str | None = None) -> str:
    return fingerprint_of("chunk_config", chunking_version=VERSION, chunk_size_tokens=settings.chunk_size, chunk_overlap_tokens=settings.chunk_overlap, min_chunk_tokens=settings.chunk_min_tokens, tokenizer_name=counter, tokenizer_version=counter_version)


def chunks(sections: DataFrame, settings: Settings, count: Callable[[str], int] = count_words) -> DataFrame:
    """sections(section_id, paper_id, paper_version_id, section_type, title, page_start, page_end, text) as chunk rows.

    Packing depends on all before it, so each section is packed by one call in an Arrow scan; sections stay where
    they are. The index starts anew in each section; pages are the section's.
    """
    keep = [c for c in sections.columns if c != "text"]
    out = T.StructType([*[sections.schema[c] for c in keep], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])
    source = sections.select(*keep, "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, index, texts = [], [], []
            for row, text in enumerate(batch.column(len(keep)).to_pylist()):
                for k, chunk in enumerate(packed(text or "", settings, count)):
                    at.append(row)
                    index.append(k)
                    texts.append(chunk)
            taken = [batch.column(i).take(pa.array(at, pa.int32())) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(index, pa.int32()), pa.array(texts, pa.string())], names=[f.name for f in out])

    made = source.mapInArrow(pack, out)
    print_of = config_fingerprint(settings)
    return made.withColumn("token_count", token_count("text")).withColumn("chunk_config_fingerprint", F.lit(print_of)).withColumn("chunk_id", chunk_id("paper_version_id", "section_id", "chunk_index", F.lit(print_of)))


def diagnostics(chunks: DataFrame, by: list[str], settings: Settings) -> DataFrame:
    """Counts, extremes, mean, exact median, small and oversized chunks of each group."""
    n = F.col("token_count")
    return chunks.groupBy(*by).agg(F.count("*").alias("chunk_count"), F.min(n).alias("min_tokens"), F.max(n).alias("max_tokens"), F.avg(n).alias("average_tokens"), F.median(n).alias("median_tokens"), F.count_if(n < settings.chunk_min_tokens).alias("small_chunk_count"), F.count_if(n > OVERSIZED * settings.chunk_size).alias("oversized_chunk_count"))


def problems(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks that break an invariant, with the reason; none may remain."""
    repeated = chunks.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    known = sections.select("section_id", F.lit(True).alias("known")).distinct()
    met = chunks.join(repeated, "chunk_id").join(known, "section_id", "left")
    reason = F.when(F.col("copies") > 1, "duplicate_id").when(F.col("chunk_index") < 0, "negative_index").when(strip("text") == "", "blank_text").when(F.col("token_count") <= 0, "no_tokens").when(F.col("known").isNull(), "unknown_section")
    return met.withColumn("problem", reason).where("problem is not null").select("chunk_id", "problem")
