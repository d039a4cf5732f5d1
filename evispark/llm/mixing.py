"""Mixing sources to target weights: hash-random order, distributed prefix sums of sizes, a cut at each exact budget.

Sources in code point order, null last, take WEIGHTS in turn and share `share` times the corpus's words. A source
takes at most `most` times its own words; what is above is shared anew by weight among the rest until none is
above. Within a source every document has a hash-random key; whole passes over the source (epochs) come first,
then documents in key order up to the budget, the last one in part, so a source's words equal its rounded target.

Plan: the key's range is dealt into as many buckets as the root of the source's rows, so the prefix sums have two levels
that grow alike: a source's bucket sums (partially aggregated), then the rows of the one bucket in which its budget ends. What comes
out is one cut for each source, with which every document is compared; a source with a third of all rows stays
spread over all tasks, and no text is shuffled. The shares need each source's rank and total only: sources are
ranked by range-partitioned prefix counts, and the level at which they fill is found by a few aggregates.

Defined cases: null and empty texts have size 0 and take 0; an empty table gives an empty result; repeated rows
are separate documents, and equal rows at a cut share what is left evenly; ties of the key go by id and size; texts of
any length are counted whole; other columns, whatever their names, are unread or passed through (a document's own
mix_epoch stays, and the copy's number is mix_epoch_2).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ADDED, apart, each_text, field, materialize, restored, scan_texts

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 20_241
#: One window may rank this many sources in one task; beyond it, ranks come from ranges.
WINDOW_SOURCES = 10_000


def _sizes(col: pa.Array) -> list[pa.Array]:
    return [pa.array([len(t.split()) for t in each_text(col)], pa.int64())]


def sized(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    return scan_texts(docs, text_col, keep, [field("size", "long")], lambda: _sizes)


def ranked(sources: DataFrame, window_sources: int) -> DataFrame:
    """sources(source, source_size) with `rank` from 0 in code point order, null last."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    if sources.limit(window_sources + 1).count() <= window_sources:
        return sources.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
    ranges = materialize(sources.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # one row for each partition
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return ranges.withColumn("inner", inner).join(F.broadcast(before), "range").withColumn("rank", F.col("before") + F.col("inner")).drop("range", "before", "inner")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, window_sources: int = WINDOW_SOURCES) -> DataFrame:
    """sources(source, source_size) with each one's target (double)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialize(ranked(sources, window_sources).withColumn("weight", weight).drop("rank"), "mix-sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while total:  # the level rises until no further source is full
        is_full = F.col("weight") * F.lit(level) >= most * F.col("source_size")
        at = rows.agg(F.sum(F.when(is_full, most * F.col("source_size")).otherwise(0)).alias("taken"), F.sum(F.when(is_full, 0).otherwise(F.col("weight"))).alias("open"), F.count_if(is_full).alias("full")).first()
        if at.full == full or not at.open:
            break
        level, full = (share * total - at.taken) / at.open, at.full
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")))


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int, keep: list[str]) -> DataFrame:
    """The `keep` columns under the ADDED prefix, then id, source, size and the hash-random key (60 bits)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(ADDED + c) for c in keep])
    rows = sized(rows, [c for c in rows.columns if c != "text"]).withColumnRenamed(ADDED + "size", "size")
    named = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    return rows.withColumn("key", F.conv(F.substring(named, 1, 15), 16, 10).cast("long"))


def cuts(rows: DataFrame, shares: DataFrame, few: bool) -> DataFrame:
    """For each source: target, epochs, the place in key order where its budget ends, and what a row there takes."""
    shares = shares.withColumn("epochs", F.expr("CASE WHEN source_size > 0 THEN cast(round(target) AS bigint) div source_size ELSE 0L END"))
    shares = shares.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size"))
    side = shares.select(F.col("source").alias("s"), "rest", F.ceil(F.sqrt("n")).alias("buckets"))
    dealt = rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("s")))
    dealt = dealt.withColumn("bucket", F.floor(F.col("key").cast("double") / F.lit(2.0**60) * F.col("buckets")))
    sums = dealt.groupBy("s", "rest", "bucket").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("upto", F.sum("sum").over(Window.partitionBy("s", "rest").orderBy("bucket")))
    first = sums.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("sum")).alias("before")), "bucket").alias("cut"))
    first = first.select(F.col("s").alias("c"), F.col("cut.bucket").alias("cut_bucket"), "cut.before")
    last = dealt.join(F.broadcast(first) if few else first, F.col("s").eqNullSafe(F.col("c")) & (F.col("bucket") == F.col("cut_bucket")))
    last = last.groupBy("s", "rest", "before", "key", "id", "size").agg(F.count("*").alias("m"))
    last = last.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("m")).over(Window.partitionBy("s").orderBy("key", "id", "size")))
    at = F.struct("key", "id", "size")
    ends = last.where(F.col("upto") > F.col("rest")).groupBy("s").agg(F.min_by(F.struct(at.alias("at"), F.expr("(rest - upto + size * m) div m").alias("part")), at).alias("end"))
    return shares.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "epochs", "end.at", "end.part")


def taken(rows: DataFrame, ends: DataFrame, few: bool) -> DataFrame:
    """rows with source_size, target and taken."""
    met = rows.join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("s")))
    here = F.struct("key", "id", "size")
    part = F.when(F.col("at").isNull(), F.lit(0)).when(here < F.col("at"), F.col("size")).when(here == F.col("at"), F.col("part")).otherwise(F.lit(0))
    return met.withColumn("taken", F.col("epochs") * F.col("size") + part)


def _plan(docs, id_col, text_col, source_col, weights, share, most, seed):
    rows = materialize(keyed(docs, id_col, source_col, text_col, seed, []), "mix-sizes")
    sources = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-totals")
    few = sources.limit(WINDOW_SOURCES + 1).count() <= WINDOW_SOURCES
    shares = targets(sources, weights, share, most)
    return rows, materialize(cuts(rows, shares, few), "mix-cuts"), few


def planned(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """For every document: id, source, size, source_size, target and taken."""
    rows, ends, few = _plan(docs, id_col, text_col, source_col, weights, share, most, seed)
    return taken(rows, ends, few).select("id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed corpus: a row for each copy taken, with the documents' columns and mix_epoch; a copy that the budget cuts keeps its first words.

    The texts are scanned twice and never shuffled: the second scan compares each key with its source's cut.
    """
    own, names = apart(docs)
    columns = names[id_col], names[text_col], names[source_col]
    _, ends, few = _plan(own, *columns, weights, share, most, seed)
    rows = taken(keyed(own, columns[0], columns[2], columns[1], seed, own.columns), ends, few)
    epoch = next(n for n in ("mix_epoch", *(f"mix_epoch_{k}" for k in range(2, len(names) + 3))) if n not in names)
    size, words = F.col("size"), F.col("taken")
    rows = rows.where(words > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((words - 1) / size).cast("int"))))
    here = F.least(size, words - F.col("epoch") * size)
    text = F.col(ADDED + names[text_col])
    cut = F.when(here == size, text).otherwise(first_words(text, here))
    return restored(rows.withColumn(ADDED + names[text_col], cut), {c: ADDED + n for c, n in names.items()}, F.col("epoch").alias(epoch))


def first_words(text, n):
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), n.cast("int")), "")
