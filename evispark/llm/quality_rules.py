"""Quality rules with adaptive thresholds: one mergeable quantile sketch per language, source and metric.

The sketch is a log-linear histogram: an integer value falls in a bin by its bit length and its next BITS bits, so
a quantile is within 1/2**BITS of the value, sketches merge by adding counts, and every figure is exact integer
arithmetic that any run repeats. Every (language, source) group has fences of its own: its sketch counts whole, and the
language's merged sketch is added with the weight of `prior` documents, which in turn holds the corpus's with that
weight. A small group leans on its language, a large one hardly, and no count of documents switches anything.

A document passes if it isn't failed by the fixed base rules and each metric lies within its group's fences,
tail + `reach` * max(tail - q50, slack), and for the mean word length also above the same on the other side; METRICS
names each metric's tail quantile and slack.

Plan: scans of the texts without a shuffle, of which narrow rows alone are written; partial aggregation sums bins
before the shuffle, so a hot group moves bins, not rows; thresholds are broadcast while their count is within
`broadcast_groups`, else joined.

Defined cases: null, empty and blank texts have no words and fail the base rules; null languages and sources are
groups of their own; repeated rows count each time; texts of any length are measured whole; a value on a fence is inside;
an empty table gives an empty result; other columns, whatever their names, are unread or passed through.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ADDED, apart, each_text, field, materialize, restored, scan_texts

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
REACH, PRIOR, BITS, BROADCAST_GROUPS = 3, 100, 7, 50_000
#: Sketches are merged in these parts of a document.
PARTS = 1000
#: metric: (percent of its upper tail quantile, of its lower one or None, slack)
METRICS = {"word_len_x100": (90, 10, 8), "symbols_x10k": (90, None, 100), "dup_lines_x10k": (98, None, 100), "repeats_x10k": (98, None, 100)}
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
NOT_POINTS = SPACE + bytes(range(0x80, 0xC0))

FIELDS = [field(n, "long") for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    twice = np.fromiter((counts[w] > 1 for w in windows), bool, len(windows))
    cover = np.zeros(len(words), bool)
    for k in range(3):
        cover[k : k + len(twice)] |= twice
    return int(cover.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, lines with a word, repeats among them, words in repeated windows."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else [text] if words else []
    return len(words), len(text.translate(None, NOT_POINTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def _kernel(col: pa.Array) -> list[pa.Array]:
    rows = np.array([measure(t) for t in each_text(col)], np.int64).reshape(-1, len(FIELDS))
    return [pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(FIELDS))]


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns, the counts, and base_failed, under the ADDED prefix."""
    out = scan_texts(docs, text_col, keep, FIELDS, lambda: _kernel)
    c = {f.name: F.col(ADDED + f.name) for f in FIELDS}
    return out.withColumn(ADDED + "base_failed", (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]))


def metric_columns() -> dict:
    share = lambda top, base, scale: F.expr(f"{scale} * {ADDED}{top} div greatest({ADDED}{base}, 1L)")
    return {"word_len_x100": share("word_chars", "n_words", 100), "symbols_x10k": share("n_symbols", "word_chars", 10_000), "dup_lines_x10k": share("n_dup_lines", "n_lines", 10_000), "repeats_x10k": share("n_repeat_words", "n_words", 10_000)}


def bin_of(value: str) -> str:
    """SQL: the bin of a non-negative integer; equal to the value below 2**BITS."""
    e = f"(length(bin({value})) - {BITS + 1})"
    return f"CASE WHEN {value} < {2 << BITS} THEN {value} ELSE ({e} << {BITS}) + shiftright({value}, cast({e} AS int)) END"


def bin_value(b: str) -> str:
    """SQL: the smallest value of a bin."""
    e = f"(({b} >> {BITS}) - 1)"
    return f"CASE WHEN {b} < {2 << BITS} THEN {b} ELSE shiftleft({b} - ({e} << {BITS}), cast({e} AS int)) END"


def sketches(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Counts by language, source, metric and bin over the documents that pass the base rules."""
    metrics = metric_columns()
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in metrics.items()])).alias("m")
    return rows.where(~F.col(ADDED + "base_failed")).select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), each).selectExpr("g_lang", "g_source", "m.metric", f"{bin_of('m.value')} AS bin").groupBy("g_lang", "g_source", "metric", "bin").agg(F.count("*").alias("n"))


def blended(own: DataFrame, keys: list[str], parent: DataFrame, parent_keys: list[str], prior: int) -> DataFrame:
    """Sketches in parts of a document, each with its parent's added at the weight of `prior` documents."""
    total = F.sum("n").over(Window.partitionBy(*parent_keys, "metric"))
    weight = F.expr(f"cast(cast({prior * PARTS} AS decimal(18,0)) * n div total AS bigint)")
    lent = parent.withColumn("total", total).select(*[F.col(k).alias(f"p_{k}") for k in parent_keys], F.col("metric").alias("p_metric"), "bin", weight.alias("n")).where("n > 0")
    same = F.col("metric") == F.col("p_metric")
    for k in parent_keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    return own.unionByName(own.select(*keys, "metric").distinct().join(lent, same).select(*keys, "metric", "bin", "n")).groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))


def group_sketches(bins: DataFrame, prior: int) -> DataFrame:
    """(g_lang, g_source, metric, bin, n): what a group's quantiles are taken of."""
    by = lambda *keys: bins.groupBy(*keys, "metric", "bin").agg((F.sum("n") * PARTS).alias("n"))
    languages = blended(by("g_lang"), ["g_lang"], by(), [], prior)
    return blended(by("g_lang", "g_source"), ["g_lang", "g_source"], languages, ["g_lang"], prior)


def quantiles(bins: DataFrame, keys: list[str], percents: list[int]) -> DataFrame:
    """Quantiles of sketches: bins are bounded in number, so a group's prefix sums stay small."""
    by = Window.partitionBy(*keys, "metric")
    run = bins.select(*keys, "metric", "bin", F.sum("n").over(by.orderBy("bin")).alias("upto"), F.sum("n").over(by).alias("total"))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("bin")))
    out = run.groupBy(*keys, "metric").agg(*[at(p).alias(f"b_{p}") for p in percents])
    return out.selectExpr(*keys, "metric", *[f"{bin_value(f'b_{p}')} AS q_{p}" for p in percents])


def thresholds(bins: DataFrame, prior: int = PRIOR, reach: int = REACH) -> DataFrame:
    """One row for each (language, source): each metric's fences, and by_spread_, whether the group's spread sets the upper one."""
    percents = sorted({50} | {p for high, low, _ in METRICS.values() for p in (high, low) if p is not None})
    found = quantiles(group_sketches(bins, prior), ["g_lang", "g_source"], percents)
    fences = []
    for m, (high, low, slack) in METRICS.items():
        own = lambda c, m=m: F.max(F.when(F.col("metric") == m, c))
        spread = F.col(f"q_{high}") - F.col("q_50")
        fences += [own((F.col(f"q_{high}") + reach * F.greatest(spread, F.lit(slack))).cast("long")).alias(f"high_{m}"), own(spread > slack).alias(f"by_spread_{m}")]
        if low is not None:
            fences.append(own((F.col(f"q_{low}") - reach * F.greatest(F.col("q_50") - F.col(f"q_{low}"), F.lit(slack))).cast("long")).alias(f"low_{m}"))
    return found.groupBy("g_lang", "g_source").agg(*fences)


def limits_of(rows: DataFrame, lang: str, source: str, prior: int, reach: int) -> DataFrame:
    """The fences of each group of measured rows."""
    return materialize(thresholds(sketches(rows, lang, source), prior, reach), "quality-limits")


def verdicts(rows: DataFrame, limits: DataFrame, keep: list[str], lang: str, source: str, broadcast_groups: int) -> DataFrame:
    """Measured rows met with their group's fences: the `keep` columns, counts, base_failed and kept."""
    few = limits.limit(broadcast_groups + 1).count() <= broadcast_groups
    met = rows.join(F.broadcast(limits) if few else limits, F.col(lang).eqNullSafe(F.col("g_lang")) & F.col(source).eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for m, c in metric_columns().items():
        inside = inside & (c <= F.col(f"high_{m}"))
        if METRICS[m][1] is not None:
            inside = inside & (c >= F.col(f"low_{m}"))
    added = [f"{ADDED}{f.name}" for f in FIELDS] + [ADDED + "base_failed"]
    return met.select(*keep, *added, (~F.col(ADDED + "base_failed") & F.coalesce(inside, F.lit(False))).alias(ADDED + "kept"))


def judged(docs: DataFrame, keep: list[str], *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR, reach: int = REACH, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The `keep` columns, which should be narrow, then counts, base_failed and kept under the ADDED prefix: one scan, whose rows are written."""
    own, names = apart(docs)
    narrow = [names[c] for c in dict.fromkeys([*keep, lang_col, source_col])]
    rows = materialize(measured(own, narrow, names[text_col]), "quality-rules")
    limits = limits_of(rows, names[lang_col], names[source_col], prior, reach)
    out = verdicts(rows, limits, [names[c] for c in keep], names[lang_col], names[source_col], broadcast_groups)
    return restored(out, {c: names[c] for c in keep}, *[c for c in out.columns if c.startswith(ADDED)])


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR, reach: int = REACH, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The documents that pass, with their own columns: a second scan measures again, so that no text is written in between."""
    own, names = apart(docs)
    lang, source, text = names[lang_col], names[source_col], names[text_col]
    limits = limits_of(materialize(measured(own, [lang, source], text), "quality-rules"), lang, source, prior, reach)
    out = verdicts(measured(own, own.columns, text), limits, own.columns, lang, source, broadcast_groups)
    return restored(out.where(F.col(ADDED + "kept")), names)
