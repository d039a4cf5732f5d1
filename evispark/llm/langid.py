"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features: the 1-, 2- and 3-grams of the lower-cased text, in which every ASCII character that is no letter counts as
a space, hashed into 2**BITS places. A feature's weight is its share of the text's n-grams, times ln((1 + D) / (1 +
df)) + 1 over all D training texts, times SCALE. Training is follow-the-regularised-leader (per-coordinate rates,
elastic net) over the training rows of a bounded sample, `epochs` times; what the sample has of the calibration fold fits
one temperature by log loss instead. The languages are those of all training rows, and each gives the sample its rows of
least hashed ids, half of `sample_rows` shared out evenly and half by rows, so that a rare language is learnt beside a
hot one; each has one row at least, so the sample's bound is `sample_rows` and one row a language. All languages are
learnt (`max_languages`, if given, keeps the most frequent). Weights are held for the features of the sample alone.

Because weights are linear in the counts, a text's logits are sums over its positions of a table's rows, so
prediction never builds sparse vectors; they are gathered CELLS numbers at a time, whatever the languages. Long texts
are read in pieces of CHUNK code points, each with the two that follow it, so that every n-gram counts once. Document
frequencies cover all training texts.

Plan: one scan counts document frequencies (2**BITS numbers a task), one takes the sample's sparse rows to the
driver (bounded), one predicts; no text is shuffled. Each language's share of the sample is cut in every task before its
shuffle. The table, the sample's features by languages, is broadcast; training holds four numbers for each of its
places in the driver, so languages cost 2**BITS * 20 bytes each at most.

Defined cases: null texts and texts without a letter are `und` with score 0; no training rows: all texts are `und`;
a null id is in no fold that trains; texts of any length are read whole;
equal scores go to the first language in code point order; a language of the calibration fold alone is trained on that;
repeated rows get a row each; empty tables give empty results; other columns, whatever their names, are unread.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, each_text, field, part_of, scan_texts

BITS, ORDERS, SCALE, SAMPLE_ROWS, EPOCHS = 16, (1, 2, 3), 30.0, 4000, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
#: What lets a row into the shuffle of the sample: its hash is below SPARE quotas' share and that of SPARE_ROWS rows.
SPARE, SPARE_ROWS = 4, 64
UNKNOWN, CHUNK, CELLS = "und", 1 << 20, 1 << 22
SIZE = 1 << BITS
LETTER = re.compile(r"[^\W\d_]")
#: ASCII code points: letters stay, all else is a space.
_PLAIN = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the features by position over the texts' joined code points; each text's start and size."""
    return lower_grams([t.lower() for t in texts])


def lower_grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """grams() of texts in lower case."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate(([0], np.cumsum(size + 2)))[:-1]
    c = np.frombuffer("  ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
    c = np.where(c < 128, _PLAIN[np.minimum(c, 127)], c)
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1)) if len(c) >= n else np.zeros(0, np.uint32)
        if n in ORDERS:
            out.append(((h + np.uint32(n * 0x1FEB352D)) * np.uint32(0x846CA68B)) >> np.uint32(32 - BITS))
    return out, start, size


@dataclass
class Piece:
    """Some code points of a text in lower case: n-grams start at the first `own` of them, the others end such n-grams."""

    at: int
    text: str
    own: int


def pieces(at: int, text: str) -> Iterator[Piece]:
    """Of the text with number `at`; one of an empty text."""
    low = text.lower()
    for a in range(0, max(1, len(low)), CHUNK):
        yield Piece(at, low[a : a + CHUNK + max(ORDERS) - 1], min(CHUNK, len(low) - a))


def chunks(texts: Iterator[str]) -> Iterator[list[Piece]]:
    held, n = [], 0
    for at, text in enumerate(texts):
        for piece in pieces(at, text):
            held.append(piece)
            n += len(piece.text)
            if n >= CHUNK:
                yield held
                held, n = [], 0
    if held:
        yield held


def placed(held: list[Piece]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order the features by position, and where each piece's own begin and end."""
    by_order, start, size = lower_grams([p.text for p in held])
    own = np.array([p.own for p in held], np.int64)
    for order, f in zip(ORDERS, by_order):
        yield f, start, start + np.maximum(0, np.minimum(own, size - order + 1))


def sparse(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, counts, all n-grams) of a text."""
    n = np.zeros(SIZE, np.int64)
    for piece in pieces(0, text):
        for f, start, end in placed([piece]):
            n += np.bincount(f[start[0] : end[0]], minlength=SIZE)
    f = np.flatnonzero(n)
    return f.astype(np.int32), n[f].astype(np.int32), int(n.sum())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of every feature over texts(text), and the number of texts."""
    bounded_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(SIZE, np.int64), 0
        for batch in batches:
            last, there = None, np.zeros(SIZE, bool)
            for held in chunks(t.decode() for t in each_text(batch.column(0))):
                orders = list(placed(held))
                for k, piece in enumerate(held):
                    if piece.at != last:
                        df += there
                        there[:] = False
                        last = piece.at
                        total += 1
                    for f, start, end in orders:
                        there[f[start[k] : end[k]]] = True
            df += there
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], total))], names=["f", "n"])

    rows = texts.mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    f, n = rows["f"].to_numpy(), rows["n"].to_numpy()
    df = np.zeros(SIZE, np.int64)
    df[f[f >= 0]] = n[f >= 0]
    return df, int(n[f < 0].sum())


@dataclass
class Model:
    languages: list[str]
    place: np.ndarray  # each feature's row of the table; the last, of zeros, for those that the sample lacks
    table: np.ndarray  # (rows, languages): weight * idf * SCALE
    bias: np.ndarray
    temperature: float


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, classes: int, epochs: int) -> Callable[[np.ndarray], np.ndarray]:
    """FTRL-proximal over (features below `size`, values, class), as a function from features to their weights.

    The last feature is the bias, which stands in every row. A row of many features is met CELLS weights at a time.
    """
    z, n = np.zeros((size, classes)), np.zeros((size, classes))
    step = max(1, CELLS // classes)

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(epochs):
        for f, x, y in rows:
            first = weights(f[:step])
            logits = x[:step] @ first
            for k in range(step, len(f), step):
                logits += x[k : k + step] @ weights(f[k : k + step])
            p = softmax(logits)
            p[y] -= 1
            for k in range(0, len(f), step):
                at = f[k : k + step]
                w = weights(at) if k else first
                g = x[k : k + step, None] * p
                root = np.sqrt(n[at])
                n[at] += g * g
                z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on a grid."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def by_language(values: dict[str, int]) -> Column:
    """Each row's language's value; null for other languages."""
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("lang")]


def trained(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = EPOCHS, max_languages: int | None = None) -> Model | None:
    """From rows(id, text, lang, calibrates): all of them count for the document frequencies, a bounded sample for the weights."""
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, total = document_frequencies(rows.select("text"))
    if not total:
        return None
    frequent = rows.groupBy("lang").agg(F.count("*").alias("n"))
    if max_languages is not None:
        frequent = frequent.orderBy(F.desc("n"), "lang").limit(max_languages)
    counts = {r.lang: r.n for r in frequent.collect()}
    languages = sorted(counts)
    # half of the sample is dealt evenly, half by the languages' rows
    quota = {lang: max(1, int(sample_rows / 2 * (1 / len(counts) + n / sum(counts.values())))) for lang, n in counts.items()}
    key = F.xxhash64(F.col("id").cast("string"))
    # keys are spread evenly: what is far above the quota's place goes before the shuffle, so a hot language's task gets few rows
    far = {lang: min((1 << 63) - 1, round((1 << 64) * min(1.0, (SPARE * quota[lang] + SPARE_ROWS) / n)) - (1 << 63)) for lang, n in counts.items()}
    named = rows.select("lang", key.alias("key")).where(F.col("key") <= by_language(far))
    first = named.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("k") <= by_language(quota))
    last = {r.lang: r.key for r in first.groupBy("lang").agg(F.max("key").alias("key")).collect()}
    limit = by_language(last)
    fields = [field("f", "array<int>"), field("n", "array<int>"), field("total", "long")]

    def kernel(col: pa.Array) -> list[pa.Array]:
        made = [sparse(t.decode()) for t in each_text(col)]
        return [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made], pa.int64())]

    taken = scan_texts(rows.where(key <= limit).select("text", "lang", "calibrates", key.alias("key")), "text", ["lang", "calibrates", "key"], fields, lambda: kernel, prefix="")
    taken = taken.orderBy("key", "total", "lang").limit(max(sample_rows, sum(quota.values()))).toArrow()
    idf = np.log((1 + total) / (1 + df)) + 1
    number = {lang: k for k, lang in enumerate(languages)}
    fit, check = [], []
    for k in range(taken.num_rows):
        f = taken["f"][k].values.to_numpy()
        x = taken["n"][k].values.to_numpy() / max(1, taken["total"][k].as_py()) * idf[f] * SCALE
        (check if taken["calibrates"][k].as_py() else fit).append((f, x, number[taken["lang"][k].as_py()]))
    seen = {y for _, _, y in fit}
    fit += [row for row in check if row[2] not in seen]
    there = np.zeros(SIZE, bool)
    for f, _, _ in fit:
        there[f] = True
    used = np.flatnonzero(there)
    bias = len(used)
    place = np.full(SIZE, bias, np.int32)
    place[used] = np.arange(bias)

    def inside(f: np.ndarray, x: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray, int]:
        return np.append(place[f[there[f]]], bias), np.append(x[there[f]], 1.0), y

    weights = follow_the_leader([inside(*row) for row in fit], bias + 1, len(languages), epochs)
    step = max(1, CELLS // len(languages))
    logits = np.zeros((len(check), len(languages)))
    for k, row in enumerate(check):
        f, x, _ = inside(*row)
        for a in range(0, len(f), step):
            logits[k] += x[a : a + step] @ weights(f[a : a + step])
    heat = temperature_of(logits, np.array([y for _, _, y in check], int))
    table = np.zeros((bias + 1, len(languages)), np.float32)
    for a in range(0, bias, step):
        at = np.arange(a, min(bias, a + step))
        table[at] = weights(at) * (idf[used[at]] * SCALE)[:, None]
    return Model(languages, place, table, weights(np.array([bias]))[0], heat)


def sums(model: Model, f: np.ndarray, start: np.ndarray, end: np.ndarray, into: np.ndarray) -> None:
    """Add to each of `into` the table's rows of the features from `start` to `end`, CELLS numbers at a time."""
    step = max(1, CELLS // len(model.languages))
    for a in range(0, len(f), step):
        b = min(len(f), a + step)
        lo, hi = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
        full = lo + np.flatnonzero(end[lo:hi] > start[lo:hi])
        if len(full):
            edges = np.stack((np.maximum(start[full], a), np.minimum(end[full], b)), axis=1).ravel() - a
            rows = np.vstack((model.table[model.place[f[a:b]]], np.zeros((1, into.shape[1]), np.float32)))
            into[full] += np.add.reduceat(rows, edges, axis=0, dtype=np.float64)[::2]


def _kernel(model: Model | None):
    def kernel(col: pa.Array) -> list[pa.Array]:
        if model is None:
            return [pa.array([UNKNOWN] * len(col), pa.string()), pa.array([0.0] * len(col), pa.float64())]
        logits, count, letters = np.zeros((len(col), len(model.languages))), np.zeros(len(col)), np.zeros(len(col), bool)
        for held in chunks(t.decode() for t in each_text(col)):
            at = np.array([p.at for p in held])
            found = np.zeros((len(held), len(model.languages)))
            for f, start, end in placed(held):
                sums(model, f, start, end, found)
                np.add.at(count, at, end - start)
            np.add.at(logits, at, found)
            letters[at[[LETTER.search(p.text) is not None for p in held]]] = True
        p = softmax((logits / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, p[np.arange(len(p)), best], 0.0))]

    return kernel


def predicted(docs: DataFrame, model: Model | None, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The `keep` columns, then lang_pred and score under the ADDED prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scan_texts(docs, text_col, keep, [field("lang_pred", "string"), field("score", "double")], lambda: _kernel(shared.value))


def training_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, held: int = 2, calibrates: int = 3) -> DataFrame:
    """rows(id, text, lang, calibrates) of the folds that aren't held out."""
    part = part_of(id_col, modulus)
    return docs.where(part != held).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), (part == calibrates).alias("calibrates"))
