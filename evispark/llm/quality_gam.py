"""A quality classifier: a generalised additive model with pairwise interactions, in lookup tables.

Each numeric feature of a text falls in one of at most BINS quantile bins. Cyclic gradient boosting visits the
features in turn, each time adding a shallow tree (up to four leaves) on that one feature to its table; then the
PAIRS pairs of features whose quadrants explain most of what is left get tables of two features, boosted in turn
with trees that cut one feature and then the other. A text's score is the logistic of the sum of its bins' entries.

The model is fitted on a bounded sample (`sample_rows`, least hashed ids) of the labelled training rows; labels,
language, source and id are never inputs. Plan: the sample's ids are broadcast (bounded) to a scan that takes their
features to the driver; another scan scores all texts. Nothing is shuffled but the labels' ids.

Defined cases: null texts count as empty, and empty texts are scored like others; texts of any length are measured whole;
null labels are ignored, equal labels of an id count once, different ones each; labels of one class, or none, give a
constant score; a value on a bin's edge is in the upper bin, and of equal gains the first cut wins in a feature, the last
leaf among leaves; repeated rows get a row each; empty tables give empty results; other columns, whatever their names,
are unread.
"""

from __future__ import annotations

from dataclasses import dataclass, field as entry

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_text, field, scan_texts
from .quality_rules import measure

BINS, COARSE, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, RIDGE, LEAST_ROWS = 32, 8, 120, 6, 60, 0.1, 5.0, 20
SAMPLE_ROWS = 20_000
NAMES = ["words", "word_len", "symbols", "dup_lines", "repeats", "upper", "digits", "marks", "non_ascii", "line_words", "capped_words", "distinct", "bars"]
NOT = {name: bytes(c for c in range(256) if c not in wanted) for name, wanted in {"upper": range(65, 91), "digits": range(48, 58), "marks": b".,;:!?'\"()-", "bars": b"|"}.items()}


def features(text: bytes) -> list[float]:
    """One number for each of NAMES; shares are of the text's bytes, lines or words."""
    n_words, word_chars, n_symbols, n_lines, n_dup, n_repeat = measure(text)
    size, words = max(1, len(text)), max(1, n_words)
    of = {name: len(text.translate(None, others)) / size for name, others in NOT.items()}
    distinct = len(set(text.split())) / words
    return [np.log1p(n_words), word_chars / words, n_symbols / max(1, word_chars), n_dup / max(1, n_lines), n_repeat / words, of["upper"], of["digits"], of["marks"], 1 - word_chars / size, words / max(1, n_lines), of["upper"] * size / words, distinct, of["bars"]]


def _feature_kernel(col: pa.Array) -> list[pa.Array]:
    return [pa.array([features(t) for t in each_text(col)], pa.list_(pa.float64()))]


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = entry(default_factory=list)
    tables: list[np.ndarray] = entry(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = entry(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities by bin additions."""
        b = self.binned(x)
        total = np.full(len(x), self.bias)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for i, j, table in self.pairs:
            total += table[b[:, i], b[:, j]]
        return logistic(total)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray, a: int, b: int) -> tuple[float, int]:
    """(gain, place) of the best cut of bins a..b-1; place 0 if there is none."""
    left_g, left_h, left_n = (np.cumsum(v[a : b - 1]) for v in (g, h, n))
    if not len(left_g):
        return 0.0, 0
    all_g, all_h, all_n = g[a:b].sum(), h[a:b].sum(), n[a:b].sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    gain = np.where((left_n >= LEAST_ROWS) & (all_n - left_n >= LEAST_ROWS), gain, 0.0)
    k = int(gain.argmax())
    return float(gain[k]), a + k + 1 if gain[k] > 1e-9 else 0


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The steps of a tree on one feature's bins: the best cut of any leaf, again and again."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        cuts = [(best_cut(g, h, n, a, b), k) for k, (a, b) in enumerate(parts)]
        (gain, at), k = max(cuts)
        if not at:
            break
        a, b = parts.pop(k)
        parts += [(a, at), (at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = RATE * g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of a tree on two features: a cut of the first and, on each side, one of the second; or the other way round."""
    best, steps = 0.0, np.zeros_like(g)
    for turned in (False, True):
        G, H, N = (v.T if turned else v for v in (g, h, n))
        made, gain = np.zeros_like(G), 0.0
        first = max(((sum(best_cut(G[s].sum(0), H[s].sum(0), N[s].sum(0), 0, G.shape[1])[0] for s in (slice(0, c), slice(c, None))), c) for c in range(1, len(G))), default=(0.0, 0))
        if not first[1]:
            continue
        for s in (slice(0, first[1]), slice(first[1], None)):
            sg, sh, sn = G[s].sum(0), H[s].sum(0), N[s].sum(0)
            own, at = best_cut(sg, sh, sn, 0, len(sg))
            for t in (slice(0, at), slice(at, None)) if at else (slice(None),):
                gg, hh = sg[t].sum(), sh[t].sum()
                made[s, t] = RATE * gg / (hh + RIDGE)
                gain += gg**2 / (hh + RIDGE)
        gain -= G.sum() ** 2 / (H.sum() + RIDGE)
        if gain > best:
            best, steps = gain, made.T if turned else made
    return best, steps


def fitted(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost one table for each feature, then the tables of the best pairs."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Model(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    b = model.binned(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.bias)
    counts = [np.bincount(b[:, k], minlength=s) for k, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for k, s in enumerate(sizes):
            p = logistic(total)
            steps = tree(np.bincount(b[:, k], y - p, s), np.bincount(b[:, k], p * (1 - p), s), counts[k])
            model.tables[k] += steps
            total += steps[b[:, k]]
    p = logistic(total)
    g, h = y - p, p * (1 - p)
    coarse = [np.minimum(np.arange(s) * COARSE // s, COARSE - 1) for s in sizes]
    grid = lambda i, j, w: np.bincount(coarse[i][b[:, i]] * COARSE + coarse[j][b[:, j]], w, COARSE * COARSE).reshape(COARSE, COARSE)
    one = np.ones(len(y))
    ranked = sorted(((pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, one))[0], i, j) for i in range(len(sizes)) for j in range(i)), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((COARSE, COARSE))) for gain, i, j in ranked if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            p = logistic(total)
            _, steps = pair_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)), grid(i, j, one))
            table += steps
            total += steps[coarse[i][b[:, i]], coarse[j][b[:, j]]]
    model.pairs = [(i, j, table[np.ix_(coarse[i], coarse[j])]) for i, j, table in pairs]
    return model


def trained(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """From labels that the caller has restricted to training rows."""
    key = F.xxhash64(F.col(f"`{id_col}`").cast("string"))
    ids = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("label_id"), F.col(f"`{label_col}`").cast("double").alias("y"), key.alias("key")).distinct().orderBy("key", "label_id", "y").limit(sample_rows)
    met = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(ids), F.col("id") == F.col("label_id"))  # at most sample_rows rows
    rows = scan_texts(met, "text", ["key", "label_id", "y"], [field("x", "array<double>")], lambda: _feature_kernel, prefix="")
    rows = rows.orderBy("key", "label_id", "y", "x").limit(sample_rows).toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(NAMES))
    return fitted(x, rows["y"].to_numpy().astype(float))


def scored(docs: DataFrame, model: Model, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The `keep` columns and the score under the ADDED prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(col: pa.Array) -> list[pa.Array]:
        x = np.array([features(t) for t in each_text(col)], float).reshape(-1, len(NAMES))
        return [pa.array(shared.value.score(x), pa.float64())]

    return scan_texts(docs, text_col, keep, [field("score", "double")], lambda: kernel)
