"""Benchmark decontamination: a hash set of normalised test n-grams against every window of the training texts.

Words are maximal runs of ASCII digits, letters (A-Z lower-cased) and all non-ASCII characters. An item of a
benchmark gives its windows of `n` consecutive words; an item of fewer words, but not none, is one window.
Window hashes find candidates; every candidate is confirmed by comparing its words.

Plan: while the index that the benchmark makes is within `broadcast_bytes` (an upper bound is computed before it is
built), it is broadcast and the documents are scanned once, with no shuffle. The index holds sorted hashes, one buffer of
words and lists of owners as arrays. A larger benchmark stays a table: a bitmap of its window hashes, of fixed size, is
broadcast, the scan sends only windows that the bitmap knows, each once a document, into an equi-join, and documents
with hits are looked at again for their spans. Both ways give the same rows.

Defined cases: null and empty texts have no words (0 hits, not contaminated); null item texts have no windows;
repeated items count once an id; repeated document rows give a row each; a null item_id takes no part; an empty
benchmark hits nothing; texts of any length are scanned whole, several megabytes at once; overlapping and touching hits
are one span; other columns, whatever their names, are ignored or passed through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ADDED, SPANS, apart, bounded_batches, each_text, field, materialize, restored, runs, scan_texts, utf8

N, BROADCAST_BYTES, CHUNK = 13, 64 << 20, 2 << 20
#: Bytes of an index for each word of the benchmark, beside its text: hash, place, owner and what marks present hashes.
WORD_BYTES = 100
#: Bits of the bitmap for a benchmark that isn't broadcast: 16 MB.
BITMAP_BITS = 27
#: One byte to one: word bytes lower-cased, everything else 0.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
SPACED = bytes(int(c) or 32 for c in FOLD)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_A, _B, _C, _P = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x100000001B3))

FIELDS = [field("n_words", "long"), field("n_hit", "long"), field("items", "array<string>"), field("spans", "spans")]
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(SPACED).split()


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (with 8 spare ones), each word's start and end, and each text's range of words."""
    folded = np.zeros(len(data) + 8, np.uint8)
    np.take(FOLD, data, out=folded[: len(data)])
    inside = folded[: len(data)] != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = True, True
    edge[offsets] = True  # a text's end is a word's end
    at = np.flatnonzero(edge)
    full = inside[at[:-1]] if len(data) else np.zeros(0, bool)
    starts, ends = at[:-1][full], at[1:][full]
    return folded, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes from a word's first and last eight bytes and its length: a filter, not a proof."""
    eight = np.ndarray((len(folded) - 7,), "<u8", folded, strides=(1,))
    size = ends - starts
    h = (eight[starts] & _MASK[np.minimum(size, 8)]) * _A
    h ^= h >> np.uint64(29)
    h += np.where(size > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0)) * _B + size.astype(np.uint64) * _C
    h ^= h >> np.uint64(32)
    return h * _A


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for k in range(1, size):
        out *= _P
        out += h[k : k + n]
    return out ^ (out >> np.uint64(31))


class Windows:
    """The distinct windows of one length: sorted hashes, a presence table over hash prefixes, each one's words and owners."""

    def __init__(self, hashes: np.ndarray, at: np.ndarray, to: np.ndarray, item: np.ndarray, text: bytes):
        order = np.lexsort((item, hashes))
        hashes, at, to, item = hashes[order], at[order], to[order], item[order]
        new = np.concatenate(([True], hashes[1:] != hashes[:-1]))
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        where: dict[tuple[int, bytes], int] = {}  # other words of a hash that is taken
        for k in np.flatnonzero(~new).tolist():
            first, own = heads[group[k]], text[at[k] : to[k]]
            if own != text[at[first] : to[first]]:
                group[k] = where.setdefault((int(hashes[k]), own), len(heads) + len(where))
        order = np.argsort(group, kind="stable")
        group, item = group[order], item[order]
        single = np.concatenate(([True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])))
        group, item, order = group[single], item[single], order[single]
        start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        by_hash = np.argsort(hashes[order[start]], kind="stable")
        ends = np.append(start[1:], len(item))
        self.hashes, self.at, self.to = (x[order[start]][by_hash] for x in (hashes, at, to))
        self.owner_at, self.owner_to, self.owners = start[by_hash], ends[by_hash], item
        bits = int(min(24, max(12, np.ceil(np.log2(len(self.hashes) + 1)) + 4)))
        self.present, self.shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
        self.present[self.hashes >> self.shift] = True

    def near(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in w of known hashes, and the first window of each."""
        found = np.flatnonzero(self.present[w >> self.shift])
        first = np.searchsorted(self.hashes, w[found])
        first = np.minimum(first, len(self.hashes) - 1)
        known = self.hashes[first] == w[found]
        return found[known], first[known]

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.at, self.to, self.owner_at, self.owner_to, self.owners, self.present))


class WindowIndex:
    """All windows of a benchmark by their length."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        ids: dict[str, int] = {}
        own, bodies = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                own.append(ids.setdefault(item, len(ids)))
                bodies.append(b" ".join(words))
        self.names, self.text = list(ids), b" ".join(bodies)
        size = np.array([len(x) + 1 for x in bodies], np.int64)
        offsets = np.concatenate(([0], np.cumsum(size)))
        offsets[-1] = min(offsets[-1], len(self.text))
        self.by_size: dict[int, Windows] = {}
        if not bodies:
            return
        folded, starts, ends, first = word_bounds(np.frombuffer(self.text, np.uint8), offsets)
        h, count, owner = word_hashes(folded, starts, ends), np.diff(first), np.array(own, np.int32)
        for k in range(1, n + 1):
            made = np.where(count >= n if k == n else count == k, count - k + 1, 0)
            if made.any():
                at = np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made) + np.repeat(first[:-1], made)
                self.by_size[k] = Windows(window_hashes(h, k)[at], starts[at], ends[at + k - 1], np.repeat(owner, made), self.text)

    @property
    def nbytes(self) -> int:
        return len(self.text) + sum(w.nbytes for w in self.by_size.values())

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]], dict[int, list[tuple[int, int]]]]:
        """For each text: words, hit words; and for texts with hits, their items' numbers and hit byte spans."""
        folded, starts, ends, first = word_bounds(data, offsets)
        n_words, n_hit = np.diff(first), np.zeros(len(offsets) - 1, np.int64)
        items: dict[int, set[int]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        if not len(starts) or not self.by_size:
            return n_words, n_hit, items, spans
        h, raw = word_hashes(folded, starts, ends), None
        cover = np.zeros(len(starts) + 1, np.int64)
        for size, windows in self.by_size.items():
            w = window_hashes(h, size)
            found, near = windows.near(w)
            doc = np.searchsorted(first, found, side="right") - 1
            whole = found + size <= first[doc + 1]
            found, doc, near = found[whole], doc[whole], near[whole]
            raw = folded.tobytes() if raw is None and len(found) else raw
            for i, d, r in zip(found.tolist(), doc.tolist(), near.tolist()):
                key = b" ".join([raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())])
                while r < len(windows.hashes) and windows.hashes[r] == w[i]:
                    if self.text[windows.at[r] : windows.to[r]] == key:
                        cover[i] += 1
                        cover[i + size] -= 1
                        items.setdefault(d, set()).update(windows.owners[windows.owner_at[r] : windows.owner_to[r]].tolist())
                        break
                    r += 1
        if items:
            hit = np.cumsum(cover[:-1]) > 0
            sums = np.concatenate(([0], np.cumsum(hit)))
            n_hit = sums[first[1:]] - sums[first[:-1]]
            for d in items:
                spans[d] = stretches(hit[first[d] : first[d + 1]], starts[first[d] :] - offsets[d], ends[first[d] :] - offsets[d])
        return n_words, n_hit, items, spans


def stretches(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """From the first byte to the last of each run of hit words."""
    own = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(starts[a]), int(ends[b - 1])) for a, b in zip(own[::2].tolist(), own[1::2].tolist())]


def code_points(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Byte spans as code point spans."""
    out, at, points = [], 0, 0
    for a, b in spans:
        start = points + len(text[at:a].decode())
        points = start + len(text[a:b].decode())
        at = b
        out.append({"start": start, "end": points})
    return out


def _kernel(index: WindowIndex):
    def kernel(col: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(col)
        n_words, n_hit, items, spans = [], [], [], []
        for a, b in runs(offsets, CHUNK):
            base = offsets[a]
            part, own = data[base : offsets[b]], offsets[a : b + 1] - base
            w, hit, its, sp = index.scan(part, own)
            n_words.append(w)
            n_hit.append(hit)
            items += [sorted(index.names[k] for k in its[d]) if d in its else [] for d in range(b - a)]
            spans += [code_points(part[own[d] : own[d + 1]].tobytes(), sp[d]) if d in sp else [] for d in range(b - a)]
        none = [np.zeros(0, np.int64)]
        return [pa.array(np.concatenate(n_words or none), pa.int64()), pa.array(np.concatenate(n_hit or none), pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, ARROW_SPANS)]

    return kernel


def usable_items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    item = F.col(f"`{item_col}`").cast("string")
    return benchmark.select(item.alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("item is not null and text is not null")


def index_bytes(items: DataFrame) -> int:
    """No index of these items takes more."""
    words = F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    return items.agg(F.sum(F.octet_length("text") + WORD_BYTES * words)).first()[0] or 0


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = N, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The `keep` columns of every document, then n_words, n_hit, items and hit spans (code points) under the ADDED prefix."""
    items = usable_items(benchmark, item_col, item_text_col)
    if index_bytes(items) > broadcast_bytes:
        return scan_joined(docs, items, keep, text_col=text_col, n=n)
    index = docs.sparkSession.sparkContext.broadcast(WindowIndex([(r.item, r.text) for r in items.toLocalIterator()], n))
    return scan_texts(docs, text_col, keep, FIELDS, lambda: _kernel(index.value))


CANDIDATES = T.ArrayType(T.StructType([T.StructField("size", T.IntegerType()), T.StructField("hash", T.LongType()), T.StructField("window", T.BinaryType()), T.StructField("ats", T.ArrayType(T.IntegerType()))]))
ARROW_CANDIDATES = pa.list_(pa.struct([("size", pa.int32()), ("hash", pa.int64()), ("window", pa.binary()), ("ats", pa.list_(pa.int32()))]))


def windows_of(text: bytes, sizes: list[int], bits: np.ndarray | None) -> tuple[int, list[dict]]:
    """The number of words, and the distinct windows of some lengths that the bitmap knows, with the words they start at."""
    folded, starts, ends, _ = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
    made: dict[bytes, dict] = {}
    h, raw = word_hashes(folded, starts, ends), folded.tobytes()
    for size in sizes:
        w = window_hashes(h, size)
        top = w >> np.uint64(64 - BITMAP_BITS)
        found = np.arange(len(w)) if bits is None else np.flatnonzero((bits[top >> np.uint64(6)] >> (top & np.uint64(63))) & np.uint64(1))
        for i in found.tolist():
            key = b" ".join([raw[a:b] for a, b in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist())])
            made.setdefault(key, {"size": size, "hash": int(w[i].astype(np.int64)), "window": key, "ats": []})["ats"].append(i)
    return len(starts), list(made.values())


def benchmark_windows(items: DataFrame, n: int) -> DataFrame:
    """(size, hash, window, items): each distinct window with all its owners, written."""
    bounded_batches(items.sparkSession)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), each_text(batch.column(1))):
                words = len(text.translate(SPACED).split())
                own = windows_of(text, [min(n, words)], None)[1] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([x["size"] for x in own], pa.int32()), pa.array([x["hash"] for x in own], pa.int64()), pa.array([x["window"] for x in own], pa.binary()), pa.array([item] * len(own), pa.string())], names=["size", "hash", "window", "item"])

    rows = items.select("item", "text").mapInArrow(make, "size int, hash long, window binary, item string")
    return materialize(rows.groupBy("size", "hash", "window").agg(F.collect_set("item").alias("items")), "decontaminate-windows")


def bitmap_of(windows: DataFrame) -> np.ndarray:
    """A bit for each prefix of BITMAP_BITS that a window's hash has, put together by Spark in words of 64."""
    top = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    words = windows.select(top.alias("top")).selectExpr("shiftright(top, 6) AS word", "shiftleft(1L, cast(top & 63 AS int)) AS mask")
    few = words.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**(BITMAP_BITS - 6) rows
    bits = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    bits[few["word"].to_numpy()] = few["mask"].to_numpy().view(np.uint64)
    return bits


def scan_joined(docs: DataFrame, items: DataFrame, keep: list[str], *, text_col: str, n: int) -> DataFrame:
    """The same for a benchmark that is too large to broadcast."""
    windows = benchmark_windows(items, n)
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most n values
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(windows))
    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).withColumn("uid", F.monotonically_increasing_id()), "decontaminate-rows")

    def kernel(col: pa.Array) -> list[pa.Array]:
        made = [windows_of(t, sizes, bits.value) for t in each_text(col)]
        return [pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], ARROW_CANDIDATES)]

    seen = materialize(scan_texts(rows, "text", ["uid"], [field("n_words", "long"), T.StructField("candidates", CANDIDATES)], lambda: kernel, prefix=""), "decontaminate-candidates")
    each = seen.select("uid", F.explode("candidates").alias("c")).select("uid", "c.*")
    met = each.join(windows, ["size", "hash", "window"])
    spots = F.expr("transform(ats, a -> struct(a AS at, size AS size))")
    hits = met.groupBy("uid").agg(F.flatten(F.collect_list(spots)).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = rows.join(seen.select("uid", "n_words"), "uid").join(located(rows.select("uid", "text").join(hits, "uid")), "uid", "left")
    empty = F.array().cast("array<string>")
    return out.select("kept.*", F.col("n_words").alias(ADDED + "n_words"), F.coalesce("n_hit", F.lit(0)).alias(ADDED + "n_hit"), F.coalesce("items", empty).alias(ADDED + "items"), F.coalesce("spans", F.array().cast(SPANS)).alias(ADDED + "spans"))


def located(hits: DataFrame) -> DataFrame:
    """uid, items, n_hit, and the stretches of hit words as spans of code points."""
    bounded_batches(hits.sparkSession)
    source = hits.select("uid", "items", "hits", "text")

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for text, own in zip(each_text(batch.column(3)), batch.column(2).to_pylist()):
                _, starts, ends, _ = word_bounds(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
                hit = np.zeros(len(starts), bool)
                for x in own:
                    hit[x["at"] : x["at"] + x["size"]] = True
                n_hit.append(int(hit.sum()))
                spans.append(code_points(text, stretches(hit, starts, ends)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_hit, pa.int64()), pa.array(spans, ARROW_SPANS)], names=["uid", "items", "n_hit", "spans"])

    return source.mapInArrow(locate, T.StructType([T.StructField("uid", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("n_hit", T.LongType()), T.StructField("spans", SPANS)]))


def contaminated(hit="n_hit", words="n_words", share: int = 20):
    """The rule: at least one hit word, and at least one word in `share` hit."""
    return (F.col(ADDED + hit) > 0) & (F.col(ADDED + hit) * share >= F.col(ADDED + words))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """Documents that the rule spares, with their own columns."""
    own, names = apart(docs)
    return restored(scan(own, benchmark, own.columns, text_col=names[text_col], **how).where(~contaminated()), names)


def remove_spans(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """All documents with every hit span cut out of their texts (null stays null)."""
    own, names = apart(docs)
    text = names[text_col]
    cut = F.expr(f"aggregate({ADDED}spans, struct('' as out, 0L as at), (s, x) -> struct(s.out || substring({text}, int(s.at + 1), int(x.start - s.at)) as out, x.end as at), s -> s.out || substring({text}, int(s.at + 1)))")
    seen = scan(own, benchmark, own.columns, text_col=text, **how)
    return restored(seen.withColumn(text, F.when(F.size(ADDED + "spans") > 0, cut).otherwise(F.col(text))), names)
