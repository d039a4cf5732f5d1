"""Near-duplicate classes by ProbMinHash: signatures of weighted word shingles, banding, exact verification, components.

Words are those of the decontamination operator; a shingle is `SHINGLE` consecutive words (a shorter text, but not
an empty one, is one shingle), weighted by 1 + ln(its count in the text), so that a line said a hundred times does not
outweigh all the rest. Two texts are linked if their probability
Jaccard similarity, the sum over common shingles i of 1 / sum_j max(x_j / x_i, y_j / y_i), is at least `threshold`;
where no shingle repeats this is the Jaccard similarity of their shingle sets. Classes are the connected components.

Signatures: each shingle is a Poisson process whose rate is its weight; its arrivals fall in random registers, a
register keeps the shingle that arrives first, and a text's processes stop once their next arrival is later than
its latest register. Registers of two texts agree with the probability Jaccard of the texts.

Plan: one scan of whole texts makes a 16-byte digest of the words and a signature for each row. Equal word
sequences collapse by partial aggregation, so thousands of copies count as one node from there on. In each band
bucket of two nodes or more, all are compared to the bucket's least node (a star, not all pairs); links are
joined into components by alternating large-star and small-star contractions. In buckets whose nodes are still in
several components, nodes outside the bucket's main component are then compared to all nodes of other components, in
pairs of blocks that are dealt over tasks by bucket and block: first by signatures alone, then by the texts of the nodes
that came near another. No link between bucket mates can be lost to the star. Only texts of candidates move.

Defined cases: null texts and texts without words are classes of their own, by row; repeated rows get a row each;
null ids are allowed (a class's id is its least non-null id); texts of any length are compared whole; of ties, a pair at
the threshold is linked; an empty table gives an empty result; other columns, whatever their names, are unread, and
near_duplicate_free() passes them through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ADDED, apart, drop, each_text, field, give_back, materialize, restored, runs, scan_texts, utf8
from .decontaminate import SPACED, window_hashes, word_bounds, word_hashes

SHINGLE, THRESHOLD, BANDS, ROWS, REGISTERS = 5, 0.8, 24, 5, 160
#: Pairs are screened out if their signatures agree in less than threshold - SCREEN deviations of such an estimate.
SCREEN = 5
#: Nodes of a block of signatures, and of one with texts.
WIDE, BLOCK = 512, 64
CHUNK, BROADCAST_NODES = 1 << 20, 400_000
#: A node with more copies than this, and than this share of all rows, is met by broadcast.
HOT_COPIES, HOT_NODES = 500, 10_000
#: Sums of fractions carry rounding.
ROUNDING = 1e-9
_G, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_48 = np.uint64((1 << 48) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_weights(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts together: the row, 48-bit hash and weight of each distinct shingle."""
    folded, starts, ends, first = word_bounds(data, offsets)
    n = np.diff(first)
    h = word_hashes(folded, starts, ends)
    rows, hashes = [], []
    for k in range(1, size + 1):
        own = n >= size if k == size else n == k
        w = window_hashes(h, k)
        if not own.any() or not len(w):
            continue
        count = np.where(own, n - k + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
        rows.append(row)
        hashes.append(w[at])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(48)) | (mixed(np.concatenate(hashes)) >> np.uint64(16))
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    key, counts = key[new], np.diff(np.concatenate((new, [len(key)])))
    return (key >> np.uint64(48)).astype(np.int64), key & _48, 1 + np.log(counts)


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: (n, registers) of 16-bit names of the shingles that arrive first."""
    first = np.full(n * registers, np.inf)
    name = np.zeros(n * registers, np.uint16)
    seed, t, r = mixed(elements * _G + _M2), np.zeros(len(rows)), 0
    own = (seed >> np.uint64(48)).astype(np.uint16)
    while len(rows):
        r += 1
        u = mixed(seed + np.uint64((r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        at = rows * registers + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        t = t - np.log(((u >> np.uint64(33)).astype(np.float64) + 0.5) / (1 << 31)) / weights
        np.minimum.at(first, at, t)
        won = first[at] == t
        name[at[won]] = own[won]
        latest = first.reshape(n, registers).max(axis=1)
        live = t < latest[rows]
        rows, seed, t, weights, own = rows[live], seed[live], t[live], weights[live], own[live]
    return name.reshape(n, registers)


def digest(text: bytes) -> bytes | None:
    """16 bytes that name a sequence of words; None where there is no word."""
    words = text.translate(SPACED).split()
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None


def _sketch_kernel(size: int, registers: int):
    def kernel(col: pa.Array) -> list[pa.Array]:
        data, offsets = utf8(col)
        nodes = [digest(t) for t in each_text(col)]
        sigs: list[bytes | None] = []
        for a, b in runs(offsets, CHUNK):
            rows, elements, weights = shingle_weights(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
            made = signatures(rows, elements, weights, b - a, registers)
            sigs += [s.tobytes() for s in made]
        return [pa.array(nodes, pa.binary()), pa.array([s if k is not None else None for k, s in zip(nodes, sigs)], pa.binary())]

    return kernel


#: Fixed random values: what a folded byte adds to a word's hash.
BYTES = np.random.default_rng(5).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def profile(text: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The weighted shingles of a text: sorted 64-bit hashes, over every byte of every word, and their weights."""
    data = np.frombuffer(text, np.uint8)
    folded, starts, ends, _ = word_bounds(data, np.array([0, len(data)], np.int64))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0)
    length = ends - starts
    power = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(int(length.max()) - 1, _G | np.uint64(1)))))
    inside = np.flatnonzero(folded[: len(data)])
    offset = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    words = np.add.reduceat(BYTES[folded[inside]] * power[offset], np.cumsum(length) - length)
    h = np.sort(mixed(window_hashes(mixed(words + length.astype(np.uint64) * _M1), min(size, len(words)))))
    new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[new], 1 + np.log(np.diff(np.concatenate((new, [len(h)]))))


def similarity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard of two profiles."""
    both, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    cx, cy = x[1][i], y[1][j]
    only_x, only_y = x[1].sum() - cx.sum(), y[1].sum() - cy.sum()
    ratio, which = np.unique(cx / cy, return_inverse=True)
    total = np.array([np.maximum(cx, q * cy).sum() + only_x + q * only_y for q in ratio])
    return float((cx / total[which]).sum())


class Duplicates:
    """The steps over one table; every table that is read twice is written to the shared folder.

    A node, a distinct sequence of words, gets a number once its table is made: numbers keep later rows short and
    their minima in hash aggregation.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, bands: int, rows: int, registers: int = REGISTERS):
        self.docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        self.size, self.threshold, self.bands, self.rows = size, threshold, bands, rows
        self.registers = registers = max(registers, bands * rows)
        fields = [field("digest", "binary"), field("sig", "binary")]
        self.sketched = materialize(scan_texts(self.docs, "text", ["id"], fields, lambda: _sketch_kernel(size, registers), prefix=""), "dup-sketches")
        nodes = self.sketched.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
        self.nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "dup-nodes")
        self.hot = max(HOT_COPIES, self.sketched.count() // HOT_NODES)

    def met(self, rows: DataFrame, named: DataFrame) -> DataFrame:
        """rows(digest, ...) with the columns of named(digest, ...), a row for each node. The few digests with many copies are broadcast, at most HOT_NODES of them, so that their rows stay spread."""
        many = self.nodes.where(F.col("copies") > self.hot).select("digest")
        if many.isEmpty():
            return rows.join(named, "digest")
        many = F.broadcast(many)
        hot, cold = named.join(many, "digest", "left_semi"), named.join(many, "digest", "left_anti")
        return rows.join(F.broadcast(hot), "digest").unionByName(rows.join(many, "digest", "left_anti").join(cold, "digest"))

    def members(self) -> DataFrame:
        """(band, bucket, node, center, n) of the buckets that hold n nodes, two or more; each band has an order of its own, whose least node is the center."""
        width = 2 * self.rows
        bucket = F.expr(f"posexplode(transform(sequence(0, {self.bands - 1}), b -> xxhash64(b, substring(sig, b * {width} + 1, {width})))) AS (band, bucket)")
        banded = self.nodes.select(bucket, "node").withColumn("turned", F.col("node").bitwiseXOR(F.xxhash64("band")))
        shared = banded.groupBy("bucket").agg(F.min("turned").alias("first"), F.count("*").alias("n")).where("n > 1")
        met = banded.select("band", "bucket", "node").join(shared, "bucket")
        return materialize(met.select("band", "bucket", "node", F.col("first").bitwiseXOR(F.xxhash64("band")).alias("center"), "n"), "dup-members")

    def texts_of(self, nodes: DataFrame) -> DataFrame:
        """(node, text) for nodes(node): one text of each; the other rows' texts don't move."""
        wanted = materialize(self.nodes.join(nodes.distinct(), "node", "left_semi").select("node", "digest", F.col("id").alias("wanted")), "dup-wanted")
        few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
        side = (lambda df: F.broadcast(df)) if few else (lambda df: df)
        there = self.docs.join(side(wanted.select("wanted")), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
        texts = scan_texts(there, "text", ["text"], [field("found", "binary")], lambda: lambda col: [pa.array([digest(t) for t in each_text(col)], pa.binary())], prefix="")
        named = texts.join(side(wanted.select("node", "digest")), F.col("found") == F.col("digest"))
        return materialize(named.groupBy("node").agg(F.first("text").alias("text")), "dup-texts")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs(a, b) of nodes, by comparing whole texts."""
        pairs = materialize(pairs, "dup-pairs")
        texts = self.texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        size = self.size
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, kept = None, None
            for batch in batches:
                sims = []
                for a, x, y in zip(batch.column(0).to_pylist(), each_text(batch.column(2)), each_text(batch.column(3))):
                    if a != last:
                        last, kept = a, profile(x, size)
                    sims.append(similarity(kept, profile(y, size)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])
            give_back()

        links = materialize(both.mapInArrow(compare, "a long, b long, sim double").where(F.col("sim") >= self.threshold - ROUNDING).select("a", "b"), "dup-links")
        drop(pairs, texts)
        return links

    def floor(self) -> int:
        """Equal registers below which a pair is screened out."""
        return int(np.ceil(self.registers * self.threshold - SCREEN * np.sqrt(self.registers * self.threshold * (1 - self.threshold))))

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Pairs(a, b) whose signatures agree often enough."""
        sig = self.nodes.select("node", "sig")
        both = pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")
        registers, least = self.registers, self.floor()

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, registers) for k in (2, 3))
                near = pa.array((x == y).sum(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

        return both.mapInArrow(screen, "a long, b long")

    def labelled(self, members: DataFrame, comps: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, with their component and the bucket's main one."""
        rows = materialize(members.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root", "center"), "dup-rows")
        sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("size"))
        mains = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1").select("bucket", "main")
        mixed_rows = materialize(rows.join(mains, "bucket"), "dup-mixed")
        drop(members, rows)
        return mixed_rows

    def block_pairs(self, rows: DataFrame, width: int, cell: list[str]) -> DataFrame:
        """(bucket, band, main, outside, mates): a bucket's nodes in blocks of about `width`, each block's mates with each block's nodes outside the main component.

        Copies of outside blocks go to the task of the (bucket, block) whose mates they meet, so a large bucket is spread.
        """
        cells = F.struct(*cell)
        dealt = rows.withColumn("blocks", F.ceil(F.col("n") / width)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        mates = dealt.groupBy("bucket", "band", "main", "block").agg(F.collect_list(cells).alias("mates"))
        outside = dealt.where("comp <> main").groupBy("bucket", "block", "blocks").agg(F.collect_list(cells).alias("outside"))
        outside = outside.select("bucket", "outside", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        return outside.join(mates, ["bucket", "block"]).select("bucket", "band", "main", "outside", "mates")

    def across(self, mixed_rows: DataFrame) -> DataFrame:
        """The links between bucket mates in different components, of which one is outside the bucket's main component.

        A first pass over signatures finds the nodes that come near any other; the second compares the texts of these
        alone, so rows made are nodes and links, never all pairs. A pair is looked at in the first band only that both share.
        """
        rows = mixed_rows.join(self.nodes.select("node", "sig"), "node")
        registers, width, least, size, threshold = self.registers, self.rows, self.floor(), self.size, self.threshold

        class Block:
            def __init__(self, cells: pa.Array):
                self.node, self.comp = (cells.field(c).to_numpy() for c in ("node", "comp"))
                self.sig = np.frombuffer(b"".join(cells.field("sig").to_pylist()), np.uint16).reshape(len(cells), registers)
                self.text, self.known = cells.field("text") if cells.type.get_field_index("text") >= 0 else None, {}

            def profile(self, i: int) -> tuple[np.ndarray, np.ndarray]:
                if i not in self.known:
                    self.known[i] = profile(self.text[i].as_py().encode(), size)
                return self.known[i]

        def near_pairs(batch: pa.RecordBatch, k: int) -> Iterator[tuple[Block, int, Block, int]]:
            band, main = batch.column("band")[k].as_py(), batch.column("main")[k].as_py()
            x, y = Block(batch.column("outside")[k].values), Block(batch.column("mates")[k].values)
            for i in range(len(x.node)):
                same = y.sig == x.sig[i]
                near = np.flatnonzero((same.sum(axis=1) >= least) & (y.comp != x.comp[i]))
                if band and len(near):
                    near = near[~same[near, : band * width].reshape(len(near), band, width).all(axis=2).any(axis=1)]
                yield from ((x, i, y, j) for j in near.tolist() if y.comp[j] == main or x.node[i] < y.node[j])

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    found = list({int(n) for x, i, y, j in near_pairs(batch, k) for n in (x.node[i], y.node[j])})
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("bucket")[k].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["bucket", "node"])
            give_back()

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    found = [(int(x.node[i]), int(y.node[j])) for x, i, y, j in near_pairs(batch, k) if similarity(x.profile(i), y.profile(j)) >= threshold - ROUNDING]
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])
            give_back()

        near = materialize(self.block_pairs(rows, WIDE, ["node", "comp", "sig"]).mapInArrow(screen, "bucket long, node long").distinct(), "dup-near")
        texts = self.texts_of(near.select("node"))
        left = near.join(near.groupBy("bucket").agg(F.count("*").alias("n")), "bucket")
        rows = rows.drop("n").join(left, ["bucket", "node"]).join(texts, "node")
        links = materialize(self.block_pairs(rows, BLOCK, ["node", "comp", "sig", "text"]).mapInArrow(compare, "a long, b long"), "dup-across")
        drop(mixed_rows, near, texts)
        return links

    def classes(self) -> DataFrame:
        """(node, root) of the nodes that have links."""
        members = self.members()
        star = members.where("node <> center").select(F.least("center", "node").alias("a"), F.greatest("center", "node").alias("b")).distinct()
        links = self.compared(self.screened(star))
        rows = self.labelled(members, components(links))
        return components(links.union(self.across(rows)))

    def described(self, comps: DataFrame) -> DataFrame:
        """A row for each document: id and its class."""
        named = self.nodes.join(comps, "node", "left").select("digest", "id", "copies", F.coalesce("root", "node").alias("root"))
        totals = named.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_rows"), F.count("*").alias("class_texts"))
        named = materialize(named.join(totals, "root").select("digest", "class_id", "class_rows", "class_texts"), "dup-named")
        one = F.lit(1).cast("long")
        alone = self.sketched.where("digest is null").select("id", F.col("id").alias("class_id"), one.alias("class_rows"), F.lit(0).cast("long").alias("class_texts"))
        rows = self.sketched.where("digest is not null").select("id", "digest")
        return self.met(rows, named).select("id", "class_id", "class_rows", "class_texts").union(alone)


def components(links: DataFrame, rows_a_task: int = 50_000) -> DataFrame:
    """(node, root): connected components of links(a, b) by alternating large-star and small-star contractions.

    Each contraction is a minimum for each node (partially aggregated) and a join back, never a list of neighbours.
    """
    edges, seen = materialize(links.where("a <> b").distinct(), "cc-edges"), None
    tasks = 1 + edges.count() // rows_a_task  # contractions never add edges
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = materialize(large, "cc-large", tasks)
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "cc-small", tasks)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen:
            break
        seen = now
    return materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "cc-roots", tasks)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each document: id, class_id (the least id of its class), class_rows, class_texts (distinct word sequences)."""
    work = Duplicates(docs, id_col, text_col, size, threshold, bands, rows)
    return work.described(work.classes())


def near_duplicate_free(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each class, the one with the least id, with its own columns; of equal (id, words) rows, one stays.

    The rows to leave out are broadcast while they are within BROADCAST_NODES, so that texts stay in place.
    """
    opts = {"size": SHINGLE, "threshold": THRESHOLD, "bands": BANDS, "rows": ROWS} | how
    docs, names = apart(docs)
    id_col, text_col = names[id_col], names[text_col]
    work = Duplicates(docs, id_col, text_col, *[opts[k] for k in ("size", "threshold", "bands", "rows")])
    roots = work.nodes.join(work.classes(), "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    first = roots.groupBy("root").agg(F.min_by("digest", F.struct("id", "digest")).alias("stays")).select("stays")
    keys = work.sketched.where("digest is not null").groupBy("id", "digest").agg(F.count("*").alias("n"))
    least = work.nodes.join(first, F.col("digest") == F.col("stays"), "left").select("digest", F.col("id").alias("least"), F.col("stays").isNotNull().alias("stays"))
    keys = work.met(keys, least).select("id", "digest", "n", (F.col("stays") & F.col("id").eqNullSafe(F.col("least"))).alias("stays"))
    keys = materialize(keys.where("not stays or n > 1").select(F.col("id").alias("x_id"), F.col("digest").alias("x_digest"), "stays"), "dup-out")
    few = keys.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    named = scan_texts(docs, text_col, docs.columns, [field("digest", "binary")], lambda: lambda col: [pa.array([digest(t) for t in each_text(col)], pa.binary())])
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("x_id")) & (F.col(ADDED + "digest") == F.col("x_digest"))
    kept = restored(named.join(F.broadcast(keys) if few else keys, same, "left_anti"), names)
    again = keys.where("stays")
    if again.isEmpty():
        return kept
    repeated = named.join(F.broadcast(again) if few else again, same, "left_semi").dropDuplicates([id_col, ADDED + "digest"])
    return kept.union(restored(repeated, names))
