"""A hidden Markov language model over whole corpora, and its unigram base.

Tokens are the white-space words of the text, A-Z lower-cased, then one end token. Training tokens are counted over
all training documents, and each has its own emissions; all unseen tokens share theirs. `states` latent states are
trained by `rounds` of Baum-Welch over all training documents. With E the expected counts of a round, C(k) their sum
over a state's tokens, c a token's count (0 of unseen ones), N and V the training tokens and distinct ones, and
W = N + 0.1 * (V + 1), P(token | k) is proportional to
E(token, k) + 0.1 * C(k) / N + (c + 0.1) / W * (PRIOR_TOKENS + PRIOR_SHARE * C(k)).
The scaled forward recursion then gives each text's exact likelihood, log10 P = sum of log10 scales. Probabilities are
scaled 4-byte floats, logarithms are summed in 8 bytes: a score is within 1e-6 of its size of a recursion in 8-byte floats.

Plan: the texts are written once as blocks of about BLOCK_TOKENS tokens, each with a dictionary of its own; trained and
scored texts share blocks. Tokens that several blocks hold are dealt into shards of about SHARD_PAIRS (block, token)
pairs. In every round a block sends a shard the expected counts of the tokens that both have, as one packed row, the
shard adds them up as whole numbers and sends each block its tokens' sums, and the block goes on from there. Tokens of
one block alone, most of all distinct ones, never leave it. What is gathered grows with the input and stays spread:
the driver sees the sums of starts, moves and states only, and nothing but those is broadcast.
Documents run through the recursion side by side, longest first, so that a step handles all texts that reach it.

Defined cases: null and empty texts have one token, the end; a null in `learns` counts as false; texts of any length go
through the recursion whole, at some hundred bytes a token; repeated rows count and are scored each; no training
documents: N and V are 0 and every token has probability 1, as in the base; an empty table gives an empty result; other
columns, whatever their names, are unread.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, drop, each_text, field, give_back, materialize, part_of

STATES, ROUNDS, SEED = 8, 3, 11
#: The first model: states last, and their emissions differ by chance by up to this share.
STAY, NOISE = 0.98, 0.9
#: Expected counts travel as whole numbers of this fraction: their sums are exact in any order.
PARTS = 1 << 12
#: Added to counts of tokens and of symbols; pseudo-counts of transitions.
ADD, SMOOTH, SMOOTH_MOVE = 0.1, 0.1, 1.0
#: A state's emissions are drawn to the tokens' frequencies by so many tokens, and this share of its own.
PRIOR_TOKENS, PRIOR_SHARE = 15_000, 0.02
END = b"\n"  # no word holds it
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Tokens that share a dictionary; that go through the recursion at once; (block, token) pairs of a shard.
BLOCK_TOKENS, PACK, SHARD_PAIRS = 3_000_000, 1_000_000, 400_000
#: A token's place: its block and its number there, in so many bits.
LOCAL_BITS = 28
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, label: str) -> DataFrame:
    """materialize(), after which Spark deletes the shuffles that the write alone needed."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return materialize(df, label)
    finally:
        conf.set(CLEANUP, before)


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.translate(LOWER).split(), END]


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: size of an item, number of items, then the planes."""
    size = 4 if not x.size or (x.max() < 1 << 31 and x.min() >= -(1 << 31)) else 8
    planes = np.ascontiguousarray(x.ravel().astype(f"<i{size}").view(np.uint8).reshape(-1, size).T)
    return np.array([size, x.size], "<i8").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    size, n = np.frombuffer(data, "<i8", 2).tolist()
    planes = np.frombuffer(pa.decompress(data[16:], decompressed_size=size * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(f"<i{size}").ravel()


def length_of(data: bytes) -> int:
    return int.from_bytes(data[8:16], "little")


class Numbers(dict):
    """token -> its number in order of appearance."""

    def __missing__(self, token: bytes) -> int:
        self[token] = out = len(self)
        return out


class Packed:
    """Texts side by side: sorted longest first, the tokens of step t stand together."""

    def __init__(self, texts: list[np.ndarray]):
        size = np.array([len(x) for x in texts], np.int64)
        self.order = np.argsort(-size, kind="stable")
        size = size[self.order]
        self.live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # texts with more than t tokens
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        self.symbols = np.empty(int(self.at[-1]), np.int32)
        for k, i in enumerate(self.order.tolist()):
            self.symbols[self.at[: size[k]] + k] = texts[i]


@dataclass
class Model:
    """What all blocks need: the chain, the totals of the corpus, and how expected counts become emissions."""

    total: int
    types: int
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    rates: tuple[np.ndarray, np.ndarray, np.ndarray]

    def emissions(self, expected: np.ndarray, counts: np.ndarray) -> np.ndarray:
        flat, share, whole = self.rates
        return ((expected / PARTS + flat + (counts[:, None] + SMOOTH) * share) / whole).astype(np.float32)


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, pack: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's log10 likelihood of its symbols; alphas and scales by token."""
    n, kind = len(pack.order), emit.dtype
    start, move = start.astype(kind), move.astype(kind)
    alphas = np.take(emit, pack.symbols, axis=0)  # emissions first, alphas in their place
    scales = np.empty(len(pack.symbols), kind)
    one = np.ones(len(start), kind)
    alpha = None
    for a, live in zip(pack.at[:-1].tolist(), pack.live.tolist()):
        here = alphas[a : a + live]
        here *= start if alpha is None else alpha[:live] @ move
        c = scales[a : a + live]
        np.dot(here, one, out=c)
        here /= c[:, None]
        alpha = here
    logs = np.log10(scales, dtype=np.float64)
    score = np.zeros(n)
    for a, live in zip(pack.at[:-1].tolist(), pack.live.tolist()):
        score[:live] += logs[a : a + live]
    out = np.empty(n)
    out[pack.order] = score
    return out, alphas, scales


def expected(start: np.ndarray, move: np.ndarray, emit: np.ndarray, pack: Packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch expected counts of starts, moves and (symbol, state)."""
    s = len(start)
    _, alphas, scales = forward(start, move, emit, pack)
    ahead = np.take(emit, pack.symbols, axis=0)  # emission * beta / scale of a token, in place
    ahead /= scales[:, None]
    back = np.ascontiguousarray(move.T.astype(emit.dtype))
    moves, late = np.zeros((s, s)), None
    for t in range(len(pack.live) - 1, -1, -1):
        a, live = pack.at[t], int(pack.live[t])
        here, gamma = ahead[a : a + live], alphas[a : a + live]
        if late is not None:
            k = len(late)
            beta = late @ back
            moves += gamma[:k].T @ late
            gamma[:k] *= beta
            here[:k] *= beta
        late = here
    moves *= move
    starts = alphas[: pack.live[0]].sum(axis=0, dtype=np.float64) if len(pack.live) else np.zeros(s)
    by = np.stack([np.bincount(pack.symbols, weights=alphas[:, k], minlength=len(emit)) for k in range(s)], axis=1)
    return starts, moves, by


def first_weights(marks: np.ndarray, states: int, seed: int) -> np.ndarray:
    """What one occurrence of a token counts in the first model, in PARTS; a token's chance comes from its own hash, its mark."""
    words = -(-states // 8)  # a byte of the hash for each state
    x = (marks.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    weight = np.rint((1 - NOISE + 2 * NOISE * (np.arange(256) + 0.5) / 256) / states * PARTS).astype(np.int64)
    return weight[np.ascontiguousarray(x).astype("<u8", copy=False).view(np.uint8)[:, :states]]


def rates(totals: np.ndarray, n: int, types: int, prior: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, share, whole) by state: a token's emission is (expected + flat + (count + SMOOTH) * share) / whole."""
    if not n:
        return np.zeros(len(totals)), np.full(len(totals), 1 / SMOOTH), np.ones(len(totals))
    flat, mass = SMOOTH * totals / n, n + SMOOTH * (types + 1)
    share = (PRIOR_TOKENS + PRIOR_SHARE * totals) / mass if prior else np.zeros(len(totals))
    return flat, share, totals + flat * (types + 1) + share * mass


def blocks(docs: DataFrame, learns: Column, text_col: str, keep: list[str], states: int, seed: int) -> DataFrame:
    """Written, for each text: the `keep` columns (k_), its block, whether it is learnt from, and its tokens' numbers; and for each block a row with its tokens, their marks and uses in learnt texts, and the first model's sums."""
    bounded_batches(docs.sparkSession)
    source = docs.select(*[F.col(f"`{c}`").alias(f"k_{c}") for c in keep], F.coalesce(learns, F.lit(False)).alias("learns"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kept = source.schema.fields[:-2]
    own = [field("block", "long"), field("learns", "boolean"), field("symbols", "binary"), field("tokens", "array<binary>"), field("uses", "array<int>"), field("marks", "binary"), field("first", "array<long>")]
    schema = T.StructType([*kept, *own])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, block = None, TaskContext.get().partitionId() << 16
        known, uses, held = Numbers(), np.zeros(0, np.int64), 0

        def dictionary() -> pa.RecordBatch:
            tokens = list(known)
            marks = np.fromiter(map(zlib.crc32, tokens), np.uint32, len(tokens))
            first = (first_weights(marks, states, seed) * uses[:, None]).sum(axis=0)
            values = [pa.array([v], t) for v, t in ((block, pa.int64()), (None, pa.bool_()), (None, pa.binary()), (tokens, pa.list_(pa.binary())), (uses, pa.list_(pa.int32())), (marks.tobytes(), pa.binary()), (first, pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in arrow], *values], names=schema.names)

        for batch in batches:
            arrow = [c.type for c in batch.columns[:-2]]
            if held >= BLOCK_TOKENS:
                yield dictionary()
                block, known, uses, held = block + 1, Numbers(), np.zeros(0, np.int64), 0
            symbols = [np.fromiter(map(known.__getitem__, tokens_of(t)), np.int32) for t in each_text(batch.column(batch.num_columns - 1))]
            learnt = batch.column(batch.num_columns - 2)
            held += sum(map(len, symbols))
            uses = np.concatenate((uses, np.zeros(len(known) - len(uses), np.int64)))
            if mine := [s for s, x in zip(symbols, learnt.to_pylist()) if x]:
                uses += np.bincount(np.concatenate(mine), minlength=len(known))
            n = batch.num_rows
            made = [pa.array(np.full(n, block, np.int64)), learnt, pa.array([packed(s) for s in symbols], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made, *[pa.nulls(n, t) for t in (pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))]], names=schema.names)
        if known:
            yield dictionary()
        give_back()

    return written(source.mapInArrow(encode, schema), "lm-blocks")


def shared_tokens(texts: DataFrame) -> DataFrame:
    """(block, local, uses, id, c) of the tokens that several blocks hold, written: id is a token's first place, c its count."""
    each = texts.where("tokens is not null").select("block", F.posexplode(F.arrays_zip("tokens", "uses")).alias("local", "t"))
    each = each.select("block", "local", F.col("t.tokens").alias("token"), F.col("t.uses").alias("uses"))
    by = Window.partitionBy("token")
    place = F.shiftleft("block", LOCAL_BITS).bitwiseOR(F.col("local").cast("long"))
    met = each.withColumn("id", F.min(place).over(by)).withColumn("c", F.sum("uses").over(by)).withColumn("n", F.count("*").over(by))
    return written(met.where("n > 1").select("block", "local", "uses", "id", "c"), "lm-shared")


def linked(shared: DataFrame, shards: int) -> DataFrame:
    """For each shard and block that have tokens in common, written: their numbers in the block (locals) and in the shard (places), their counts, and the shard's size."""
    dealt = shared.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), "block", "local", "id", "c")

    def link(table: pa.Table) -> pa.Table:
        block, local, id_, c = (table[x].to_numpy() for x in ("block", "local", "id", "c"))
        own, place = np.unique(id_, return_inverse=True)
        order = np.lexsort((local, block))
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        parts = np.split(order, cuts)
        n = len(parts)
        columns = [pa.array(np.full(n, table["shard"][0].as_py(), np.int64)), pa.array([int(block[p[0]]) for p in parts], pa.int64()), *[pa.array([packed(x[p]) for p in parts], pa.binary()) for x in (local, place, c)], pa.array(np.full(n, len(own), np.int64))]
        return pa.Table.from_arrays(columns, names=["shard", "block", "locals", "places", "counts", "size"])

    return written(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(link, "shard long, block long, locals binary, places binary, counts binary, size long"), "lm-links")


def summed(links: DataFrame, parts: DataFrame, states: int, shards: int) -> DataFrame:
    """(block, shard, sums): each block's tokens with the sums that all blocks' parts give."""
    rows = links.select("shard", "block", "places", "size").unionByName(parts.where("shard is not null").select("shard", "block", "part"), allowMissingColumns=True)

    def add(table: pa.Table) -> pa.Table:
        sent = table.filter(table["part"].is_valid())
        part = dict(zip(sent["block"].to_pylist(), sent["part"].to_pylist()))
        mine = table.filter(table["places"].is_valid())
        places = {b: unpacked(x) for b, x in zip(mine["block"].to_pylist(), mine["places"].to_pylist())}
        total = np.zeros((mine["size"][0].as_py(), states), np.int64)
        for b, x in part.items():
            total[places[b]] += unpacked(x).reshape(-1, states)
        shard = table["shard"][0].as_py()
        return pa.Table.from_arrays([pa.array(list(places), pa.int64()), pa.array([shard] * len(places), pa.int64()), pa.array([packed(total[x]) for x in places.values()], pa.binary())], names=["block", "shard", "sums"])

    return rows.repartition(shards, "shard").groupBy("shard").applyInArrow(add, "block long, shard long, sums binary")


def gathered(texts: DataFrame, links: DataFrame, parts: DataFrame | None, states: int, tasks: tuple[int, int]):
    """All that a block needs, grouped by block, in as many tasks as there are blocks (and shards): its texts and dictionary; what it shares; and, after a round, sums and its own tokens' counts."""
    out = texts.drop("tokens", "first") if parts is None else texts.drop("tokens", "first", "marks")
    out = out.unionByName(links.select("block", "shard", "locals", "counts"), allowMissingColumns=True)
    if parts is not None:
        out = out.unionByName(summed(links, parts, states, tasks[1]), allowMissingColumns=True).unionByName(parts.where("state is not null").select("block", "state"), allowMissingColumns=True)
    return out.repartition(tasks[0], "block").groupBy("block")


class Block:
    """One block's texts, counts and emissions."""

    def __init__(self, table: pa.Table, model: Model, seed: int):
        states, has = len(model.start), set(table.schema.names)
        valid = lambda c: table.filter(table[c].is_valid())
        self.texts = valid("symbols")
        words = valid("uses")
        uses = words["uses"].combine_chunks().values.to_numpy().astype(np.int64)
        self.counts, alone = uses.copy(), np.full(len(uses), True)
        self.links = []
        for shard, at, c in zip(*[valid("locals")[x].to_pylist() for x in ("shard", "locals", "counts")]):
            at = unpacked(at)
            self.counts[at], alone[at] = unpacked(c), False
            self.links.append((shard, at))
        self.own = np.flatnonzero(alone & (uses > 0))
        if "sums" in has:
            counts = np.zeros((len(uses), states), np.int64)
            sums = valid("sums")
            given = dict(zip(sums["shard"].to_pylist(), sums["sums"].to_pylist()))
            for shard, at in self.links:
                counts[at] = unpacked(given[shard]).reshape(-1, states)
            for x in valid("state")["state"].to_pylist():
                counts[self.own] = unpacked(x).reshape(-1, states)
        else:
            counts = first_weights(np.frombuffer(words["marks"][0].as_py(), np.uint32), states, seed) * self.counts[:, None]
        self.emit = model.emissions(counts, self.counts)

    def packs(self, texts: pa.Table) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
        """Places of texts of about PACK tokens together, with their symbols; texts of like lengths go together, as steps last as long as the longest."""
        column = texts["symbols"].to_pylist()
        size = np.array([length_of(x) for x in column], np.int64)
        order = np.argsort(-size, kind="stable")
        part = np.cumsum(size[order]) // PACK
        for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
            yield own, [unpacked(column[k]) for k in own.tolist()]


def trained(texts: DataFrame, links: DataFrame, model: Model, rounds: int, seed: int, tasks: tuple[int, int]) -> tuple[Model, DataFrame | None]:
    """The model after so many rounds, and the blocks' parts of the last one."""
    spark, states, parts = texts.sparkSession, len(model.start), None
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(model)

        def count(table: pa.Table) -> pa.Table:
            model = given.value  # noqa: B023
            block, here = table["block"][0].as_py(), Block(table, model, seed)
            starts, moves, by = np.zeros(states), np.zeros((states, states)), np.zeros((len(here.emit), states))
            for _, symbols in here.packs(here.texts.filter(here.texts["learns"])):
                a, b, c = expected(model.start, model.move, here.emit, Packed(symbols))
                starts, moves, by = starts + a, moves + b, by + c
            found = np.rint(by * PARTS).astype(np.int64)
            sums = np.concatenate((np.rint(np.vstack((starts, moves)) * PARTS).astype(np.int64).ravel(), found.sum(axis=0)))
            n = len(here.links)
            columns = [pa.array([*[s for s, _ in here.links], None], pa.int64()), pa.array([block] * (n + 1), pa.int64()), pa.array([*[packed(found[at]) for _, at in here.links], None], pa.binary()), pa.array([*[None] * n, packed(found[here.own])], pa.binary()), pa.array([*[None] * n, sums], pa.list_(pa.int64()))]
            give_back()
            return pa.Table.from_arrays(columns, names=["shard", "block", "part", "state", "sums"])

        made = written(gathered(texts, links, parts, states, tasks).applyInArrow(count, "shard long, block long, part binary, state binary, sums array<long>"), "lm-parts")
        if parts is not None:
            drop(parts)
        parts = made
        few = np.array(parts.where("sums is not null").select(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(states * (states + 2))]).first(), object)
        found = np.array([x or 0 for x in few], float).reshape(states + 2, states) / PARTS
        start, move = found[0] + SMOOTH_MOVE, found[1:-1] + SMOOTH_MOVE
        model = Model(model.total, model.types, start / start.sum(), move / move.sum(axis=1, keepdims=True), rates(found[-1], model.total, model.types, True))
    return model, parts


def scored(docs: DataFrame, learns: Column, keep: list[str], *, text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = SEED, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """The `keep` columns (k_ before their names), then n_tokens, n_known, train_tokens, base_score and score of all rows; learnt from those that `learns` names."""
    texts = blocks(docs, learns, text_col, keep, states, seed)
    shared = shared_tokens(texts)
    own = texts.where("uses is not null").select(F.expr("aggregate(uses, 0L, (s, x) -> s + x)").alias("n"), F.expr("size(filter(uses, x -> x > 0))").alias("types"), "first")
    at = own.agg(F.sum("n"), F.sum("types"), F.count("*"), *[F.sum(F.col("first")[k]) for k in range(states)]).first()
    total, first = at[0] or 0, np.array([x or 0 for x in at[3:]], float)
    place = F.shiftleft("block", LOCAL_BITS).bitwiseOR(F.col("local").cast("long"))
    pairs, twice = shared.agg(F.count("*"), F.coalesce(F.count_if(F.col("uses") > 0) - F.count_if((place == F.col("id")) & (F.col("c") > 0)), F.lit(0))).first()
    types = (at[1] or 0) - twice
    tasks = max(1, at[2]), 1 + pairs // shard_pairs
    links = linked(shared, tasks[1])
    drop(shared)
    move = np.full((states, states), (1 - STAY) / max(1, states - 1)) + np.eye(states) * STAY
    model = Model(total, types, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), rates(first / PARTS, total, types, False))
    model, parts = trained(texts, links, model, rounds, seed, tasks)
    given = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in texts.schema.fields if f.name.startswith("k_")]
    schema = T.StructType([*kept, *[field(n, "long") for n in ("n_tokens", "n_known")], *[field(n, "double") for n in ("base_score", "score")]])

    def score(table: pa.Table) -> pa.Table:
        model = given.value
        here = Block(table, model, seed)
        logs = np.log10(here.counts + ADD) - np.log10(model.total + ADD * (model.types + 1))
        made = np.zeros((4, len(here.texts)))
        for own, symbols in here.packs(here.texts):
            made[:3, own] = np.array([(len(x), (here.counts[x] > 0).sum(), logs[x].sum()) for x in symbols]).T
            made[3, own] = forward(model.start, model.move, here.emit, Packed(symbols))[0]
        give_back()
        return pa.Table.from_arrays([*[here.texts[f.name].combine_chunks() for f in kept], *[pa.array(x.astype(np.int64)) for x in made[:2]], *[pa.array(x) for x in made[2:]]], names=schema.names)

    out = gathered(texts, links, parts, states, tasks).applyInArrow(score, schema)
    return out.select(*[f"`{f.name}`" for f in kept], "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id", modulus: int = 10, remainder: int = 0) -> Column:
    return F.coalesce(part_of(id_col, modulus) == remainder, F.lit(False))
