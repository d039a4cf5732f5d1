"""The trie of conversations' prefixes: nodes shared by conversations, their sizes and what sharing them saves.

Conversations are first rebuilt (rebuilt()): the head of conversation c - c % 5 takes the place of as many own turns. A
node is a distinct sequence of first turns; it is named by its depth and a 128-bit XOR of hashes of (depth, turn), which a
windowed aggregate carries from turn to turn in chunks of CHUNK turns, so no conversation has to be in one task.

Plan: one scan turns texts into digests and byte counts; texts move no further. Turns are range-sorted into runs, whose
counts give positions. An aggregate over prefixes, with partial sums, makes the nodes. What lies below a node with a single
member is a path whose figures are known, so only shared nodes and the first single node of each conversation enter tries.
Nodes with more than `limit` turns at or below them (at most 2^16 times the depth, as the limit grows with all turns) are the
upper levels. Every other subtree goes, by the hash of its top, to a prefix shard: numpy numbers its nodes in level order,
builds the LOUDS bits (a node's children in unary, closed by a zero) and label arrays, finds parents as rank0(select1), and
adds each level to the one above, from the last one, with add.at. The sums of the shards' tops then enter the upper levels,
a tree built the same way. Ids that end at a node are joined in blocks of 4,096 consecutive ids and hashed as a sorted stream.

Memory: a shard holds about twice `limit` nodes, the upper levels 2^16 times the depth of shared nodes; a chain shared by two
conversations of a length beyond `limit` adds its length. SHA-256 over the ids that end at one node is one stream by nature.

Defined cases: turns of equal number go by the digest of role and text; repeated rows are turns of their own; null role and
text are empty, a null turn comes first; rows without conv_id belong to no conversation and are left out; an empty table has
no nodes; texts of any length are hashed whole; other columns, whatever their names, are unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .merkle import placed

#: Turns of a chunk, and consecutive ids of a block, as powers of two; turns below a node of the upper levels, at least.
CHUNK, BLOCK, LIMIT, UPPER = 12, 12, 1024, 1 << 16
#: Members of upper nodes are marked by broadcast up to so many of them.
BROADCAST = 1_000_000
HEADS, FAMILY = 9, 5
NODE = ["depth", "a", "b"]
EMPTY = hashlib.sha256(b"").hexdigest()
ROLLED = "depth long, a long, b long, pa long, pb long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def turns_of(conversations: DataFrame) -> DataFrame:
    """c, pos (from 0), size, node (a turn's digest), bytes."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("grp"), F.col("turn").cast("long").alias("turn"), digest.alias("node"), F.octet_length(text).cast("long").alias("bytes"))
    return materialize(placed(rows, ["turn"]).select(F.col("grp").alias("c"), "pos", "size", "node", "bytes"), "trie-turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (c, length) and their turns (c, length, depth, node, bytes)."""
    sizes = turns.where("pos = 0").select("c", "size", (F.col("c") - F.col("c") % FAMILY).alias("p"), F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(HEADS)).alias("h"))
    heads = sizes.where("c = p").select(F.col("c").alias("p"), F.col("size").alias("head"))
    convs = sizes.join(heads, "p", "left").withColumn("k", F.least("h", F.coalesce("head", F.lit(0))))
    convs = materialize(convs.select("c", "p", "h", "k", "size", (F.col("k") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "trie-conversations")
    # A long conversation's turns meet their conversation chunk by chunk.
    chunks = convs.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("size") - 1, CHUNK))))
    own = turns.select("c", "pos", "node", "bytes", F.shiftright("pos", CHUNK).alias("chunk")).join(chunks, ["c", "chunk"]).where("pos >= h")
    own = own.select("c", "length", (F.col("k") + F.col("pos") - F.col("h") + 1).alias("depth"), "node", "bytes")
    first = turns.where(f"pos < {HEADS - 1} and c % {FAMILY} = 0").select(F.col("c").alias("p"), "pos", "node", "bytes")
    begun = convs.select("c", "p", "h", "length").join(first, "p").where("pos < h").select("c", "length", (F.col("pos") + 1).alias("depth"), "node", "bytes")
    return convs.select("c", "length"), own.unionByName(begun)


def prefixes(rows: DataFrame) -> DataFrame:
    """c, length, depth, bytes and the names of the prefix (a, b) and of the one before it (pa, pb)."""
    rows = rows.select("c", "length", "depth", "bytes", *[F.xxhash64(F.lit(k), "depth", "node").alias(f"t{n}") for k, n in ((1, "a"), (2, "b"))], F.shiftright(F.col("depth") - 1, CHUNK).alias("chunk"))
    rows = materialize(rows, "trie-rows")
    upto = W.partitionBy("c", "chunk").orderBy("depth")
    rows_in = rows.withColumns({x: F.bit_xor(f"t{x}").over(upto) for x in "ab"})
    whole = rows.where(F.col("length") > 1 << CHUNK).groupBy("c", "chunk").agg(*[F.bit_xor(f"t{x}").alias(f"w{x}") for x in "ab"])
    before = W.partitionBy("c").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select("c", "chunk", *[F.bit_xor(f"w{x}").over(before).alias(f"w{x}") for x in "ab"]).where("chunk > 0")
    far = rows_in.where("chunk > 0").join(carried, ["c", "chunk"]).withColumns({x: F.col(x).bitwiseXOR(F.col(f"w{x}")) for x in "ab"}).drop("wa", "wb")
    out = rows_in.where("chunk = 0").unionByName(far)
    return materialize(out.select("c", "length", "depth", "bytes", "a", "b", *[F.col(x).bitwiseXOR(F.col(f"t{x}")).alias(f"p{x}") for x in "ab"]), "trie-prefixes")


def nodes_of(rows: DataFrame) -> DataFrame:
    """One row a node: its members, the least of them, and turns at or below it."""
    made = rows.groupBy(*NODE).agg(F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("bytes").alias("bytes"), F.sum(F.col("length") - F.col("depth") + 1).alias("below"), F.max("length").alias("length"))
    return materialize(made, "trie-nodes")


def louds(degrees: np.ndarray) -> np.ndarray:
    """Level-order bits: each node's children in unary, closed by a zero; the first node is the root above all tops."""
    bits = np.ones(int(degrees.sum()) + len(degrees), bool)
    bits[np.cumsum(degrees + 1) - 1] = False
    return bits


def level_order(nodes: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """The nodes in level order, siblings by label (their least member), and each one's number of children, the root's first."""
    keys = list(map(tuple, nodes[NODE].to_numpy()))
    at = {k: i for i, k in enumerate(keys)}
    parent = np.fromiter((at.get((d - 1, a, b), -1) for d, a, b in nodes[["depth", "pa", "pb"]].to_numpy()), np.int64, len(nodes))
    level = np.zeros(len(nodes), np.int64)
    place = np.full(len(nodes) + 1, -1, np.int64)  # of each row in level order; the last one is the root above
    order, label = [], nodes["conv_id"].to_numpy()
    by_depth = np.argsort(nodes["depth"].to_numpy(), kind="stable")
    for i in by_depth:
        level[i] = level[parent[i]] + 1 if parent[i] >= 0 else 0
    done = 0
    by_level = np.argsort(level, kind="stable")
    for rows in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        rows = rows[np.lexsort((rows, label[rows], place[parent[rows]]))]
        place[rows] = done + np.arange(len(rows))
        done += len(rows)
        order.append(rows)
    order = np.concatenate(order)
    degrees = np.bincount(place[parent[order]] + 1, minlength=len(nodes) + 1)
    return nodes.iloc[order].assign(level=level[order]), degrees


def rolled(nodes: pd.DataFrame) -> pd.DataFrame:
    """The figures of all nodes of a shard: what more_* columns bring from below, summed upwards along the LOUDS bits."""
    nodes, degrees = level_order(nodes)
    bits = louds(degrees)
    ones = np.flatnonzero(bits)
    parent = ones - np.arange(len(ones)) - 1  # zeros before the i-th one, less the root above
    children = degrees[1:] + nodes["more_children"].to_numpy()
    leaves = nodes["more_leaves"].to_numpy() + (children == 0)
    saved = nodes["more_saved"].to_numpy() + (nodes["n_convs"].to_numpy() - 1) * nodes["bytes"].to_numpy()
    level = nodes["level"].to_numpy()
    starts = np.searchsorted(level, np.arange(level[-1] + 2))
    for k in range(level[-1], 0, -1):
        here = slice(starts[k], starts[k + 1])
        np.add.at(leaves, parent[here], leaves[here])
        np.add.at(saved, parent[here], saved[here])
    label = nodes["conv_id"].to_numpy()
    single = nodes["n_convs"].to_numpy() == 1
    out = nodes[[*NODE, "pa", "pb", "conv_id", "n_convs"]].assign(
        parent_conv_id=pd.array(np.where(parent < 0, 0, label[parent]), "Int64"),
        n_children=np.where(single & (children == 0), nodes["length"].to_numpy() > nodes["depth"].to_numpy(), children).astype(np.int64),
        n_leaves=leaves,
        saved_tokens=saved,
        top=parent < 0,
    )
    out.loc[out["top"], "parent_conv_id"] = pd.NA
    return out


ORDER = [part.split()[0] for part in ROLLED.split(", ")]


def roll_shard(rows: pa.Table) -> pa.Table:
    out = rolled(rows.to_pandas())[ORDER]
    return pa.Table.from_pandas(out, preserve_index=False).cast(pa.schema([(n, pa.bool_() if n == "top" else pa.int64()) for n in ORDER]))


def ends_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """NODE columns and ends_sha256 of nodes at which conversations end."""
    last = rows.where("depth = length").select(*NODE, "c")
    zero = F.lit(0).cast("long")
    last = last.unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "c"))
    blocks = last.groupBy(*NODE, F.shiftright("c", BLOCK).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        names = [*NODE, "ends_sha256"]
        for batch in batches:
            out = []
            for *now, ids in zip(*[batch.column(batch.schema.get_field_index(n)).to_pylist() for n in (*NODE, "ids")]):
                if now != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=names)

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").mapInArrow(stream, "depth long, a long, b long, ends_sha256 string")


def below_singles(tops: DataFrame) -> DataFrame:
    """The nodes below each conversation's first single node: a path, so their figures are known."""
    size = 1 << CHUNK
    long = F.lit(1).cast("long")
    tops = tops.where("length > depth").select("conv_id", "length", F.explode(F.expr(f"sequence(depth + 1, length, {size}L)")).alias("first"))
    each = tops.select("conv_id", "length", F.explode(F.expr(f"sequence(first, least(length, first + {size - 1}))")).alias("depth"))
    is_last = F.col("depth") == F.col("length")
    ends = F.when(is_last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    return each.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), long.alias("n_convs"), (~is_last).cast("long").alias("n_children"), long.alias("n_leaves"), (long * 0).alias("saved_tokens"), ends.alias("ends_sha256"))


def hashed(*columns: str) -> Column:
    return F.xxhash64(*columns)


def prefix_trie(conversations: DataFrame, *, limit: int = LIMIT) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs, turns = rebuilt(turns_of(conversations))
    rows = prefixes(turns)
    nodes = nodes_of(rows)
    total = int(rows.count())
    limit = max(limit, total // UPPER)
    shared = nodes.where("n_convs > 1")
    single = F.min_by(F.struct("depth", "a", "b", "pa", "pb", "bytes", "length"), "depth")
    tops = materialize(nodes.where("n_convs = 1").groupBy("conv_id").agg(single.alias("s")).select("conv_id", "s.*"), "trie-singles")
    nothing = {f"more_{x}": F.lit(0).cast("long") for x in ("children", "leaves", "saved")}
    heavy = shared.where(F.col("below") > limit)
    light = shared.where(F.col("below") <= limit).drop("below").unionByName(tops.withColumn("n_convs", F.lit(1).cast("long")))

    marks = heavy.select(*NODE)
    marks = F.broadcast(marks) if heavy.count() <= BROADCAST else marks
    begins = rows.join(marks, NODE, "left_anti").groupBy("c").agg(F.min_by(F.struct("a", "b"), "depth").alias("top")).select(F.col("c").alias("conv_id"), "top.*")
    begins = begins.select("conv_id", F.pmod(hashed("a", "b"), F.lit(max(1, -(-total // (2 * limit))))).alias("shard"))
    sharded = light.join(begins, "conv_id").withColumns(nothing)
    lower = materialize(sharded.groupBy("shard").applyInArrow(lambda t: roll_shard(t), ROLLED), "trie-shards")

    up = lower.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("length").alias("length")).where("n_convs > 0")
    # The root's parent is named like no node.
    root = root.select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), (zero - 1).alias("pa"), (zero - 1).alias("pb"), "conv_id", "n_convs", zero.alias("bytes"), "length")
    upper = root.unionByName(heavy.drop("below")).join(up, NODE, "left").fillna(0, list(nothing))
    # The upper levels are one tree of a bounded number of nodes.
    upper = materialize(upper.withColumn("tree", F.lit(0)).groupBy("tree").applyInArrow(lambda t: roll_shard(t), ROLLED), "trie-upper")

    over = upper.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("over"))
    joined = lower.join(over, ["depth", "pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over")).drop("over")
    out = joined.unionByName(upper).join(ends_of(rows, convs), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return out.select(*columns).unionByName(below_singles(tops).select(*columns))
