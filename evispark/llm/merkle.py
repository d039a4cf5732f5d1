"""Merkle manifest of a table: a node store on disk, proofs by coordinate, and their verification.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its UTF-8 byte count, `:` and its value. Leaves ascend within
their group; while a group has several nodes, every two consecutive ones (a last one alone) become the SHA-256 of their
digests' hex text. What remains is the group's subroot; subroots, ordered by group (null first, UTF-8 bytewise), give the
root in the same way. A node's coordinate is (group, level, position).

Plan: one scan of the table hashes the leaves, natively; only 32-byte digests move from there on. They are range-sorted
into runs, a run's rows numbered as they stand, and counts of (group, run) turn the numbers into positions. Blocks of
2^BITS positions stream through a task each, which writes all levels of its block to Parquet laid out by level; the tops of
the blocks are the next pass's leaves, read back from their level alone (two passes make 16 million leaves, three 68 billion).
Proofs go the other way: the top pass first, each pass's targets meet their block's nodes by coordinate in a sorted merge,
and a block's own path is passed on once a block. No group, however large, is in one task: a block has 4,096 rows at most.

Defined cases: null groups are the first group; null order values come first, equal ones go by leaf and, for rows that are
equal altogether, by their place in the input (their proofs differ, the set of results doesn't); a group of one row has
its leaf as subroot, a table of one group its subroot as root; an empty table has no rows and root None; texts of any
length are hashed whole; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _written, materialize, shared_dir

#: A block has 2^BITS nodes of its lowest level.
BITS = 12
#: One step of a path: its side (0: the sibling is on the left, 1: on the right, 2: there is none) and the sibling's digest.
STEP, LEFT, RIGHT, ALONE = 33, 0, 1, 2
NODES = "grp string, block long, pos long, node binary, size long, done boolean, level int"
PATHS = "path binary, subroot binary"


def leaf_of(*columns: Column) -> Column:
    """The digest (32 bytes) of a row's fields."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]).cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def group_of(col: Column) -> Column:
    """The group as text that sorts null first and has no null."""
    return F.when(col.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), col.cast("string")))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (grp, node, `order` and more) with pos, its place in its group, and size, the group's."""
    keys = ["grp", *order, "node", "at"]
    runs = leaves.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("at")
    runs = materialize(runs.select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at")), "merkle-runs")
    spans = runs.groupBy("grp", "run").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # The runs of one group are no more than the partitions of the sort.
    spans = spans.selectExpr("grp", "run", "first - sum(n) OVER (PARTITION BY grp ORDER BY run) + n AS shift", "sum(n) OVER (PARTITION BY grp) AS size")
    return runs.join(spans, ["grp", "run"]).withColumn("pos", F.col("at") - F.col("shift")).drop("at", "run", "shift")


def depth_of(size: int) -> int:
    """How many levels lie above the leaves of a group of so many."""
    return max(0, int(size) - 1).bit_length()


def digests(column: pa.ChunkedArray) -> np.ndarray:
    """A binary column of 32 bytes each as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def levels_of(nodes: np.ndarray, upto: int) -> Iterator[np.ndarray]:
    """The levels above nodes, each made of the one below."""
    for _ in range(upto):
        text = nodes.tobytes().hex().encode()
        nodes = np.frombuffer(b"".join(hashlib.sha256(text[at : at + 128]).digest() for at in range(0, len(text), 128)), np.uint8).reshape(-1, 32)
        yield nodes


def whole_block(base: int, bits: int):
    """All levels of one block of level `base`."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        grp, block = (k.as_py() for k in key)
        size = rows.column("size")[0].as_py()
        upto = min(bits, depth_of(size))
        nodes = digests(rows.column("node"))[np.argsort(rows.column("pos").to_numpy())]
        made = [nodes, *levels_of(nodes, upto)]
        of = lambda make: np.concatenate([make(k, len(x)) for k, x in enumerate(made)])
        total = sum(map(len, made))
        top = (np.arange(total) == total - 1) if size > 1 or not base else np.ones(total, bool)
        return pa.table({
            "grp": pa.array([grp], pa.string()).take(pa.array(np.zeros(total, np.int64))),
            "block": np.full(total, block),
            "pos": of(lambda k, n: (block << (bits - k)) + np.arange(n)),
            "node": pa.array([bytes(x) for level in made for x in level], pa.binary()),
            "size": pa.array(np.full(total, -(-size // (1 << bits))), mask=~top),
            "done": pa.array(np.full(total, size <= 1 << bits), mask=~top),
            "level": of(lambda k, n: np.full(n, base + k)).astype(np.int32),
        })

    return build


@dataclass
class Forest:
    """Groups of placed leaves, and the node store: a folder of levels for each pass."""

    leaves: DataFrame
    passes: list[DataFrame]

    def tops(self, k: int, done: bool) -> DataFrame:
        """The tops of pass k's blocks, in groups that end there or in those that go on."""
        return self.passes[k].where(F.col("done") if done else ~F.col("done"))

    def subroots(self) -> DataFrame:
        """grp, node: one row a group."""
        found = self.tops(0, True)
        for k in range(1, len(self.passes)):
            found = found.unionByName(self.tops(k, True))
        return found.select("grp", "node")


def stored(nodes: DataFrame) -> DataFrame:
    """Nodes written by level, ordered by coordinate; read back with their schema."""
    spark = nodes.sparkSession
    path = f"{shared_dir(spark)}/evispark/merkle-levels-{uuid.uuid4().hex}"
    nodes.sortWithinPartitions("level", "grp", "pos").write.partitionBy("level").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(NODES).parquet(path)


def built(leaves: DataFrame) -> Forest:
    """All levels of all groups of placed() leaves."""
    passes, nodes = [], leaves.select("grp", "pos", "node", "size")
    while True:
        blocks = nodes.withColumn("block", F.shiftright("pos", BITS)).groupBy("grp", "block")
        passes.append(stored(blocks.applyInArrow(whole_block(BITS * len(passes), BITS), NODES)))
        more = Forest(leaves, passes).tops(len(passes) - 1, False)
        if more.isEmpty():
            return Forest(leaves, passes)
        nodes = more.select("grp", F.col("block").alias("pos"), "node", "size")


def block_paths(base: int, bits: int, schema: pa.Schema):
    """Targets of a block with the block's nodes: each target's path through the block, then the block's own."""

    def extract(key: tuple, targets: pa.Table, nodes: pa.Table) -> pa.Table:
        level, pos, node = nodes.column("level").to_numpy(), nodes.column("pos").to_numpy(), nodes.column("node")
        tail = np.frombuffer(node[int(np.flatnonzero(level < 0)[0])].as_py(), np.uint8)
        n, low = targets.num_rows, (key[1].as_py() << bits)
        at = targets.column("pos").to_numpy() - low
        steps = []
        for k in range(level.max() - base):
            here = np.flatnonzero(level == base + k)
            siblings = digests(node.take(pa.array(here[np.argsort(pos[here])])))
            sibling = (at >> k) ^ 1
            there = sibling < len(siblings)
            step = np.zeros((n, STEP), np.uint8)
            step[:, 0] = np.where(there, np.where(sibling < at >> k, LEFT, RIGHT), ALONE)
            step[there, 1:] = siblings[sibling[there]]
            steps.append(step)
        path = np.concatenate([*steps, np.broadcast_to(tail[32:], (n, len(tail) - 32))], axis=1)
        ends = np.arange(n + 1, dtype=np.int32) * path.shape[1]
        packed = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(path.tobytes())])
        more = {"path": packed, "subroot": pa.array([tail[:32].tobytes()] * n, pa.binary())}
        return pa.table([more[f.name] if f.name in more else targets.column(f.name) for f in schema], names=schema.names).cast(schema)

    return extract


def proved(forest: Forest, suffixes: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """targets (rows of forest.leaves; all, if not given) with path and subroot.

    suffixes: grp, subroot, path: what follows above each group's subroot.
    """
    above = None
    for k in reversed(range(len(forest.passes))):
        ends = forest.tops(k, True).select("grp", "block").join(suffixes, "grp")
        tails = ends if above is None else ends.unionByName(above)
        tails = tails.select("grp", "block", F.lit(0).cast("long").alias("pos"), F.concat("subroot", "path").alias("node"), F.lit(-1).alias("level"))
        nodes = forest.passes[k].select("grp", "block", "pos", "node", "level").unionByName(tails)
        if k:
            rows = forest.tops(k - 1, False).select("grp", F.col("block").alias("pos"))
        else:
            rows = targets if targets is not None else forest.leaves
        rows = rows.withColumn("block", F.shiftright("pos", BITS))
        kept = [f for f in rows.schema.fields if f.name != "block"]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), PATHS])
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "int": pa.int32()}
        arrow = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in kept] + [("path", pa.binary()), ("subroot", pa.binary())])
        above = rows.groupBy("grp", "block").cogroup(nodes.groupBy("grp", "block")).applyInArrow(block_paths(BITS * k, BITS, arrow), schema)
        if k:
            above = materialize(above.withColumnRenamed("pos", "block"), "merkle-paths")
    return above


@dataclass
class Manifest:
    """forest: the rows' groups. upper: the tree over subroots. root: its digest in hex, None for an empty table."""

    forest: Forest
    upper: Forest
    root: str | None

    def proofs(self, targets: DataFrame | None = None) -> DataFrame:
        """Rows of forest.leaves with path (steps from leaf to root) and subroot."""
        none = self.upper.leaves.sparkSession.createDataFrame([("", bytes(32), b"")], "grp string, subroot binary, path binary")
        heads = proved(self.upper, none).select(F.col("of").alias("grp"), F.col("node").alias("subroot"), "path")
        return proved(self.forest, materialize(heads, "merkle-heads"), targets)


def manifest(leaves: DataFrame, order: list[str]) -> Manifest:
    """leaves: grp (of group_of), node (of leaf_of), `order` and further columns (string, bigint, int, binary, boolean) to carry."""
    forest = built(materialize(placed(materialize(leaves, "merkle-leaves"), order), "merkle-placed"))
    heads = forest.subroots().select(F.lit("").alias("grp"), F.col("grp").alias("of"), "node")
    upper = built(materialize(placed(materialize(heads, "merkle-subroots"), ["of"]), "merkle-upper"))
    last = upper.subroots().first()
    return Manifest(forest, upper, bytes(last["node"]).hex() if last else None)


def steps_of(path: Column) -> Column:
    """A path as an array of (side, digest in hex)."""
    at = lambda i, first, n: F.substring(path, i * STEP + first, n)
    each = F.transform(F.sequence(F.lit(0), (F.length(path) / STEP).cast("int") - 1), lambda i: F.struct(F.conv(F.hex(path.substr(i * STEP + 1, F.lit(1))), 16, 10).cast("int").alias("side"), hex_of(path.substr(i * STEP + 2, F.lit(32))).alias("digest")))
    return F.when(F.length(path) >= STEP, each).otherwise(F.slice(F.array(F.struct(F.lit(0).alias("side"), F.lit("").alias("digest"))), 1, 0))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of a proof's siblings, from leaf to root."""
    return F.sha2(F.array_join(F.transform(F.filter(steps, lambda s: s["side"] != ALONE), lambda s: s["digest"]), "").cast("binary"), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf (hex) and a proof's steps give."""
    beside = lambda s, side: F.when(s["side"] == side, s["digest"]).otherwise("")
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(beside(s, LEFT), node, beside(s, RIGHT)).cast("binary"), 256))
