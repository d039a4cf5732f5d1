"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Nearness is the inner product. In a shard, vectors get one more component that makes all norms equal, so that the nearest by
distance are those of the largest product. Equal vectors are one node with all their rows. Points enter the graph in batches:
a greedy search from the entry nodes proposes neighbours, relaxed distance pruning keeps a diverse few of them (a candidate
goes if one that is kept is ALPHA times nearer to it than the point is), and reverse edges are added and pruned likewise.
A query's beam starts at the entry nodes and widens the REACH best found until all of them are expanded; what it found is
scored anew in double precision on the original vectors.

Plan: rows are dealt by hash into shards of about PER rows, and each shard's graph is written as one Parquet row of fixed
size bounds. Queries are broadcast in blocks of BLOCK_BYTES; each task keeps its shards' best k of a block, a group-limited
window the best of all. A block's results are written before the next one, so nothing grows with the number of blocks but
the files. Every shard is searched for every query: shards, hence work for a query, grow with the rows, at beam cost
(some hundred products) for each PER rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor rows without an
id; vectors meet those of their own length only; repeated rows are candidates of their own, and queries of their own; ties
go to the smaller id; shards of up to ENTRIES different vectors are searched whole; with fewer than k candidates all are
returned; an empty table gives no rows; other columns, whatever their names, are unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a shard; edges of a node; width of a beam that proposes neighbours, and of a query's; nodes that a step expands; nodes that a beam starts at.
PER, DEGREE, BEAM, REACH, STEP, ENTRIES = 8192, 32, 64, 128, 4, 64
ALPHA, BATCH, BLOCK_BYTES = 1.2, 256, 16 << 20
VECTORS = "uid long, vec_id long, dim int, x binary"
SHARD = "dim int, ids binary, uids binary, ends binary, points binary, edges binary"
HITS = "query_uid long, query_id long, vec_id long, uid long, score double"


def ready(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """uid (of the row), vec_id, dim and x (bytes of doubles) of the vectors that take part."""
    source = rows.where(f"`{id_col}` is not null").select(F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uid, vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(v).all() and v.any():
                        out.append((uid, vec_id, len(v), v.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["uid", "vec_id", "dim", "x"])

    return materialize(source.mapInArrow(scan, VECTORS), "ann-vectors")


def level(points: np.ndarray) -> np.ndarray:
    """Points (single precision, scaled to a largest norm of 1) with a component more, so that all norms are 1."""
    scale = np.abs(points).max()
    points = points / scale
    norms = (points * points).sum(1)
    points = points / np.sqrt(norms.max())
    more = np.sqrt(np.maximum(0, 1 - norms / norms.max()))
    return np.concatenate([points, more[:, None]], axis=1).astype(np.float32)


def beam_search(points: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, width: int) -> np.ndarray:
    """For each query, `width` nodes of the largest products that a beam finds, best first; -1 where it finds fewer."""
    n, q = len(points), len(queries)
    row = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)  # the last column stands for missing edges
    seen[:, n] = True
    seen[:, entries] = True
    found = np.broadcast_to(entries, (q, len(entries)))
    score = queries @ points[entries].T
    fresh = np.ones(found.shape, bool)
    while True:
        best = np.argsort(-score, axis=1, kind="stable")[:, :width]
        found, score, fresh = found[row, best], score[row, best], fresh[row, best]
        if not fresh.any():
            break
        # The STEP best nodes that aren't expanded yet, of those beams that have any.
        pick = np.argsort(~fresh, axis=1, kind="stable")[:, :STEP]
        use = fresh[row, pick]
        near = np.where(use[:, :, None], edges[np.where(use, found[row, pick], 0)], n).reshape(q, -1)
        fresh[row, pick] = False
        new = ~seen[row, near]
        seen[row, near] = True
        near = np.sort(np.where(new, near, n), axis=1)
        new = near < n
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        most = int(new.sum(1).max(initial=0))
        if most:
            order = np.argsort(~new, axis=1, kind="stable")[:, :most]
            near, new = near[row, order], new[row, order]
            own = np.where(new, np.einsum("qkd,qd->qk", points[np.where(new, near, 0)], queries), -np.inf)
            found, score, fresh = np.concatenate([found, near], 1), np.concatenate([score, own], 1), np.concatenate([fresh, new], 1)
    return np.where(np.isfinite(score), found, -1)


def pruned(points: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Each own node's kept neighbours of its candidates (-1: none), at most `degree`."""
    row = np.arange(len(own))[:, None]
    candidates = np.sort(candidates, axis=1)
    there = (candidates >= 0) & (candidates != own[:, None])
    there[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    vectors = points[np.where(there, candidates, 0)]
    far = np.where(there, 2 - 2 * np.einsum("bkd,bd->bk", vectors, points[own]), np.inf)
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far, vectors = candidates[row, order], far[row, order], vectors[row, order]
    between = 2 - 2 * np.einsum("bkd,bjd->bkj", vectors, vectors, optimize=True)
    alive = np.isfinite(far)
    kept = np.full((len(own), degree), -1, np.int32)
    for k in range(degree):
        if not alive.any():
            break
        first = alive.argmax(1)
        some = alive[row[:, 0], first]
        kept[some, k] = candidates[row[:, 0], first][some]
        alive &= ~(some[:, None] & (alpha * alpha * between[row[:, 0], first] <= far))
        alive[row[:, 0], first] = False
    return kept


def entry_nodes(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))


def graph_of(points: np.ndarray, degree: int = DEGREE, width: int = BEAM, alpha: float = ALPHA) -> np.ndarray:
    """The neighbours (n, degree) of levelled points; n stands for a missing one."""
    n = len(points)
    random = np.random.default_rng(7)
    edges = np.full((n, degree), n, np.int32)
    entries = entry_nodes(n)
    for lo in range(0, n, 1024):  # a few random edges to begin with
        few = random.integers(0, n, (min(1024, n - lo), 8))
        edges[lo : lo + len(few), :8] = few
    order = random.permutation(n)
    for own in np.array_split(order, -(-n // BATCH)):
        found = beam_search(points, edges, entries, points[own], width)
        kept = pruned(points, own, np.concatenate([found, np.where(edges[own] < n, edges[own], -1)], 1), degree, alpha)
        edges[own] = np.where(kept >= 0, kept, n)
        to, source = kept.ravel(), np.repeat(own, degree)
        source, to = source[to >= 0], to[to >= 0]
        by = np.argsort(to, kind="stable")
        to, source = to[by], source[by]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for few in np.array_split(np.arange(len(targets)), max(1, -(-len(targets) // BATCH))):
            if not len(few):
                continue
            most = int(counts[few].max())
            at = first[few][:, None] + np.arange(most)
            new = np.where(np.arange(most) < counts[few][:, None], source[np.minimum(at, len(source) - 1)], -1)
            old = edges[targets[few]]
            kept = pruned(points, targets[few], np.concatenate([np.where(old < n, old, -1), new], 1), degree, alpha)
            edges[targets[few]] = np.where(kept >= 0, kept, n)
    return edges


def indexed_shard(rows: pa.Table) -> pa.Table:
    """A shard as one row: its rows' ids by node, the nodes' vectors and edges."""
    dim = rows.column("dim")[0].as_py()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float64).reshape(-1, dim)
    ids, uids = rows.column("vec_id").to_numpy(), rows.column("uid").to_numpy()
    nodes, node_of = np.unique(x, axis=0, return_inverse=True)
    by = np.lexsort((uids, ids, node_of.ravel()))
    ends = np.cumsum(np.bincount(node_of.ravel(), minlength=len(nodes)))
    # Nodes stand in the order of a shuffle, so that evenly spaced entries are a random sample.
    shuffle = np.random.default_rng(5).permutation(len(nodes))
    members = [by[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
    by = np.concatenate([members[k] for k in shuffle])
    ends = np.cumsum([len(members[k]) for k in shuffle]).astype(np.int64)
    nodes = np.ascontiguousarray(nodes[shuffle])
    edges = graph_of(level(nodes))
    return pa.table({"dim": pa.array([dim], pa.int32()), "ids": [ids[by].tobytes()], "uids": [uids[by].tobytes()], "ends": [ends.tobytes()], "points": [nodes.tobytes()], "edges": [edges.tobytes()]})


def index(vectors: DataFrame, per: int = PER) -> DataFrame:
    """One row a shard, written."""
    shards = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-vectors.count() // per))))
    return materialize(vectors.withColumn("shard", shards).groupBy("dim", "shard").applyInArrow(lambda t: indexed_shard(t), SHARD), "ann-graphs")


def shard_hits(shard: dict, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, uid, score) of each query's best k rows of a shard but its own row."""
    points = np.frombuffer(shard["points"], np.float64).reshape(-1, shard["dim"])
    edges = np.frombuffer(shard["edges"], np.int32).reshape(len(points), -1)
    ends, ids, uids = (np.frombuffer(shard[c], np.int64) for c in ("ends", "ids", "uids"))
    begins = np.concatenate([[0], ends[:-1]])
    flat, entries = level(points), entry_nodes(len(points))
    out = []
    for lo in range(0, len(queries), BATCH):
        some = queries[lo : lo + BATCH]
        asked = np.zeros((len(some), flat.shape[1]), np.float32)
        asked[:, :-1] = some / np.abs(some).max(1, keepdims=True)
        nodes = beam_search(flat, edges, entries, asked, max(REACH, 2 * k))
        q, at = np.nonzero(nodes >= 0)
        node = nodes[q, at]
        # Of a node's rows the k + 1 of the smallest ids: one may be the query's own.
        count = np.minimum(ends[node] - begins[node], k + 1)
        score = np.repeat(np.einsum("id,id->i", points[node], some[q]), count)
        place = np.repeat(begins[node], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        q = np.repeat(q, count) + lo
        out.append(best(q, ids[place], uids[place], score, own, k))
    return tuple(map(np.concatenate, zip(*out)))


def best(q, ids, uids, score, own, k):
    """The best k of each query, its own row aside; ties by id and then row."""
    keep = uids != own[q]
    q, ids, uids, score = q[keep], ids[keep], uids[keep], score[keep]
    by = np.lexsort((uids, ids, -score, q))
    q = q[by]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    by = by[rank < k]
    return q[rank < k], ids[by], uids[by], score[by]


def search_block(graphs: DataFrame, block: list[Row], k: int) -> DataFrame:
    """HITS of one block of queries of one length: the best k of each task, then of all."""
    dim = block[0]["dim"]
    shared = graphs.sparkSession.sparkContext.broadcast((b"".join(bytes(r["x"]) for r in block), [r["uid"] for r in block], [r["vec_id"] for r in block]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, uids, ids = shared.value
        queries, own = np.frombuffer(raw, np.float64).reshape(-1, dim), np.array(uids, np.int64)
        so_far = None
        for batch in batches:
            for shard in (r for k in range(batch.num_rows) for r in batch.slice(k, 1).to_pylist()):
                hits = shard_hits(shard, queries, own, k)
                so_far = hits if so_far is None else best(*map(np.concatenate, zip(so_far, hits)), own, k)
        if so_far is not None:
            q, vec_id, uid, score = so_far
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(np.array(ids, np.int64)[q]), pa.array(vec_id), pa.array(uid), pa.array(score)], names=["query_uid", "query_id", "vec_id", "uid", "score"])

    hits = graphs.where(F.col("dim") == dim).mapInArrow(scan, HITS)
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")))
    return materialize(ranked.where(F.col("rank") <= k), "ann-hits")


def nearest(rows: DataFrame, *, every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", per: int = PER) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of each row whose id `every` divides."""
    vectors = ready(rows, id_col, vector_col)
    graphs = index(vectors, per)
    asked = vectors.where(F.col("vec_id") % every == 0)
    out, spark = None, rows.sparkSession
    for dim, n in asked.groupBy("dim").count().collect():  # one row a length of vectors
        parts = max(1, -(-n * dim * 8 // BLOCK_BYTES))
        own = asked.where(F.col("dim") == dim).withColumn("part", F.pmod(F.xxhash64("uid", F.lit("query")), F.lit(parts)))
        for part in range(parts):
            block = own.where(F.col("part") == part).collect()  # about BLOCK_BYTES
            if block:
                hits = search_block(graphs, block, k)
                out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], HITS + ", rank int")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
