"""The neighbour graph against brute force, and its odd cases."""

import math

import numpy as np
import pytest

from evispark.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, x string"


def plain(rows, k=20, every=20):
    """{query row: [(vec_id, score)]}, best first."""
    good = [(i, r["vec_id"], np.array(r["embedding"], float)) for i, r in enumerate(rows) if r["vec_id"] is not None and r["embedding"] and None not in r["embedding"] and all(map(math.isfinite, r["embedding"])) and any(r["embedding"])]
    out = []
    for i, q, x in good:
        if q % every == 0:
            near = sorted(((-float(x @ y), v, j) for j, v, y in good if j != i and len(y) == len(x)))[:k]
            out += [(q, rank, v, -s) for rank, (s, v, _) in enumerate(near, 1)]
    return out


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def recall(got, want):
    pairs = lambda rows: {(q, v) for q, _, v, _ in rows}
    return len(pairs(got) & pairs(want)) / len(pairs(want))


@pytest.mark.parametrize("per", [ann.PER, 300])
def test_recall_of_the_query(spark, per):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = [tuple(r) for r in ann.nearest(rows, per=per).collect()]
    want = plain(rows_of(rows))
    assert len(got) == len(want) and recall(got, want) >= 0.95
    exact = {(q, v): s for q, _, v, s in plain(rows_of(rows), k=2000)}
    assert all(abs(exact[q, v] - s) < 1e-9 for q, _, v, s in got)
    for q in {q for q, *_ in got}:
        own = sorted((r for r in got if r[0] == q), key=lambda r: r[1])
        assert [r[1] for r in own] == list(range(1, 21)) and [(-r[3], r[2]) for r in own] == sorted((-r[3], r[2]) for r in own)


def test_odd_vectors(spark, tmp_path):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [1.0, math.nan]), (120, [math.inf, 1.0]), (None, [1.0, 1.0])]
    rows = bad + [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (5, [1.0, 2.0]), (3, [1.0, 2.0]), (20, [3.0]), (4, [2.0, -9.0]), (-40, [5.0, 5.0]), (7, [1.0, 2.0, 3.0])]
    rows = spark.createDataFrame([(v, x, 1, 5, "x") for v, x in rows], SCHEMA).coalesce(1)
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in queries.op12_nearest_neighbours(spark, str(tmp_path)).collect())
    assert got == sorted(plain(rows_of(rows)))
    assert ann.nearest(rows.limit(0)).collect() == []


def test_many_copies_and_unequal_norms(spark):
    random = np.random.default_rng(1)
    x = random.normal(size=(3000, 16)) * random.uniform(0.1, 3, (3000, 1))
    x[1000:2000] = x[0]
    x[2000:2500] = x[1] + random.normal(size=(500, 16)) * 1e-3
    rows = spark.createDataFrame([(k, [float(v) for v in r], 1, 5, "x") for k, r in enumerate(x)], SCHEMA)
    got = [tuple(r) for r in ann.nearest(rows, per=1500).collect()]
    want = plain(rows_of(rows))
    assert len(got) == len(want) and recall(got, want) >= 0.95
