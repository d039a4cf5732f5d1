"""The prefix trie against a plain one, and its odd cases."""

import hashlib
import zlib

import numpy as np
import pytest

from evispark.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, c string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All nodes, by walking up from every conversation's prefixes."""
    turns = {}
    for r in rows:
        if r["conv_id"] is not None:
            turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    digest = lambda t: hashlib.sha256(f"{len(t[1].encode())}:{t[1]}{t[2]}".encode()).digest()
    own = {c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, digest(t)))] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = tuple(own.get(first, [])[:h] + ts[h:])
    members = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(whole[c][:d], []).append(c)
    figures = {}
    for key in sorted(members, key=len, reverse=True):
        mine = figures.setdefault(key, [0, 0, 0])
        if not mine[0]:
            mine[1] = 1
        if key:
            mine[2] += (len(members[key]) - 1) * len(key[-1][1].encode())
            above = figures.setdefault(key[:-1], [0, 0, 0])
            above[0] += 1
            above[1] += mine[1]
            above[2] += mine[2]
    return sorted(
        ((m[0], len(k), members[k[:-1]][0] if k else None, len(m), *figures[k], hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()),
        key=str,
    )


def shown(df):
    return sorted((tuple(r) for r in df.select(COLUMNS).collect()), key=str)


def rows_of(spark, folder):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(c, t, "user" if t % 2 else None, f"turn {t} of {c % 4}", 5, "x") for c in range(-12, 60) for t in range(c % 7 + 1)]
    rows += [(200 + c, t, "user", f"same {t}", 5, "x") for c in range(40) for t in range(12)]
    rows += [(300, t, "user", f"long {t}", 5, "x") for t in range(700)] + [(305, t, "user", f"long {t}", 5, "x") for t in range(700)]
    rows += [(None, 1, "user", "lost", 5, "x"), (400, None, None, None, None, None), (400, None, None, None, None, None), (400, 1, "a", "é" * 100_000, 5, "x"), (400, 1, "a", "b", 5, "x"), (400, 1, "a", "b", 5, "x"), (401, 1, "", "", 5, "x")]
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(root / "conversations.parquet"))
    return str(root)


def test_query_equals_a_plain_trie(spark, sf):
    assert shown(queries.op13_prefix_trie(spark, sf)) == plain(rows_of(spark, sf))


@pytest.mark.parametrize(("limit", "chunk"), [(1024, 12), (20, 4)])
def test_odd_rows_with_upper_levels_and_chunks(spark, odd, monkeypatch, limit, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    assert shown(trie.prefix_trie(spark.read.parquet(f"{odd}/conversations.parquet"), limit=limit)) == plain(rows_of(spark, odd))


def test_no_conversations(spark):
    assert shown(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_louds_bits():
    degrees = np.array([1, 3, 0, 2, 0, 0, 0])
    assert "".join("01"[int(x)] for x in trie.louds(degrees)) == "1011100110000"
