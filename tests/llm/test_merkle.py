"""The Merkle manifest against a plain one, and its odd cases."""

import hashlib
import zlib

import pytest

from evispark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, grp string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """The root, and each leaf's (siblings on the left, on the right) level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for k, i in enumerate(at):
            sibling = i ^ 1
            paths[k].append(("", "") if sibling >= len(nodes) else (nodes[sibling], "") if sibling < i else ("", nodes[sibling]))
        at = [i // 2 for i in at]
        nodes = [digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0], paths


def plain(docs):
    groups = {}
    for d in sorted(docs, key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, bytes.fromhex(leaf(*[d[c] for c in ("doc_id", "source", "lang", "n_chars", "text")])))):
        groups.setdefault(d["lang"], []).append(d)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in groups[g]]) for g in order}
    root, upper = tree([made[g][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for d, path in zip(groups[g], made[g][1]):
            whole = path + upper[k]
            bad = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0
            own = leaf(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"])
            n = d["n_chars"] + 1 if bad and d["n_chars"] is not None else d["n_chars"]
            node = leaf(d["doc_id"], d["source"], d["lang"], n, d["text"])
            for left, right in whole:
                node = digest(left, node, right)
            out.append((d["doc_id"], own, made[g][0], root, digest(*[x + y for x, y in whole]), node, node == root))
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query_equals_a_plain_manifest(spark, sf):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert shown(queries.op11_merkle_manifest(spark, sf)) == plain(docs)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_odd_rows_in_blocks_of_any_size(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = [(k, f"text {k}", "en", "a", k, "x", "y") for k in range(21)]
    rows += [(None, None, None, None, None, None, None), (7, "", "", "b", None, "x", "y"), (8, "é\n" * 50_000, "日本", None, 3, "x", "y"), (8, "é", "日本", None, 3, "x", "y"), (9, "t", None, "c", 1, "x", "y"), (9, "t", None, "c", 1, "x", "y"), (12, "t", "=", "c", 1, "x", "y")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    docs = [r.asDict() for r in spark.read.parquet(str(tmp_path / "documents.parquet")).collect()]
    assert shown(queries.op11_merkle_manifest(spark, str(tmp_path))) == plain(docs)


def test_one_row_and_none(spark, tmp_path):
    for name, rows in (("one", [(3, "t", "en", "a", 1, "x", "y")]), ("none", [])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / name / "documents.parquet"))
    docs = [r.asDict() for r in spark.read.parquet(str(tmp_path / "one/documents.parquet")).collect()]
    assert shown(queries.op11_merkle_manifest(spark, str(tmp_path / "one"))) == plain(docs)
    assert shown(queries.op11_merkle_manifest(spark, str(tmp_path / "none"))) == []
