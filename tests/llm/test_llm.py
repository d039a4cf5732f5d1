"""The corpus operators against brute force, SQL, other implementations, and their defined odd cases."""

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evispark.llm import decontaminate, hmm, langid, mixing, neardup, quality_gam, quality_rules, queries, secrets, tokencount, urlfilter
from evispark.llm.common import ADDED, materialize

DOCS = "doc_id long, text string, lang string, source string, n_words long, kept string, score double"
random.seed(3)


def words(n, seed=0, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


LONG = words(30_000, 9)
#: Null, empty, blank, wordless, long, repeated rows, repeated texts, null ids, languages and sources; columns with clashing names.
ODD = [
    (1, None, "en", "a", 7, "x", 0.1),
    (2, "", "en", "a", None, None, None),
    (3, " \n\t ", None, None, 1, "y", 0.2),
    (4, "!!! ???", "en", "b", 1, "y", 0.2),
    (5, LONG, "en", "b", 1, "y", 0.2),
    (6, words(80, 1), "en", "a", 1, "y", 0.2),
    (6, words(80, 1), "en", "a", 1, "y", 0.2),
    (7, words(80, 1), "de", "a", 1, "y", 0.2),
    (None, words(80, 2), "de", None, 1, "y", 0.2),
    (9, "日本語 テキスト é ß \U0001F600", "ja", "ü", 1, "y", 0.2),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The odd documents, and empty tables, as folders that queries can read."""
    root = tmp_path_factory.mktemp("odd")
    tables = {"benchmark": ([(1, words(80, 1)), (1, words(80, 1)), (2, None), (3, ""), (None, "w1 w2"), (4, "w3")], "item_id long, text string, doc_id long"), "labels": ([(6, 1, 0), (7, 0, 0), (5, 1, None), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int"), "pages": ([(1, None), (2, "nohost"), (3, "http://A.Example.com/en/x?q"), (3, "http://A.Example.com/en/x?q"), (4, "ftp://net/es/"), (5, "http:///en/"), (6, "x://net"), (7, "http://" + "a." * 300 + "net/fr/" + "p" * 5000)], "page_id long, url string, host string")}
    spark.createDataFrame(ODD, DOCS).write.parquet(str(root / "odd/documents.parquet"))
    spark.createDataFrame([], DOCS).write.parquet(str(root / "empty/documents.parquet"))
    for name, (rows, schema) in tables.items():
        rows = [(*r, 1)[: len(schema.split(","))] for r in rows]
        if name == "pages":
            rows = [(r[0], r[1], "clash") for r in rows]
        spark.createDataFrame(rows, schema).write.parquet(str(root / f"odd/{name}.parquet"))
        spark.createDataFrame([], schema).write.parquet(str(root / f"empty/{name}.parquet"))
    return root


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_odd_and_empty_tables(spark, folder, name):
    run = queries.queries()[name]
    rows = run(spark, str(folder / "odd")).collect()
    assert len(rows) == (8 if name == "op7_url_filter" else len(ODD))
    assert run(spark, str(folder / "empty")).collect() == []


def test_pipeline_odd_and_empty(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(folder / "odd")).collect()} <= {5, 6, 7, None}
    assert corpus_pipeline.run(spark, str(folder / "empty")).collect() == []


# --- 1: decontamination


def brute_hits(text, items, n=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = split(text), set(), set()
    for item, body in items:
        w = split(body)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(own) - size + 1):
                if own[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def test_decontamination_matches_brute_force(spark):
    items = [(1, words(40, 1, 30)), (2, words(13, 2, 30)), (3, "only THREE words"), (10, "w5"), (4, words(20, 3, 9)), (5, None), (6, "É ß-x"), (7, "abcdefgh12345678MIDDLE1abcdefgh12345678 z")]
    docs = [(0, words(100, 4, 12)), (1, "a " + words(40, 1, 30).upper() + " b"), (2, "x only-three,WORDS y"), (3, words(20, 3, 9) + words(20, 3, 9)), (4, None), (5, "é ß x É"), (6, words(12, 2, 30)), (7, "abcdefgh12345678middle2abcdefgh12345678 z abcdefgh12345678middle1abcdefgh12345678 z")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"broadcast_bytes": 0}):
        got = {r.doc_id: (r[1], r[2], r[3]) for r in decontaminate.scan(d, b, ["doc_id"], **how).collect()}
        assert got == {i: brute_hits(t, items) for i, t in docs}
        text = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b, **how).collect()}
        assert text[2] == "x  y" and text[4] is None and text[5] == "é ß x É"  # only A-Z is lower-cased
        share = {i: brute_hits(t, items)[:2] for i, t in docs}
        assert {r.doc_id for r in decontaminate.drop_contaminated(d, b, **how).collect()} == {i for i, (n, hit) in share.items() if not hit or 20 * hit < n}


def test_hot_one_word_item(spark):
    """A window that all documents hold, under many ids, and two long words that share a hash."""
    same = [f"abcdefgh{'x' * 9}{c}{'x' * 9}12345678" for c in "pq"]
    items = [(f"i{k:03}", "the") for k in range(300)] + [("p", same[0]), ("q", same[1]), ("q", same[1])]
    docs = [(i, "the " * (i % 7) + f"word{i} " + (same[i % 2] if i % 5 == 0 else "")) for i in range(400)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    few, many = (sorted(map(str, decontaminate.scan(d, b, ["doc_id"], broadcast_bytes=n).collect())) for n in (1 << 30, 0))
    assert few == many
    got = {r[0]: r for r in decontaminate.scan(d, b, ["doc_id"], broadcast_bytes=0).collect()}
    assert all(len(got[i][3]) == (300 if i % 7 else 0) + (i % 5 == 0) and got[i][2] == i % 7 + (i % 5 == 0) for i, _ in docs)


def test_index_stays_within_its_estimate(spark):
    for items in ([(str(i), words(200, i, 50_000)) for i in range(300)], [(str(i), f"w{i}") for i in range(4000)], [("a", "x")], [("a", words(5, 1)), ("b", None)]):
        index = decontaminate.WindowIndex(items, 13)
        assert index.nbytes <= decontaminate.index_bytes(spark.createDataFrame(items, "item string, text string")) + (14 << 12)


def test_spans_do_not_depend_on_the_benchmark_s_size(spark):
    items = [(1, words(40, 1, 30)), (3, "only THREE words"), (6, "É ß-x")]
    docs = [(0, "\U0001F600é, " + words(40, 1, 30).upper() + " -- zz Only three, words!"), (1, "x only-three,WORDS y " * 3), (2, None), (3, "é É ß x \U0001F600 É-ß x"), (4, ""), (4, "none")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: str(tuple(r))
    few, many = (sorted(decontaminate.scan(d, b, ["doc_id"], broadcast_bytes=n).collect(), key=key) for n in (1 << 20, 0))
    assert few == many and all(r[4] is not None for r in many)
    few, many = (sorted(decontaminate.remove_spans(d, b, broadcast_bytes=n).collect(), key=key) for n in (1 << 20, 0))
    assert few == many and {r.text for r in many if r.doc_id == 0} == {"\U0001F600é,  -- zz !"}
    assert all(r[4] == [] for r in decontaminate.scan(d, b.limit(0), ["doc_id"], broadcast_bytes=-1).collect())


# --- 2: quality rules


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    count = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if count[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_measures_match_brute_force():
    texts = [t[1] for t in ODD] + ["a b c a b c", "x\nx\n\n \n x\ny # $", "a\x0bb\x85c\u00a0d\x1ce", "one two", "p q r s p q r"]
    for t in texts:
        n, chars, symbols, _, dup, repeat = quality_rules.measure((t or "").encode())
        assert (n, chars, symbols, dup, repeat) == brute_measures(t)


def test_quality_thresholds_adapt(spark):
    """A source whose texts all have long words keeps them; a text unlike its own source goes."""
    rows = [(i, " ".join("x" * (3 if i % 2 else 14) + str(j) for j in range(60 + i % 5)), "en", f"s{i % 2}") for i in range(600)]
    rows += [(1000, " ".join("x" * 60 + str(j) for j in range(60)), "en", "s1"), (1001, "short", "en", "s1")]
    out = {r.doc_id: r[1] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), ["doc_id"]).select("doc_id", ADDED + "kept").collect()}
    assert not out[1000] and not out[1001] and all(out[i] for i in range(600))


def test_small_groups_lean_on_their_language(spark):
    """Every group has fences of its own, between its own quantiles and its language's by its size."""
    rows = [(i, " ".join("x" * 4 + str(10 + (i * j) % 89) for j in range(60)), "en", "big") for i in range(4000)]
    for name, n in (("few", 5), ("some", 60), ("many", 2000)):
        rows += [(0, " ".join("y" * 9 + str(10 + (i * j) % 89) for j in range(60)), "fr" if name == "few" else "en", name) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    fences = {r.g_source: r.low_word_len_x100 for r in quality_rules.thresholds(quality_rules.sketches(quality_rules.measured(docs, ["lang", "source"]), "lang", "source")).collect()}
    assert len(fences) == 4 and fences["many"] > fences["some"] and fences["few"] < 1000 < fences["many"]


def test_bins_bound_the_error(spark):
    values = [(v,) for v in [0, 1, 31, 32, 63, 64, 65, 1000, 4095, 4096, 10**6, 10**12]]
    for v, b, low in spark.createDataFrame(values, "v long").selectExpr("v", f"{quality_rules.bin_of('v')} AS b").selectExpr("v", "b", f"{quality_rules.bin_value('b')} AS low").collect():
        assert low <= v <= low * (1 + 1 / 2**quality_rules.BITS)


# --- 3: mixing


def test_mix_meets_targets(spark):
    rows = [(i, words(1 + i % 40, i), "abcde"[i % 5] if i % 3 else "a") for i in range(900)] + [(5000 + i, words(9, 1), None) for i in range(30)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.planned(docs).collect()
    total, by = sum(r.size for r in out), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, []).append(r)
    caps = {s: (2 * rs[0].source_size, (5, 2, 1)[k % 3]) for k, (s, rs) in enumerate(sorted(by.items(), key=lambda x: (x[0] is None, x[0] or "")))}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level at which sources fill, by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(w * mid, c) for c, w in caps.values()) < 1.5 * total else (low, mid)
    for s, rs in by.items():
        cap, w = caps[s]
        assert rs[0].target == pytest.approx(min(w * low, cap)) and sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= len(rs) if s is None else abs(sum(r.taken for r in rs) - rs[0].target) <= 1
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.planned(docs.repartition(7)).collect()), key=str)
    copies = mixing.mix(docs).collect()
    assert sum(len((r.text or "").split()) for r in copies) == sum(r.taken for r in out)


def test_mix_with_many_sources_ranks_by_ranges(spark):
    rows = spark.createDataFrame([(f"s{i:03}" if i else None, 5 + i) for i in range(60)], "source string, source_size long")
    few, many = (sorted(map(tuple, mixing.targets(rows, window_sources=n).select("source", "target").collect()), key=str) for n in (1000, 5))
    assert few == many


# --- names that clash, odd rows: every function from documents to documents


CLASHING = ["g_lang", "g_source", "metric", "bin", "high_word_len_x100", "x_id", "x_digest", "stays", "digest", "sig", "node", "root", "host", "path", "rule", "action", "verdict", "b_host", "short", "mix_epoch", "epoch", "key", "size", "id", "s", "c", "at", "taken", "target", "epochs", "uid", "kept", "items", "spans", "n_words", "text_b", "__scan_text", "a b", "x`y", "dot.ted"]


@pytest.mark.parametrize("name", ["keep_good", "near_duplicate_free", "drop", "drop_joined", "remove", "remove_joined", "redact", "mix", "allowed", "allowed_joined"])
def test_columns_of_any_name_pass(spark, name):
    """Long, tied, repeated, null and empty rows with every helper's name as a column: what stays, stays whole."""
    rows = [(r[0], r[1], r[2], r[3], f"http://example.com/{'en/' if k % 2 else ''}{k}", *[f"{c}{k}" for c in CLASHING]) for k, r in enumerate(ODD)]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("text", "lang", "source", "url", *CLASHING)]])
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, words(13, 1)), (2, "日本語")], "item_id long, text string")
    rules = urlfilter.default_rules(spark)
    run = {
        "keep_good": quality_rules.keep_good, "near_duplicate_free": neardup.near_duplicate_free, "drop": lambda d: decontaminate.drop_contaminated(d, bench), "drop_joined": lambda d: decontaminate.drop_contaminated(d, bench, broadcast_bytes=0),
        "remove": lambda d: decontaminate.remove_spans(d, bench), "remove_joined": lambda d: decontaminate.remove_spans(d, bench, broadcast_bytes=0), "redact": lambda d: secrets.redact(d, []), "mix": mixing.mix,
        "allowed": lambda d: urlfilter.allowed(d, rules), "allowed_joined": lambda d: urlfilter.allowed(d, rules, broadcast_keys=0),
    }[name]
    out = run(docs)
    assert out.columns == docs.columns + (["mix_epoch_2"] if name == "mix" else [])
    known = {tuple(x for k, x in enumerate(r) if k != 1) for r in rows}
    got = out.collect()
    assert got and {tuple(x for k, x in enumerate(r[: len(schema)]) if k != 1) for r in got} <= known
    if name.startswith("allowed"):
        assert {r.url for r in got} == {r[4] for r in rows if "/en/" not in r[4]}
    assert run(docs.limit(0)).collect() == []


# --- 4: near-duplicates


def brute_similarity(a, b, k=5):
    def weigh(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        return {s: 1 + math.log(n) for s, n in Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))).items()}

    x, y = weigh(a), weigh(b)
    every = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in every) for i in x.keys() & y.keys())


def test_near_duplicates_match_brute_force(spark):
    rng, texts = random.Random(1), []
    for base in range(6):
        w = words(90, base, 5000).split()
        texts.append(" ".join(w))
        for _ in range(12):  # more and more changed copies, among them chains
            v = w[:]
            for _ in range(rng.randrange(1, 9)):
                v[rng.randrange(len(v))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(v))
    texts += [texts[0].upper() + " !", texts[0], "a b c", "A, b c.", "a b", "", None, "?"] + ["common passage " * 30 + words(40, 99 + i, 5000) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parent = list(range(len(texts)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    usable = [i for i, t in enumerate(texts) if t and re.search("[a-z0-9]", t.lower())]
    for n, i in enumerate(usable):
        for j in usable[:n]:
            if brute_similarity(texts[i], texts[j]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    kept = {r.doc_id for r in neardup.near_duplicate_free(docs).collect()}
    assert kept == {i for i in got if got[i] == i}


def test_near_duplicates_match_brute_force_on_a_table(spark):
    """All links of similarity 0.8 or more of sf0.01, found through shared shingles: each pair that brute force links is in one class."""
    root = "/root/testdata/sf0.01"
    texts = {r.doc_id: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in spark.read.parquet(f"{root}/documents.parquet").collect()}
    weighted = {i: {s: 1 + math.log(n) for s, n in Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))).items()} for i, w in texts.items() if w}
    holders, parent = {}, {i: i for i in texts}
    for i, s in weighted.items():
        for x in s:
            holders.setdefault(x, []).append(i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    shared = Counter((i, j) for own in holders.values() for n, j in enumerate(own) for i in own[:n])
    for (i, j), n in shared.items():
        x, y = weighted[i], weighted[j]
        if n >= 0.3 * max(len(x), len(y)):
            both = x.keys() & y.keys()
            every = [(x.get(s, 0), y.get(s, 0)) for s in x.keys() | y.keys()]
            ratios = {r: sum(max(p, r * q) for p, q in every) for r in {x[s] / y[s] for s in both}}
            if sum(x[s] / ratios[x[s] / y[s]] for s in both) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: r.class_id for r in queries.op4_near_duplicates(spark, root).collect()}
    assert got == {i: find(i) for i in texts} and len(set(got.values())) < len(got)


def test_bucket_with_several_components(spark):
    """Texts that share buckets with their neighbours' templates, in more components than one block holds."""
    rng = random.Random(12)
    base = words(120, 1, 9000).split()
    texts = []
    for family in range(16):
        own = base[:]
        for k in rng.sample(range(120), 6):
            own[k] = f"f{family}x{k}"
        for copy in range(5):
            one = own[:]
            one[rng.randrange(120)] = f"c{family}y{copy}"
            texts.append(" ".join(one))
    want = list(range(len(texts)))

    def find(i):
        return i if want[i] == i else find(want[i])

    for i in range(len(texts)):
        for j in range(i):
            if brute_similarity(texts[i], texts[j]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                want[b] = a
    got = {r.id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_many_copies_of_one_text(spark, monkeypatch):
    """A text with a third of all rows is met by broadcast, with the same classes."""
    monkeypatch.setattr(neardup, "HOT_COPIES", 20)
    rows = [(i, words(60, i % 97, 5000) if i % 3 else "The same TEXT again and again, in many a document.") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    out = neardup.near_duplicates(docs).collect()
    assert {r.id: r.class_id for r in out} == {i: first[t] for i, t in rows} and {r.class_rows for r in out if r.id % 3 == 0} == {200}
    assert {r.doc_id for r in neardup.near_duplicate_free(docs).collect()} == set(first.values())


def test_signatures_estimate_probability_jaccard():
    a, b = words(300, 1, 5000), words(300, 1, 5000).split()
    b[40:60] = [f"z{i}" for i in range(20)]
    pair = "\n".join([a, " ".join(b)]).encode()
    offsets = np.array([0, len(a) + 1, len(pair)])
    sig = neardup.signatures(*neardup.shingle_weights(np.frombuffer(pair, np.uint8), offsets, 5), 2, 4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(brute_similarity(a, " ".join(b)), abs=0.03)
    assert neardup.similarity(neardup.profile(a.encode(), 5), neardup.profile(" ".join(b).encode(), 5)) == pytest.approx(brute_similarity(a, " ".join(b)))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    random.shuffle(edges)
    roots = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# --- 5, 6: classifiers


def test_language_id_on_held_out_rows(spark, sf):
    out = queries.op5_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out)


def test_language_id_without_letters_or_training(spark, odd):
    assert {r[1] for r in langid.predicted(odd, None, ["doc_id"]).collect()} == {"und"}
    model = langid.trained(langid.training_rows(odd))
    got = {r.text: r[1] for r in langid.predicted(odd, model, ["text"]).collect()}
    assert got[None] == got[""] == got["!!! ???"] == "und" and got[LONG] in model.languages


def test_scores_are_sums_over_positions():
    texts = ["Straße und Weg", "a", "", "the quick brown fox", "İstanbul ǅ"]
    by_order, start, size = langid.grams(texts)
    for k, t in enumerate(texts):
        f, n, total = langid.sparse(t)
        every = np.concatenate([x[start[k] : max(start[k], start[k] + size[k] - o + 1)] for o, x in zip(langid.ORDERS, by_order)])
        assert total == len(every) and dict(zip(f.tolist(), n.tolist())) == Counter(every.tolist())


def plain_grams(text):
    """Hashed 1-, 2- and 3-grams, one by one."""
    c = [ord(x) if ord(x) > 127 or x.isalpha() else 32 for x in text.lower()]
    out = []
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            h = 0
            for x in c[i : i + n]:
                h = (h * 0x01000193 % 2**32) ^ (x * 0x9E3779B1 % 2**32)
            out.append(((h + n * 0x1FEB352D) * 0x846CA68B % 2**32) >> (32 - langid.BITS))
    return Counter(out)


def plain_language_id(train, calibration, texts):
    """TF-IDF, follow-the-regularised-leader with elastic net and temperature, coordinate by coordinate."""
    grams = {t: plain_grams(t) for t in {t for t, _ in train + calibration} | set(texts)}
    df = Counter(f for t, _ in train + calibration for f in grams[t])
    total = len(train) + len(calibration)
    langs = sorted({y for _, y in train + calibration})

    def vector(t):
        size = max(1, sum(grams[t].values()))
        return {"bias": 1.0} | {f: n / size * (math.log((1 + total) / (1 + df[f])) + 1) * langid.SCALE for f, n in grams[t].items()}

    z, n = Counter(), Counter()

    def weight(f, y):
        v = z[f, y]
        return 0.0 if abs(v) <= langid.L1 else -(v - math.copysign(langid.L1, v)) / ((langid.BETA + math.sqrt(n[f, y])) / langid.ALPHA + langid.L2)

    def shares(x, heat=1.0):
        logits = [sum(v * weight(f, y) for f, v in x.items()) / heat for y in langs]
        e = [math.exp(v - max(logits)) for v in logits]
        return [v / sum(e) for v in e]

    for _ in range(langid.EPOCHS):
        for t, lang in train:
            x = vector(t)
            p = shares(x)
            step = []
            for y, q in zip(langs, p):
                for f, v in x.items():
                    step.append((f, y, v * (q - (y == lang)), weight(f, y)))
            for f, y, g, w in step:
                z[f, y] += g - (math.sqrt(n[f, y] + g * g) - math.sqrt(n[f, y])) / langid.ALPHA * w
                n[f, y] += g * g
    heats = [math.exp(math.log(0.05) + k / 199 * (math.log(20) - math.log(0.05))) for k in range(200)]
    vectors = [(vector(t), langs.index(y)) for t, y in calibration]
    heat = min(heats, key=lambda h: -sum(math.log(max(shares(x, h)[y], 1e-12)) for x, y in vectors)) if calibration else 1.0
    return {t: max(zip(shares(vector(t), heat), langs), key=lambda x: x[0])[::-1] for t in texts}


def test_language_id_matches_plain_training(spark):
    """The same predictions and scores as training coordinate by coordinate, on all training rows in the sample's order."""
    rng = random.Random(6)
    letters = {"de": "aeinrstßü", "en": "aeiotnhsw", "fr": "aéeisruqç"}
    rows = [(i, " ".join("".join(rng.choice(letters[y]) for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(3, 9))), y) for i in range(60) for y in [rng.choice(sorted(letters))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _, _ in rows}
    order = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("k")).collect()}
    ranked = sorted((r for r in rows if part[r[0]] != 2), key=lambda r: order[r[0]])
    want = plain_language_id([(t, y) for i, t, y in ranked if part[i] != 3], [(t, y) for i, t, y in ranked if part[i] == 3], [t for _, t, _ in rows])
    got = {r.text: (r[1], r[2]) for r in langid.predicted(docs, langid.trained(langid.training_rows(docs)), ["text"]).collect()}
    assert all(got[t][0] == want[t][0] and got[t][1] == pytest.approx(want[t][1], abs=1e-3) for t in want)


def test_rare_languages_are_learnt(spark):
    """One language with nearly all rows leaves the others their share of the sample; the most frequent are kept."""
    rows = [(i, f"the house and the tree {i}", "en") for i in range(3000)] + [(5000 + i, f"das Haus über Straße {i}", "de") for i in range(6)] + [(6000, "çà", "zz")]
    docs = langid.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(langid.trained(docs, sample_rows=60).languages) >= {"de", "en"} and langid.trained(docs, max_languages=1).languages == ["en"]
    got = langid.predicted(spark.createDataFrame([("das Haus über Straße",), ("the house",)], "text string"), langid.trained(docs, sample_rows=60), ["text"]).collect()
    assert {r.text: r[1] for r in got} == {"das Haus über Straße": "de", "the house": "en"}


def test_a_thousand_languages(spark):
    """Every language is learnt, whatever their number; a language's words tell it from the others."""
    rng = random.Random(3)
    words_of = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)] for _ in range(1000)]
    rows = [(4 * y + k, " ".join(words_of[y]), f"l{y:04}") for y in range(1000) for k in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _, _ in rows}
    learnt = {lang for i, _, lang in rows if part[i] != 2}
    model = langid.trained(langid.training_rows(docs))
    assert model.languages == sorted(learnt) and len(learnt) > 980
    got = langid.predicted(docs.where("doc_id % 4 = 0"), model, ["lang"]).collect()
    assert sum(r[0] == r[1] for r in got if r[0] in learnt) / len(got) > 0.95


def test_pieces_of_a_long_text_count_its_n_grams_once(monkeypatch):
    """Pieces, slices of positions and slices of weights change no count and no sum, ends of texts included."""
    rng = np.random.default_rng(2)
    texts = ["", "a", "ab", "abc", *("".join(rng.choice(list("abc dß"), n)) for n in (5, 6, 7, 8, 9, 10, 11, 64, 201)), "ΑΣ ΣΑΣ"]
    table = np.vstack((rng.normal(size=(langid.SIZE, 3)).astype(np.float32), np.zeros((1, 3), np.float32)))
    model = langid.Model(["x", "y", "z"], np.arange(langid.SIZE, dtype=np.int32), table, np.zeros(3), 1.0)
    whole, scored = [langid.sparse(t) for t in texts], langid._kernel(model)(pa.array(texts))
    for t, (f, n, total) in zip(texts, whole):
        assert total == n.sum() == sum(max(0, len(t.lower()) - o + 1) for o in langid.ORDERS)
    monkeypatch.setattr(langid, "CHUNK", 5)
    monkeypatch.setattr(langid, "CELLS", 21)
    for t, want in zip(texts, whole):
        f, n, total = langid.sparse(t)
        assert (f.tolist(), n.tolist(), total) == (want[0].tolist(), want[1].tolist(), want[2])
    cut = langid._kernel(model)(pa.array(texts))
    assert cut[0] == scored[0] and cut[1].to_pylist() == pytest.approx(scored[1].to_pylist(), abs=1e-9)


def test_long_text_and_many_languages_in_bounded_memory():
    """A text of 20 MB, and 256 languages, within the memory of some pieces."""
    code = """
import resource, numpy as np, pyarrow as pa
from evispark.llm import langid
table = np.ones((langid.SIZE + 1, 256), np.float32)
model = langid.Model([str(i) for i in range(256)], np.arange(langid.SIZE, dtype=np.int32), table, np.zeros(256), 1.0)
col = pa.array(["the house and the tree " * 45000])
small = langid.Model(["a", "b"], model.place, table[:, :2].copy(), np.zeros(2), 1.0)
long = pa.array(["the house and the tree " * 900000])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
langid._kernel(model)(col)
langid._kernel(small)(long)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=root)
    assert int(out.stdout) < 500


def plain_gam(x, y):
    """Cyclic boosting row by row: the same trees from plain sums over rows."""
    G = quality_gam
    share = min(max(sum(y) / len(y), 1e-3), 1 - 1e-3)
    bias, width = math.log(share / (1 - share)), len(x[0])
    edges = [sorted(set(np.quantile([r[k] for r in x], np.linspace(0, 1, G.BINS + 1)[1:-1]).tolist())) for k in range(width)]
    bins = [[sum(v >= e for e in edges[k]) for k, v in enumerate(r)] for r in x]
    total = [bias] * len(y)
    logistic = lambda v: 1 / (1 + math.exp(-v))

    def gain(rows, g, h):
        return sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + G.RIDGE)

    def best_cut(rows, key, g, h, places):
        found = (0.0, None)
        for c in places:
            left, right = [i for i in rows if key[i] < c], [i for i in rows if key[i] >= c]
            if min(len(left), len(right)) >= G.LEAST_ROWS:
                v = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                if v > found[0] + 1e-12:
                    found = (v, c)
        return found if found[0] > 1e-9 else (0.0, None)

    for _ in range(G.ROUNDS):
        for k in range(width):
            p = [logistic(v) for v in total]
            g, h = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
            key = [b[k] for b in bins]
            leaves = [list(range(len(y)))]
            while len(leaves) < 4:
                cuts = [(best_cut(rows, key, g, h, range(1, len(edges[k]) + 1)), n) for n, rows in enumerate(leaves) if rows]
                (v, c), n = max(cuts, key=lambda z: (z[0][0], z[0][1] or 0, z[1]))
                if c is None:
                    break
                rows = leaves.pop(n)
                leaves += [[i for i in rows if key[i] < c], [i for i in rows if key[i] >= c]]
            for rows in leaves:
                step = G.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + G.RIDGE)
                for i in rows:
                    total[i] += step
    return [logistic(v) for v in total]


def test_gam_matches_plain_boosting(monkeypatch):
    """Lookup tables score as trees that were grown row by row; pairs aside, which the interaction test covers."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.4, size=160) > 0.4).astype(float)
    monkeypatch.setattr(quality_gam, "PAIRS", 0)
    monkeypatch.setattr(quality_gam, "ROUNDS", 12)
    assert quality_gam.fitted(x, y).score(x) == pytest.approx(plain_gam(x.tolist(), y.tolist()), abs=1e-9)


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, words(60 + i, i) if i % 2 else "| # $ " * (20 + i)) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    a, b = (quality_gam.scored(docs, quality_gam.trained(docs, spark.createDataFrame(rows, "doc_id long, quality int")), ["doc_id"]).collect() for rows in (labels, labels * 50))
    assert sorted(a) == sorted(b) and all((r[1] >= 0.5) == (r[0] % 2 == 1) for r in a)


def test_quality_gam_on_held_out_rows(spark, sf):
    out = queries.op6_quality_score(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.quality == r.predicted for r in out) / len(out) > 0.93


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality_gam.fitted(x, y)
    assert {model.pairs[0][0], model.pairs[0][1]} == {0, 1} and ((model.score(x) >= 0.5) == y).mean() > 0.9
    assert quality_gam.fitted(x, np.ones(4000)).score(x[:3]).min() > 0.9 and len(quality_gam.fitted(x[:0], y[:0]).score(x[:2])) == 2


# --- 7: URLs


def test_url_rules_match_brute_force(spark):
    rules = [*urlfilter.RULES, ("org", "", "block"), ("a.org", "/x", "allow"), ("a.org", "/x", "block"), (None, "/", "block"), ("long.org", "/" + "p" * 400, "block")]
    hosts = ["example.com", "www.example.com", "m.www.EXAMPLE.com", "net", "x.net", "notnet", "a.org", "b.a.org", "org", "", "com", "long.org"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://", "") for h in hosts for p in ("", "/", "/en/", "/en", "/es/?a#b", "/fr/x", "/xy", "?/en/", "/" + "p" * 401, "#/es/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(-1, None)], "page_id long, url string")
    known = {}
    for h, p, a in rules:
        if h is not None:
            known[h, p] = max(a, known.get((h, p), ""))

    def judge(u):
        m = re.search("://", u or "")
        rest = u[m.end() :] if m else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), len(h), a, h + p) for (h, p), a in known.items() if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    frame = spark.createDataFrame(rules, "host string, path string, action string")
    got = {r.page_id: tuple(r[1:]) for r in urlfilter.judged(pages, frame, ["page_id"]).collect()}
    assert got == {r.page_id: judge(r.url) for r in pages.collect()}
    plan = urlfilter.judged(pages, frame, ["page_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_urls_are_broadcast(spark, monkeypatch):
    """A URL with a third of all rows, and as many rows without one, have the verdicts that others have."""
    pages = spark.createDataFrame([(i, "http://www.example.com/en/" if i % 3 == 0 else None if i % 3 == 1 else f"http://h{i}.net/{'es' if i % 2 else 'de'}/{i}") for i in range(900)], "page_id long, url string")
    rules = urlfilter.default_rules(spark)
    plain = sorted(urlfilter.judged(pages, rules, ["page_id"]).collect())
    monkeypatch.setattr(urlfilter, "HOT_ROWS", 50)
    assert sorted(urlfilter.judged(pages, rules, ["page_id"]).collect()) == plain and len(plain) == 900
    gone = {r[0] for r in plain if r[4] == "block"}
    for keys in (100_000, 0):
        assert {r.page_id for r in urlfilter.allowed(pages, rules, broadcast_keys=keys).collect()} == set(range(900)) - gone


# --- 8: secrets


GUESSES = secrets.Guesses(queries.frequent_words())


def brute_cost(value, rank):
    """The cheapest segmentation, over all spans of the value and all that a span can be."""
    near = {(a, b) for r, row in enumerate(secrets.ROWS) for c, a in enumerate(row) for dr, dc in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) if 0 <= r + dr < 4 and 0 <= c + dc < len(secrets.ROWS[r + dr]) for b in secrets.ROWS[r + dr][c + dc]}
    keys = value.lower().translate(secrets.SHIFTED)
    plain = value.lower().translate(secrets.LEET)

    def span(s, e):
        own, costs = value[s:e], []
        if e - s == 1:
            costs.append(math.log10(10 if own.isdigit() else 26 if own.isascii() and own.isalpha() else 33 if own.isascii() else 1000))
        for word, extra in ((own.lower(), 0), (plain[s:e], 0.5)):
            if e - s > 2 and word in rank:
                costs.append(rank[word] + extra + (0 if own.islower() else 0.3))
        if (m := secrets.DATE.match(value, s)) and m.end() == e and own[0].isdigit():
            costs.append(2.1 if e - s == 4 else 4.6)
        if e - s > 1 and all((keys[i - 1], keys[i]) in near for i in range(s + 1, e)):
            costs.append(secrets.WALK_START + secrets.WALK_STEP * (e - s - 1))
        for p in (1, 2, 3, 4):
            if s >= p and all(value[i] == value[i - p] for i in range(s, e)):
                costs.append(secrets.REPEAT_START + secrets.REPEAT_STEP * (e - s))
        return min(costs, default=math.inf)

    best = [0.0]
    for e in range(1, len(value) + 1):
        best.append(min(best[s] + span(s, e) for s in range(e)))
    return best[-1]


def test_guess_costs_match_all_segmentations():
    bits = ["password", "Summer", "p4ssw0rd", "the", "qwert", "zxcvb", "1990", "1999-12-31", "31.12.99", "aaaa", "abab", "x", "K", "9", "!", "é", "日", "lkjh", "111", "İ"]
    rng = random.Random(8)
    for _ in range(400):
        value = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))[:26]
        if len(value.lower()) == len(value):
            assert GUESSES.cost(value) == pytest.approx(brute_cost(value, GUESSES.rank)), value


def test_cost_alone_decides():
    """Short values and letters alone are secrets if they are dear, and nothing else is."""
    for value in ("x9K!p2Z", "kqzvxwpfjhgtybnmrlkd", "aB3$é日"):
        assert GUESSES.cost(value) >= secrets.MIN_COST and secrets.find(("pwd is " + value).encode(), GUESSES) == [(7, "guess", 7 + len(value))]
    for value in ("qwertyuiop1990", "passwordpassword", "x9K", "1234567890"):
        assert GUESSES.cost(value) < secrets.MIN_COST and secrets.find(("pwd is " + value).encode(), GUESSES) == []


def test_secrets_query_matches_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op8_secrets(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in ("assign", "access", "hex")]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, k, b in base} <= set(r.spans.split(",")) | {""}
    assert all(sum(getattr(r, n) for r in rows) for n in ("n_assign", "n_hex"))  # no access keys there


def brute_base(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), "assign", m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[1])))


def test_secret_spans_match_brute_force():
    bits = ["password", "PassWd", "secret", "ſecret", "toKen", "apikey", "API_KEY", " ", ":", "=", "'", '"', "abc", "x9K!pq2Zw7", "AKIA", "ABCDEFGH1234567890", "deadbeef" * 3, "0" * 23, "é\U0001F600", "\n", "is", "pwd"]
    rng = random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        spans = secrets.find(t.encode(), GUESSES)
        assert [s for s in spans if s[1] != "guess"] == brute_base(t)
        assert all(not (a < y and x < b) for a, k, b in spans if k == "guess" for x, j, y in spans if j != "guess")


def test_values_that_base_spans_cover_in_part():
    text = "password: Tr0ub4dor&3$xyz!9 then token=x9K!pq2Zw7#Lm_" + "deadbeef" * 3 + "%Q4 and secret: abcdef123456"
    got = [(k, text[a:b]) for a, k, b in secrets.find(text.encode(), GUESSES)]
    assert got == [("assign", "password: Tr0ub4dor"), ("guess", "&3$xyz!9"), ("guess", "x9K!pq2Zw7#Lm_"), ("hex", "deadbeef" * 3), ("guess", "%Q4"), ("assign", "secret: abcdef123456")]
    spans = [{"kind": k, "start": a, "end": b} for a, k, b in secrets.find(text.encode(), GUESSES)]
    assert secrets.cut(text, spans, "<{kind}>") == "<assign><guess> then token=<guess><hex><guess> and <assign>"


def test_guess_costs_order_values():
    cost = GUESSES.cost
    assert cost("password") < cost("password1990") < cost("xk3-Qz81vB")
    assert cost("a" * 500) < cost("kT9wq2LmZx") and cost("qwertyuiop") < cost("qpwoeiruty") and cost("abcabcabcabc") < cost("abcdhijkopqr")
    assert [k for _, k, _ in secrets.find(b"the pwd is x9K!pq2Zw7 and pwd: monkey123", GUESSES)] == ["guess"]
    fresh = secrets.Guesses([])
    assert fresh.cost("0123456789" * 20_000) > 0 and not fresh.known and fresh.cost("abc") > 0 and fresh.known  # linear in the length; long values aren't remembered


def test_letters_alone_can_be_a_secret():
    for context in ("pwd: ", "auth=", "login is ", "pass: ", "credentials: "):
        assert secrets.find((context + "qWkzTnvBxRpLmJhYdSgc").encode(), GUESSES) == [(len(context), "guess", len(context) + 20)]
        for word in ("authentication", "incorrect", "unbelievably", "Confidentiality", "management", "misunderstood"):
            assert secrets.find((context + word).encode(), GUESSES) == []


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "a token = abcdef12345 b", "x"), (2, None, None), (3, "é password:hunter22 " + "deadbeef" * 4, "y")], "doc_id long, text string, spans string")
    assert {r.doc_id: r.text for r in secrets.redact(rows, queries.frequent_words()).collect()} == {1: "a <assign> b", 2: None, 3: "é <assign> <hex>"}


# --- 9: tokens


def test_token_counts_match_a_unigram_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(2)
    letters = "abcdeéß日"
    pieces = {"▁", *letters[:6]} | {"".join(rng.choice("▁" + letters) if k == 0 else rng.choice(letters) for k in range(rng.randrange(1, 5))) for _ in range(150)}
    for scores in ("ties", "random"):
        vocabulary = [(p, -2.0 * len(p) if scores == "ties" else -rng.uniform(1, 9)) for p in sorted(pieces)]
        model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *vocabulary], 0, False))
        counts = tokencount.Counts(vocabulary)
        low = min(s for _, s in vocabulary)
        assert counts.unknown == low - 10
        for _ in range(1500):
            w = "".join(rng.choice(letters + "xyz") for _ in range(rng.randrange(1, 14)))
            assert counts.of_text(w)[1] == len(model.encode("▁" + w).ids), w


def sentencepiece_file(pieces, kind):
    """A SentencePiece file, written field by field: pieces (piece, score, type), trainer (kind), normaliser (identity)."""
    import struct

    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    message = lambda f, body: bytes([f << 3 | 2]) + number(len(body)) + body
    out = b"".join(message(1, message(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + bytes([3 << 3, t])) for p, s, t in pieces)
    return out + message(2, bytes([3 << 3, kind])) + message(3, message(1, b"identity"))


def test_scores_come_from_a_unigram_file(tmp_path):
    """Counts equal those of the file's own library; a file of merges gets a Zipf law."""
    sentencepiece = pytest.importorskip("sentencepiece")
    rng = random.Random(4)
    letters = "abcdeéß"
    plain = ["▁", *letters[:5], *sorted({rng.choice(["▁", ""]) + "".join(rng.choice(letters) for _ in range(rng.randrange(2, 5))) for _ in range(120)})]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *[(p, -rng.uniform(1, 9), 1) for p in plain]]
    path = tmp_path / "unigram.model"
    path.write_bytes(sentencepiece_file(pieces, 1))
    vocabulary = tokencount.pieces_of(str(path))
    assert [p for p, _ in vocabulary] == plain and all(s == pytest.approx(x[1], rel=1e-6) for (_, s), x in zip(vocabulary, pieces[2:]))
    model, counts = sentencepiece.SentencePieceProcessor(model_file=str(path)), tokencount.Counts(vocabulary)
    for _ in range(1500):
        w = "".join(rng.choice(letters + "xy") for _ in range(rng.randrange(1, 14)))
        assert counts.of_text(w)[1] == len(model.encode(w)), w
    path.write_bytes(sentencepiece_file([pieces[0], *[(p, -float(k), 1) for k, p in enumerate(plain)]], 2))
    zipf = tokencount.pieces_of(str(path))
    assert sum(math.exp(s) for _, s in zipf) == pytest.approx(1) and zipf[0][1] - zipf[1][1] == pytest.approx(math.log(2))


def plain_counts(text, known, unknown):
    """Viterbi over whole texts, all starts of all ends."""
    tokens = unknowns = 0
    for w in text.split():
        w = "▁" + w
        best = [(0.0, 0, 0, False)]
        for end in range(1, len(w) + 1):
            ways = []
            for start in range(max(0, end - 40), end):
                s, t, u, last = best[start]
                if w[start:end] in known:
                    ways.append((s + known[w[start:end]], t + 1, u, False))
            if w[end - 1] not in known:
                s, t, u, last = best[end - 1]
                ways.append((s + unknown, t + (not last), u + (not last), True))
            best.append(max(ways, key=lambda x: x[0]))
        tokens, unknowns = tokens + best[-1][1], unknowns + best[-1][2]
    return len(text.split()), tokens, unknowns


def test_token_query_matches_brute_force(spark, sf, folder):
    known = dict(tokencount.pieces_of(queries.VOCABULARY))
    unknown = min(known.values()) - 10
    for root in (sf, str(folder / "odd")):
        texts = Counter((r.doc_id, *plain_counts(r.text or "", known, unknown)) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 60_000)
        got = Counter(tuple(r) for r in queries.op9_token_counts(spark, root).collect())
        assert not texts - got


def test_long_words_take_little_memory():
    import tracemalloc

    counts, word = tokencount.Counts([("▁", -1.0), ("a", -2.0), ("ab", -2.5)]), "ab" * 500_000
    tracemalloc.start()
    assert counts.of_text(word) == (1, 500_001, 0) and not counts
    assert tracemalloc.get_traced_memory()[1] < 8 << 20


def test_token_cache_is_bounded():
    counts = tokencount.Counts([("▁a", -1.0), ("b", -2.0)], most=5)
    assert [counts.of_text("a ab abb abbb x y z " * 3)[0], len(counts) <= 5] == [21, True]
    assert tokencount.Counts([]).of_text("ab c") == (2, 2, 2)


# --- 10: language model


def tiny_model(states=3, symbols=5, seed=0, kind=np.float32):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return norm(rng.uniform(0.1, 1, states), 0), norm(rng.uniform(0.1, 1, (states, states)), 1), norm(rng.uniform(0.1, 1, (symbols, states)), 0).astype(kind)


def test_forward_and_expected_counts_match_enumeration():
    import itertools

    model, texts = tiny_model(), [np.array([0, 1, 4, 2]), np.array([3, 2]), np.array([2])]
    start, move, emit = model
    scores, _, _ = hmm.forward(*model, hmm.Packed(texts))
    starts, moves, by = hmm.expected(*model, hmm.Packed(texts))
    s0, m0, b0 = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for text, score in zip(texts, scores):
        paths = {p: start[p[0]] * emit[text[0], p[0]] * math.prod(move[p[t - 1], p[t]] * emit[text[t], p[t]] for t in range(1, len(text))) for p in itertools.product(range(3), repeat=len(text))}
        total = sum(paths.values())
        assert score == pytest.approx(math.log10(total), abs=1e-5)
        for p, v in paths.items():
            s0[p[0]] += v / total
            for t in range(len(text)):
                b0[text[t], p[t]] += v / total
                if t:
                    m0[p[t - 1], p[t]] += v / total
    assert starts == pytest.approx(s0, abs=1e-4) and moves == pytest.approx(m0, abs=1e-4) and by == pytest.approx(b0, abs=1e-4)


def test_base_scores_match_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    train = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in split(r.text))
    n, v = sum(train.values()), len(train)
    got = {r.doc_id: r for r in queries.op10_hmm_scores(spark, sf).collect()}
    for r in rows:
        t, g = split(r.text), got[r.doc_id]
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(t), sum(train[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)  # states tell more than frequencies


def test_four_byte_recursion_is_near_an_eight_byte_one():
    """On texts of up to 40,000 words over rare and frequent tokens."""
    rng = np.random.default_rng(1)
    texts = [np.minimum(rng.zipf(1.2, n) - 1, 49_999).astype(np.int32) for n in (40_000, 20_000, 300, 7, 1)]
    start, move, emit = tiny_model(8, 50_000, 2, np.float64)
    emit = emit / np.arange(1, 50_001)[:, None] ** 1.2
    exact = hmm.forward(start, move, emit, hmm.Packed(texts))[0]
    short = hmm.forward(start, move, emit.astype(np.float32), hmm.Packed(texts))[0]
    assert np.abs(short / exact - 1).max() < 1e-6


def test_packed_numbers_come_back():
    for x in (np.zeros(0, np.int64), np.array([0, 1, -5, 2**31 - 1]), np.array([2**40, -(2**40), 3]), np.arange(100_000)):
        assert (hmm.unpacked(hmm.packed(x)) == x).all()


def plain_model(rows, learns, states=8, rounds=3, seed=hmm.SEED):
    """The whole model in one process, over dense arrays."""
    texts = [hmm.tokens_of((t or "").encode()) for t in rows]
    names = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    symbols = [np.array([names[w] for w in t]) for t in texts]
    learnt = [s for s, x in zip(symbols, learns) if x]
    c = np.bincount(np.concatenate(learnt), minlength=len(names))
    n, v = int(c.sum()), int((c > 0).sum())
    e = hmm.first_weights(np.array([zlib.crc32(w) for w in names], np.uint32), states, seed) * c[:, None] / hmm.PARTS
    start, move = np.full(states, 1 / states), np.full((states, states), (1 - hmm.STAY) / (states - 1)) + np.eye(states) * hmm.STAY
    move /= move.sum(axis=1, keepdims=True)
    for k in range(rounds + 1):
        flat, share, whole = hmm.rates(e.sum(axis=0), n, v, k > 0)
        emit = (e + flat + (c[:, None] + 0.1) * share) / whole
        unseen = (flat + 0.1 * share) / whole
        assert emit[c > 0].sum(axis=0) + unseen == pytest.approx(1)  # a distribution of every state
        if k == rounds:
            return hmm.forward(start, move, emit, hmm.Packed(symbols))[0]
        s0, m0, e = hmm.expected(start, move, emit, hmm.Packed(learnt))
        start, move = (s0 + 1) / (s0 + 1).sum(), (m0 + 1) / (m0 + 1).sum(axis=1, keepdims=True)


def test_scores_match_a_model_in_one_process(spark, sf):
    """However texts are dealt into blocks and tokens into shards."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000")
    rows = docs.select("doc_id", "text", (~hmm.held_out()).alias("learns")).collect()
    want = dict(zip([r.doc_id for r in rows], plain_model([r.text for r in rows], [r.learns for r in rows])))
    for given, shard_pairs in ((docs, 400_000), (docs.repartition(5), 700)):
        got = {r.k_doc_id: r.score for r in hmm.scored(given, ~hmm.held_out(), ["doc_id"], shard_pairs=shard_pairs).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-4) for k in want)


def test_materialized_tables_live_in_the_shared_folder(spark):
    out = materialize(spark.range(5), "test")
    assert out.count() == 5 and spark.conf.get("spark.checkpoint.dir") in out.inputFiles()[0]


def test_results_leave_nothing_behind(spark, tmp_path):
    from evispark.llm import common

    first = materialize(spark.range(3), "kept")
    before = list(common._written)
    out = common.result_of(lambda: materialize(spark.range(9), "between").where("id > 3"), "result")
    assert out.count() == 5 and first.count() == 3 and len(common._written) == len(before) + 1
    common.drop(out)
    assert common._written == before


# --- the pipeline


def test_pipeline_frees_its_stages(spark, folder):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from evispark.llm import common

    before = len(common._written)
    out = corpus_pipeline.run(spark, str(folder / "odd"))
    assert len(common._written) == before + 1 and out.columns == spark.read.parquet(str(folder / "odd/documents.parquet")).columns + ["mix_epoch"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_keep_clashing_columns(spark, folder, stage):
    """Each stage on a table of odd rows with its helpers' names as columns; all but the last return the table's columns."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(*r, *[f"{c}{k}" for c in CLASHING]) for k, r in enumerate(ODD)]
    schema = T.StructType([*spark.createDataFrame([], DOCS).schema.fields, *[T.StructField(c, T.StringType()) for c in CLASHING if c != "n_words" and c != "kept"]])
    keep = [k for k, c in enumerate([f.name for f in spark.createDataFrame([], DOCS).schema.fields] + CLASHING) if k < len(ODD[0]) or c in schema.names[len(ODD[0]):]]
    docs = spark.createDataFrame([tuple(r[k] for k in keep) for r in rows], schema)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, str(folder / "odd"))
    assert out.columns[: len(docs.columns)] == docs.columns and 0 < out.count() and (stage == 4 or out.columns == docs.columns)


def brute_redaction(text):
    """Characters marked one by one: the base spans, then what is left of dear values after wider credential words."""
    kind = [None] * len(text)
    spans = brute_base(text)
    context = r"(?<![A-Za-z])(?i:password|passwd|passphrase|pass|pwd|secret|token|api[ _-]?key|private[ _-]?key|credentials?|auth|login)[\"']?[ ]*(?:[:=]|\bis\b)[ ]*[\"']?([^\s\"'<>,;]+)"
    dear = []
    for m in re.finditer(context, text, re.ASCII):
        value = m[1].rstrip(".!?)]}")
        if brute_cost(value, GUESSES.rank) >= secrets.MIN_COST:
            dear.append((m.start(1), m.start(1) + len(value)))
    for a, k, b in sorted(spans, key=lambda s: (s[0], secrets.KINDS.index(s[1]))):
        label = kind[a] or (k, a)  # an overlapping span goes on with the mark of the one before it
        kind[a:b] = [x or label for x in kind[a:b]]
    base = [bool(k) for k in kind]
    for a, b in dear:
        for i in range(a, b):
            if not base[i]:
                kind[i] = ("guess", i) if i == a or base[i - 1] else kind[i - 1]
    out = []
    for i, c in enumerate(text):
        if not kind[i]:
            out.append(c)
        elif i == 0 or kind[i - 1] != kind[i]:
            out.append(f"<{kind[i][0]}>")
    return "".join(out)


def test_pipeline_matches_brute_force(spark, sf):
    """Each stage's effect, made plainly from the one before it."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    duckdb = pytest.importorskip("duckdb")
    from evispark.llm import sql

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    good = {r[0] for r in con.sql(f"SELECT doc_id FROM ({sql.op2()}) WHERE kept").fetchall()}
    docs = {r[0]: r[1:] for r in con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall() if r[0] in good}
    folded = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), d[0])) for i, d in docs.items()}
    sets = {i: Counter(zip(*[w[k:] for k in range(5)])) for i, w in folded.items()}
    parent = {i: i for i in docs}

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for n, i in enumerate(sorted(docs)):
        for j in sorted(docs)[:n]:
            if len(sets[i].keys() & sets[j].keys()) > 0.5 * max(len(sets[i]), len(sets[j])) and brute_similarity(docs[i][0], docs[j][0]) >= 0.8 - 1e-9:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    docs = {i: d for i, d in docs.items() if find(i) == i}
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) for (t,) in con.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    windows = {tuple(w[k : k + min(13, len(w))]) for w in items for k in range(len(w) - min(13, len(w)) + 1)}

    def contaminated(w):
        hit = {k + x for size in {len(v) for v in windows} for k in range(len(w) - size + 1) if tuple(w[k : k + size]) in windows for x in range(size)}
        return bool(hit) and 20 * len(hit) >= len(w)

    docs = {i: d for i, d in docs.items() if not contaminated(folded[i])}
    docs = {i: (brute_redaction(d[0]), *d[1:]) for i, d in docs.items()}
    con.sql("DROP VIEW documents")
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [(i, *d) for i, d in docs.items()])
    want = Counter()
    for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({sql.OP3})").fetchall():
        for epoch in range(-(-taken // size) if size else 0):
            n = min(size, taken - epoch * size)
            text = docs[i][0]
            want[i, epoch, text if n == size else text[: [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)][n - 1]], *docs[i][1:]] += 1
    got = Counter((r.doc_id, r.mix_epoch, r.text, r.lang, r.source, r.n_chars) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == want


def test_text_scans_do_not_shuffle(spark, sf):
    for name in ("op1_decontaminate", "op8_secrets", "op9_token_counts"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "struct<doc_id:bigint,text:string>" in plan
