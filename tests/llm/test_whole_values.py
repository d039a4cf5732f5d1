"""Whole credential values, long inputs, and URLs of many labels."""

import time

import pytest

from evispark.llm import queries, secrets, urlfilter
from evispark.llm.common import ADDED


@pytest.fixture(scope="module")
def guesses():
    return secrets.Guesses(queries.frequent_words())


def redacted(text, guesses):
    found = secrets.find(text.encode(), guesses)
    return secrets.cut(text, [{"kind": k, "start": a, "end": b} for a, k, b in found], "*")


@pytest.mark.parametrize(
    ("text", "leaks"),
    [
        ('password: "x9K!p2Z;qW#8vT"', ["x9K", "qW#", "8vT"]),
        ("my pass is x9K!p2Z,qW8", ["x9K", "qW8"]),
        ('passphrase: "correct horse battery staple zq9"', ["horse", "staple", "zq9"]),
        ("password: hunter2Xq9z!", ["hunter2", "!"]),
        ("password:\n  x9K!p2Zq<R;t", ["x9K", "R;t"]),
        ("Passwort: x9K!p2Zq", ["x9K"]),
        ("contraseña: x9K!p2Zq", ["x9K"]),
        ("mot de passe = 'x9K p2Zq!7'", ["x9K", "p2Zq"]),
        ("password=x9K'p2Z\"qW#8", ["x9K", "p2Z", "qW#"]),
    ],
)
def test_nothing_of_a_value_is_left(guesses, text, leaks):
    out = redacted(text, guesses)
    assert not any(x in out for x in leaks), out


@pytest.mark.parametrize("text", ["the password is required, as ever.", "my pass: monday", "a token is given to all", "passing is for the best", "login: admin123"])
def test_plain_words_stay(guesses, text):
    assert redacted(text, guesses) == text


def test_a_text_of_many_assignments_takes_linear_time(guesses):
    text = "".join(f"password: Zq{k}!x;W#{k % 977}vT\n" for k in range(100_000)).encode()
    start = time.time()
    found = secrets.find(text, guesses)
    assert len(found) >= 100_000 and time.time() - start < 20
    assert secrets.outside(0, 10, [(0, 2), (4, 6)]) == [(2, 4), (6, 10)] and secrets.united([(3, "hex", 5), (0, "assign", 4), (7, "hex", 8)]) == [(0, 5), (7, 8)]


def test_needs_are_in_every_match():
    assert secrets.needs_of(("credentials?", "pass", "password", "api[ _-]?key")) == [b"api", b"credential", b"pass"]


def test_urls_of_many_labels(spark):
    hosts = ["a." * 100_000 + "net", "a." * 100_000 + "x.www.example.com", "net.", "com"]
    pages = spark.createDataFrame([(k, f"http://{h}/fr/") for k, h in enumerate(hosts)], "page_id long, url string")
    start = time.time()
    out = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judged(pages, urlfilter.default_rules(spark), ["page_id"]).select("page_id", *[(ADDED + n) for n in ("rule", "verdict")]).toDF("page_id", "rule", "verdict").collect()}
    assert out == {0: ("net/fr/", "block"), 1: ("com/", "allow"), 2: (None, "allow"), 3: ("com/", "allow")} and time.time() - start < 60
