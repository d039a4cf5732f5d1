"""URL filters: host-suffix and path-prefix expressions, an equi-join on short digest prefixes, full digests, precedence.

A URL's host is what stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; its path
goes on up to `?`, `#` or end. A rule (host, path, action) fits its host and all subdomains where the URL's path
starts with the rule's. Of several, the longest host and path together wins, then the longer host, then `block`.

Plan (DataFrame functions only): every distinct (host, path) is expanded once into expressions, one for each
dot-suffix of the host of as many labels as a rule's host has, and each length that rules' paths have; these meet the rules on the first 8 hex digits of
SHA-256, and full digests confirm. Verdicts, written once, join back to the rows on (host, path), so a hot URL is judged
once; the verdicts of the HOT_URLS URLs of most rows are broadcast, and rows without a host join nothing, so that no task
gets a hot URL's rows. Label counts and path lengths that rules have are collected: of the latter
there are at most MAX_PATH of them, as longer rule paths fall in one class that is expanded from the rule side's
lengths by a join on the host alone.

Defined cases: a null URL, or one without `://`, has an empty host and path and gets the default verdict; an empty
host fits no rule; repeated rows get a row each; rules with a null host, path or action are ignored, equal rules
count once; no rules leave every verdict at the default; URLs of any length are judged whole; an empty table gives an
empty result; other columns, whatever their names, are unread or passed through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ADDED, apart, materialize, restored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_PATH, BROADCAST_KEYS = 256, 200_000
#: URLs whose verdicts are broadcast, and the rows that one has at least.
HOT_URLS, HOT_ROWS = 10_000, 500
#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, action string")


def split_url(url):
    """(host, path) of a URL column; both empty where there is no host part."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest[0], UPPER, LOWER), rest[1]


def digest(host, path):
    """Rules and expressions are named by SHA-256; a separator that no host holds keeps the two parts apart."""
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def ready_rules(rules: DataFrame) -> DataFrame:
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action"))
    rules = rules.where("r_host is not null and r_path is not null and r_action is not null").groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))  # block before allow
    return rules.withColumn("full", digest(F.col("r_host"), F.col("r_path"))).withColumn("short", F.substring("full", 1, 8))


def labels_of(host):
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def suffixes(host, sizes: list[int]):
    """The host's last labels, as many as any of the sizes says, as an array."""
    own = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= labels_of(host))
    return F.transform(own, lambda n: F.call_function("substring_index", host, F.lit("."), -n))


def matches(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) with each rule that fits."""
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).where(F.length("r_path") <= MAX_PATH).distinct().collect())  # at most MAX_PATH + 1 numbers
    labels = sorted(r[0] for r in rules.select(labels_of(F.col("r_host"))).distinct().collect())  # n different numbers take rules of n * n / 2 labels
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    each = keys.where("host <> ''").select("host", "path", F.explode(suffixes(F.col("host"), labels)).alias("suffix"))
    short = each.select("host", "path", "suffix", F.explode(prefixes).alias("size")).withColumn("wanted", digest(F.col("suffix"), F.expr("substring(path, 1, size)"))).withColumn("short", F.substring("wanted", 1, 8))
    found = short.join(rules, "short").where("wanted = full").select("host", "path", "r_host", "r_path", "r_action")
    if rules.where(F.length("r_path") > MAX_PATH).isEmpty():
        return found
    far = rules.where(F.length("r_path") > MAX_PATH).drop("short", "full")
    return found.union(each.join(far, each["suffix"] == far["r_host"]).where("startswith(path, r_path)").select("host", "path", "r_host", "r_path", "r_action"))


def placed(pages: DataFrame, url_col: str) -> DataFrame:
    """pages with host and path under the ADDED prefix."""
    host, path = split_url(F.col(f"`{url_col}`").cast("string"))
    return pages.withColumns({ADDED + "host": host, ADDED + "path": path})


def best_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(b_host, b_path, n, rule, action) of the distinct placed URLs, n rows each; rule and action are null where no rule fits."""
    urls = rows.select(F.col(ADDED + "host").alias("host"), F.col(ADDED + "path").alias("path")).where("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_action"))
    best = matches(urls.select("host", "path"), ready_rules(rules)).groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")), order).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return materialize(out.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "n", "best.rule", "best.action"), "url-verdicts")


def met(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Placed rows with the rule and action of their URL: by broadcast for hot URLs, by a join for all others."""
    same = (F.col(ADDED + "host") == F.col("b_host")) & (F.col(ADDED + "path") == F.col("b_path"))
    hot = F.broadcast(best.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n"), "b_host", "b_path").limit(HOT_URLS))
    quick = rows.join(hot, same, "left").where((F.col(ADDED + "host") == "") | F.col("b_host").isNotNull())
    rest = rows.where(F.col(ADDED + "host") != "").join(hot, same, "left_anti").join(best, same)
    return quick.unionByName(rest)


def judged(pages: DataFrame, rules: DataFrame, keep: list[str], *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The `keep` columns, then host, path, rule (host and path, or null) and verdict under the ADDED prefix."""
    own, names = apart(pages.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, url_col])]))
    rows = placed(own, names[url_col])
    out = met(rows, best_rules(rows, rules))
    return restored(out, {c: names[c] for c in keep}, ADDED + "host", ADDED + "path", F.col("rule").alias(ADDED + "rule"), F.coalesce("action", F.lit(default)).alias(ADDED + "verdict"))


def allowed(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The pages that aren't blocked, with their own columns; they stay in place while the URLs that decide are few enough to broadcast."""
    own, names = apart(pages)
    rows = placed(own, names[url_col])
    best = best_rules(rows, rules)
    decisive = best.where((F.col("action") == "block") != F.lit(default == "block"))
    if decisive.limit(broadcast_keys + 1).count() > broadcast_keys:
        return restored(met(rows, best).where(F.coalesce("action", F.lit(default)) != "block"), names)
    same = (F.col(ADDED + "host") == F.col("b_host")) & (F.col(ADDED + "path") == F.col("b_path"))
    return restored(rows.join(F.broadcast(decisive), same, "left_semi" if default == "block" else "left_anti"), names)
