"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from . import mixing, quality_rules, urlfilter

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""WITH d AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(_FOLDED)} AS w FROM benchmark),
bw AS (SELECT item, least(13, len(w)) AS size, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS key FROM bw),
dw AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (SELECT doc_id, i, dw.size, item FROM dw JOIN windows k ON k.size = dw.size AND k.key = array_to_string(w[i:i + dw.size - 1], ' ')),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots s ON s.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id"""


def op2() -> str:
    bits, reach, prior, parts = quality_rules.BITS, quality_rules.REACH, quality_rules.PRIOR, quality_rules.PARTS
    metrics = {"word_len_x100": "100 * word_chars // greatest(n_words, 1)", "symbols_x10k": "10000 * n_symbols // greatest(word_chars, 1)", "dup_lines_x10k": "10000 * n_dup_lines // greatest(n_lines, 1)", "repeats_x10k": "10000 * n_repeat_words // greatest(n_words, 1)"}
    each = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {e} AS v FROM base WHERE NOT base_failed" for m, e in metrics.items())
    whole = lambda keys: f"SELECT {keys} metric, bin, {parts} * sum(n)::BIGINT AS n FROM bins GROUP BY ALL"
    lent = lambda table, keys: f"SELECT {keys} metric, bin, ({prior * parts}::HUGEINT * n // sum(n) OVER (PARTITION BY {keys} metric)) AS n FROM {table}"
    at = lambda p: f"min(bin) FILTER (upto * 100 >= total * {p})"
    value = lambda b: f"CASE WHEN {b} < {2 << bits} THEN {b} ELSE ({b} - ((({b} >> {bits}) - 1) << {bits})) << (({b} >> {bits}) - 1) END"
    percents = sorted({50} | {p for high, low, _ in quality_rules.METRICS.values() for p in (high, low) if p is not None})
    highs = " ".join(f"WHEN '{m}' THEN q_{h} + {reach} * greatest(q_{h} - q_50, {s})" for m, (h, _, s) in quality_rules.METRICS.items())
    lows = " ".join(f"WHEN '{m}' THEN q_{x} - {reach} * greatest(q_50 - q_{x}, {s})" for m, (_, x, s) in quality_rules.METRICS.items() if x is not None)
    inside = " AND ".join(f"({e}) <= max_{m}" + (f" AND ({e}) >= min_{m}" if quality_rules.METRICS[m][1] is not None else "") for m, e in metrics.items())
    pivot = ", ".join(f"max(high) FILTER (metric = '{m}') AS max_{m}, max(low) FILTER (metric = '{m}') AS min_{m}" for m in metrics)
    return f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {_SPACED} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM t WHERE n > 1) GROUP BY 1),
counts AS (SELECT d.doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id),
base AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM counts),
vals AS ({each}), bins AS (SELECT lang, source, metric, CASE WHEN v < {2 << bits} THEN v ELSE ((length(bin(v)) - {bits + 1}) << {bits}) + (v >> (length(bin(v)) - {bits + 1})) END AS bin, count(*) AS n FROM vals GROUP BY ALL),
lent_all AS ({lent(f"({whole('')})", '')}),
languages AS (SELECT lang, metric, bin, sum(n) AS n FROM ({whole('lang,')} UNION ALL SELECT lang, metric, bin, n FROM (SELECT DISTINCT lang, metric FROM bins) JOIN lent_all USING (metric)) GROUP BY ALL),
lent_lang AS ({lent('languages', 'lang,')}),
groups AS (SELECT lang, source, metric, bin, sum(n) AS n FROM ({whole('lang, source,')} UNION ALL SELECT g.lang, g.source, g.metric, p.bin, p.n FROM (SELECT DISTINCT lang, source, metric FROM bins) g JOIN lent_lang p ON p.lang IS NOT DISTINCT FROM g.lang AND p.metric = g.metric) GROUP BY ALL),
run AS (SELECT lang, source, metric, bin, sum(n) OVER (PARTITION BY lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lang, source, metric) AS total FROM groups),
b AS (SELECT lang, source, metric, {', '.join(f'{at(p)} AS b_{p}' for p in percents)} FROM run GROUP BY ALL),
q AS (SELECT lang, source, metric, {', '.join(f"{value(f'b_{p}')} AS q_{p}" for p in percents)} FROM b),
fences AS (SELECT lang, source, metric, CASE metric {highs} END AS high, CASE metric {lows} END AS low FROM q),
limits AS (SELECT lang, source, {pivot} FROM fences GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, false) AS kept FROM base b LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source"""


OP3 = f"""WITH d AS (SELECT doc_id, source, len({_SPACED}) AS size, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ({list(mixing.WEIGHTS)})[(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM d GROUP BY source),
o AS (SELECT *, sum({mixing.MOST} * source_size) OVER w - {mixing.MOST} * source_size AS full_before, sum(weight) OVER () - sum(weight) OVER w + weight AS open_weight, row_number() OVER w AS k, {mixing.SHARE} * sum(source_size) OVER () AS total FROM s WINDOW w AS (ORDER BY {mixing.MOST} * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
level AS (SELECT arg_min((total - full_before)::DOUBLE / open_weight::DOUBLE, k) AS level FROM o WHERE weight * (total - full_before)::DOUBLE / open_weight::DOUBLE <= {mixing.MOST} * source_size),
t AS (SELECT source, source_size, least(weight * level, {mixing.MOST} * source_size)::DOUBLE AS target FROM s, level),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) - size AS before FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken FROM e"""


def op7() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in urlfilter.RULES)
    return f"""WITH rules(r_host, r_path, action) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(action, length(r_host || r_path)) AS action FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN m ON m.page_id = p.page_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": OP1, "op2_quality_rules": op2(), "op3_mix_sources": OP3, "op7_url_filter": op7()}
