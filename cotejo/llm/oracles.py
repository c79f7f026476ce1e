"""DuckDB SQL for the queries of this subpackage that SQL can express.

op1 (XXH64 of shingles), op2, op7, op8, op9, op10 and op11 have none; tests hold them against
plain versions.
"""

from __future__ import annotations

from cotejo.llm.queries import LISTED_WORDS, URL_RULES

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _matches(kind: int, pattern: str) -> str:
    """doc_id, i, m, s, e of all matches; starts are running sums of gaps and matches."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS k, m, e - length(m) AS s, e FROM (SELECT doc_id, m, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e
        FROM (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
              FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS ms, string_split_regex(t, {p}) AS gaps FROM docs) WHERE len(ms) > 0))"""


ASSIGNED = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMED = r"""(?i:(user|username|login|account|client_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)"""
PLACED = r"""[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(:[0-9]+)?"""

OP3 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
assign AS ({_matches(0, ASSIGNED)}), access AS ({_matches(1, "AKIA[A-Z0-9]+")}),
hex AS ({_matches(2, "[0-9a-f]{16,}")}), users AS ({_matches(5, NAMED)}), ends AS ({_matches(6, PLACED)}),
valued AS (SELECT *, length(regexp_extract(m, {_quoted(ASSIGNED)}, 2)) AS v FROM assign),
parts AS (
  SELECT doc_id, 0 AS k, s, e, 's' AS r, false AS w FROM valued WHERE v >= 12
  UNION ALL SELECT doc_id, 1, s, e, 'i', false FROM access WHERE e - s >= 18
  UNION ALL SELECT doc_id, 2, s, e, 's', false FROM hex
  UNION ALL SELECT doc_id, 3, s, e, 's', true FROM valued WHERE v < 12
  UNION ALL SELECT doc_id, 4, s, e, 'i', true FROM access x WHERE e - s < 18
    AND NOT EXISTS (SELECT 1 FROM assign y WHERE y.doc_id = x.doc_id AND y.s < x.e AND y.e > x.s)
  UNION ALL SELECT doc_id, 5, s, e, 'i', true FROM users
  UNION ALL SELECT doc_id, 6, s, e, 'e', true FROM ends),
numbered AS (SELECT *, row_number() OVER () AS n FROM parts),
near AS (SELECT a.n, bool_or(b.r = 'i') AS i, bool_or(b.r = 's') AS sec, bool_or(b.r = 'e') AS ep FROM numbered a JOIN numbered b
  ON a.doc_id = b.doc_id AND a.n <> b.n AND (b.s BETWEEN a.e AND a.e + 200 OR b.e BETWEEN a.s - 200 AND a.s) GROUP BY a.n),
kept AS (SELECT p.* FROM numbered p LEFT JOIN near USING (n)
  WHERE NOT w OR (r = 'i' AND sec) OR (r = 's' AND (i OR ep)) OR (r = 'e' AND i AND sec)),
named AS (SELECT doc_id, k, s, e, concat(['assign', 'access', 'hex', 'weak_secret', 'weak_access', 'user', 'endpoint'][k + 1], ':', CAST(s AS BIGINT), ':', CAST(e AS BIGINT)) AS x FROM kept)
SELECT d.doc_id, count(x) FILTER (k = 0) AS n_assign, count(x) FILTER (k = 1) AS n_access, count(x) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, k), '') AS spans
FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

RULES = ("short", "repetitive", "symbols", "dup_lines")
OP4 = rf"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM docs),
grams AS (SELECT doc_id, i, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g FROM pos),
twice AS (SELECT doc_id, i, i + 7 <= n AND count(*) FILTER (i + 7 <= n) OVER (PARTITION BY doc_id, g) > 1 AS d FROM grams),
covered AS (SELECT doc_id, coalesce(bool_or(d) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS c FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
fig AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM docs LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
rules AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM fig),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER ({r}) AS {r}" for r in RULES)} FROM rules WHERE source IS NOT NULL GROUP BY source),
sums AS (SELECT count(*) AS h, {", ".join(f"sum({r} / n) AS a_{r}, sum(({r} / n) * ({r} / n)) AS b_{r}" for r in RULES)} FROM hosts),
means AS (SELECT hosts.*, h, {", ".join(f"CASE WHEN h = 1 THEN 0.5 ELSE greatest(0.0, least(1.0, (a_{r} - {r} / n) / (h - 1))) END AS m_{r}, b_{r}" for r in RULES)} FROM hosts, sums),
spread AS (SELECT *, {", ".join(f"CASE WHEN h > 1 THEN (b_{r} - ({r} / n) * ({r} / n)) / (h - 1) - m_{r} * m_{r} END AS v_{r}" for r in RULES)} FROM means),
strength AS (SELECT *, {", ".join(f"CASE WHEN h = 1 THEN 2.0 WHEN v_{r} > 0 THEN least(100.0, greatest(1.0, m_{r} * (1 - m_{r}) / v_{r} - 1)) ELSE 100.0 END AS s_{r}" for r in RULES)} FROM spread),
rates AS (SELECT *, {", ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) AS p_{r}" for r in RULES)} FROM strength),
refused AS (SELECT source FROM rates WHERE {" OR ".join(f"p_{r} - 3 * sqrt(p_{r} * (1 - p_{r}) / (n + s_{r} + 1)) > greatest(0.1, 2 * m_{r} / (1 + m_{r}))" for r in RULES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repetitive AS base_failed,
  NOT (short OR repetitive) AND (source IS NULL OR source NOT IN (SELECT source FROM refused)) AS kept FROM rules
"""

_FITS = sorted(URL_RULES, key=lambda r: -len(r.text))


def _fits(r) -> str:
    return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"


OP5 = rf"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits(r)} THEN '{r.text}'" for r in _FITS)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE rule {" ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in _FITS)}
  ELSE CASE WHEN regexp_matches(host, '{"|".join(LISTED_WORDS)}') THEN 'block' ELSE 'allow' END END AS verdict FROM r
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
k AS (SELECT *, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR regexp_matches(t, '<P>|<S>|<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
  ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END AS o FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(o) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""

_LOWER_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
OP13 = f"""
WITH d AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_LOWER_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item, ws, least(len(ws), 10) AS k, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
grams AS (SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM win))),
hits AS (SELECT doc_id, i, grams.k, item FROM grams JOIN win ON grams.k = win.k AND grams.g = win.g),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL = {"op3_secret_scans": OP3, "op4_quality_rules": OP4, "op5_url_filters": OP5, "op12_fill_in_middle": OP12, "op13_benchmark_decontamination": OP13}
