"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

from votesel.llm.secrets import ALLOW, BASE, CLASSES, KINDS

WORD_SPACE = r"[\x20\x09-\x0D]"

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '{WORD_SPACE}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM t),
g AS (
  SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) AS g3 FROM w),
h AS (SELECT *, list_histogram(g3) AS hist, list_histogram(ls) AS lh, list_histogram(ws) AS wh FROM g),
m AS (
  SELECT doc_id, ls, ws, lh, wh, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_distinct(flatten(list_transform(list_filter(range(1, len(g3) + 1), lambda i: hist[g3[i]] > 1), lambda i: [i, i + 1, i + 2])))) AS n_repeat_words,
         coalesce(list_sum(list_transform(ls, lambda x: strlen(x))), 0) AS line_bytes,
         coalesce(list_sum(list_transform(ls, lambda x: strlen(x))), 0) - coalesce(list_sum(list_transform(list_distinct(ls), lambda x: strlen(x))), 0) AS dup_bytes
  FROM h),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars / n_words BETWEEN 2 AND 15
       AND n_symbols <= 0.1 * n_words
       AND (len(ls) < 10 OR n_dup_lines <= 0.3 * len(ls))
       AND dup_bytes <= 0.3 * line_bytes
       AND coalesce(list_max(map_values(wh)), 0) <= 0.3 * n_words
       AND len(list_filter(ls, lambda x: regexp_matches(x, '^{WORD_SPACE}*[-*•]{WORD_SPACE}'))) <= 0.9 * len(ls)
       AND len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){WORD_SPACE}*$'))) <= 0.3 * len(ls)
       AND len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) >= 0.6 * n_words AS kept
FROM v
"""


def _quoted(rx: str) -> str:
    return "'" + rx.replace("'", "''") + "'"


def _spans(name: str, pattern: str, group: int, least: int, kind: int) -> str:
    rx = _quoted(pattern)
    begin = "coalesce(list_sum(list_transform(p[:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)"
    return (
        f"(SELECT list_transform(list_filter(range(1, len(m) + 1), lambda i: length(g[i]) >= {least}), lambda i: {{'s': {begin}, 'k': {kind}, 'e': {begin} + length(m[i])}}) "
        f"FROM (SELECT regexp_extract_all(text, {rx}, 0) AS m, regexp_extract_all(text, {rx}, {group}) AS g, string_split_regex(text, {rx}) AS p)) AS {name}"
    )


def _windows(k: int) -> str:
    """Rows of joined windows of class ``k``: every window's entropy from its own histogram."""
    c = CLASSES[k]
    allowed = " OR ".join(f"regexp_matches(cand, {_quoted(a)})" for a in ALLOW)
    return f"""
  SELECT doc_id, {len(BASE) + k} AS k, min(s) AS s, max(e) AS e FROM (
    SELECT *, sum(CASE WHEN s <= last_e THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, c0 ORDER BY s) AS island FROM (
      SELECT *, lag(e) OVER (PARTITION BY doc_id, c0 ORDER BY s) AS last_e FROM (
        SELECT doc_id, c0, c0 + i AS s, c0 + i + {c.window} AS e,
               list_sum(list_transform(map_values(list_histogram(string_split(cand[i + 1:i + {c.window}], ''))), lambda n: n * log2(n))) AS x
        FROM (SELECT doc_id, c0, cand, unnest(range(0, length(cand) - {c.window} + 1)) AS i FROM
               (SELECT doc_id, z.s AS c0, text[z.s + 1:z.e] AS cand FROM (SELECT doc_id, text, unnest({c.name}) AS z FROM f))
              WHERE NOT ({allowed})))
      WHERE x <= {c.window} * (log2({c.window}.0) - {c.bits}) + 1e-9))
  GROUP BY doc_id, c0, island"""


def _joined(spans: str) -> str:
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    return f"array_to_string(list_transform(list_sort({spans}), lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"


SECRETS_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT doc_id, text, {", ".join(_spans(*b, k) for k, b in enumerate(BASE))},
      {", ".join(_spans(c.name, c.pattern, 0, 1, len(BASE) + k) for k, c in enumerate(CLASSES))} FROM t),
b AS (SELECT *, list_concat(list_concat(assign, access), hex) AS base FROM f),
w AS ({" UNION ALL ".join(_windows(k) for k in range(len(CLASSES)))}),
a AS (SELECT w.doc_id, list({{'s': w.s, 'k': w.k, 'e': w.e}}) AS added FROM w JOIN b ON w.doc_id = b.doc_id
      WHERE len(list_filter(b.base, lambda y: y.s <= w.s AND y.e >= w.e)) = 0 GROUP BY w.doc_id)
SELECT b.doc_id, len(assign) AS n_assign, len(access) AS n_access, len(hex) AS n_hex,
       sha256({_joined("base")}) AS base_sha256, {_joined("list_concat(base, coalesce(added, []))")} AS spans
FROM b LEFT JOIN a ON a.doc_id = b.doc_id
"""

RANKED_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row_no,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_no, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM sized),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
tf AS (SELECT row_no, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT row_no, doc_id, n, unnest(ts) AS t FROM sized) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::BIGINT AS w FROM df, totals),
s AS (
  SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t), totals GROUP BY item_id, row_no, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""

TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY i) AS ts FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, ts, conv_id - conv_id % 100 AS base,
         xor(4294967295::BIGINT, list_reduce(
           list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) % 6 AS h
  FROM own),
convs AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, c.h), []), list_slice(c.ts, c.h + 1, len(c.ts))) AS ts
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.base),
prefixes AS (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM convs),
nodes AS (
  SELECT list_slice(ts, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CASE WHEN len(ts) = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM prefixes GROUP BY ALL),
children AS (SELECT list_slice(p, 1, depth - 1) AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own_values AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.p[n.depth].text) ELSE 0 END AS saved
  FROM nodes n LEFT JOIN children c ON c.p = n.p AND c.depth = n.depth),
up AS (SELECT p, saved, n_children, unnest(range(0, depth + 1)) AS d FROM own_values),
sums AS (SELECT list_slice(p, 1, d) AS p, d AS depth, sum(saved) AS saved_tokens, count_if(n_children = 0) AS n_leaves FROM up GROUP BY ALL)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM own_values n JOIN sums s ON s.p = n.p AND s.depth = n.depth
LEFT JOIN nodes q ON q.depth = n.depth - 1 AND q.p = list_slice(n.p, 1, n.depth - 1)
"""
