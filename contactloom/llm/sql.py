"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

from __future__ import annotations

from .licenses import PHRASES, SPAN, TEMPLATES, _sequence, needed, template_words
from .quality import BASE_MIN_WORDS, BASE_REPEAT_PERCENT, RULES, STOP_FORMS

_STOP = ", ".join(f"'{w}'" for w in STOP_FORMS)
_BROKEN = ", ".join(f"CASE WHEN 100 * {m} {op} {pct} * {ref} THEN '{name}' END" for name, m, op, pct, ref in RULES)

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), e AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT rid, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM e
), y AS (
  SELECT rid, i, x, lead(x) OVER s AS x1, lead(x, 2) OVER s AS x2 FROM g WINDOW s AS (PARTITION BY rid ORDER BY i)
), h AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, x, x1, x2) AS c FROM y WHERE x2 IS NOT NULL
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM h, (VALUES (0), (1), (2)) AS o(k) WHERE c > 1 GROUP BY rid
), m AS (
  SELECT doc_id, len(w) AS n_words, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words,
    len(regexp_extract_all(t, '\p{{Lu}}{{3,}}')) AS n_capital_runs,
    len(regexp_extract_all(t, '[0-9]')) AS n_digits,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    len(list_filter(l, lambda x: ltrim(x)[1] IN ('-', '*', '•'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS n_ellipsis_lines,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM e LEFT JOIN r USING (rid)
), v AS (
  SELECT *, n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed,
    concat_ws(',', {_BROKEN}) AS failed_rules
  FROM m
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""

_TEMPLATE_ROWS = ", ".join(
    f"('{label}', [" + ", ".join(f"'{w}'" for w in template_words(t)) + f"], {needed(len(template_words(t)))}, {SPAN * len(_sequence(t))})" for label, t in TEMPLATES
)
_PLACES = " UNION ALL ".join(
    f"SELECT rid, i - 1 AS p, '{label}' AS label FROM (SELECT rid, w, unnest(generate_series(1, len(w))) AS i FROM e WHERE contains(flat, ' {phrase} ')) "
    f"WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    for phrase, label in PHRASES
)

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), e AS (
  SELECT *, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, ' ' || array_to_string(w, ' ') || ' ' AS flat FROM d
), p AS ({_PLACES}
), b AS (
  SELECT rid, count(*) AS n, min(p) AS a, max(p) AS z, list_sort(list(DISTINCT label)) AS l FROM p GROUP BY rid
), c0 AS (
  SELECT rid, w, label, ws, need, span, unnest(generate_series(1, len(w))) AS i
  FROM e, (VALUES {_TEMPLATE_ROWS}) AS k(label, ws, need, span) WHERE len(list_intersect(w, ws)) >= need
), c1 AS (
  SELECT rid, label, ws, need, list_intersect(w[i:i + span - 1], ws) AS x FROM c0 WHERE list_contains(ws, w[i])
), c AS (
  SELECT rid, label, max(len(x) / len(ws)) AS s FROM c1 WHERE len(x) >= need GROUP BY rid, label
), m AS (
  SELECT rid, list(label) AS own, max(s) AS s FROM c GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word,
  coalesce(array_to_string(l, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(l, []), coalesce(own, [])))), ',') AS labels,
  greatest(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(s, 0.0::DOUBLE)) AS score
FROM e LEFT JOIN b USING (rid) LEFT JOIN m USING (rid)
"""

ORACLES: dict[str, str] = {
    "op2_licenses": OP2,
    "op1_quality": OP1,
}
