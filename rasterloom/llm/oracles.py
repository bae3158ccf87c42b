"""SQL for DuckDB of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from . import quality

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_warc"] = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT digest, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY digest)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.digest = f.digest
"""

# Matches with their places: the k-th begins after k gaps and k - 1 matches.
_KIND = """
SELECT doc_id, {order} AS kind_order, '{kind}' AS kind, m[k] AS found,
  CAST(list_sum([length(x) FOR x IN gaps[1:k]]) + coalesce(list_sum([length(x) FOR x IN m[1:k - 1]]), 0) AS BIGINT) AS first
FROM (SELECT doc_id, m, gaps, unnest(range(1, len(m) + 1)) AS k
  FROM (SELECT doc_id, regexp_extract_all(body, '{pattern}') AS m, string_split_regex(body, '{pattern}') AS gaps FROM d))
"""
_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
_VALID = r"""
  CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN len([x FOR x IN string_split(found, '.') IF length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 256) > 255]) = 0
    WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum([CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT)
      ELSE 2 * CAST(digits[i] AS INT) // 10 + 2 * CAST(digits[i] AS INT) % 10 END FOR i IN range(1, length(digits) + 1)]) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END"""
ORACLE_SQL["pii_base_spans"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
met AS ({" UNION ALL ".join(_KIND.format(order=k, kind=kind, pattern=pattern) for k, (kind, pattern) in enumerate(_PATTERNS))}),
told AS (SELECT *, regexp_replace(found, '[^0-9]', '', 'g') AS digits FROM met),
good AS (SELECT * FROM told WHERE {_VALID}),
joined AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind, _ in _PATTERNS)},
  string_agg(kind || ':' || first || ':' || (first + length(found)), ',' ORDER BY first, kind_order) AS spans FROM good GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _ in _PATTERNS)}, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN joined USING (doc_id)
"""

ORACLE_SQL["mixing_targets"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight, 3e0 * source_size AS stop FROM s),
o AS (SELECT *, stop / weight AS level, (SELECT sum(CAST(source_size AS DOUBLE)) FROM s) AS whole FROM w),
f AS (SELECT *, (whole - coalesce(sum(stop) OVER (ORDER BY level, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / sum(weight) OVER (ORDER BY level, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM o),
l AS (SELECT first(share ORDER BY level, rank) AS level FROM f WHERE f.level >= share)
SELECT doc_id, size, source_size, least(stop, coalesce((SELECT level FROM l) * weight, stop)) AS target
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
"""

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a),
lows AS (SELECT a AS id, min(b) AS low FROM reach GROUP BY a)"""

ORACLE_SQL["op6_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
linked AS (SELECT s.vec_id AS a, t.vec_id AS b FROM sound s JOIN sound t ON s.label = t.label AND s.vec_id <> t.vec_id AND len(s.e) = len(t.e)
  WHERE list_dot_product(s.e, t.e) / (sqrt(list_dot_product(s.e, s.e)) * sqrt(list_dot_product(t.e, t.e))) >= 0.98),
{_COMPONENTS}
SELECT vec_id, (SELECT count(*) FROM linked WHERE a = vec_id) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN lows ON id = vec_id
"""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL["op10_minhash_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, least(len(words), 1) + 1))) AS i FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
met AS (SELECT s.doc_id AS a, t.doc_id AS b, count(*) AS n FROM sets s JOIN sets t ON s.shingle = t.shingle AND s.doc_id <> t.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN lows ON id = doc_id
"""


def _quality_sql(rules: tuple[quality.Rule, ...]) -> str:
    stop = ", ".join(f"'{w}', '{w.capitalize()}'" for w in quality.STOP_WORDS)
    failed = " OR ".join(f"({r.applies} >= {r.applies_from} AND {r.numerator} {'<' if r.least else '>'} CAST({r.limit!r} AS DOUBLE) * {r.denominator})" for r in rules)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT doc_id, body, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS words, [x FOR x IN string_split(body, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
spans AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS seen FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, seen) AS n FROM spans) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN words]), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, len([x FOR x IN words IF x IN ({stop})]) AS n_stop_words, len(lines) AS n_lines,
  len([x FOR x IN lines IF substring(x, 1, 1) IN ('-', '*', '•', '‣', '·')]) AS n_bullet_lines,
  len([x FOR x IN lines IF suffix(x, '...') OR suffix(x, '…')]) AS n_ellipsis_lines
  FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {failed}) AS kept FROM b
"""


ORACLE_SQL["op8_quality_rules"] = _quality_sql(quality.RULES)

ORACLE_SQL["fingerprint_edits"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
n AS (SELECT doc_id, body, coalesce(lead(body) OVER w, first_value(body) OVER w) AS next, length(body) AS n FROM d WINDOW w AS (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(body, 1, n - n // 3) || substring(next, 1, n // 3)) AS edited_sha256 FROM n
"""

_WHOLE = "[floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding]"
_SOUND = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    steps = []
    for k in range(rounds + 1):
        # Distances less |x|^2 are whole numbers in doubles; the lower entry on a tie.
        steps.append(f"""
a{k} AS (SELECT p.vec_id, p.part, arg_min(b.e, {{'d': list_dot_product(b.v, b.v) - 2 * list_dot_product(p.v, b.v), 'e': b.e}}) AS e FROM p JOIN b{k} b USING (part) GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT part, e, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{k} USING (vec_id, part), (SELECT width, unnest(range(1, width + 1)) AS pos FROM w) GROUP BY ALL),
c{k} AS (SELECT part, e, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY pos) AS v FROM m{k} GROUP BY ALL),
b{k + 1} AS (SELECT part, e, coalesce(c.v, b.v) AS v FROM b{k} b LEFT JOIN c{k} c USING (part, e))""")
    return f"""
WITH k AS (SELECT vec_id, label, {_WHOLE} AS v FROM embeddings WHERE {_SOUND}),
w AS (SELECT max(len(v)) // {parts} AS width FROM k),
p AS (SELECT vec_id, part, v[part * width + 1 : part * width + width] AS v FROM k, w, (SELECT unnest(range({parts})) AS part)),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k QUALIFY e < {entries}),
b0 AS (SELECT part, e, v FROM p JOIN o USING (vec_id)),{",".join(steps)},
f AS (SELECT vec_id, string_agg(printf('%02x', a.e), '' ORDER BY part) AS code,
  CAST(sum(list_dot_product(p.v, p.v) - 2 * list_dot_product(p.v, b.v) + list_dot_product(b.v, b.v)) AS BIGINT) AS error
  FROM a{rounds} a JOIN p USING (vec_id, part) JOIN b{rounds} b USING (part, e) GROUP BY vec_id),
t AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM f JOIN k USING (vec_id) GROUP BY label),
g AS (SELECT sha256(string_agg(array_to_string([CAST(x AS BIGINT) FOR x IN v], ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM f JOIN k USING (vec_id) JOIN t ON t.label IS NOT DISTINCT FROM k.label, g
"""


ORACLE_SQL["op12_vector_codes"] = _codes_sql(16, 64, 2)

ORACLE_SQL["op13_hard_negatives"] = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND {_SOUND}),
s AS (SELECT a.vec_id AS anchor, x.vec_id AS id, a.label = x.label AS same, CAST(list_dot_product(a.v, x.v) AS BIGINT) AS score FROM r a JOIN r x ON a.vec_id <> x.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score FROM n WHERE rank <= 3
"""
