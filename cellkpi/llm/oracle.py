"""SQL for the operators' queries that SQL can express over whole tables."""

from __future__ import annotations

from cellkpi.llm.license_rules import BASE_WEIGHT, SPAN, WEIGHTS
from cellkpi.llm.license_scan import RULES

WORD = r"[^\x20\x09-\x0D]+"

LINE_QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
),
windows AS (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w),
twice AS (
  SELECT doc_id, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY doc_id, words[i : i + 4]) > 1
),
repeated AS (
  SELECT doc_id, count(DISTINCT i + o) AS n
  FROM twice CROSS JOIN (SELECT unnest(range(5)) AS o) GROUP BY doc_id
),
line AS (SELECT doc_id, unnest(lines) AS l FROM w),
sized AS (SELECT doc_id, l, len(regexp_extract_all(l, '{WORD}')) AS n FROM line),
judged AS (
  SELECT doc_id, n,
    100 * (len(regexp_extract_all(l, '[#*$%&|<>]')) + len(regexp_extract_all(l, '!!'))) >= 33 * n
    OR 100 * len(list_filter(regexp_extract_all(l, '{WORD}'),
      lambda x: x IN ('|', '>', '»', '•', '·', '/', '-', '–'))) >= 33 * n
    OR n >= 6 AND NOT regexp_matches(l, '[.!?:;…。！？]')
    OR regexp_matches(lower(l), 'all rights reserved|terms of use|terms of service|privacy policy'
      || '|cookie policy|accept cookies|powered by|subscribe to our|sign up for our'
      || '|released under the|licensed under|javascript is disabled|enable javascript') AS fails
  FROM sized
),
kept AS (
  SELECT doc_id, count(*) AS found, count(*) FILTER (WHERE fails) AS failed,
    coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS good
  FROM judged GROUP BY doc_id
),
counts AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    coalesce(k.found, 0)::BIGINT AS n_lines, coalesce(k.failed, 0)::BIGINT AS n_failed_lines,
    coalesce(k.good, 0)::BIGINT AS n_kept_words
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id LEFT JOIN kept k ON k.doc_id = w.doc_id
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND 100 * n_kept_words >= 50 * n_words AS kept
FROM counts
"""

PHRASE_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY words[i : i + 19] ORDER BY doc_id, i) > 1
),
gone AS (
  SELECT DISTINCT doc_id, i + o AS i FROM later CROSS JOIN (SELECT unnest(range(20)) AS o)
),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words,
  (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

BYTE_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS text FROM documents),
windows AS (
  SELECT doc_id, i, md5(substr(text, 2 * i + 1, 400)) AS k
  FROM (SELECT doc_id, text, unnest(range(0, length(text) // 2 - 199)) AS i FROM d)
),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY k) > 1),
reach AS (
  SELECT doc_id, i, max(i + 200) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM again
),
numbered AS (
  SELECT doc_id, i, sum(CASE WHEN i <= before THEN 0 ELSE 1 END) OVER (
    PARTITION BY doc_id ORDER BY i) AS run
  FROM reach
),
runs AS (
  SELECT doc_id, min(i) AS b, max(i) + 200 AS e FROM numbered GROUP BY doc_id, run
),
gaps AS (
  SELECT doc_id, b, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS kept_from,
    e, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY b) AS k
  FROM runs
),
parts AS (
  SELECT g.doc_id, any_value(n) AS n, sum(e - b) AS removed,
    string_agg(substr(text, 2 * kept_from + 1, 2 * (b - kept_from)), '' ORDER BY b)
      || substr(any_value(text), 2 * max(e) + 1) AS kept
  FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id
)
SELECT d.doc_id, (length(text) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
  coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, text))) AS kept_sha256
FROM d LEFT JOIN parts ON parts.doc_id = d.doc_id
"""


HARD_NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scores AS (
  SELECT a.r AS anchor, a.id AS anchor_id, b.r AS other, b.id, a.label = b.label AS same,
    list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r
  WHERE a.id % 100 = 0
),
positives AS (
  SELECT anchor, anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id, other) AS slot
  FROM scores WHERE same
  QUALIFY slot <= 5
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor, p.slot ORDER BY s.score DESC, s.id, s.other)::INTEGER
    AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor = p.anchor AND NOT s.same
WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

_RULES = ", ".join(
    f"({i}, '{r.label}', {r.level}, '{r.keyword}', '^({r.pattern})(?: |$)', "
    f"{WEIGHTS.get(r.level, BASE_WEIGHT)}::DOUBLE)"
    for i, r in enumerate(RULES)
)

LICENSES = rf"""
WITH rules(rule, label, level, keyword, pattern, weight) AS (VALUES {_RULES}),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
word AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS i, words FROM docs),
ahead AS (
  SELECT r, word, i - 1 AS start, array_to_string(words[i : i + {SPAN - 1}], ' ') AS said
  FROM word WHERE word IN (SELECT keyword FROM rules)
),
matched AS (
  SELECT r, rule, label, level, weight, start, regexp_extract(said, pattern, 1) AS text
  FROM ahead JOIN rules ON keyword = word
),
places AS (
  SELECT r, rule, label, level, weight, start, start + len(string_split(text, ' ')) AS stop
  FROM matched WHERE text <> ''
),
outermost AS (
  SELECT * FROM places p WHERE level > 0 AND NOT EXISTS (
    SELECT 1 FROM places q
    WHERE q.r = p.r AND q.level >= p.level AND q.start <= p.start AND q.stop >= p.stop
      AND (q.start < p.start OR q.stop > p.stop OR q.level > p.level
        OR (q.level = p.level AND q.rule < p.rule)))
),
kept AS (
  SELECT * FROM outermost p WHERE NOT EXISTS (
    SELECT 1 FROM outermost q
    WHERE q.r = p.r AND q.level > p.level AND q.start < p.stop AND q.stop > p.start)
  UNION ALL SELECT * FROM places WHERE level = 0
),
marks AS (
  SELECT r, count(*) FILTER (level = 0) AS n_base, min(start) FILTER (level = 0) AS first_word,
    max(start) FILTER (level = 0) AS last_word, max(weight) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (level = 0) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM kept GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base,
  first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN marks USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_quality": LINE_QUALITY,
        "op9_phrase_dedup": PHRASE_DEDUP,
        "op10_byte_dedup": BYTE_DEDUP,
        "op12_hard_negatives": HARD_NEGATIVES,
        "op13_license_scan": LICENSES,
    }
