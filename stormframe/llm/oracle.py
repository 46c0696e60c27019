"""DuckDB SQL of the corpus operators that SQL can state."""

from __future__ import annotations

from stormframe.llm.licenses import CUES, LICENSE_FILE, TEMPLATES, TERM, THRESHOLD
from stormframe.llm.mixing import SEED
from stormframe.llm.phrases import COVERED_PERCENT, MINIMUM, SCALE, TOP, UNKNOWN

_WORD = r"[^\x20\x09-\x0D]+"

_CUE = " OR ".join(f"contains({{0}}, '{cue}')" for cue in CUES)
_TEMPLATES = ", ".join(f"('{license}', lower('{text}'))" for license, text in TEMPLATES)

OP2 = rf"""
WITH files AS (
  SELECT doc_id, lower(coalesce(text, '')) AS text,
    coalesce(source, 'none') || CASE WHEN doc_id % 50 = 0 THEN '/LICENSE'
      ELSE '/b' || (doc_id // 1000) || '/' || CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END
    END AS path
  FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))) AS sentence
  FROM files WHERE {_CUE.format("text")}),
notices AS (SELECT * FROM lines WHERE {_CUE.format("sentence")}),
counted AS (SELECT sentence, count(*) AS n FROM notices GROUP BY sentence),
total AS (SELECT coalesce(sum(n), 0) AS n FROM counted),
terms AS (
  SELECT sentence, term, count(*) AS tf
  FROM (SELECT sentence, unnest(regexp_extract_all(sentence, '{TERM}')) AS term FROM counted) GROUP BY ALL),
idf AS (
  SELECT term, ln((1.0 + any_value(t.n)) / (1.0 + sum(c.n))) + 1.0 AS idf
  FROM terms JOIN counted c USING (sentence), total t GROUP BY term),
templates(license, template) AS (VALUES {_TEMPLATES}),
template_terms AS (
  SELECT template, term, count(*) AS tf
  FROM (SELECT template, unnest(regexp_extract_all(template, '{TERM}')) AS term FROM (SELECT DISTINCT template FROM templates))
  GROUP BY ALL),
s AS (SELECT sentence, term, tf * idf AS w FROM terms JOIN idf USING (term)),
t AS (SELECT template, term, tf * coalesce(idf, ln(1.0 + total.n) + 1.0) AS w FROM template_terms LEFT JOIN idf USING (term), total),
s_norm AS (SELECT sentence, sqrt(sum(w * w)) AS norm FROM s GROUP BY sentence),
t_norm AS (SELECT template, sqrt(sum(w * w)) AS norm FROM t GROUP BY template),
products AS (
  SELECT sentence, license, round(sum(s.w * t.w) / (any_value(s_norm.norm) * any_value(t_norm.norm)), 9) AS cosine
  FROM s JOIN t USING (term) JOIN templates USING (template) JOIN s_norm USING (sentence) JOIN t_norm USING (template)
  GROUP BY sentence, license, template),
best AS (
  SELECT sentence, cosine, license FROM products WHERE cosine >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY cosine DESC, license) = 1),
own AS (
  SELECT doc_id, license AS own_license, cosine AS similarity FROM notices JOIN best USING (sentence)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, license) = 1),
placed AS (
  SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, own_license, similarity
  FROM files f LEFT JOIN own USING (doc_id)),
given AS (
  SELECT directory, arg_min(own_license, doc_id) AS license FROM placed
  WHERE own_license IS NOT NULL AND regexp_matches(lower(regexp_extract(path, '([^/]*)$', 1)), '{LICENSE_FILE}')
  GROUP BY directory),
near AS (
  SELECT p.doc_id, g.directory AS inherited_from, g.license AS inherited_license
  FROM placed p JOIN given g ON p.directory = g.directory OR starts_with(p.directory, g.directory || '/') OR g.directory = ''
  QUALIFY row_number() OVER (PARTITION BY p.doc_id ORDER BY length(g.directory) DESC) = 1)
SELECT doc_id, path, own_license, round(similarity, 6) AS similarity, inherited_license, inherited_from,
  coalesce(own_license, inherited_license) AS license
FROM placed LEFT JOIN near USING (doc_id)
"""

# The level of the shares: sources are stopped in the order of size over weight.
OP4 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
weighted AS (
  SELECT source, source_size, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    3.0::DOUBLE * source_size AS stop FROM per_source),
ordered AS (
  SELECT *, stop / weight AS stop_level,
    coalesce(sum(stop) OVER (ORDER BY stop / weight, turn_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
    sum(weight) OVER (ORDER BY stop / weight, turn_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn_key FROM weighted)),
level AS (
  SELECT arg_min(((SELECT sum(source_size) FROM per_source) - stopped) / open_weight, stop_level) AS level
  FROM ordered WHERE ((SELECT sum(source_size) FROM per_source) - stopped) / open_weight < stop_level),
rates AS (
  SELECT source, source_size, least(stop, weight * coalesce(level, 1e300)) AS target,
    CASE WHEN source_size = 0 THEN 0 WHEN stop <= weight * coalesce(level, 1e300) THEN 3.0 ELSE weight * level / source_size END AS rate
  FROM weighted, level)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT
    / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source
"""

# Equal words are compared as text; the pairs that share a shingle are counted in full.
OP5 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1) + 1))) AS i FROM words)),
sizes AS (SELECT doc_id, count(s)::BIGINT AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP13 = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, size, words[i:i + size - 1] AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM worded, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(words) >= size)),
counts AS (
  SELECT lang, size, phrase, count(*)::BIGINT AS a FROM grams GROUP BY ALL HAVING count(*) >= {MINIMUM}),
cuts AS (
  SELECT lang, size, phrase, a, unnest(range(1, size)) AS k FROM counts WHERE size > 1),
marks AS (
  SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r,
    ({SCALE}::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.phrase[1:k]
    JOIN counts r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]),
lowest AS (
  SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, phrase[i:i + m - 1] AS phrase
  FROM (SELECT lang, a, phrase, m, unnest(range(1, size - m + 2)) AS i
        FROM counts, (SELECT unnest([2, 3]) AS m) WHERE size > m)),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN longest g ON g.lang = o.lang AND g.phrase = o.phrase
  WHERE longer IS NULL OR 100 * longer < {COVERED_PERCENT} * o.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
  array_to_string(phrase, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""

ORACLE: dict[str, str] = {
    "op2_license_scan": OP2,
    "op4_mixing": OP4,
    "op5_ngram_join": OP5,
    "op8_exact_dedup": OP8,
    "op13_phrases": OP13,
}
