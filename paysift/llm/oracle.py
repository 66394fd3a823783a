"""DuckDB SQL of the queries that SQL can express, written independently of the operators."""

from __future__ import annotations

_METRICS = ["word_length", "symbols", "punctuation", "capitals", "dup_lines", "repeats"]

QUALITY_RULES = r"""
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, list_aggregate(words[i:i+4], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
cover AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n
          FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY 1),
base AS (
  SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[\p{L}\p{N}\x20\x09-\x0D]+', '', 'g')) AS n_punct,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capital, len(lines) AS n_lines
  FROM w LEFT JOIN cover USING (doc_id)),
m AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * word_chars // nullif(n_words, 0) AS word_length, 1000 * n_symbols // nullif(n_words, 0) AS symbols,
         1000 * n_punct // nullif(n_words, 0) AS punctuation, 1000 * n_capital // nullif(word_chars, 0) AS capitals,
         1000 * n_dup_lines // nullif(n_lines, 0) AS dup_lines, 1000 * n_repeat_words // nullif(n_words, 0) AS repeats
  FROM base),
long AS (
""" + "\n  UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {s} AS spread, {m} AS v FROM m WHERE NOT base_failed AND {m} IS NOT NULL"
                          for m, s in zip(_METRICS, [60, 40, 60, 40, 60, 40], strict=True)) + r"""),
b AS (SELECT lang, source, metric, spread,
             CASE WHEN v < 64 THEN v ELSE (v >> (length(bin(v)) - 6)) << (length(bin(v)) - 6) END AS bucket FROM long),
lev AS (SELECT 0 AS level, lang, source, metric, spread, bucket FROM b
        UNION ALL SELECT 1, lang, NULL, metric, spread, bucket FROM b
        UNION ALL SELECT 2, NULL, NULL, metric, spread, bucket FROM b),
q AS (SELECT level, lang, source, metric, spread, count(*) AS n,
             quantile_disc(bucket, 0.25) AS q25, quantile_disc(bucket, 0.5) AS q50, quantile_disc(bucket, 0.75) AS q75
      FROM lev GROUP BY ALL),
f AS (SELECT level, lang, source, metric, n, q50 - 5 * greatest(q50 - q25, spread) AS low,
             q50 + 5 * greatest(q75 - q50, spread) AS high FROM q),
g AS (SELECT level, lang, source, max(n) AS n, max(low) FILTER (metric = 'word_length') AS low_word_length,
""" + ",\n".join(f"             max(high) FILTER (metric = '{m}') AS high_{m}" for m in _METRICS) + r"""
      FROM f GROUP BY ALL),
j AS (SELECT m.*, CASE WHEN a.n >= 100 THEN a WHEN l.n >= 100 THEN l ELSE c END AS t
      FROM m LEFT JOIN g a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
             LEFT JOIN g l ON l.level = 1 AND l.lang IS NOT DISTINCT FROM m.lang
             LEFT JOIN g c ON c.level = 2),
k AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
             concat_ws(',', """ + ", ".join(f"CASE WHEN {m} > t.high_{m} THEN '{m}' END" for m in _METRICS) + r""",
                       CASE WHEN word_length < t.low_word_length THEN 'low_word_length' END) AS broken FROM j)
SELECT *, NOT base_failed AND broken = '' AS kept FROM k
"""

MINHASH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) < 2 THEN words
                               ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, k = x.n AND k = y.n AS same FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * k >= 80 * (x.n + y.n - k)),
sides AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT sides.v, reach.c FROM reach JOIN sides ON sides.u = reach.doc_id),
least_of AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1),
class AS (SELECT b AS doc_id, min(a) AS first FROM links WHERE same GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept,
       CASE WHEN n.n IS NOT NULL THEN coalesce(class.first, doc_id) END AS class_id
FROM w JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)
"""

# Conversation prefix trie: prefixes as lists of (role, text), subtrees by listing every ancestor.
# DuckDB has no crc32: its table is made by the polynomial's rule.
PREFIX_TRIE = r"""
WITH RECURSIVE
crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS first,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda k: ascii(s[k])::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id, conv_id::VARCHAR AS s FROM numbered), crc
),
taken AS (
  SELECT c.conv_id, n.place, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.first AND n.place <= c.h
),
rebuilt AS (
  SELECT * FROM taken
  UNION ALL
  SELECT n.conv_id, n.place - c.h + (SELECT count(*) FROM taken k WHERE k.conv_id = n.conv_id) AS place, n.role, n.text
  FROM numbered n JOIN convs c ON c.conv_id = n.conv_id AND n.place > c.h
),
whole AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.place) FILTER (WHERE r.place IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id
),
prefixes AS (
  SELECT conv_id, d, s[1:d] AS p, d = len(s) AS is_end FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM whole)
),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE is_end), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS words
  FROM prefixes GROUP BY d, p
),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
flagged AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.d = n.d AND c.p = n.p),
totals AS (
  SELECT a AS d, p[1:a] AS p, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM flagged) GROUP BY 1, 2
)
SELECT f.conv_id::BIGINT AS conv_id, f.d::BIGINT AS depth, o.conv_id::BIGINT AS parent_conv_id, f.n_convs::BIGINT AS n_convs,
       f.n_children::BIGINT AS n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM flagged f JOIN totals t ON t.d = f.d AND t.p = f.p
LEFT JOIN flagged o ON o.d = f.d - 1 AND o.p = f.p[1:f.d - 1]
"""

# Phrase collocations: every n-gram listed and counted by itself, products as 128-bit integers.
COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
listed AS (
  SELECT lang, pid, unnest(w) AS w1, generate_subscripts(w, 1) AS i
  FROM (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces)
),
places AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM listed WINDOW o AS (PARTITION BY pid ORDER BY i)
),
grams AS (
  SELECT lang, 1 AS k, w1 AS p, count(*)::HUGEINT AS f FROM places GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM places WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM places WHERE w3 IS NOT NULL GROUP BY ALL
),
total AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
cand AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM grams WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.k, c.a, x.f AS l, y.f AS r, s.c AS cut, (1000000 * c.a * c.a) // (x.f * y.f) AS score
  FROM cand c JOIN (VALUES (1), (2)) AS s(c) ON s.c < c.k
  JOIN grams x ON x.lang = c.lang AND x.k = s.c AND x.p = array_to_string(c.w[1:s.c], ' ')
  JOIN grams y ON y.lang = c.lang AND y.k = c.k - s.c AND y.p = array_to_string(c.w[s.c + 1:c.k], ' ')
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p, k ORDER BY score, cut) = 1),
longer AS (
  SELECT lang, p, max(f) AS f FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS p, a AS f FROM cand WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL
),
kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.p = b.p AND b.k = 2
  WHERE g.f IS NULL OR 100 * g.f < 50 * b.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM kept)
SELECT r.lang, r.rank::BIGINT AS rank, r.p AS phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r,
       t.n::BIGINT AS n, r.score::BIGINT AS score
FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
