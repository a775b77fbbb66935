"""DuckDB twins of the corpus queries that SQL can express, over the same tables."""

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every 13-word window with the smallest document that starts it; words covered by windows of a smaller one go.
SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
cut AS (SELECT DISTINCT doc_id, i + j AS p FROM win JOIN low USING (k), range(13) t(j) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Sets of 2-word shingles, joined on their shingles; components by following links.
NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM d)
      UNION ALL SELECT doc_id, ws[1] FROM d WHERE len(ws) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT id, b FROM reach JOIN links ON c = a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS low FROM reach GROUP BY id) r ON r.id = d.doc_id
"""

#: Distinct word sets of lines; sets with 80 % likeness share one of their rarest words, and all such pairs are compared.
LINE_DEDUP = f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, line, list_sort(list_distinct({_WORDS.format(_LOWER.format("s"))})) AS ws FROM l),
f AS (SELECT row_number() OVER (ORDER BY pl) AS k, ws, pl FROM (SELECT ws, min({{'d': doc_id, 'l': line}}) AS pl FROM t WHERE len(ws) > 0 GROUP BY ws)),
w AS (SELECT k, len(ws) AS n, unnest(ws) AS w FROM f),
df AS (SELECT w, count(*) AS c FROM w GROUP BY w),
p AS (SELECT k, n, w FROM (SELECT k, n, w.w, row_number() OVER (PARTITION BY k ORDER BY c, w.w) AS r FROM w JOIN df ON df.w = w.w) WHERE r <= n - (n * 80 + 99) // 100 + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.w = b.w AND a.k > b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
hit AS (SELECT DISTINCT a FROM (SELECT a, len(x.ws) + len(y.ws) AS n, len(list_intersect(x.ws, y.ws)) AS shared FROM c JOIN f x ON x.k = a JOIN f y ON y.k = b) WHERE shared * 100 >= 80 * (n - shared)),
gone AS (SELECT doc_id, line FROM t JOIN f ON t.ws = f.ws WHERE doc_id <> pl.d OR line <> pl.l OR k IN (SELECT a FROM hit)),
kept AS (SELECT doc_id, string_agg(s, chr(10) ORDER BY line) AS k FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id),
many AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, coalesce(n, 0) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(k, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN many ON many.doc_id = d.doc_id
"""
