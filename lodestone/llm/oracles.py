"""The operators' results in DuckDB SQL, where SQL can express them on whole tables."""

from __future__ import annotations

_WORDS = "'[^\\x20\\x09-\\x0D]+'"

OP3 = f"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
rows AS (SELECT doc_id, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM split),
counted AS (SELECT doc_id, i, len(regexp_extract_all(line, {_WORDS})) AS w FROM rows),
summed AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM counted),
ahead AS (SELECT a.doc_id, a.i AS first, min(b.i) AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 GROUP BY ALL),
back AS (SELECT a.doc_id, max(b.i) AS first, a.i AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i <= a.i AND a.upto - b.upto + b.w >= 50 GROUP BY ALL),
runs AS (SELECT r.doc_id, r.first, r.last, s.l[r.first : r.last] AS body FROM (SELECT * FROM ahead UNION SELECT * FROM back) r JOIN split s ON s.doc_id = r.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS copy FROM runs),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM placed WHERE copy > 1),
kept AS (SELECT r.doc_id, r.i, r.line, g.i IS NOT NULL AS out FROM rows r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.i = r.i)
SELECT doc_id, coalesce(string_agg(CASE WHEN NOT out THEN line END, chr(10) ORDER BY i), '') AS text, count(*)::INT AS n_lines,
  coalesce(string_agg(CASE WHEN out THEN (i - 1)::VARCHAR END, ',' ORDER BY i), '') AS removed_lines
FROM kept GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, '' FROM documents WHERE text IS NULL"""

OP5 = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS s FROM worded),
nodes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS item FROM nodes),
links AS (SELECT a.node AS u, b.node AS v FROM items a JOIN items b ON a.item = b.item AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT r.node, e.v FROM reach r JOIN edges e ON e.u = r.other),
roots AS (SELECT node, min(other) AS root FROM reach GROUP BY node)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN roots r ON r.node = n.node"""

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(coalesce({html}, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce({html}, '') || chr(13) || chr(10) || chr(13) || chr(10)"""

OP7 = f"""
WITH texts AS (SELECT page_id, {_RECORD.format(html="html")} AS mine, {_RECORD.format(html="(CASE WHEN page_id % 50 = 7 THEN '#' || substr(html, 2) ELSE html END)")} AS theirs FROM pages),
sized AS (SELECT page_id, strlen(mine)::BIGINT AS length, sha256(mine) AS sha256, sha256(theirs) AS other FROM texts),
placed AS (SELECT *, (('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % (SELECT greatest(1, (sum(length) + 16777215) // 16777216)::BIGINT FROM sized))::INT AS archive FROM sized),
laid AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM placed),
judged AS (SELECT *, CASE WHEN page_id % 211 = 3 THEN 'missing' WHEN sha256 <> other THEN 'corrupt' ELSE 'intact' END AS state FROM laid),
ranges AS (SELECT DISTINCT archive, "offset" // 65536 AS node FROM judged WHERE state <> 'intact')
SELECT j.page_id, j.archive, j."offset", j.length, j.sha256, CASE WHEN r.node IS NOT NULL AND j.state <> 'missing' THEN j.other END AS replica_sha256, j.state
FROM judged j LEFT JOIN ranges r ON r.archive = j.archive AND r.node = j."offset" // 65536"""

# case is folded for ASCII only, and one length in code points; look-arounds are the tails of whole runs
OP6 = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
patterns(kind, place, folded, p) AS (VALUES
  ('assign', 0, true, '(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[a-z0-9+/_.=-]+'),
  ('access', 1, false, 'AKIA[A-Z0-9]+'),
  ('hex', 2, false, '[0-9a-f]+'),
  ('linked_secret', 3, false, '[A-Za-z0-9+/_=-]+'),
  ('linked_id', 4, true, '(?:client_?id|access_?key_?id|account|user_?name|user|login)["'']?\x20*[:=]\x20*["'']?[a-z0-9_@.+-]{3,}'),
  ('linked_endpoint', 5, true, '\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"''<>]+')),
found AS (SELECT row, kind, place, regexp_extract_all(CASE WHEN folded THEN low ELSE t END, p) AS m, regexp_split_to_array(CASE WHEN folded THEN low ELSE t END, p) AS gaps, t FROM texts, patterns),
parts AS (SELECT row, kind, place, t, unnest(m) AS match, unnest(gaps[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT row, kind, place, substr(t, stop - length(match) + 1, length(match)) AS match, stop - length(match) AS start, stop FROM
  (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY row, kind ORDER BY i)::BIGINT AS stop FROM parts)),
tails AS (SELECT * REPLACE (CASE WHEN kind = 'linked_secret' THEN regexp_extract(match, '(?:^|=)([A-Za-z0-9+/_-]{32,}={0,2})$', 1) ELSE match END AS match) FROM placed),
spans AS (SELECT row, kind, place, stop - length(match) AS start, stop FROM tails WHERE CASE kind
  WHEN 'assign' THEN length(regexp_extract(match, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6
  WHEN 'access' THEN length(match) >= 20 WHEN 'hex' THEN length(match) >= 24
  WHEN 'linked_secret' THEN match SIMILAR TO '.*[A-Z].*' AND match SIMILAR TO '.*[a-z].*' AND match SIMILAR TO '.*[0-9].*' ELSE true END),
base AS (SELECT * FROM spans WHERE place < 3),
weak AS (SELECT * FROM spans w WHERE place >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = w.row AND b.start < w.stop AND w.start < b.stop)),
sides AS (SELECT *, kind IN ('assign', 'hex', 'linked_secret') AS secret FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM sides s WHERE s.row = w.row AND s.secret <> (w.kind = 'linked_secret') AND s.start - w.stop <= 256 AND w.start - s.stop <= 256)),
reported AS (SELECT row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop) FILTER (place < 3) AS bases,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place, stop) AS spans, count(*) FILTER (place >= 3) AS n_linked
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bases, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM texts LEFT JOIN reported USING (row)"""
