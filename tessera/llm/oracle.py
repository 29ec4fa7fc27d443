"""DuckDB SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
),
g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

URLS = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                               lambda x: x <> '' AND NOT starts_with(x, 'utm_'))) AS args
  FROM p
),
c AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
            || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical
  FROM parts
),
listed AS (
  SELECT DISTINCT canonical FROM c
  WHERE regexp_matches(regexp_extract(canonical, '^[^/?]*'),
                       '(^|\.)(ads-track|spam-farm|casino-win|adult-x|cheap-pills|free-bets)\.')
),
r AS (
  SELECT c.*, l.canonical IS NOT NULL AS listed,
    CASE
      WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
    END AS rule
  FROM c LEFT JOIN listed l ON c.canonical = l.canonical
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict,
       listed
FROM r
"""

DECONTAMINATION = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
iw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, sizes WHERE len(w) >= n)
),
found AS (SELECT doc_id, item_id, p, n FROM grams JOIN windows USING (n, g)),
hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id
),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS meet
  FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
),
links AS (
  SELECT a, b FROM pairs JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id
  WHERE 100 * meet >= 75 * (p.n + q.n - meet)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.b) AS component_id
FROM d JOIN reach ON d.doc_id = reach.a LEFT JOIN n ON n.doc_id = d.doc_id
GROUP BY d.doc_id
"""

MERKLE = r"""
WITH RECURSIVE parts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
),
hashed AS (
  SELECT rid, doc_id, lang,
         sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || tail) AS tampered,
         xor(4294967295::BIGINT, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda r, e: xor(xor(r, e) >> 1, 3988292384 * (xor(r, e) & 1)))) AS crc
  FROM parts
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
),
nodes AS (
  SELECT lang, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY lang, level, idx // 2
),
tops AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n
  FROM nodes WHERE n = 1
),
over_tops AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM tops
  UNION ALL
  SELECT level + 1, idx // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY idx))
  FROM over_tops WHERE n > 1 GROUP BY level, idx // 2
),
steps AS (
  SELECT l.rid, x.level, CASE WHEN x.idx & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
  FROM leaves l
  JOIN nodes x ON x.lang IS NOT DISTINCT FROM l.lang AND x.idx = l.idx >> x.level AND x.n > 1
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.level = x.level AND s.idx = xor(x.idx, 1)
  UNION ALL
  SELECT l.rid, 1000 + x.level, CASE WHEN x.idx & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '')
  FROM leaves l
  JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang
  JOIN over_tops x ON x.idx = t.idx >> x.level AND x.n > 1
  LEFT JOIN over_tops s ON s.level = x.level AND s.idx = xor(x.idx, 1)
),
paths AS (SELECT rid, list(step ORDER BY level) AS path FROM steps GROUP BY rid),
whole AS (
  SELECT l.*, t.subroot, coalesce(p.path, []) AS path,
         CASE WHEN crc % 7 = 0 AND tampered IS NOT NULL THEN tampered ELSE leaf END AS start
  FROM leaves l JOIN tops t ON t.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p USING (rid)
),
folded AS (
  SELECT *, sha256(coalesce(array_to_string(list_transform(path, lambda e: substr(e, 2)), ''), '')) AS proof_sha256,
         list_reduce(list_prepend(start, path), lambda r, e: sha256(
           CASE WHEN e[1] = 'L' THEN substr(e, 2) || r ELSE r || substr(e, 2) END)) AS folded_root
  FROM whole
)
SELECT doc_id, leaf, subroot, o.h AS root, proof_sha256, folded_root, folded_root = o.h AS verified
FROM folded, over_tops o WHERE o.n = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op5_exact_dedup": EXACT_DEDUP, "op8_urls": URLS, "op9_jaccard_join": JACCARD_JOIN,
    "op10_decontamination": DECONTAMINATION, "op12_merkle": MERKLE,
}
