"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) = 1 AS kept,
       text_sha256
FROM texts
"""

WARC = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM firsts
"""

URL_FILTER = r"""
WITH RECURSIVE
urls AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'),
                                        '(?is)<(?:link|meta)\b[^>]*>')) AS tag
  FROM urls WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')),
told AS (
  SELECT url, trim(replace(CASE
      WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b')
        THEN concat(regexp_extract(tag, '(?is)\bhref\s*=\s*"([^"]*)"', 1),
                    regexp_extract(tag, '(?is)\bhref\s*=\s*''([^'']*)''', 1),
                    regexp_extract(tag, '(?is)\bhref\s*=\s*([^\s>"'']+)', 1))
      WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
        THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''>\s]+)', 1) END, '&amp;', '&')) AS link
  FROM tags),
ends AS (
  SELECT url AS source, CASE
      WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://') THEN link
      WHEN starts_with(link, '//') THEN 'http:' || link
      WHEN starts_with(link, '/') THEN 'http://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || link
      WHEN link = '' OR starts_with(link, '#') THEN NULL
      WHEN starts_with(link, '?') THEN 'http://' || regexp_extract(url, '(?s)^.*?://([^?#]*)', 1) || link
      ELSE 'http://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)
           || regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '')
           || CASE WHEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE '' END || link
    END AS target
  FROM told WHERE link IS NOT NULL),
known AS (
  SELECT url FROM urls UNION SELECT target FROM ends WHERE target IS NOT NULL),
parts AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query
  FROM known),
nodes AS (
  SELECT *, CASE WHEN contains(url, '://')
                 THEN concat(host, CASE WHEN path = '' THEN '/' ELSE path END, query) END AS node
  FROM parts),
rules(rule_host, rule_path, verdict, rule) AS (
  VALUES ('net', '/', 'block', 'net/'), ('example.net', '/en/', 'allow', 'example.net/en/'),
         ('example.com', '/de/', 'block', 'example.com/de/'), ('org', '/fr/', 'allow', 'org/fr/')),
ruled AS (
  SELECT n.url, n.node, n.host, n.path, r.rule, r.verdict
  FROM nodes n LEFT JOIN rules r
    ON (n.host = r.rule_host OR ends_with(n.host, '.' || r.rule_host)) AND starts_with(n.path, r.rule_path)
  QUALIFY row_number() OVER (PARTITION BY n.url ORDER BY length(r.rule) DESC NULLS LAST) = 1),
edges AS (
  SELECT DISTINCT a.node AS u, b.node AS v
  FROM ends e JOIN nodes a ON a.url = e.source JOIN nodes b ON b.url = e.target
  WHERE a.node <> b.node),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(node, other) AS (
  SELECT u, u FROM both_ways UNION SELECT r.node, b.v FROM reach r JOIN both_ways b ON b.u = r.other),
alias AS (
  SELECT r.node, bool_or(d.verdict = 'allow') AS allowed, bool_or(d.verdict = 'block') AS blocked
  FROM reach r JOIN ruled d ON d.node = r.other AND d.rule IS NOT NULL GROUP BY r.node)
SELECT u.page_id, d.host, d.path, d.rule,
       coalesce(d.verdict, CASE WHEN a.allowed THEN 'allow' WHEN a.blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM urls u JOIN ruled d ON d.url = u.url LEFT JOIN alias a ON a.node = d.node
"""

CONVERSATION_TRIE = """
WITH RECURSIVE
steps AS (
  SELECT range AS b, range AS v, 0 AS k FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT b, v FROM steps WHERE k = 8),
crcs AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS v
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, i + 1, xor(crcs.v >> 8, t.v)
  FROM crcs JOIN crc_table t ON t.b = xor(crcs.v, CAST(ascii(s[i + 1]) AS BIGINT)) & 255
  WHERE i < length(s)),
heads AS (SELECT conv_id, xor(v, 4294967295) % 6 AS h FROM crcs WHERE i = length(s)),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
         length(coalesce(text, '')) AS size,
         sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS name
  FROM conversations WHERE conv_id IS NOT NULL),
rebuilt AS (
  SELECT h.conv_id, t.pos, t.size, t.name FROM heads h JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 100
  WHERE t.pos <= h.h
  UNION ALL
  SELECT h.conv_id, t.pos, t.size, t.name FROM heads h JOIN turns t ON t.conv_id = h.conv_id
  WHERE t.pos > h.h),
placed AS (
  SELECT conv_id, size, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth,
         sha256(string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS prefix
  FROM rebuilt),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS prefix, 0 AS size FROM heads
  UNION ALL
  SELECT conv_id, depth, prefix, size FROM placed),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS least, count(*) AS n, any_value(size) AS size
  FROM paths GROUP BY depth, prefix),
lasts AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
ends AS (
  SELECT depth, prefix, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM paths JOIN lasts USING (conv_id, depth) GROUP BY depth, prefix),
parents AS (
  SELECT n.depth, n.prefix, p.prefix AS above FROM nodes n JOIN paths p ON p.conv_id = n.least AND p.depth = n.depth - 1),
children AS (SELECT depth - 1 AS depth, above AS prefix, count(*) AS n_children FROM parents GROUP BY depth, above),
subtrees AS (
  SELECT p.depth, p.prefix, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (WHERE c.n_children IS NULL) AS n_leaves
  FROM nodes n JOIN paths p ON p.conv_id = n.least AND p.depth <= n.depth
  LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
  GROUP BY p.depth, p.prefix)
SELECT n.least AS conv_id, CAST(n.depth AS BIGINT) AS depth, a.least AS parent_conv_id, n.n AS n_convs,
       coalesce(c.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM nodes n
JOIN subtrees s ON s.depth = n.depth AND s.prefix = n.prefix
LEFT JOIN parents p ON p.depth = n.depth AND p.prefix = n.prefix
LEFT JOIN nodes a ON a.depth = p.depth - 1 AND a.prefix = p.above
LEFT JOIN children c ON c.depth = n.depth AND c.prefix = n.prefix
LEFT JOIN ends e ON e.depth = n.depth AND e.prefix = n.prefix
"""

VECTOR_DEDUP = """
WITH RECURSIVE
vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (
  SELECT vec_id AS node, vec_id AS root FROM vectors
  UNION
  SELECT l.v, r.root FROM reached r JOIN links l ON l.u = r.node),
parts AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node),
numbers AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN parts ON node = vec_id LEFT JOIN numbers ON u = vec_id
"""
