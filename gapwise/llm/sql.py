"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

MIX_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('11|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
rows_ AS MATERIALIZED (
  SELECT doc_id, source, size, CAST('0x' || h[1:2] AS INT) AS block, CAST('0x' || h[3:4] AS INT) AS leaf FROM docs),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM rows_ GROUP BY source),
filled AS (
  SELECT *, 3 * source_size AS cap,
         CAST(coalesce(sum(3 * source_size) OVER before, 0) AS BIGINT) AS capped_before,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS weight_left,
         CAST(sum(source_size) OVER () AS BIGINT) AS total
  FROM sizes
  WINDOW before AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - capped_before)::DOUBLE / weight_left AS level FROM filled),
fill AS (SELECT arg_min(level, (cap::DOUBLE / weight, source)) AS filled_to FROM levels WHERE cap::DOUBLE / weight >= level),
goal AS (SELECT source, source_size, least(cap::DOUBLE, filled_to * weight) AS target FROM levels, fill),
due AS (
  SELECT source, source_size, target, CAST(floor(target) AS BIGINT) AS due,
         CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS copies FROM goal),
quota AS (SELECT *, due - copies * source_size AS rest FROM due),
blocks AS (
  SELECT source, block, part, greatest(0, least(part, rest - (coalesce(sum(part) OVER (
           PARTITION BY source ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS own
  FROM (SELECT source, block, CAST(sum(size) AS BIGINT) AS part FROM rows_ GROUP BY ALL) b
  JOIN quota q USING (source)),
leaves AS (
  SELECT l.source, l.block, leaf, l.part, greatest(0, least(l.part, own - (coalesce(sum(l.part) OVER (
           PARTITION BY l.source, l.block ORDER BY leaf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))) AS own
  FROM (SELECT source, block, leaf, CAST(sum(size) AS BIGINT) AS part FROM rows_ GROUP BY ALL) l
  JOIN blocks b ON b.source = l.source AND b.block = l.block WHERE b.own > 0 AND b.own < b.part),
level1 AS (SELECT source, block, CAST(2 * (row_number() OVER (ORDER BY md5('11|1|' || source || '|' || block), source, block) - 1) >= count(*) OVER () AS INT) AS shard FROM blocks),
level2 AS (SELECT source, block, 2 * shard + CAST(2 * (row_number() OVER (PARTITION BY shard ORDER BY md5('11|2|' || source || '|' || block), source, block) - 1) >= count(*) OVER (PARTITION BY shard) AS INT) AS shard FROM level1),
level4 AS (SELECT source, block, 2 * shard + CAST(2 * (row_number() OVER (PARTITION BY shard ORDER BY md5('11|4|' || source || '|' || block), source, block) - 1) >= count(*) OVER (PARTITION BY shard) AS INT) AS shard FROM level2),
level8 AS (SELECT source, block, 2 * shard + CAST(2 * (row_number() OVER (PARTITION BY shard ORDER BY md5('11|8|' || source || '|' || block), source, block) - 1) >= count(*) OVER (PARTITION BY shard) AS INT) AS shard FROM level4)
SELECT r.doc_id, r.size, q.source_size, q.target, CAST(q.copies * r.size + CASE
         WHEN q.copies >= 3 OR b.own = 0 THEN 0 WHEN b.own = b.part THEN r.size
         ELSE coalesce(floor(r.size * v.own / v.part), 0) END AS BIGINT) AS taken, s.shard
FROM rows_ r JOIN quota q USING (source) JOIN blocks b ON b.source = r.source AND b.block = r.block
JOIN level8 s ON s.source = r.source AND s.block = r.block
LEFT JOIN leaves v ON v.source = r.source AND v.block = r.block AND v.leaf = r.leaf
"""

NEAREST_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]), lambda a, b: a + b) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored)
SELECT query_id, CAST(n AS INT) AS rank, vec_id, score FROM ranked WHERE n <= 20
"""

NEAR_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (
  SELECT vec_id AS id, vec_id AS other FROM v
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT v.vec_id, coalesce((SELECT count(*) FROM links l WHERE l.a = v.vec_id), 0) AS n_links,
       min(r.other) AS component_id, v.vec_id = min(r.other) AS kept
FROM v JOIN reach r ON r.id = v.vec_id GROUP BY v.vec_id
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2
         THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
         WHEN len(w) = 1 THEN w ELSE [] END) AS s FROM words),
counts AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN counts x ON x.doc_id = a JOIN counts y ON y.doc_id = b
  WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (
  SELECT doc_id AS id, doc_id AS other FROM documents
  UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d LEFT JOIN counts c USING (doc_id) JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id, n
"""

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS MATERIALIZED (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts),
placed AS MATERIALIZED (
  SELECT *, string_split(host, '.')[-1] AS suffix,
         array_to_string(string_split(host, '.')[-2:], '.') AS domain FROM split),
known AS (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
hosts AS MATERIALIZED (
  SELECT host, domain, suffix, count(*) AS n, CAST(sum(good) AS BIGINT) AS good
  FROM placed JOIN known USING (page_id) WHERE host <> '' GROUP BY ALL),
domains AS MATERIALIZED (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good FROM hosts GROUP BY ALL),
suffixes AS MATERIALIZED (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(good) AS BIGINT) AS good FROM domains GROUP BY ALL),
rate AS (SELECT (coalesce(sum(good), 0) + 1)::DOUBLE / (coalesce(sum(n), 0) + 2) AS r FROM suffixes),
groups AS (
  SELECT 1 AS level, n::DOUBLE AS n, good::DOUBLE AS k FROM suffixes UNION ALL
  SELECT 2, n, good FROM domains UNION ALL SELECT 3, n, good FROM hosts),
moments AS (
  SELECT level, count(*) AS g, sum(n) AS n, sum(k) AS k, sum(n * n) AS nn, sum(k * k / n) AS kk FROM groups GROUP BY level),
spread AS (
  SELECT level, greatest(0.0, kk - k * k / n) / nullif(g - 1, 0) AS b, greatest(0.0, k - kk) / nullif(n - g, 0.0) AS w,
         (n - nn / n) / nullif(g - 1, 0) AS t FROM moments),
rho AS (SELECT level, (b - w) / nullif(b + (t - 1) * w, 0.0) AS r FROM spread),
strength AS (
  SELECT l.level, coalesce(CASE WHEN r > 0 THEN least(1000.0, greatest(1.0, (1 - r) / r)) END, 1000.0) AS s
  FROM (VALUES (1), (2), (3)) l(level) LEFT JOIN rho ON rho.level = l.level),
weights AS (
  SELECT max(s) FILTER (level = 1) AS s1, max(s) FILTER (level = 2) AS s2, max(s) FILTER (level = 3) AS s3 FROM strength),
of_suffix AS (SELECT suffix, (good + s1 * r) / (n + s1) AS p FROM suffixes, weights, rate),
of_domain AS (SELECT domain, (d.good + s2 * p) / (d.n + s2) AS p FROM domains d JOIN of_suffix USING (suffix), weights),
of_host AS (SELECT host, h.n, (h.good + s3 * p) / (h.n + s3) AS p FROM hosts h JOIN of_domain USING (domain), weights),
rules(host, path, says) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
         arg_max(says, length(r.host || r.path)) AS says
  FROM placed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY page_id),
rated AS (
  SELECT p.page_id, p.host, p.path, coalesce(h.n, 0) AS n, coalesce(h.p, d.p, s.p, r) AS m, s3
  FROM placed p LEFT JOIN of_host h USING (host) LEFT JOIN of_domain d ON d.domain = p.domain
  LEFT JOIN of_suffix s ON s.suffix = p.suffix, rate, weights)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN m - 1.645 * sqrt(m * (1 - m) / (n + s3 + 1)) >= 0.5
       THEN 'allow' ELSE 'block' END) AS verdict
FROM rated LEFT JOIN fits USING (page_id)
"""
