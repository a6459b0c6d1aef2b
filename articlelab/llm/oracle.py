"""DuckDB SQL of the registered training-data queries."""

ORACLE = {}

ORACLE["op3_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item, w, least(len(w), 13) AS m FROM bw WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS p
             FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT m FROM bs),
wins AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS p
         FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, wins.m, item FROM wins JOIN patterns ON wins.m = patterns.m AND wins.p = patterns.p),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op8_line_dedup"] = r"""
WITH lined AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '') AS host,
         list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''),
           '(?is)<script.*?(?:</script>|\z)|<style.*?(?:</style>|\z)|<!--.*?(?:-->|\z)', chr(10), 'g'), '<[^>]*>|[\r\n]+'),
           lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages),
per_host AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
counts AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM lined) GROUP BY host, line),
boiler AS (SELECT host, list(line) AS lines FROM counts JOIN per_host USING (host)
           WHERE n >= 2 AND n / pages > 0.1 GROUP BY host),
kept AS (SELECT l.page_id, l.host, l.lines, list_filter(l.lines, lambda x: NOT list_contains(coalesce(b.lines, []), x)) AS kept
         FROM lined l LEFT JOIN boiler b USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       coalesce(array_to_string(kept, chr(10)), '') AS kept_text
FROM kept
"""

ORACLE["op9_exact_dedup"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM t GROUP BY t)
SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM t JOIN g USING (t)
"""

ORACLE["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS everything,
        coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
c AS (SELECT *, cap * w_left <= (everything - before) * w AS capped FROM o),
r AS (SELECT *, everything - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0) AS rest,
        sum(w) FILTER (WHERE NOT capped) OVER () AS w_rest FROM c),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE)
        ELSE CAST(rest * w AS DOUBLE) / CAST(w_rest AS DOUBLE) END AS target FROM r),
x AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t)
SELECT d.doc_id, d.size, x.source_size, x.target,
  CAST((floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0
        < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * d.size AS taken
FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""

ORACLE["op12_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
              lambda x: [CAST(unicode(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
            lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)) AS crc
  FROM documents),
f AS (
  SELECT doc_id, lang,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    CAST(n_chars AS VARCHAR) AS own,
    CAST(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS found,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM d),
h AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(own) || ':' || own, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen(found) || ':' || found, '-') || tail) AS changed FROM f),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS total FROM h),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, total FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (total + 1) // 2
  FROM nodes WHERE total > 1 GROUP BY lang, level, pos // 2, total),
subroots AS (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total
  FROM nodes WHERE total = 1),
tops AS (
  SELECT 0 AS level, pos, subroot AS digest, total FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (total + 1) // 2
  FROM tops WHERE total > 1 GROUP BY level, pos // 2, total),
above AS (
  SELECT s.lang, list(CASE WHEN t.digest IS NULL THEN '-' WHEN (s.pos >> l.level) % 2 = 1 THEN 'L' || t.digest ELSE 'R' || t.digest END ORDER BY l.level) AS steps
  FROM subroots s JOIN (SELECT DISTINCT level FROM tops WHERE total > 1) l ON true
  LEFT JOIN tops t ON t.level = l.level AND t.pos = xor(s.pos >> l.level, 1::BIGINT)
  GROUP BY s.lang),
within AS (
  SELECT p.doc_id, p.lang, p.leaf, p.pos, any_value(p.changed) AS changed,
    list(CASE WHEN n.digest IS NULL THEN '-' WHEN (p.pos >> l.level) % 2 = 1 THEN 'L' || n.digest ELSE 'R' || n.digest END ORDER BY l.level)
      FILTER (WHERE l.level IS NOT NULL) AS steps
  FROM leaves p LEFT JOIN (SELECT DISTINCT lang, level FROM nodes WHERE total > 1) l ON l.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM p.lang AND n.level = l.level AND n.pos = xor(p.pos >> l.level, 1::BIGINT)
  GROUP BY p.doc_id, p.lang, p.leaf, p.pos),
proofs AS (
  SELECT w.*, s.subroot, list_concat(coalesce(w.steps, []), coalesce(a.steps, [])) AS proof
  FROM within w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang LEFT JOIN above a ON a.lang IS NOT DISTINCT FROM w.lang),
folded AS (
  SELECT *, (SELECT digest FROM tops WHERE total = 1) AS root,
    list_reduce(list_prepend(changed, proof), lambda a, s: CASE WHEN s[1] = 'L' THEN sha256(substr(s, 2) || a)
      WHEN s[1] = 'R' THEN sha256(a || substr(s, 2)) ELSE sha256(a) END) AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root,
  sha256(coalesce(array_to_string(list_transform(proof, lambda s: substr(s, 2)), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""

ORACLE["op13_url_filter"] = r"""
WITH RECURSIVE u AS (
  SELECT page_id, coalesce(html, '') AS html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
rules(verdict, name, start) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT p.page_id, p.host, p.path, max_by(name || start, length(name || start)) AS rule, max_by(verdict, length(name || start)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM p) p
  JOIN rules ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY ALL),
judged AS (
  SELECT p.*, f.rule, f.verdict FROM p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path),
seeds AS (
  SELECT host, unnest(['trust', 'distrust']) AS kind,
         unnest([avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END)]) AS seed
  FROM judged WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html,
    '(?i)\b(?:href|src|action)\s{0,9}=\s{0,9}["'']?\s{0,9}(?:[a-z][a-z0-9+.-]{0,20}:)?//([^/?#"''<>\s]{1,255})', 1),
    lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS dst FROM p WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
flows AS (
  SELECT 'trust' AS kind, src AS source, dst AS target, 0.85 * n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, 0.85 * n / sum(n) OVER (PARTITION BY dst) FROM edges
  UNION ALL SELECT kind, '', host, 0.15 * seed FROM seeds WHERE seed > 0
  UNION ALL SELECT kind, '', '', 1.0 FROM (VALUES ('trust'), ('distrust')) k(kind)),
scores AS (
  SELECT 0 AS step, kind, target AS host, share AS score FROM flows WHERE source = ''
  UNION ALL
  SELECT step + 1, s.kind, f.target, sum(s.score * f.share) FROM scores s JOIN flows f ON f.kind = s.kind AND f.source = s.host
  WHERE step < 20 GROUP BY step, s.kind, f.target),
hosts AS (
  SELECT host, coalesce(sum(score) FILTER (WHERE kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (WHERE kind = 'distrust'), 0) AS distrust
  FROM scores WHERE step = 20 AND host <> '' GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule,
  coalesce(j.verdict, CASE WHEN h.distrust >= 0.5 * 0.15 AND h.distrust > h.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN hosts h ON j.host = h.host
"""
