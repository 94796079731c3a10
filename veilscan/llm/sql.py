"""SQL counterparts of this package's queries, for those that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op3_url_filter"] = r"""
WITH rules(rule, host_part, path_part, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT r, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict FROM parts, rules
  WHERE (host = host_part OR ends_with(host, '.' || host_part)) AND starts_with(path, path_part) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (r)
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontaminate"] = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
place AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM d, lens WHERE len(w) >= n),
hit AS (SELECT r, place.n, p, item_id FROM place JOIN win ON place.n = win.n AND array_to_string(w[p:p + place.n - 1], ' ') = s),
words AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

ORACLES["op4_bwt_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT r, s, md5(substr(h, 2 * s + 1, 400)) AS m FROM (SELECT r, h, unnest(generate_series(0, len(h) // 2 - 200)) AS s FROM d WHERE len(h) >= 400)),
twice AS (SELECT m FROM win GROUP BY m HAVING count(*) > 1),
starts AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM win SEMI JOIN twice USING (m)),
runs AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM (SELECT r, s, count(*) FILTER (before IS NULL OR s > before + 200) OVER (PARTITION BY r ORDER BY s) AS k FROM starts) GROUP BY r, k),
keep AS (
  SELECT r, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM (
    SELECT r, h, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM d JOIN runs USING (r) WINDOW w AS (PARTITION BY r ORDER BY a)
    UNION ALL SELECT r, any_value(h), max(b), any_value(len(h)) // 2 FROM d JOIN runs USING (r) GROUP BY r) GROUP BY r),
cut AS (SELECT r, sum(b - a) AS n, count(*) AS c FROM runs GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans,
  sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN keep USING (r)
"""

ORACLES["op8_unit_dedup"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, replace(regexp_replace(coalesce(text, ''), '([.!?。！？])([ \t\x0B\f\r]+)', '\1' || chr(1) || '\2' || chr(2), 'g'),
    chr(10), chr(1) || chr(10) || chr(2)) AS marked FROM documents),
pieces AS (SELECT doc_id, r, unnest(string_split(marked, chr(2))) AS p, generate_subscripts(string_split(marked, chr(2)), 1) AS i FROM d),
cut AS (
  SELECT doc_id, r, i, split_part(p, chr(1), 1) AS line, replace(p, chr(1), '') AS whole,
    trim(regexp_replace(translate(split_part(p, chr(1), 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS form,
    sum(length(replace(p, chr(1), ''))) OVER (PARTITION BY r ORDER BY i) - length(replace(p, chr(1), '')) AS a
  FROM pieces),
ranked AS (
  SELECT *, form <> '' AND len(string_split(form, ' ')) >= 12 AND row_number() OVER (PARTITION BY form ORDER BY doc_id NULLS LAST, a) > 1 AS gone FROM cut),
placed AS (SELECT *, i = max(i) FILTER (NOT gone) OVER (PARTITION BY r) AS is_last FROM ranked),
per AS (
  SELECT r, count(*) FILTER (form <> '') AS n_units, count(*) FILTER (gone) AS n_removed, coalesce(sum(length(line)) FILTER (gone), 0) AS chars,
    string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a AS BIGINT) + length(line) AS VARCHAR), ',' ORDER BY i) FILTER (gone) AS removed,
    string_agg(CASE WHEN is_last THEN line ELSE whole END, '' ORDER BY i) FILTER (NOT gone) AS rest
  FROM placed GROUP BY r)
SELECT doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(chars, 0) AS BIGINT) AS n_removed_chars,
  coalesce(removed, '') AS removed, md5(coalesce(rest, '')) AS kept_md5
FROM d LEFT JOIN per USING (r)
"""

ORACLES["op10_bbit_minhash"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""

ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS g, n_chars,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
    n_chars + CASE WHEN xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0
      THEN 1 ELSE 0 END AS claimed
  FROM documents),
h AS (
  SELECT r, doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(claimed AS VARCHAR)) || ':' || claimed, '-') || tail) AS changed FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM h),
nodes(g, l, i, m, h) AS (
  SELECT g, 0, i, m, leaf FROM placed
  UNION ALL SELECT g, l + 1, i // 2, max((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE m > 1 GROUP BY g, l, i // 2),
subs AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM nodes WHERE m = 1),
tops(l, i, m, h) AS (
  SELECT 0, i, m, subroot FROM subs
  UNION ALL SELECT l + 1, i // 2, max((m + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE m > 1 GROUP BY l, i // 2),
low(r, g, l, i, m, v, p) AS (
  SELECT r, g, 0, i, m, changed, '' FROM placed
  UNION ALL SELECT low.r, low.g, low.l + 1, low.i // 2, (low.m + 1) // 2,
    sha256(CASE WHEN low.i % 2 = 0 THEN low.v || coalesce(n.h, '') ELSE n.h || low.v END), low.p || coalesce(n.h, '')
  FROM low LEFT JOIN nodes n ON n.g = low.g AND n.l = low.l AND n.i = xor(low.i, 1) WHERE low.m > 1),
high(r, l, i, m, v, p) AS (
  SELECT r, 0, s.i, s.m, v, p FROM low JOIN subs s ON s.g = low.g WHERE low.m = 1
  UNION ALL SELECT high.r, high.l + 1, high.i // 2, (high.m + 1) // 2,
    sha256(CASE WHEN high.i % 2 = 0 THEN high.v || coalesce(n.h, '') ELSE n.h || high.v END), high.p || coalesce(n.h, '')
  FROM high LEFT JOIN tops n ON n.l = high.l AND n.i = xor(high.i, 1) WHERE high.m > 1)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(p) AS proof_sha256, v AS folded_root, v = t.h AS verified
FROM placed JOIN subs USING (g) JOIN high USING (r) JOIN tops t ON t.m = 1 WHERE high.m = 1
"""
