"""DuckDB twins of the corpus queries that SQL can express."""

EXACT_DEDUP = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

DECONTAMINATE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM p),
o AS (SELECT d.doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m) d),
h AS (SELECT o.doc_id, o.m, o.i, p.item FROM o JOIN p ON o.m = p.m AND o.g = p.g),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM h) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items, sha256(coalesce(found.items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

LINE_DEDUP = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, least(3, len(l)) AS m, array_to_string(l[i + 1 : i + 3], chr(10)) AS k FROM (SELECT *, unnest(range(0, greatest(len(l) - 2, 1))) AS i FROM d)),
v AS (SELECT * FROM w WHERE regexp_matches(k, '[^ \t\n\x0b\f\r]')),
o AS (SELECT doc_id, i, m, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n, count(*) OVER (PARTITION BY k) AS c FROM v),
covered AS (SELECT doc_id, i FROM (SELECT doc_id, n, unnest(range(i, i + m)) AS i FROM o WHERE c > 1) GROUP BY doc_id, i HAVING min(n) > 1),
spans AS (SELECT doc_id, min(i) AS s, max(i) + 1 AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM covered) GROUP BY doc_id, g),
r AS (SELECT doc_id, sum(e - s)::BIGINT AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS removed FROM spans GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS i FROM d),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t FROM lines ANTI JOIN covered USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(l), 0) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed, sha256(coalesce(kept.t, '')) AS text_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

MIXING = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
c AS (SELECT *, sum(source_size) OVER () AS words, coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY 3 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM r),
level AS (SELECT arg_min((words - held)::DOUBLE / left_::DOUBLE, (3 * source_size / weight, source)) AS v FROM c WHERE 3 * source_size >= (words - held)::DOUBLE / left_::DOUBLE * weight),
t AS (SELECT source, source_size, CASE WHEN 3 * source_size < v * weight THEN (3 * source_size)::DOUBLE ELSE v * weight END AS target FROM c, level),
p AS (SELECT d.doc_id, size, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS b FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(greatest(floor(target) - b, 0), size) + least(greatest(floor(target) - b - source_size, 0), size) + least(greatest(floor(target) - b - 2 * source_size, 0), size))::BIGINT AS taken FROM p
"""
