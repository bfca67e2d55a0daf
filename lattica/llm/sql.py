"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t
"""

OP3 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), w AS (
  SELECT *, 12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11 AS written FROM c
), p AS (
  SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM w
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR back = 1) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR back = 1) AS n_examples
FROM p GROUP BY conv_id
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left2,
         sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS i FROM s
), c AS (SELECT *, left2 * w > 4 * source_size * ws AS capped FROM o),
f AS (SELECT left2 AS l2, ws AS w2 FROM c WHERE NOT capped ORDER BY i LIMIT 1),
g AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(l2 * w AS DOUBLE) / CAST(2 * w2 AS DOUBLE) END AS target
  FROM c LEFT JOIN f ON true
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM g
), u AS (SELECT source, h, sum(size) AS unit FROM d GROUP BY source, h),
b AS (SELECT *, sum(unit) OVER (PARTITION BY source ORDER BY h) - unit AS ahead FROM u)
SELECT d.doc_id, d.size, r.source_size, r.target,
  CAST(d.size * (copies + CASE WHEN target - copies * source_size > 0 AND 2 * ahead + unit <= 2 * (target - copies * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken,
  CAST(copies + CASE WHEN target - copies * source_size > 0 AND 2 * ahead + unit <= 2 * (target - copies * source_size) THEN 1 ELSE 0 END AS INTEGER) AS times
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN b ON d.source IS NOT DISTINCT FROM b.source AND d.h = b.h
"""

OP9 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * m >= 80 * (p.n + q.n - m)
), reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = r)
SELECT reach.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY reach.doc_id
"""

OP10 = r"""
WITH c AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'),
      '(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|nav|article|section|header|footer|table|tr|title|body|head|html)|br)(?:\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l
  FROM pages
), t AS (SELECT host, count(*) AS pages FROM c GROUP BY host),
k AS (SELECT host, line, count(*) AS n FROM (SELECT DISTINCT page_id, host, unnest(l) AS line FROM c) GROUP BY ALL),
b AS (SELECT host, list(line) AS drop FROM k JOIN t USING (host) WHERE n >= 3 AND n > 0.1 * pages GROUP BY host),
o AS (SELECT page_id, host, l, list_filter(l, lambda x: NOT list_contains(coalesce(drop, []), x)) AS m FROM c LEFT JOIN b USING (host))
SELECT page_id, host, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(m) AS BIGINT) AS n_dropped, array_to_string(m, chr(10)) AS text FROM o
"""

OP11 = r"""
WITH RECURSIVE c(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM c WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS t FROM c WHERE k = 8),
r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{6,}')) AS x FROM documents
), o AS (SELECT doc, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS m FROM r GROUP BY ALL),
b AS (SELECT run, m, hex(encode(doc || ':' || run)) AS x FROM o),
h AS (
  SELECT run, m, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(len(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda acc, byte: xor(acc >> 8, t[CAST(xor(acc % 256, byte) + 1 AS BIGINT)])), 4294967295) AS h FROM b, crc
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, m FROM h
), n AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(m) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM n)),
p AS (
  SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM d x JOIN d y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM d x JOIN n y ON x.rest = y.word
  UNION SELECT y.word, y.n, x.word, x.n FROM d x JOIN n y ON x.rest = y.word
), k AS (SELECT word, near, near_n, n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS i, count(*) OVER (PARTITION BY word) AS n_near FROM p),
f AS (
  SELECT n.word, n.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n.n THEN near END AS form, CASE WHEN near_n >= 5 * n.n THEN near_n END AS form_n
  FROM n LEFT JOIN k ON n.word = k.word AND k.i = 1
), g(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT g.word, f.form, depth + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, n, CAST(n_near AS BIGINT) AS n_near, form, form_n, arg_max(root, depth) AS root FROM f JOIN g USING (word) GROUP BY ALL
"""

OP12 = "SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM (" + OP9.replace("len(w) < 5", "len(w) < 4").replace("w[i:i + 4]", "w[i:i + 3]").replace("len(w) - 3", "len(w) - 2") + ")"

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM t
), c AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:n], '') AS s FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM c
"""

ORACLES = {"op2_block_naming": OP2, "op3_prefix_target": OP3, "op7_hash_thresholds": OP7, "op9_ngram_jaccard": OP9, "op10_line_frequency": OP10, "op11_anagram_hash": OP11, "op12_hyperminhash": OP12, "op13_rope_fim": OP13}
