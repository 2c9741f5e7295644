"""DuckDB SQL for the operators whose results SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_decontamination"] = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bs AS (
  SELECT item_id, w, least(10, len(w)) AS n FROM bw WHERE len(w) > 0
), bwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bs)
), dpos AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw
), dwin AS (
  SELECT doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS win
  FROM dpos, (SELECT DISTINCT n FROM bwin) s WHERE i + s.n - 1 <= len(w)
), hits AS (
  SELECT doc_id, i, n, item_id FROM dwin JOIN bwin USING (n, win)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op9_quality"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), c AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols
  FROM d
), p AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), g AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM p, (VALUES (5), (6), (7), (8), (9), (10)) v(n) WHERE i + n - 1 <= len(w)
), hit AS (
  SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, n, s) AS k FROM g) WHERE k > 1
), cov AS (
  SELECT doc_id, n, count(*) AS words, CAST(sum(length(w[i])) AS DOUBLE) AS chars FROM hit JOIN p USING (doc_id, i) GROUP BY doc_id, n
), bad AS (
  SELECT doc_id, max(CASE WHEN n = 5 THEN words END) AS n_repeat,
         bool_or(chars / word_chars > CAST(CASE n WHEN 5 THEN 0.30 WHEN 6 THEN 0.28 WHEN 7 THEN 0.26 WHEN 8 THEN 0.24 WHEN 9 THEN 0.22 ELSE 0.20 END AS DOUBLE)) AS over
  FROM cov JOIN c USING (doc_id) GROUP BY doc_id
), l AS (
  SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id, x) AS k
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), ln AS (
  SELECT doc_id, count(*) AS n_dup, CAST(sum(list_sum(list_transform(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), lambda y: length(y)))) AS DOUBLE) AS chars
  FROM l WHERE k > 1 GROUP BY doc_id
), r AS (
  SELECT c.*, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         coalesce(over, false) OR coalesce(ln.chars / word_chars > CAST(0.30 AS DOUBLE), false) OR n_symbols > CAST(0.30 AS DOUBLE) * n_words AS over_limits
  FROM c LEFT JOIN bad USING (doc_id) LEFT JOIN ln USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT over_limits AS kept
FROM r
"""

ORACLES["op3_url_filter"] = r"""
WITH p AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
         1704067200 + page_id * 7919 % 365 * 86400 AS fetched
  FROM pages
), s AS (
  SELECT page_id, host, fetched, unnest(list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda i: array_to_string(l[i : len(l)], '.'))) AS pattern
  FROM (SELECT *, string_split(host, '.') AS l FROM p WHERE host IS NOT NULL)
), n AS (
  SELECT pattern, CAST('0x' || substr(md5(pattern), 1, 6) AS BIGINT) AS h FROM (SELECT DISTINCT pattern FROM s)
), e AS (
  SELECT pattern, h, (['adult', 'malware', 'phishing', 'spam'])[h % 4 + 1] AS list, 1704067200 + h % 200 * 86400 AS t FROM n WHERE h % 5 <> 0
), c AS (
  SELECT list, pattern, t, 'add' AS op FROM e
  UNION ALL SELECT list, pattern, t + (1 + h % 60) * 86400, 'remove' FROM e
  UNION ALL SELECT list, pattern, t + (100 + h % 50) * 86400, 'add' FROM e WHERE h % 3 = 0
), i AS (
  SELECT list, pattern, t AS added, until FROM (
    SELECT *, lead(t) OVER (PARTITION BY list, pattern ORDER BY t) AS until FROM (SELECT list, pattern, t, max(op) AS op FROM c GROUP BY 1, 2, 3)
  ) WHERE op = 'add'
), m AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT s.pattern, ',' ORDER BY s.pattern) AS patterns
  FROM s JOIN i ON s.pattern = i.pattern AND added <= fetched AND (until IS NULL OR fetched < until) GROUP BY page_id
)
SELECT page_id, host, CAST(fetched AS BIGINT) AS fetched, coalesce(lists, '') AS lists, coalesce(patterns, '') AS patterns, lists IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id)
"""

ORACLES["op5_warc"] = r"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
