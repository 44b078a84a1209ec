"""SQL twins of the corpus queries that SQL can express, over the whole tables."""

PREFIX_TREE = """WITH RECURSIVE tb AS (SELECT CAST(b AS BIGINT) AS b, CAST(b AS BIGINT) AS v, 0 AS k FROM range(256) r(b)
 UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), v >> 1) ELSE v >> 1 END, k + 1 FROM tb WHERE k < 8),
table8 AS (SELECT b, v FROM tb WHERE k = 8),
st AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS seen, CAST(4294967295 AS BIGINT) AS crc FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
 UNION ALL SELECT conv_id, s, seen + 1, xor(v, crc >> 8) FROM st JOIN table8 ON b = xor(crc & 255, CAST(ascii(s[seen + 1]) AS BIGINT)) WHERE seen < length(s)),
cv AS (SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) % 6 AS h FROM st WHERE seen = length(s)),
tn AS (SELECT conv_id, length(text) AS len, sha256(length(role) || ':' || role || text) AS key, turn FROM
 (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS i FROM tn),
rb AS (SELECT cv.conv_id, 0 AS part, i, key, len FROM cv JOIN c ON c.conv_id = cv.conv_id - cv.conv_id % 100 WHERE i < h
 UNION ALL SELECT cv.conv_id, 1, i, key, len FROM cv JOIN c USING (conv_id) WHERE i >= h),
sq AS (SELECT cv.conv_id, coalesce(keys, []) AS keys, coalesce(lens, []) AS lens FROM cv LEFT JOIN
 (SELECT conv_id, list(key ORDER BY part, i) AS keys, list(len ORDER BY part, i) AS lens FROM rb GROUP BY 1) USING (conv_id)),
mb AS (SELECT conv_id, d, keys[1:d] AS p, lens[d] AS len, len(keys) = d AS ends FROM (SELECT *, unnest(range(len(keys) + 1)) AS d FROM sq)),
nd AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n, any_value(len) AS len, coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS members FROM mb GROUP BY p, d),
kd AS (SELECT p[1:d-1] AS p, count(*) AS kids FROM nd WHERE d > 0 GROUP BY 1),
nk AS (SELECT nd.*, coalesce(kids, 0) AS kids FROM nd LEFT JOIN kd ON kd.p = nd.p),
up AS (SELECT p[1:j] AS p, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * coalesce(len, 0)) AS saved FROM (SELECT *, unnest(range(d + 1)) AS j FROM nk) GROUP BY 1)
SELECT nk.conv_id, nk.d AS depth, pa.conv_id AS parent_conv_id, nk.n AS n_convs, nk.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
 sha256(nk.members) AS ends_sha256 FROM nk JOIN up ON up.p = nk.p LEFT JOIN nk pa ON pa.d = nk.d - 1 AND pa.p = nk.p[1:nk.d-1]"""

SUFFIX_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, ''))) AS n_bytes, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
pc AS (SELECT k, b, substr(hx, 512 * b + 1, 710) AS x FROM (SELECT k, hx, unnest(range((n_bytes - 100) // 256 + 1)) AS b FROM d WHERE n_bytes >= 100)),
w AS (SELECT k, 256 * b + j AS s, k * 4294967296 + 256 * b + j AS place, md5_number(substr(x, 2 * j + 1, 200)) AS h FROM pc, range(256) r(j) WHERE length(x) >= 2 * j + 200),
f AS (SELECT h, min(place) AS first FROM w GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT k, s FROM w JOIN f USING (h) WHERE place > first),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s) AS island FROM (SELECT *, lag(s) OVER (PARTITION BY k ORDER BY s) AS before FROM g)),
r AS (SELECT k, island, min(s) AS a, max(s) + 100 AS b FROM i GROUP BY 1, 2),
e AS (SELECT k, a, b, coalesce(lag(b) OVER (PARTITION BY k ORDER BY a), 0) AS from_byte, row_number() OVER (PARTITION BY k ORDER BY a DESC) = 1 AS final FROM r),
o AS (SELECT d.k, sum(b - a) AS n_removed, count(*) AS n_spans,
 string_agg(substr(hx, 2 * from_byte + 1, 2 * (a - from_byte)) || CASE WHEN final THEN substr(hx, 2 * b + 1) ELSE '' END, '' ORDER BY a) AS kept FROM e JOIN d USING (k) GROUP BY 1)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hx))) AS kept_sha256 FROM d LEFT JOIN o USING (k)"""
