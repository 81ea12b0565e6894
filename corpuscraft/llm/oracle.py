"""SQL that DuckDB runs on the same tables, for the operators that SQL can express at a small size."""

WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

SUFFIX_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, j, array_to_string(ws[j + 1 : j + 50], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS j FROM w WHERE len(ws) >= 50)),
f AS (SELECT g, min((doc_id, j)) AS origin FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, j, (doc_id, j) = origin AS is_first FROM s JOIN f USING (g)),
m AS (SELECT *, CASE WHEN lag(j) OVER (PARTITION BY doc_id, is_first ORDER BY j) + 50 >= j THEN 0 ELSE 1 END AS opens FROM r),
i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, is_first ORDER BY j ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, CAST(min(j) AS BIGINT) AS start_word, CAST(max(j) + 50 AS BIGINT) AS end_word, is_first FROM i GROUP BY doc_id, is_first, island
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 2
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.y FROM reach r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

BM25 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
d AS (SELECT doc_id, len(ws) AS dl FROM w),
g AS (SELECT count(*) AS n, avg(dl) AS mean FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY 1, 2),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT doc_id AS query_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM t JOIN f USING (term), g WHERE doc_id % 20 = 0),
s AS (SELECT query_id, t.doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN t USING (term) JOIN d ON d.doc_id = t.doc_id, g WHERE t.doc_id <> query_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT query_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: DuckDB has no crc32: its table is made bit by bit, and a decimal id is folded in digit by digit.
PREFIX_TRIE = """
WITH RECURSIVE b AS (SELECT i::BIGINT AS i, i::BIGINT AS x, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM b WHERE k < 8),
lut AS (SELECT list(x ORDER BY i) AS l FROM b WHERE k = 8),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(turn ORDER BY pos) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda a, d: xor(l[(xor(a, d) & 255) + 1], a >> 8)), 4294967295) % 6 AS h FROM o, lut),
r AS (SELECT x.c, list_concat(coalesce(y.turns, [])[1 : x.h], x.turns[x.h + 1 :]) AS turns FROM h x LEFT JOIN o y ON y.c = x.c - x.c % 100),
p AS (SELECT c, len(turns) AS size, unnest(range(0, len(turns) + 1)) AS d, turns FROM r),
m AS (SELECT d, turns[1 : d] AS k, min(c) AS conv_id, count(*) AS n, string_agg(CASE WHEN size = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM p GROUP BY ALL),
kids AS (SELECT d - 1 AS d, k[1 : d - 1] AS k, count(*) AS n_children FROM m WHERE d > 0 GROUP BY ALL),
n AS (SELECT m.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(k[d].text) END AS own FROM m LEFT JOIN kids USING (d, k)),
s AS (SELECT a AS d, k[1 : a] AS k, count_if(n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (d, k) LEFT JOIN m up ON up.d = n.d - 1 AND up.k = n.k[1 : n.d - 1]
"""
