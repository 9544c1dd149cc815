"""SQL that checks the training-data queries, over the whole tables."""

#: Every 50-byte string of every text by its place, in hex; texts are cut into pieces first, as a slice of a long one is slow.
SUFFIX_DEDUP = """
WITH hexed AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), pieces AS (
    SELECT doc_id, start, h[2 * start + 1:2 * start + 2098] AS piece FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49, 1000)) AS start FROM hexed)
), places AS (
    SELECT doc_id, start, piece, unnest(range(0, least(1000, len(piece) // 2 - 49))) AS j FROM pieces
), strings AS (
    SELECT doc_id, start + j AS i, md5(piece[2 * j + 1:2 * j + 100]) AS s FROM places
), firsts AS (
    SELECT s, min(doc_id) AS first FROM strings GROUP BY s
), repeats AS (
    SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM strings JOIN firsts USING (s) WHERE first < doc_id
), numbered AS (
    SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM repeats
), spans AS (
    SELECT doc_id, span, min(i) AS low, max(i) + 50 AS high FROM numbered GROUP BY ALL
), removed AS (
    SELECT doc_id, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs, sum(high - low) AS n FROM spans GROUP BY doc_id
)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(len(lows), 0) AS n_spans,
    sha256(unhex(CASE WHEN lows IS NULL THEN h ELSE array_to_string(
        list_transform(range(1, len(lows) + 2), lambda k: h[2 * (CASE WHEN k = 1 THEN 0 ELSE highs[k - 1] END) + 1:2 * coalesce(lows[k], len(h) // 2)]), '') END)) AS kept_sha256
FROM hexed LEFT JOIN removed USING (doc_id)
"""

#: All pairs of documents that share a shingle, and the components of their links.
NGRAM_JACCARD = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), grams AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS grams
    FROM texts
), sizes AS (
    SELECT doc_id, len(grams) AS n FROM grams
), lines AS (
    SELECT doc_id, unnest(grams) AS gram FROM grams
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM lines a JOIN lines b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM shared s JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * s.n >= 85 * (x.n + y.n - s.n)
), mutual AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), degrees AS (
    SELECT a AS doc_id, count(*) AS n FROM mutual GROUP BY 1
), reached AS (
    SELECT doc_id, doc_id AS other FROM sizes
    UNION
    SELECT r.doc_id, b.b FROM reached r JOIN mutual b ON r.other = b.a
)
SELECT s.doc_id, s.n AS n_shingles, coalesce(any_value(d.n), 0) AS n_links, min(r.other) AS component_id
FROM sizes s JOIN reached r ON r.doc_id = s.doc_id LEFT JOIN degrees d ON d.doc_id = s.doc_id GROUP BY s.doc_id, s.n
"""

URL_RULES = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(say, name, prefix) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(name || prefix, length(name || prefix)) AS rule,
    arg_max(say, length(name || prefix)) AS verdict
FROM (SELECT row_number() OVER () AS row, * FROM parts) p
LEFT JOIN rules r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)
GROUP BY row, page_id
"""
