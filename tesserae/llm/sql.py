"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
WITH d AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (
    SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, (5 * i + 1)::INTEGER, 5))::BIGINT) AS fives FROM d
), e AS (
    SELECT *, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((fives[i // 4 + 1] >> (5 * (3 - i % 4))::INTEGER) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest FROM b
), g AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, hex) AS largest FROM e
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM g
"""

OP4 = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
    FROM embeddings
    WHERE len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 5
"""

OP7 = """
WITH rules(host, path, verdict) AS (
    VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), rest AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM rest
), best AS (
    SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS verdict
    FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
    GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

OP8 = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)
), firsts AS (
    SELECT k, min(doc_id) AS f FROM windows GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, p
    FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE doc_id > f)
), words AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of a text expression: bytes shifted through its polynomial."""
    bits = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))"
    code = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    step = bits.format("xor(a, b)")
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {code}), lambda a, b: {step}), 4294967295)"


OP11 = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, coalesce(role, ''), left(coalesce(text, ''), 64), md5(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, {crc32("conv_id::VARCHAR")} % 6 AS h, conv_id - conv_id % 100 AS base FROM (SELECT DISTINCT conv_id FROM t)
), own AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), o.turns[h + 1:]) AS turns
    FROM convs c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = c.base
), paths AS (
    SELECT conv_id, d, len(turns) AS size, md5(to_json(turns[1:d])::VARCHAR) AS k,
           CASE WHEN d > 0 THEN md5(to_json(turns[1:d - 1])::VARCHAR) END AS parent,
           CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS n
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT k, d, parent, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = d AS leaf,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends
    FROM paths GROUP BY k, d, parent
), pairs AS (
    SELECT DISTINCT a.k AS upper, b.k AS lower FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.d <= b.d
), below AS (
    SELECT upper AS k, sum((n_convs - 1) * n)::BIGINT AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
    FROM pairs JOIN nodes ON lower = k GROUP BY upper
), children AS (
    SELECT parent AS k, count(*) AS n_children FROM nodes GROUP BY parent
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
       saved_tokens, sha256(a.ends) AS ends_sha256
FROM nodes a JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes p ON p.k = a.parent
"""

OP12 = rf"""
WITH both_texts AS (
    SELECT doc_id, false AS target, coalesce(text, '') AS text FROM documents
    UNION ALL SELECT NULL, true, coalesce(text, '') FROM benchmark
), words AS (
    SELECT row_number() OVER () AS r, doc_id, target, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM both_texts
), features AS (
    SELECT r, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), coded AS (
    SELECT f, {crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features)
), counts AS (
    SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM features JOIN coded USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE
        / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
    FROM counts
), sums AS (
    SELECT r, sum(gain)::BIGINT AS total, count(*) AS n_features FROM features JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY r
), weighed AS (
    SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(floor(total / n_features)::BIGINT, 0) AS weight,
           ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
    FROM words LEFT JOIN sums USING (r) WHERE NOT target
), scored AS (
    SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place,
           floor(25 * count(*) OVER (PARTITION BY n_words >= 20) / 100) AS drawn
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES = {
    "op2_seekable_archives": OP2,
    "op4_norm_bucketed_top_k": OP4,
    "op7_digest_array_urls": OP7,
    "op8_substring_dedup": OP8,
    "op11_conversation_prefix_trie": OP11,
    "op12_importance_resampling": OP12,
}
