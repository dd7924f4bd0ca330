"""SQL that gives the rows of those queries that SQL can express on small tables."""

from __future__ import annotations

import string

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
BLANK = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(pattern: str, fold: bool) -> str:
    text = "coalesce(text, '')"
    if fold:
        text = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    return f"regexp_extract_all({text}, '{pattern}')"


NEAR_DUPLICATES = f"""
    WITH RECURSIVE d AS (SELECT doc_id, {words(BLANK, True)} AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
        FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    links AS MATERIALIZED (SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
        JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
    reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
    SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
"""

CONTAMINATION = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {words(PLAIN, True)} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {words(PLAIN, True)} AS w FROM benchmark),
    phrases AS MATERIALIZED (SELECT DISTINCT item_id, CAST(least(len(w), 10) AS BIGINT) AS n, array_to_string(w[i:i + 9], ' ') AS k
        FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
    runs AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM d, (SELECT DISTINCT n FROM phrases), unnest(range(1, len(w) - n + 2)) t(i)),
    hits AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM runs JOIN phrases USING (n, k)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

TOP_K = """
    WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
        FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored) WHERE n <= 5
"""

REPEATS = f"""
    WITH d AS MATERIALIZED (SELECT doc_id, {words(BLANK, False)} AS w FROM documents),
    runs AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) t(i)),
    first AS (SELECT k, min(doc_id) AS least FROM runs GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM runs JOIN first USING (k) WHERE least < doc_id),
    lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN lists USING (doc_id)
"""

_CRC32 = """4294967295 - list_reduce(list_prepend(4294967295, [CAST(ascii(b) AS BIGINT) FOR b IN string_split(CAST(c AS VARCHAR), '')]),
    lambda x, y: list_reduce([xor(x, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))"""

PREFIX_TRIE = f"""
    WITH t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
        sha256(coalesce(role, '') || chr(1) || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS size
        FROM conversations WHERE conv_id IS NOT NULL),
    ids AS MATERIALIZED (SELECT c, ({_CRC32}) % 9 AS h FROM (SELECT DISTINCT c FROM t)),
    turns AS (SELECT ids.c, i, k, size FROM ids JOIN t ON t.c = ids.c - ids.c % 5 AND i <= h
        UNION ALL SELECT ids.c, i, k, size FROM ids JOIN t ON t.c = ids.c AND i > h),
    paths AS MATERIALIZED (SELECT c, row_number() OVER w AS d, string_agg(k, ',') OVER w AS p, size FROM turns WINDOW w AS (PARTITION BY c ORDER BY i)
        UNION ALL SELECT c, 0, '', 0 FROM ids),
    nodes AS MATERIALIZED (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
        CASE WHEN d > 0 THEN left(p, greatest(65 * d - 66, 0)) END AS up FROM paths GROUP BY p, d),
    kids AS (SELECT up, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
    full_nodes AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.up = n.p),
    sums AS (SELECT left(p, greatest(65 * a - 1, 0)) AS p, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
        FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY 1),
    ends AS (SELECT p, string_agg(c, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, d) AS p FROM paths GROUP BY c) GROUP BY 1)
    SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
           CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM full_nodes n JOIN sums USING (p) LEFT JOIN nodes u ON u.p = n.up LEFT JOIN ends ON ends.p = n.p
"""
