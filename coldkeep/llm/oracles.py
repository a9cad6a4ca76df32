"""SQL for the queries that SQL can express over whole tables; tests hold the others against brute force."""

from __future__ import annotations

from coldkeep.llm.secrets import EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES, KINDS

_ASSIGN = KINDS[0][1].replace("'", "''")


def _found(kind: int, pattern: str, value_group: int, least: int) -> str:
    """Matches with what precedes each; a match starts after everything before it."""
    whole = f"(?s)(.*?)({pattern})"
    return f"""SELECT row, source, {kind} AS kind, {least} AS least, regexp_extract_all(t, '{whole}', 1) AS pre,
            regexp_extract_all(t, '{whole}', 2) AS hit, regexp_extract_all(t, '{whole}', {value_group}) AS val FROM d"""


SECRETS = f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS t FROM documents),
    m AS ({_found(0, _ASSIGN, 3, 6)} UNION ALL {_found(1, KINDS[1][1], 2, 20)}
        UNION ALL {_found(2, KINDS[2][1], 2, 24)} UNION ALL {_found(3, "[A-Za-z0-9+/_.=-]{12,}", 2, 12)}),
    n AS (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m),
    f AS (SELECT row, source, kind, val[i] AS v, start, start + length(hit[i]) AS stop
        FROM (SELECT *, coalesce(list_sum(list_transform(pre[1:i], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS start FROM n)
        WHERE length(val[i]) >= least),
    o AS (SELECT v, count(DISTINCT source) < {min(EXAMPLE_REPOSITORIES, EXAMPLE_OWNERS)} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live
        FROM f WHERE kind < 3 GROUP BY v),
    s AS (SELECT f.*, o.live, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start || ':' || stop AS told
        FROM f JOIN o USING (v) WHERE kind < 3 OR o.live AND NOT EXISTS (
            SELECT 1 FROM f b WHERE b.row = f.row AND b.kind < 3 AND b.start < f.stop AND f.start < b.stop))
    SELECT doc_id, CAST(count(*) FILTER (WHERE kind = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (WHERE kind = 1) AS BIGINT) AS n_access,
        CAST(count(*) FILTER (WHERE kind = 2) AS BIGINT) AS n_hex,
        sha256(coalesce(string_agg(told, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
        coalesce(string_agg(told, ',' ORDER BY start, kind), '') AS spans,
        CAST(count(*) FILTER (WHERE kind < 3 AND live) AS BIGINT) AS n_live,
        CAST(count(*) FILTER (WHERE kind < 3 AND NOT live) AS BIGINT) AS n_example
    FROM d LEFT JOIN s USING (row) GROUP BY row, doc_id"""


def _shingled(name: str, key: str, table: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""{name}_words AS (SELECT row_number() OVER () AS row, {key},
            regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '(?:[A-Za-z0-9]|[^\\x00-\\x7F])+') AS w FROM {table}),
        {name} AS (SELECT DISTINCT row, {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
            FROM {name}_words WHERE len(w) > 0)"""


CONTAINED = f"""
    WITH {_shingled("a", "doc_id", "documents")}, {_shingled("b", "item_id", "benchmark")},
    n AS (SELECT row, count(*) AS n FROM b GROUP BY row)
    SELECT a.doc_id, b.item_id, count(*) AS n_shared, any_value(n.n) AS n_item, count(*) / any_value(n.n) AS containment
    FROM a JOIN b USING (s) JOIN n ON n.row = b.row
    GROUP BY a.row, b.row, a.doc_id, b.item_id HAVING 10 * count(*) >= 8 * any_value(n.n)"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    each = (f"list_transform(range(0, octet_length(encode({text}))), "
            f"lambda i: CAST('0x' || substr(hex(encode({text})), CAST(1 + 2 * i AS INT), 2) AS BIGINT))")
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {each}), lambda c, b: {step}), 4294967295)"


VARIANTS = f"""
    WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_UPPER.lower()}') AS w FROM documents),
    counted AS (SELECT d || w AS t, w, count(*) AS c FROM runs WHERE length(w) >= 7 GROUP BY ALL),
    hashed AS (SELECT w, c, {_crc32("t")} AS h FROM counted),
    cut AS (SELECT c, CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word FROM hashed),
    v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
    dels AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
    near AS (SELECT a.word, b.word AS other, b.n AS m FROM dels a JOIN dels b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT dels.word, v.word, v.n FROM dels JOIN v ON dels.rest = v.word
        UNION SELECT v.word, dels.word, dels.n FROM dels JOIN v ON dels.rest = v.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
    steps AS (SELECT word, word AS root, form AS next FROM known
        UNION ALL SELECT s.word, s.next, k.form FROM steps s JOIN known k ON k.word = s.next)
    SELECT word, form, root, n, n_near, form_n FROM steps JOIN known USING (word) WHERE next IS NULL"""

TRIE = f"""
    WITH given AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    t AS (SELECT c, k, n, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS i
        FROM (SELECT c, turn, md5(length(role) || ':' || role || text) AS k, length(text) AS n FROM given)),
    ids AS (SELECT c, {_crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM (SELECT DISTINCT c FROM given)),
    r AS (SELECT ids.c, i, k, n FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND i <= h
        UNION ALL SELECT ids.c, i, k, n FROM ids JOIN t ON t.c = ids.c AND i > h),
    p AS (SELECT c, d, n, string_agg(k, '/') OVER (PARTITION BY c ORDER BY d) AS path FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY i) AS d FROM r)
        UNION ALL SELECT c, 0, 0, '' FROM ids),
    node AS (SELECT path, any_value(d) AS depth, any_value(n) AS size, min(c) AS conv_id, count(*) AS n_convs FROM p GROUP BY path),
    step AS (SELECT x.path, y.path AS up FROM node x JOIN p y ON y.c = x.conv_id AND y.d = x.depth - 1),
    child AS (SELECT up AS path, count(*) AS n_children FROM step GROUP BY up),
    below AS (SELECT a.path, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
        FROM node x LEFT JOIN child ON child.path = x.path JOIN p a ON a.c = x.conv_id AND a.d <= x.depth GROUP BY a.path),
    ends AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max_by(path, d) AS path FROM p GROUP BY c) GROUP BY path)
    SELECT node.conv_id, node.depth, above.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0) AS n_children,
        CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM node JOIN below USING (path) LEFT JOIN child USING (path) LEFT JOIN ends USING (path)
    LEFT JOIN step USING (path) LEFT JOIN node above ON above.path = step.up"""

ORACLES = {"op6_secret_scan": SECRETS, "op9_decontamination": CONTAINED, "op11_conversation_trie": TRIE,
           "op12_spelling_variants": VARIANTS}
