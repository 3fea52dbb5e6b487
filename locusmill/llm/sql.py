"""SQL of the text queries that SQL can express, for DuckDB."""

PREFIX_TRIE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, list({'r': r, 'x': x} ORDER BY pos) AS own,
           xor(4294967295::UBIGINT, list_reduce(
               list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
               lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::UBIGINT)),
                   lambda s, i: xor(s >> 1, 3988292384::UBIGINT * (s & 1))))) % 6 AS h
    FROM turns GROUP BY conv_id
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h::BIGINT), []), list_slice(c.own, c.h::BIGINT + 1, len(c.own))) AS path
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 100
), members AS (
    SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT list_slice(path, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth), '') AS ends
    FROM members GROUP BY 1, 2
), above AS (
    SELECT list_slice(p, 1, depth - 1) AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2
), every AS (
    SELECT n.*, coalesce(a.n_children, 0) AS n_children FROM nodes n LEFT JOIN above a ON a.p = n.p AND a.depth = n.depth
), below AS (
    SELECT list_slice(p, 1, d) AS p, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
           sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(p[depth].x) END) AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM every) GROUP BY 1, 2
)
SELECT e.conv_id, e.depth, u.conv_id AS parent_conv_id, e.n_convs::BIGINT AS n_convs, e.n_children::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM every e JOIN below b ON b.p = e.p AND b.depth = e.depth
LEFT JOIN nodes u ON u.depth = e.depth - 1 AND u.p = list_slice(e.p, 1, e.depth - 1)
"""

_STEP = "xor({s} >> 8, t[(xor({s}, {b}) & 255)::BIGINT + 1])"
_ONE = _STEP.format(s="s", b="c")
_TWO = _STEP.format(s=f"({_STEP.format(s='s', b='195::UBIGINT')})", b="(c - 64)")

SPELLING_GROUPS = f"""
WITH bytes AS (
    SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::UBIGINT, list_transform(range(8), lambda i: i::UBIGINT)),
        lambda s, i: xor(s >> 1, 3988292384::UBIGINT * (s & 1)))) AS t
), runs AS (
    SELECT doc_id, run, count(*) AS k
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 6 GROUP BY 1, 2
), hashed AS (
    SELECT run, k, xor(4294967295::UBIGINT, list_reduce(
        list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: unicode(c)::UBIGINT)),
        lambda s, c: CASE WHEN c < 128 THEN {_ONE} ELSE {_TWO} END)) AS h
    FROM runs, bytes
), placed AS (
    SELECT run, k, h % 199 AS hit, (h % length(run)::UBIGINT)::BIGINT AS cut FROM hashed
), words AS (
    SELECT CASE WHEN hit = 0 THEN substr(run, 1, cut) || substr(run, cut + 2) ELSE run END AS word, sum(k)::BIGINT AS n
    FROM placed GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5
), shorter AS (
    SELECT word, n, substr(word, 1, i) || substr(word, i + 2) AS v, i
    FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), pairs AS (
    SELECT a.word, b.word AS other, b.n AS other_n FROM shorter a JOIN shorter b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.v = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.v = b.word
), best AS (
    SELECT word, count(*) AS n_near, min({{'m': -other_n, 'o': encode(other)}}) AS b FROM pairs GROUP BY word
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.m >= 5 * w.n THEN decode(b.o) END AS form,
           CASE WHEN -b.m >= 5 * w.n THEN -b.m END AS form_n
    FROM words w LEFT JOIN best USING (word)
), way AS (
    WITH RECURSIVE walk(word, last, form) AS (
        SELECT word, word, form FROM forms
        UNION ALL SELECT k.word, f.word, f.form FROM walk k JOIN forms f ON f.word = k.form
    ) SELECT word, last AS root FROM walk WHERE form IS NULL
)
SELECT f.word, f.form, y.root, f.n::BIGINT AS n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN way y USING (word)
"""
