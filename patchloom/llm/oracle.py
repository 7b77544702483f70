"""DuckDB SQL for the queries that SQL can express."""

_CHATS = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marks AS (
    SELECT unnest(['<s>', '</s>', '[SYSTEM]', '[/SYSTEM]', '[INST]', '[/INST]', '[REPLY]', '[ROLE]', '[/ROLE]', '\']) AS mark
), sized AS (
    SELECT *, length(text)
        + (SELECT sum((length(text) - length(replace(text, mark, ''))) // length(mark)) FROM marks)
        + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 ELSE 17 + length(role)
            + (SELECT sum((length(role) - length(replace(role, mark, ''))) // length(mark)) FROM marks) END AS chars
    FROM rows
), joined AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
        string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, ''
            ORDER BY turn NULLS FIRST, role, text) AS roles
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
    3 + cast(chars AS BIGINT) AS formatted_chars,
    regexp_full_match(roles, 's?u(au)*a?') AS valid,
    CASE WHEN NOT regexp_full_match(roles, 's?(u(au)*a?)?')
        THEN length(regexp_extract(roles, '^s?(u(au)*a?)?')) END AS first_error,
    true AS mask_agrees
FROM joined
"""

_LINES = r"""
WITH rows AS (
    SELECT doc_id, coalesce(source, '') || (source IS NULL) AS site, unnest(string_split(text, chr(10))) AS line,
        unnest(range(len(string_split(text, chr(10))))) AS pos
    FROM documents
), kept AS (SELECT *, trim(line, ' ') AS key FROM rows WHERE trim(line, ' ') <> ''
), common AS (
    SELECT key, min((doc_id, pos)) AS first FROM kept GROUP BY key HAVING count(DISTINCT site) >= 10
), gone AS (
    SELECT k.doc_id, k.pos FROM kept k JOIN common c USING (key) WHERE (k.doc_id, k.pos) <> c.first
), joined AS (
    SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) FILTER (g.pos IS NULL) AS text,
        count(*) AS n_lines, count(g.pos) AS n_removed
    FROM rows r LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos GROUP BY r.doc_id
)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM joined
"""

_HITS = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS part
    FROM items, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), parts AS (
    SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS part
    FROM words, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), found AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM parts p JOIN windows v ON v.n = p.n AND v.part = p.part
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM found, unnest(range(i, i + n)) AS t(k) GROUP BY doc_id
), ids AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_USABLE = r"""
    SELECT vec_id, {extra} list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS iv
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)
"""

_DOT = "coalesce(list_sum(list_transform(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] * {b}[i])), 0)"

_TOPK = r"""
WITH v AS (""" + _USABLE.format(extra="", scale=1024) + r"""
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, """ + _DOT.format(a="q.iv", b="c.iv") + r""" AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
"""

_NEGATIVES = r"""
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, iv FROM (""" + _USABLE.format(extra="label, ", scale=256) + r""") WHERE label IS NOT NULL
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS a_label, c.vec_id, c.label, """ + _DOT.format(a="a.iv", b="c.iv") + r""" AS score
    FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE label = a_label
    ) WHERE r <= 5
), n AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.a_label
        AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, CAST(positive_score AS BIGINT) AS positive_score,
    CAST(negative_score AS BIGINT) AS negative_score
FROM n WHERE rank <= 5
"""

ORACLE = {
    "op1_chat_formatting": _CHATS,
    "op7_line_dedup": _LINES,
    "op8_decontamination": _HITS,
    "op11_topk_search": _TOPK,
    "op13_hard_negatives": _NEGATIVES,
}
