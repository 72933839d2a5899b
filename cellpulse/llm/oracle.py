"""DuckDB SQL for the queries whose rows SQL can state, each from its contract alone.

The others rest on a fitted model, a tokenizer, a checksum or hashes that SQL lacks; tests hold them
against plain versions, round trips or held-out labels.
"""

WORDS = r"[^\x20\x09-\x0D]+"
ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PASSAGES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS ws FROM documents),
win AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
gone AS (
    SELECT DISTINCT doc_id, p FROM (
        SELECT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE m < win.doc_id)
),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
    SELECT each.doc_id, count(gone.p) AS n_removed,
           string_agg(word, ' ' ORDER BY each.p) FILTER (WHERE gone.p IS NULL) AS rest
    FROM each LEFT JOIN gone ON each.doc_id = gone.doc_id AND each.p = gone.p
    GROUP BY each.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

_COMPONENTS = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS ws FROM documents),
sets AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
),
size AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
same AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT a, b FROM same JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
    WHERE 100 * same.n >= 90 * (x.n + y.n - same.n)
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id, doc_id AS r FROM documents
    UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.r = edges.a
)
SELECT reach.doc_id, coalesce(any_value(size.n), 0) AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN size ON reach.doc_id = size.doc_id GROUP BY reach.doc_id"""

_LEAKS = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{ITEM_WORDS}') AS ws FROM benchmark),
iw AS (
    SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[j:j + 9], ' ') AS k
    FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS j FROM i WHERE len(ws) > 0)
),
d AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ITEM_WORDS}') AS ws FROM documents),
dw AS (
    SELECT doc_id, n, j, array_to_string(ws[j:j + n - 1], ' ') AS k FROM (
        SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS j
        FROM d, (SELECT DISTINCT n FROM iw) s WHERE len(ws) >= n)
),
hit AS (SELECT dw.doc_id, dw.n, dw.j, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + n)) AS p FROM hit) GROUP BY doc_id
),
items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_TURNS = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
    SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn') AS escaped FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), ''))
           AS loss_sha256,
       CAST(sum(length('<turn ' || url_encode(role) || '>' || chr(10) || escaped || '</turn>' || chr(10))) AS BIGINT)
           AS formatted_chars
FROM e GROUP BY conv_id"""

_MIDDLES = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
           regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w
    FROM documents
),
r AS (
    SELECT *, CAST('0x' || h[1:8] AS UBIGINT) % (len(w) + 1) AS r1, CAST('0x' || h[9:16] AS UBIGINT) % (len(w) + 1) AS r2,
           CAST('0x' || h[17:24] AS UBIGINT) % 100 AS r3, CAST('0x' || h[25:32] AS UBIGINT) % 100 AS r4
    FROM d
),
c AS (
    SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r3 >= 90
                THEN 'plain' WHEN r4 < 20 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(w[1:CAST(least(r1, r2) AS BIGINT)], '') AS p,
           array_to_string(w[CAST(least(r1, r2) AS BIGINT) + 1:CAST(greatest(r1, r2) AS BIGINT)], '') AS m,
           array_to_string(w[CAST(greatest(r1, r2) AS BIGINT) + 1:], '') AS s
    FROM r
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_RANKS = rf"""
WITH d AS (
    SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '{TERMS}') AS ws FROM documents
),
size AS (SELECT row, doc_id, len(ws) AS n FROM d WHERE len(ws) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
held AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM d) GROUP BY ALL),
asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '{TERMS}')) AS term FROM benchmark
),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, total GROUP BY term
),
score AS (
    SELECT item_id, row, doc_id,
           CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN held USING (term) JOIN weight USING (term) JOIN size USING (row), total
    GROUP BY item_id, row, doc_id
),
ranked AS (
    SELECT item_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
    FROM score WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLE = {
    "op3_cover_dedup": _PASSAGES,
    "op7_ngram_join": _COMPONENTS,
    "op9_decontaminate": _LEAKS,
    "op11_template_compiler": _TURNS,
    "op12_skip_list_fim": _MIDDLES,
    "op13_hybrid_search": _RANKS,
}
