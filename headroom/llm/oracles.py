"""SQL equivalents, where SQL can say what an operator returns."""

ORACLES: dict[str, str] = {}

ORACLES["op8_exact_dedup"] = """
WITH n AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
    FROM documents
), g AS (
    SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

ORACLES["op7_chat"] = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
    SELECT *,
        replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') AS etext,
        replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') AS erole,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
    FROM t
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(etext) + CASE WHEN before IS DISTINCT FROM role THEN 6 + length(erole) + 2 + 8 ELSE 6 END)::BIGINT
        AS formatted_chars
FROM e GROUP BY conv_id
"""

ORACLES["op11_filter_audit"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
    SELECT text, min(doc_id) AS first FROM d GROUP BY text
), w AS (
    SELECT d.*, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words,
        coalesce(d.doc_id > f.first, false) AS copy, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
    FROM d JOIN f USING (text) LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
    SELECT part, good, toxic,
        CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
        || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN copy THEN 'E' ELSE '' END AS fails
    FROM w
), c AS (
    SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
    FROM m GROUP BY part, fails
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
    FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
    SELECT filter_order, step, substr(filter_order, step, 1) AS filter, substr(filter_order, 1, step - 1) AS earlier
    FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), s AS (
    SELECT part, filter_order, step, filter, n, good, toxic, fails,
        contains(fails, filter) AS hit,
        len(fails) > 0 AND len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AS gone
    FROM c, steps
), t AS (
    SELECT part, filter_order, step, any_value(filter) AS filter,
        coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails = filter), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (NOT gone AND hit), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (NOT gone AND hit), 0)::BIGINT AS toxic_lost
    FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley
FROM t
"""

ORACLES["op12_source_divergence"] = r"""
WITH d AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'
        ) AS terms
    FROM documents
), t AS (
    SELECT doc, lang, source, unnest(terms) AS term FROM d
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS in_lang FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), v AS (
    SELECT lang, count(*)::HUGEINT AS kept, sum(in_lang)::HUGEINT AS lang_total FROM kept GROUP BY lang
), c AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
    SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0)::HUGEINT AS total
    FROM (SELECT DISTINCT lang, source FROM d) x
), p AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000 * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v.kept) AS p,
        1 + (1000000000 * (k.in_lang + 5)) // (v.lang_total + 5 * v.kept) AS q
    FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= 50
"""
