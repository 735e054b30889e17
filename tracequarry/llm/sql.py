"""DuckDB SQL of the numbered queries that SQL can express: tool-call linking, quality rules and collocations."""

from __future__ import annotations

from .quality_rules import CLASSES, COMMON_WORDS

TOOL_CALLS = """WITH RECURSIVE
asked AS (SELECT conv_id, 'call-' || turn AS call_id, turn, 'call-' || (turn - 2) AS parent_id,
    CASE WHEN text IS NULL AND turn IS NULL THEN '{}' WHEN text IS NULL THEN CAST(json_object('turn', turn) AS VARCHAR)
         WHEN turn IS NULL THEN CAST(json_object('text', text) AS VARCHAR) ELSE CAST(json_object('text', text, 'turn', turn) AS VARCHAR) END AS arguments
    FROM conversations WHERE role = 'user'),
calls AS (SELECT * FROM asked WHERE conv_id IS NULL OR call_id IS NULL UNION ALL
    SELECT * FROM asked WHERE conv_id IS NOT NULL AND call_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, arguments, parent_id) = 1),
replied AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
results AS (SELECT * FROM replied WHERE conv_id IS NULL OR call_id IS NULL UNION ALL
    SELECT * FROM replied WHERE conv_id IS NOT NULL AND call_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, content NULLS FIRST) = 1),
known AS (SELECT conv_id, call_id, parent_id FROM calls WHERE conv_id IS NOT NULL AND call_id IS NOT NULL),
walk AS (SELECT k.conv_id, k.call_id, CAST(0 AS BIGINT) AS depth FROM known k LEFT JOIN known p ON p.conv_id = k.conv_id AND p.call_id = k.parent_id WHERE p.call_id IS NULL
    UNION ALL SELECT k.conv_id, k.call_id, w.depth + 1 FROM walk w JOIN known k ON k.conv_id = w.conv_id AND k.parent_id = w.call_id),
made AS (SELECT c.*, CASE WHEN c.conv_id IS NULL OR c.call_id IS NULL THEN 0 ELSE w.depth END AS depth, r.call_id IS NOT NULL AS answered
    FROM calls c LEFT JOIN walk w ON w.conv_id = c.conv_id AND w.call_id = c.call_id LEFT JOIN results r ON r.conv_id = c.conv_id AND r.call_id = c.call_id),
judged AS (SELECT *, CASE WHEN depth IS NULL THEN 'cyclic' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status FROM made),
events AS (SELECT conv_id, call_id, 'call' AS kind, depth, turn, status,
    concat_ws('; ', CASE WHEN json_extract(arguments, '$.text') IS NULL THEN 'missing text' END, CASE WHEN json_extract(arguments, '$.turn') IS NULL THEN 'missing turn' END) AS violations,
    CASE WHEN call_id IS NULL THEN CAST(json_object('arguments', arguments, 'kind', 'call', 'name', 'reply') AS VARCHAR)
         ELSE CAST(json_object('arguments', arguments, 'id', call_id, 'kind', 'call', 'name', 'reply') AS VARCHAR) END AS json
FROM judged
UNION ALL
SELECT r.conv_id, r.call_id, 'result', CASE WHEN j.call_id IS NULL THEN 0 ELSE j.depth END, r.turn, coalesce(j.status, 'orphan'), '',
    CASE WHEN r.content IS NULL AND r.call_id IS NULL THEN '{"kind":"result"}' WHEN r.content IS NULL THEN CAST(json_object('id', r.call_id, 'kind', 'result') AS VARCHAR)
         WHEN r.call_id IS NULL THEN CAST(json_object('content', r.content, 'kind', 'result') AS VARCHAR) ELSE CAST(json_object('content', r.content, 'id', r.call_id, 'kind', 'result') AS VARCHAR) END
FROM results r LEFT JOIN judged j ON j.conv_id = r.conv_id AND j.call_id = r.call_id)
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY depth NULLS LAST, kind, turn NULLS FIRST, call_id NULLS FIRST, CASE WHEN conv_id IS NULL OR call_id IS NULL THEN md5(json) END NULLS FIRST) - 1 AS position
FROM events"""


def _listed(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def quality_rules_sql(min_words: int = 50, repeat_percent: int = 50, min_judged_words: int = 80, max_distance: float = 0.4) -> str:
    space, widest = r"[\x20\x09-\x0D]", max(map(len, COMMON_WORDS.values())) + 1
    named = ", ".join("length(regexp_replace(t, '" + p.replace("'", "''") + "', '', 'g'))" for p in CLASSES.values())
    bins = " ".join(f"WHEN '{code}' THEN list_transform({_listed(ws)}, lambda k: len(list_filter(lw, lambda x: x = k)))" for code, ws in COMMON_WORDS.items())
    sums = lambda what, by, n: ", ".join(f"sum({what}[{i}] / {by})" for i in range(1, n + 1))
    share = lambda h: f"list_transform({h}, lambda x: x / list_sum({h}))"
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ((z[1] + z[2]) / 2)) ELSE 0 END"
    zipped = lambda p, q: f"list_transform(list_zip({share(p)}, {share(q)}), lambda z: ({part('z[1]')} + {part('z[2]')}) / 2)"
    distance = lambda p, q: f"CASE WHEN n >= {min_words} AND {p} IS NOT NULL AND {q} IS NOT NULL THEN sqrt(greatest(0.0, list_sum({zipped(p, q)}))) END"
    return f"""WITH
base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({_listed(list(COMMON_WORDS))[1:-1]}) THEN lang ELSE '' END AS lang FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM base),
counted AS (SELECT *, len(ws) AS n, length(t) AS chars, list_transform(ws, lambda x: lower(x)) AS lw, [{named}] AS nm FROM split),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS times FROM (SELECT rid, ws, unnest(range(1, n - 1)) AS i FROM counted)),
repeats AS (SELECT rid, count(DISTINCT j) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM windows WHERE times > 1) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
binned AS (SELECT c.* EXCLUDE (ws, lw), list_append(nm, chars - list_sum(nm)) AS cl, CASE lang {bins} END AS bins FROM counted c),
hist AS (SELECT *, list_append(bins, n - list_sum(bins)) AS cm FROM binned),
refs AS (SELECT lang AS ref_lang, [{sums("cl", "chars", len(CLASSES) + 1)}] AS rc, list_filter([{sums("cm", "n", widest)}], lambda x: x IS NOT NULL) AS rw FROM hist WHERE n >= {min_words} GROUP BY lang),
judged AS (SELECT h.*, coalesce(r.n_repeat, 0) AS n_repeat, coalesce(l.n_dup, 0) AS n_dup, {distance("cl", "rc")} AS dc, {distance("cm", "rw")} AS dw
    FROM hist h LEFT JOIN refs ON ref_lang = h.lang LEFT JOIN repeats r ON r.rid = h.rid LEFT JOIN lines l ON l.rid = h.rid)
SELECT doc_id, n AS n_words, CAST(chars - cl[1] AS BIGINT) AS word_chars, CAST(cl[4] AS BIGINT) AS n_symbols, CAST(n_dup AS BIGINT) AS n_dup_lines, CAST(n_repeat AS BIGINT) AS n_repeat_words,
    n < {min_words} OR 100 * n_repeat > {repeat_percent} * n AS base_failed, round(dc, 6) AS class_distance, round(dw, 6) AS common_distance,
    NOT (n < {min_words} OR 100 * n_repeat > {repeat_percent} * n) AND NOT (n >= {min_judged_words} AND coalesce(dc + coalesce(dw, dc), 0) > {max_distance}) AS kept
FROM judged"""


COLLOCATIONS = r"""WITH lowered AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
f1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM places GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM places WHERE i + 1 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM places WHERE i + 2 <= len(ws) GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
    SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, 1 AS k, l.f AS l, r.f AS r FROM f2 b JOIN f1 l ON l.lang = b.lang AND l.w1 = b.w1 JOIN f1 r ON r.lang = b.lang AND r.w1 = b.w2
    WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = b.lang AND 100 * t.f >= 50 * b.f AND (t.w1 = b.w1 AND t.w2 = b.w2 OR t.w2 = b.w1 AND t.w3 = b.w2))
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 1, l.f, r.f FROM f3 t JOIN f1 l ON l.lang = t.lang AND l.w1 = t.w1 JOIN f2 r ON r.lang = t.lang AND r.w1 = t.w2 AND r.w2 = t.w3
    UNION ALL
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, 2, l.f, r.f FROM f3 t JOIN f2 l ON l.lang = t.lang AND l.w1 = t.w1 AND l.w2 = t.w2 JOIN f1 r ON r.lang = t.lang AND r.w1 = t.w3),
scored AS (SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM least JOIN totals USING (lang) QUALIFY rank <= 2000"""
