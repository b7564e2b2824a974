"""The chunking of operators/chunking.py as SQL for DuckDB, from windows over lines and recursion over blocks and sentences."""

from __future__ import annotations

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_PAIR = r"'(?s)^([A-Za-z][A-Za-z0-9 /]{{0,40}}):\s+(\S.*)$'".replace("{{", "{").replace("}}", "}")
_TOKENS = r"len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))"
_SENTENCES = r"list_filter(string_split(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"
_GAP = "chr(10) || chr(10)"

#: Lines with their classes; where title (t), metadata (b0) and body (b) begin.
LINES = rf"""
l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
c AS (SELECT doc_id, i, l, {_TRIM.format("l")} AS x, CASE WHEN regexp_full_match(l, '\s*') THEN 'b' WHEN regexp_matches(l, '^\s') THEN 'r'
    WHEN l = upper(l) AND regexp_matches(l, '\p{{L}}') THEN 'h' WHEN regexp_matches(l, ':\s*$') THEN 'q' ELSE 'p' END AS c FROM l),
s AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS cs, list(l ORDER BY i) AS ls, min(i) FILTER (c <> 'b') AS t FROM c GROUP BY doc_id),
m AS (SELECT *, t + 1 + len(regexp_extract(substr(cs, t + 1), '^b*')) AS b0 FROM s),
d AS (SELECT doc_id, cs, ls, coalesce({_TRIM.format("ls[t]")}, '') AS title, b0,
    b0 + coalesce(nullif(list_position(list_transform(list_slice(ls, b0, len(ls)), lambda y: regexp_matches(y, {_PAIR})), false), 0) - 1, greatest(0, len(ls) - b0 + 1)) AS b FROM m)"""

#: Blocks in order (k), with their sections' headings.
BLOCKS = rf"""{LINES},
y AS (SELECT c.doc_id, i, c, x, lag(c) OVER w AS p, lead(c) OVER w AS n, count(*) FILTER (c = 'h') OVER w AS sec FROM c JOIN d ON d.doc_id = c.doc_id AND c.i >= d.b WINDOW w AS (PARTITION BY c.doc_id ORDER BY i)),
z AS (SELECT *, sum(CASE WHEN c IN ('b', 'h') OR p IS NULL OR p IN ('b', 'h') OR c <> 'r' AND p = 'r' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g, CASE WHEN c = 'r' OR c = 'q' AND n = 'r' THEN 't' ELSE 'p' END AS kind FROM y),
f AS (SELECT doc_id, sec, g, kind, CASE WHEN kind = 't' THEN string_agg(x, chr(10) ORDER BY i) ELSE string_agg(x, ' ' ORDER BY i) END AS content FROM z WHERE c NOT IN ('b', 'h') GROUP BY doc_id, sec, g, kind),
hs AS (SELECT doc_id, sec, x AS heading FROM z WHERE c = 'h'),
blocks AS (SELECT f.doc_id, f.sec, kind, content, heading, row_number() OVER (PARTITION BY f.doc_id ORDER BY g, kind) AS k, {_TOKENS.format("content")} AS n FROM f LEFT JOIN hs ON hs.doc_id = f.doc_id AND hs.sec = f.sec),
body AS (SELECT d.doc_id, title, coalesce(string_agg(content, {_GAP} ORDER BY k), '') AS body FROM d LEFT JOIN blocks ON blocks.doc_id = d.doc_id GROUP BY d.doc_id, title)"""

#: (doc_id, c, text, path) of the section chunks, c from 1.
SECTIONS = rf"""{BLOCKS},
cuts AS (SELECT doc_id, k, 1 AS c, n AS held FROM blocks WHERE k = 1 UNION ALL
    SELECT b.doc_id, b.k, c + cut, CASE WHEN cut = 1 THEN b.n ELSE held + b.n END FROM (
        SELECT cuts.doc_id, cuts.k, c, held, CASE WHEN e.kind = 't' AND held + e.n > 900 OR held + e.n > 700 AND held >= 200 THEN 1 ELSE 0 END AS cut FROM cuts JOIN blocks e ON e.doc_id = cuts.doc_id AND e.k = cuts.k + 1) q
    JOIN blocks b ON b.doc_id = q.doc_id AND b.k = q.k + 1),
packs AS (SELECT cuts.doc_id, c, string_agg(content, {_GAP} ORDER BY cuts.k) AS body, arg_min(heading, cuts.k) FILTER (heading IS NOT NULL) AS heading FROM cuts JOIN blocks ON blocks.doc_id = cuts.doc_id AND blocks.k = cuts.k
    WHERE cuts.doc_id IN (SELECT doc_id FROM body WHERE {_TOKENS.format("body")} >= 600) GROUP BY cuts.doc_id, c),
texts AS (SELECT doc_id, c, body AS text, heading FROM packs WHERE c = 1 UNION ALL
    SELECT p.doc_id, p.c, array_to_string(list_slice(s, -greatest(1, CAST(round_even(0.15::DOUBLE * len(s), 0) AS INT)), -1), ' ') || ' ' || p.body, p.heading FROM (
        SELECT doc_id, c, CASE WHEN len({_SENTENCES.format("text")}) = 0 THEN [''] ELSE {_SENTENCES.format("text")} END AS s FROM texts) t JOIN packs p ON p.doc_id = t.doc_id AND p.c = t.c + 1),
ends AS (SELECT doc_id, max(c) AS last FROM texts GROUP BY doc_id),
merged AS (SELECT texts.doc_id, last, {_TOKENS.format("text")} < 200 AND last > 1 AS merge FROM texts JOIN ends ON ends.doc_id = texts.doc_id AND c = last),
chunks AS (SELECT doc_id, 1 AS c, body AS text, title AS path FROM body WHERE {_TOKENS.format("body")} < 600 UNION ALL
    SELECT x.doc_id, x.c, CASE WHEN merge AND x.c = last - 1 THEN x.text || {_GAP} || nx.text ELSE x.text END, title || coalesce(' > ' || x.heading, '')
    FROM texts x JOIN merged ON merged.doc_id = x.doc_id JOIN d ON d.doc_id = x.doc_id LEFT JOIN texts nx ON nx.doc_id = x.doc_id AND nx.c = x.c + 1 WHERE NOT (merge AND x.c = last))"""

#: (doc_id, c, text, title) of the sentence chunks, c from 1.
SENTENCES = rf"""{BLOCKS},
ps AS (SELECT doc_id, title, body, CASE WHEN len({_SENTENCES.format("body")}) = 0 THEN [''] ELSE {_SENTENCES.format("body")} END AS ps FROM body WHERE {_TOKENS.format("body")} >= 712),
pn AS (SELECT doc_id, ps, list_transform(ps, lambda x: {_TOKENS.format("x")}) AS ns FROM ps),
go AS (SELECT doc_id, 1 AS b, 1 AS a, ns[1] AS held, 0 AS cut_from FROM pn UNION ALL
    SELECT doc_id, b + 1, CASE WHEN cut THEN na ELSE a END, CASE WHEN cut THEN {_TOKENS.format("array_to_string(list_slice(ps, na, b), ' ')")} ELSE held END + n, CASE WHEN cut THEN a ELSE 0 END FROM (
        SELECT go.doc_id, b, a, held, ps, ns[b + 1] AS n, held >= 200 AND held + ns[b + 1] > 512 AS cut, b + 1 - greatest(1, CAST(round_even(0.15::DOUBLE * (b + 1 - a), 0) AS INT)) AS na FROM go JOIN pn ON pn.doc_id = go.doc_id WHERE b < len(ps))),
spans AS (SELECT doc_id, cut_from AS a, b - 1 AS z FROM go WHERE cut_from > 0 UNION ALL SELECT go.doc_id, a, b FROM go JOIN pn ON pn.doc_id = go.doc_id WHERE b = len(ps)),
stexts AS (SELECT spans.doc_id, row_number() OVER (PARTITION BY spans.doc_id ORDER BY z) AS c, count(*) OVER (PARTITION BY spans.doc_id) AS last, array_to_string(list_slice(ps, a, z), ' ') AS text FROM spans JOIN pn ON pn.doc_id = spans.doc_id),
smerged AS (SELECT doc_id, {_TOKENS.format("text")} < 200 AND last > 1 AS merge FROM stexts WHERE c = last),
schunks AS (SELECT doc_id, 1 AS c, body AS text, title FROM body WHERE {_TOKENS.format("body")} < 712 UNION ALL
    SELECT x.doc_id, x.c, CASE WHEN merge AND x.c = x.last - 1 THEN x.text || ' ' || nx.text ELSE x.text END, title
    FROM stexts x JOIN smerged ON smerged.doc_id = x.doc_id JOIN d ON d.doc_id = x.doc_id LEFT JOIN stexts nx ON nx.doc_id = x.doc_id AND nx.c = x.c + 1 WHERE NOT (merge AND x.c = x.last))"""

PARSE = rf"""WITH {LINES}, g AS (SELECT *, substr(cs, b) AS bc, regexp_extract_all(substr(cs, b), '[pq]*r+|[pq]+') AS gs FROM d)
SELECT doc_id, title, CAST(coalesce(len(list_distinct(list_transform(list_slice(ls, b0, b - 1), lambda y: trim(regexp_extract(y, {_PAIR}, 1))))), 0) AS BIGINT) AS n_metadata,
    CAST(coalesce(len(regexp_extract_all(bc, 'h')) + regexp_matches(bc, '^b*[^hb]')::INT, 0) AS BIGINT) AS n_sections, CAST(coalesce(len(list_filter(gs, lambda x: x LIKE '%r')), 0) AS BIGINT) AS n_tables,
    CAST(coalesce(list_sum(list_transform(gs, lambda x: CASE WHEN x NOT LIKE '%r' THEN 1 ELSE 1 + (regexp_matches(x, '^[pq]*pr') OR regexp_matches(x, '^[pq]+qr'))::INT END)), 0) AS BIGINT) AS n_blocks FROM g"""

_OUT = "SELECT doc_id, CAST(c - 1 AS BIGINT) AS chunk_index, md5(text) AS content_md5, {path} AS section_path, CAST({tokens} AS BIGINT) AS token_count FROM {table}"
BY_SECTIONS = f"WITH RECURSIVE {SECTIONS} {_OUT.format(path='path', tokens=_TOKENS.format('text'), table='chunks')}"
BY_SENTENCES = f"WITH RECURSIVE {SENTENCES} {_OUT.format(path='title', tokens=_TOKENS.format('text'), table='schunks')}"

_METADATA = rf"""pairs AS (SELECT doc_id, unnest(list_slice(ls, b0, b - 1)) AS y, generate_subscripts(list_slice(ls, b0, b - 1), 1) AS j FROM d),
keyed AS (SELECT doc_id, trim(regexp_extract(y, {_PAIR}, 1)) AS k, min(j) AS j, arg_max({_TRIM.format(f"regexp_extract(y, {_PAIR}, 2)")}, j) AS v FROM pairs GROUP BY doc_id, 2),
suffix AS (SELECT doc_id, string_agg(k || ': ' || v, ' | ' ORDER BY j) AS suffix FROM keyed GROUP BY doc_id)"""
_TEXTS = f"""WITH RECURSIVE {SECTIONS}, {SENTENCES[len(BLOCKS) + 2 :]}, {_METADATA},
windows AS (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 511) // 512))) AS i FROM documents),
paths AS (SELECT chunks.doc_id, c, text, path || {_GAP} || text AS p, coalesce({_GAP} || suffix, '') AS u FROM chunks LEFT JOIN suffix ON suffix.doc_id = chunks.doc_id),
variants AS (SELECT 1 AS strategy, doc_id, i + 1 AS c, substr(text, i * 512 + 1, 512) AS text FROM windows UNION ALL SELECT 2, doc_id, c, text FROM schunks UNION ALL
    SELECT 3, doc_id, c, text FROM paths UNION ALL SELECT 4, doc_id, c, p FROM paths UNION ALL SELECT 5, doc_id, c, p || u FROM paths)"""
VARIANTS = f"{_TEXTS} SELECT strategy, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM variants GROUP BY strategy"

_TERMS = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
STRATEGY_SCORES = rf"""{_TEXTS}, index_ AS (SELECT strategy, doc_id, c, term, count(*) AS tf FROM (SELECT strategy, doc_id, c, unnest({_TERMS.format("text")}) AS term FROM variants) GROUP BY ALL),
asked AS (SELECT item_id AS qid, len(list_distinct({_TERMS.format("text")})) AS n, unnest(list_distinct({_TERMS.format("text")})) AS term FROM benchmark),
scored AS (SELECT strategy, qid, doc_id, c, round(sum(list_sum(list_transform(range(1, tf + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685 / n), 6) AS score FROM asked JOIN index_ USING (term) GROUP BY ALL),
ranked AS (SELECT strategy, qid, doc_id, row_number() OVER (PARTITION BY strategy, qid ORDER BY score DESC, doc_id, c) AS rank FROM scored),
want AS (SELECT item_id AS qid, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)),
best AS (SELECT strategy, ranked.qid, min(rank) AS rank FROM ranked SEMI JOIN want ON want.qid = ranked.qid AND want.doc_id = ranked.doc_id GROUP BY ALL)
SELECT s AS strategy, count(*) AS n, round(avg(coalesce(rank <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(rank <= 5, false)::INT), 6) AS hit_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr
FROM (SELECT unnest(range(1, 6)) AS s) CROSS JOIN benchmark LEFT JOIN best ON best.strategy = s AND best.qid = item_id GROUP BY s"""
