"""DuckDB SQL for the queries of `queries.py`, put together from shared common table expressions.

The SQL follows the rules of the index on its own, by recursion, range joins and self-joins over exploded lines, so that
equal results mean something.
"""

from __future__ import annotations

import re

from glyphwood.functions.text import SPACE, STOPWORDS
from glyphwood.operators import parse, quality
from glyphwood.sources.vault import HTML_STEPS

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(f'[{SPACE}]+')}), lambda w: w <> '')"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace(lower({x}), {q(f'[{SPACE}]+')}, '-', 'g'), '[^a-z0-9-]', '', 'g')"


def stem(x: str) -> str:
    return rf"regexp_replace(replace({x}, '/', '_'), '(?i)\.md$', '')"


def tokens(x: str) -> str:
    stop = "[" + ", ".join(q(w) for w in STOPWORDS) + "]"
    plain = f"regexp_replace(lower({x}), {q(f'[^a-z0-9{SPACE}-]')}, ' ', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, {q(f'[{SPACE}]+')}), lambda w: length(w) > 1 AND NOT list_contains({stop}, w))"


def html(x: str) -> str:
    for form, to in HTML_STEPS:
        to = re.sub(r"\$(\d)", r"\\\1", to)
        x = f"regexp_replace({x}, {q(form)}, {q(to)}, 'g')"
    return x


def without_links(x: str, to: str) -> str:
    return f"regexp_replace(regexp_replace({x}, {q(parse.COMMENT)}, ' ', 'g'), {q(parse.LINK)}, {q(to)}, 'g')"


def doc_type(file: str) -> str:
    """The prefixes of queries.CONFIG."""
    number = f"regexp_extract({file}, '^src([0-9]+)/', 1)"
    by_number = f"CASE try_cast({number} AS INT) % 3 WHEN 0 THEN 'article' WHEN 1 THEN 'report' WHEN 2 THEN 'note' END"
    return f"CASE WHEN {file} LIKE 'src1/en/%' THEN 'brief' WHEN {file} LIKE 'pages/%' THEN 'web' WHEN {file} LIKE 'moved/%' THEN 'notice' WHEN try_cast({number} AS INT) < 64 THEN {by_number} END"


def page_forms(what: str) -> str:
    if what == "is":
        return " OR ".join(f"regexp_matches(text, {q(f)})" for f in parse.PAGE_FORMS.values())
    if what == "name":
        return "CASE " + " ".join(f"WHEN regexp_matches(text, {q(f)}) THEN '{n}'" for n, f in parse.PAGE_FORMS.items()) + " END"
    return "CASE " + " ".join(f"WHEN regexp_matches(text, {q(f)}) THEN try_cast(regexp_extract(text, {q(f)}, 1) AS BIGINT)" for n, f in parse.PAGE_FORMS.items() if n != "form_feed") + " END"


#: Marks that may open or close a fence, as literals: which character, how long, whether its line may open or close.
MARK = r"^ {0,3}(`{3,}|~{3,})"

CTES: dict[str, str] = {
    "vault": rf"""
        SELECT concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), 'doc_' || doc_id || '.md') AS file,
            CASE WHEN doc_id % 7 = 0 THEN '---' || {NL} || 'lang: ' || coalesce(lang, '') || {NL} || '---' || {NL} ELSE '' END ||
            array_to_string(list_transform(ls, lambda x, j: CASE
                WHEN (j - 1) % 4 = 0 THEN repeat('#', 1 + ((j - 1) // 4) % 3) || ' ' || x
                WHEN (j - 1) % 11 = 5 AND doc_id % 5 = 1 THEN '```' || {NL} || x
                WHEN (j - 1) % 13 = 7 AND doc_id % 5 = 2 THEN '<!-- page:' || ((j - 1) // 13 + 1) || ' -->' || {NL} || x
                WHEN (j - 1) % 9 = 3 AND doc_id % 5 = 3 THEN x || {NL} || '-----'
                WHEN (j - 1) % 4 = 2 THEN x || ' [more](./doc_' || (doc_id + 1) || '.md)'
                ELSE x END), {NL}) AS content
        FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n') AS ls FROM documents)
        UNION ALL SELECT 'pages/page_' || page_id || '.md', regexp_replace({html("coalesce(html, '')")}, '^\n+|\n+$', '', 'g') || {NL} FROM pages
        UNION ALL SELECT 'moved/item_' || item_id || '.md', '# Item ' || item_id || {NL} || {NL} || 'This page has moved to [its page](../pages/page_' || item_id || '.md#top).' || {NL} FROM benchmark""",
    "raw": r"SELECT file, content, regexp_split_to_array(content, '\r\n|\r|\n') AS ls FROM vault",
    "numbered": "SELECT file, unnest(ls) AS text, generate_subscripts(ls, 1) AS n FROM raw",
    "fronts": f"""
        SELECT r.file, len(ls) AS total, coalesce(CASE WHEN {trim("ls[1]")} = '---' THEN f.n END, 0) AS front
        FROM raw r LEFT JOIN (SELECT file, min(n) AS n FROM numbered WHERE n > 1 AND {trim("text")} IN ('---', '...') GROUP BY file) f USING (file)""",
    "marks": rf"""
        SELECT file, n, mark, row_number() OVER (PARTITION BY file ORDER BY n) AS k,
            NOT (mark LIKE '`%' AND contains(substr(text, strpos(text, mark) + length(mark)), '`')) AS opener,
            regexp_matches(text, '^ {{0,3}}(`{{3,}}|~{{3,}})[ \t]*$') AS closer
        FROM (SELECT v.*, regexp_extract(text, {q(MARK)}, 1) AS mark FROM numbered v JOIN fronts USING (file) WHERE n > front) WHERE mark <> ''""",
    "states": """
        SELECT file, 0::BIGINT AS k, '' AS ch, 0::BIGINT AS sz, 0::BIGINT AS st, 0::BIGINT AS s, 0::BIGINT AS e FROM (SELECT DISTINCT file FROM marks)
        UNION ALL
        SELECT s.file, m.k,
            CASE WHEN s.st = 0 AND opener THEN mark[1] ELSE ch END,
            CASE WHEN s.st = 0 AND opener THEN length(mark) ELSE sz END,
            CASE WHEN s.st = 0 AND opener THEN m.n WHEN s.st > 0 AND closer AND mark[1] = ch AND length(mark) >= sz THEN 0 ELSE s.st END,
            CASE WHEN s.st > 0 AND closer AND mark[1] = ch AND length(mark) >= sz THEN s.st ELSE 0 END,
            CASE WHEN s.st > 0 AND closer AND mark[1] = ch AND length(mark) >= sz THEN m.n ELSE 0 END
        FROM states s JOIN marks m ON m.file = s.file AND m.k = s.k + 1""",
    "fences": """
        SELECT file, s AS start_line, e AS end_line, false AS unterminated FROM states WHERE s > 0
        UNION ALL SELECT file, st, total, true FROM (SELECT file, arg_max(st, k) AS st FROM states GROUP BY file) JOIN fronts USING (file) WHERE st > 0""",
    "flagged": f"""
        SELECT v.file, v.n, v.text, v.n > front AS body, f.start_line IS NOT NULL AS in_code, v.n > front AND {trim("v.text")} <> '' AS substantive, front,
            v.n > front AND f.start_line IS NULL AND regexp_matches(v.text, {q(parse.ATX)}) AS atx
        FROM numbered v JOIN fronts USING (file) LEFT JOIN fences f ON f.file = v.file AND v.n BETWEEN f.start_line AND f.end_line""",
    "underlined": f"""
        SELECT *, body AND NOT in_code AND NOT atx AND n > front + 1 AND regexp_matches(text, {q(parse.UNDERLINE)}) AND NOT p_code
            AND {trim("coalesce(p_text, '')")} <> '' AND NOT regexp_matches(p_text, {q(parse.NO_SETEXT)}) AS setext
        FROM (SELECT *, lag(text) OVER w AS p_text, lag(in_code) OVER w AS p_code FROM flagged WINDOW w AS (PARTITION BY file ORDER BY n))""",
    "lines": f"""
        SELECT file, n, text, body, in_code, substantive, coalesce(setext, false) AS underline,
            CASE WHEN atx THEN 'atx' WHEN coalesce(n_setext, false) THEN 'setext' END AS kind,
            CASE WHEN atx THEN length(regexp_extract(text, {q(parse.ATX)}, 1)) WHEN coalesce(n_setext, false) THEN CASE WHEN {trim("n_text")} LIKE '=%' THEN 1 ELSE 2 END ELSE 0 END AS level
        FROM (SELECT *, lead(setext) OVER w AS n_setext, lead(text) OVER w AS n_text FROM underlined WINDOW w AS (PARTITION BY file ORDER BY n))""",
    "heads": rf"""
        SELECT file, n AS line, level, kind, CASE WHEN kind = 'setext' THEN n + 1 END AS underline_line,
            CASE WHEN kind = 'setext' THEN {trim("text")} ELSE {trim("regexp_replace(regexp_replace(regexp_replace(regexp_extract(text, '^ {0,3}#{1,6}[ \t]*(.*)$', 1), '[ \t]+$', ''), '[ \t]+#+[ \t]*$', ''), '^#+[ \t]*$', '')")} END AS text
        FROM lines WHERE level > 0""",
    "opened": "SELECT * FROM lines WHERE body AND NOT in_code AND NOT underline AND kind IS DISTINCT FROM 'atx'",
    "markers": f"""
        SELECT file, n AS line, coalesce({page_forms("number")}, row_number() OVER (PARTITION BY file ORDER BY n)) AS page, {page_forms("name")} AS pattern
        FROM opened WHERE {page_forms("is")}""",
    "links": f"""
        SELECT file, n AS line, unnest(generate_series(0, len(a) - 1)) AS idx, unnest(a) AS text, unnest(b) AS target
        FROM (SELECT file, n, regexp_extract_all(text, {q(parse.LINK)}, 1) AS a, regexp_extract_all(text, {q(parse.LINK)}, 2) AS b FROM opened) WHERE len(a) > 0""",
    "local_links": r"""
        SELECT *, split_part(target, '#', 1) AS path FROM links
        WHERE NOT regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*:') AND target NOT LIKE '#%' AND regexp_matches(split_part(target, '#', 1), '(?i)\.md$')""",
    "path_parts": """
        SELECT file, line, idx, target, list_filter(string_split(CASE WHEN path LIKE '/%' THEN path ELSE regexp_replace(file, '[^/]*$', '') || path END, '/'), lambda p: p NOT IN ('', '.')) AS parts
        FROM local_links""",
    "walked": """
        SELECT file, line, idx, target, parts, 1::BIGINT AS i, []::VARCHAR[] AS kept FROM path_parts
        UNION ALL SELECT file, line, idx, target, parts, i + 1, CASE WHEN parts[i] = '..' THEN kept[:len(kept) - 1] ELSE list_append(kept, parts[i]) END FROM walked WHERE i <= len(parts)""",
    "resolved": "SELECT file, line, idx, target, array_to_string(kept, '/') AS resolved FROM walked WHERE i = len(parts) + 1",
    "prose_lines": f"""
        SELECT file, n, text, len({words(without_links("text", " " + chr(92) + "1 "))}) AS prose_words,
            len(list_filter({words(f"regexp_replace(regexp_replace({without_links('text', ' ')}, {q(f'^[{SPACE}]*[-*+][{SPACE}]*')}, ' '), '[|>#*_`]', ' ', 'g')")}, lambda w: regexp_matches(w, '[A-Za-z0-9]'))) AS non_link_words
        FROM lines WHERE substantive AND NOT in_code AND level = 0 AND NOT underline""",
    "doc_stats": """
        SELECT f.file, f.total, f.front, coalesce(l.substantive, 0) AS substantive, coalesce(l.last_line, 0) AS last_line, coalesce(p.prose_words, 0) AS prose_words,
            coalesce(p.non_link_words, 0) AS non_link_words, coalesce(c.n, 0) AS code_blocks, coalesce(h.n, 0) AS headings, coalesce(k.n, 0) AS links, coalesce(o.n, 0) AS local_links, p.prose
        FROM fronts f
        LEFT JOIN (SELECT file, count(*) FILTER (substantive) AS substantive, max(n) FILTER (substantive) AS last_line FROM lines GROUP BY file) l USING (file)
        LEFT JOIN (SELECT file, sum(prose_words)::BIGINT AS prose_words, sum(non_link_words)::BIGINT AS non_link_words, string_agg(text, chr(10) ORDER BY n) AS prose FROM prose_lines GROUP BY file) p USING (file)
        LEFT JOIN (SELECT file, count(*) AS n FROM fences GROUP BY file) c USING (file)
        LEFT JOIN (SELECT file, count(*) AS n FROM heads GROUP BY file) h USING (file)
        LEFT JOIN (SELECT file, count(*) AS n FROM links GROUP BY file) k USING (file)
        LEFT JOIN (SELECT file, count(*) AS n FROM local_links GROUP BY file) o USING (file)""",
    "classified": r"""
        SELECT *, CASE
            WHEN substantive = 0 THEN 'placeholder'
            WHEN headings <= 1 AND code_blocks = 0 AND local_links >= 1 AND prose_words <= 40 AND regexp_matches(prose, '(?i)\b(has\s+moved|have\s+moved|moved\s+to|redirect(ed|s|ing)?|see\s+instead|now\s+lives|now\s+located|relocated|superseded\s+by|replaced\s+by|this\s+page\s+is\s+now)\b') THEN 'redirect'
            WHEN prose_words < 20 AND code_blocks = 0 THEN 'placeholder'
            WHEN links >= 5 AND non_link_words <= 30 AND code_blocks = 0 THEN 'navigation_only'
            ELSE 'substantive' END AS classification
        FROM doc_stats""",
    "typed": f"SELECT *, {doc_type('file')} AS doc_type FROM classified",
    "heads2": """
        SELECT h.*, CASE WHEN h.text = '' THEN '(untitled section)' ELSE h.text END AS title, last_line, front,
            (SELECT min(x.line) FROM heads x WHERE x.file = h.file AND x.line > h.line AND x.level <= h.level) AS next_up,
            (SELECT max(x.line) FROM heads x WHERE x.file = h.file AND x.line < h.line AND x.level < h.level) AS parent_line,
            (SELECT min(x.line) FROM heads x WHERE x.file = h.file AND x.line > h.line) AS next_any
        FROM heads h JOIN typed USING (file) WHERE classification = 'substantive' AND doc_type IS NOT NULL""",
    "sections": "SELECT *, greatest(line, coalesce(next_up - 1, last_line)) AS end_line, coalesce(next_any <> next_up, next_any IS NOT NULL AND next_up IS NULL) AS has_children FROM heads2",
    "firsts": "SELECT file, min(line) AS first_line FROM heads GROUP BY file",
    "containers": """
        SELECT file, line, level, title, parent_line, end_line, NOT has_children AS may_split, NULL::VARCHAR AS generated FROM sections
        UNION ALL SELECT t.file, front + 1, 1, 'Preamble', NULL::BIGINT, first_line - 1, true, 'preamble' FROM typed t JOIN firsts USING (file)
        WHERE classification = 'substantive' AND doc_type IS NOT NULL AND first_line > front + 1 AND EXISTS (SELECT 1 FROM lines l WHERE l.file = t.file AND l.substantive AND l.n < first_line)""",
    "proto": """
        SELECT file, line, 0 AS rank, 0 AS part, level, title, parent_line, CASE WHEN may_split AND end_line - line + 1 <= 25 THEN line END AS line_start, CASE WHEN may_split AND end_line - line + 1 <= 25 THEN end_line END AS line_end, generated FROM containers
        UNION ALL SELECT file, line, 1, i::INT, level + 1, title || ' — Part ' || i, line, line + (i - 1) * 25, least(line + i * 25 - 1, end_line), 'part'
            FROM (SELECT *, unnest(generate_series(1, (end_line - line) // 25 + 1)) AS i FROM containers WHERE may_split AND end_line - line + 1 > 25)
        UNION ALL SELECT s.file, line, 1, 0, level + 1, title || ' — Overview', line, line, next_any - 1, 'overview' FROM sections s
            WHERE has_children AND EXISTS (SELECT 1 FROM lines l WHERE l.file = s.file AND l.substantive AND l.n > s.line AND l.n < s.next_any)
        UNION ALL SELECT file, front + 1 + (i - 1) * 10, 0, 0, 1, 'Chunk ' || i, NULL::BIGINT, front + 1 + (i - 1) * 10, least(front + i * 10, last_line), 'chunk'
            FROM (SELECT *, unnest(generate_series(1, (last_line - front - 1) // 10 + 1)) AS i FROM typed WHERE classification = 'substantive' AND doc_type IS NOT NULL AND headings = 0 AND last_line > front)""",
    "sibs": f"""
        SELECT *, row_number() OVER (PARTITION BY file, parent_line ORDER BY line, rank, part) - 1 AS ordinal, CASE WHEN k > 1 THEN s || '-' || k ELSE s END AS own_slug
        FROM (SELECT *, row_number() OVER (PARTITION BY file, parent_line, s ORDER BY line, rank, part) AS k
            FROM (SELECT *, CASE WHEN {slug("title")} = '' THEN 'n' || coalesce(line_start, line) ELSE {slug("title")} END AS s FROM proto))""",
    "tree": f"""
        SELECT file, line, rank, part, level, title, line_start, line_end, generated, ordinal, {stem("file")} || '_' || own_slug AS node_id, NULL::VARCHAR AS parent_id, [ordinal] AS path, [title] AS heading_path FROM sibs WHERE parent_line IS NULL
        UNION ALL SELECT s.file, s.line, s.rank, s.part, s.level, s.title, s.line_start, s.line_end, s.generated, s.ordinal, t.node_id || '_' || s.own_slug, t.node_id, list_append(t.path, s.ordinal), list_append(t.heading_path, s.title)
        FROM tree t JOIN sibs s ON s.file = t.file AND s.parent_line = t.line AND t.rank = 0 WHERE (s.rank = 1 OR s.line > t.line)""",
    "leaf_nodes": "SELECT * FROM tree WHERE line_start IS NOT NULL",
    "ranges": """
        SELECT t.file, t.node_id, t.path, min(l.line_start) AS range_start, max(l.line_end) AS range_end
        FROM tree t JOIN leaf_nodes l ON l.file = t.file AND l.path[1:len(t.path)] = t.path GROUP BY t.file, t.node_id, t.path""",
    "owned": """
        SELECT l.file, l.n, l.substantive, l.level > 0 AS is_heading, count(t.node_id) AS owners
        FROM lines l LEFT JOIN leaf_nodes t ON t.file = l.file AND l.n BETWEEN t.line_start AND t.line_end GROUP BY ALL""",
    "covered": """
        SELECT file, count(*) FILTER (substantive AND NOT (owners = 0 AND is_heading)) AS coverable_lines, count(*) FILTER (substantive AND owners > 0) AS covered_lines,
            count(*) FILTER (substantive AND owners = 0 AND NOT is_heading) AS uncovered_count, count(*) FILTER (substantive AND owners = 0 AND is_heading) AS structural_heading_lines,
            sum(greatest(owners - 1, 0))::BIGINT AS overlapping
        FROM owned GROUP BY file""",
    "task_rows": f"""
        SELECT t.file, t.path, 0 AS last, {stem("t.file")} || ':' || t.node_id AS task_id, array_to_string(ls[range_start:range_end], {NL}) AS full_text FROM ranges t JOIN raw USING (file)
        UNION ALL SELECT file, [], 1, {stem("file")} || ':__root__', left(array_to_string(ls, {NL}), 2500) FROM raw JOIN typed USING (file) WHERE classification = 'substantive' AND doc_type IS NOT NULL""",
    "sized": f"""
        SELECT row_number() OVER (ORDER BY file, last, path) - 1 AS pos, task_id, file, CASE WHEN length(full_text) <= 12000 THEN full_text ELSE left(full_text, 12000) || {NL} || {NL} || '[content truncated for length]' END AS content FROM task_rows""",
    "leaves": f"""
        SELECT file, doc_type, CASE doc_type WHEN 'article' THEN 'editorial' WHEN 'brief' THEN 'editorial' WHEN 'report' THEN 'internal' WHEN 'web' THEN 'external' END AS doc_group,
            {stem("file")} || '.json' AS tree_index, CASE WHEN substantive % 9 = 0 THEN NULL ELSE 'Covers ' || headings || ' sections and ' || prose_words || ' words' END AS summary,
            split_part(file, '/', 2) AS lang, CASE WHEN headings % 5 = 0 THEN NULL ELSE headings::VARCHAR END AS edition, last_line
        FROM typed WHERE classification = 'substantive' AND doc_type IS NOT NULL""",
}

CTES |= {
    "sums": "SELECT pos, sum(length(content)) OVER (ORDER BY pos) AS upto, length(content) AS size FROM sized",
    "jumps": """
        SELECT a.pos, coalesce(min(b.pos), (SELECT count(*) FROM sized)) AS next FROM sums a LEFT JOIN sums b ON b.pos > a.pos AND b.pos <= a.pos + 12 AND (b.pos = a.pos + 12 OR b.upto - a.upto + a.size > 30000) GROUP BY a.pos""",
    "batch_starts": "SELECT 0::BIGINT AS pos, 1::BIGINT AS batch UNION ALL SELECT j.next, s.batch + 1 FROM batch_starts s JOIN jumps j ON j.pos = s.pos WHERE j.next < (SELECT count(*) FROM sized)",
    "results": """
        SELECT task_id, 'a' AS source, CASE WHEN length(task_id) % 5 = 1 THEN NULL WHEN length(task_id) % 5 = 2 THEN '' ELSE 'Summary of ' || task_id END AS summary FROM sized WHERE length(task_id) % 5 <> 0
        UNION ALL SELECT task_id, 'b', 'Second summary of ' || task_id FROM sized WHERE length(task_id) % 3 = 0""",
    "last_results": "SELECT task_id, arg_max(coalesce(summary, ''), source) AS summary FROM results GROUP BY task_id",
    "broken": """
        SELECT file, node_id, CASE WHEN line_start % 10 = 4 THEN NULL ELSE title END AS heading, line_start,
            CASE line_start % 10 WHEN 1 THEN line_end + 1 WHEN 2 THEN line_start - 1 WHEN 3 THEN line_end + 100000 - line_end ELSE line_end END AS line_end FROM tree""",
    "leaves2": "SELECT file, doc_type, doc_group, CASE WHEN doc_type IN ('article', 'report') THEN lang END AS lang FROM leaves",
    "synced": """
        SELECT file, last_line % 7 AS kind FROM typed WHERE last_line % 7 > 0 UNION ALL SELECT file || '.gone.md', 0 FROM typed WHERE last_line % 7 = 4""",
    "known_aliases": "SELECT t.file AS from_file, r.resolved AS to_file FROM typed t JOIN (SELECT file, arg_min(resolved, line * 1000 + idx) AS resolved FROM resolved GROUP BY file) r USING (file) JOIN typed u ON u.file = r.resolved AND u.classification = 'substantive' AND u.doc_type IS NOT NULL WHERE t.classification = 'redirect'",
    "paged": """
        SELECT l.file, l.heading_path, l.line_start, l.line_end,
            (SELECT arg_max(page, line) FROM markers m WHERE m.file = l.file AND m.line <= l.line_start) AS p1,
            (SELECT arg_max(page, line) FROM markers m WHERE m.file = l.file AND m.line <= l.line_end) AS p2,
            (SELECT arg_min(page, line) FROM markers m WHERE m.file = l.file) AS p0
        FROM leaf_nodes l""",
}


def sql(select: str) -> str:
    """select with the expressions that it needs, in order."""
    names = list(CTES)
    needed: set[str] = set()
    todo = [select]
    while todo:
        text = todo.pop()
        for name in names:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                needed.add(name)
                todo.append(CTES[name])
    parts = ", ".join(f"{n} AS ({CTES[n]})" for n in names if n in needed)
    return (f"WITH RECURSIVE {parts} " if parts else "") + select


def code_cases(summary: str, heading: str, root: str) -> str:
    """The rules for summaries as a delimited list."""
    body = trim(summary)
    n = f"len({words(body)})"
    plain = lambda x: trim(f"regexp_replace(regexp_replace(lower({x}), {q(f'[^a-z0-9{SPACE}]')}, '', 'g'), {q(f'[{SPACE}]+')}, ' ', 'g')")
    new = f"len(list_filter(list_distinct({tokens(body)}), lambda z: NOT list_contains({tokens(heading)}, z)))"
    rules = [
        (f"{n} < CASE WHEN {root} THEN 30 ELSE 15 END", "too_short"),
        (f"{n} > CASE WHEN {root} THEN 100 ELSE 60 END", "too_long"),
        *[(f"regexp_matches({body}, {q(form)})", code) for code, form in quality.EMPTY_PHRASES.items()],
        (f"{plain(heading)} <> '' AND {plain(body)} = {plain(heading)}", "repeats_heading"),
        (f"{plain(heading)} <> '' AND {plain(body)} <> {plain(heading)} AND {new} < 3", "adds_nothing_to_heading"),
    ]
    listed = ", ".join(f"CASE WHEN {c} THEN '{code}' END" for c, code in rules)
    return f"CASE WHEN {body} = '' THEN 'summary_missing' ELSE array_to_string(list_filter([{listed}], lambda z: z IS NOT NULL), ',') END"


def routing_descent() -> str:
    """Budget 15: the root, then of what is left a third for sources, half of the rest for languages, the rest for documents."""
    ranked = lambda key, ties: f"row_number() OVER (PARTITION BY item_id ORDER BY {key} DESC, {ties})"
    return f"""
        WITH l AS (SELECT source || '/' || lang || '/doc_' || doc_id || '.md' AS file, source AS s1, lang AS s2, list_distinct({tokens("text || ' ' || source || ' ' || lang || ' doc ' || doc_id || ' md'")}) AS ws FROM documents WHERE text IS NOT NULL),
        w AS (SELECT file, s1, s2, unnest(ws) AS w FROM l), qs AS (SELECT item_id, list_distinct({tokens("text")}) AS ts FROM benchmark), qw AS (SELECT item_id, unnest(ts) AS w, len(ts) AS n FROM qs),
        met AS (SELECT item_id, n, w, file, s1, s2 FROM w JOIN qw USING (w)),
        d1 AS (SELECT item_id, s1, count(DISTINCT w) / any_value(n) AS score FROM met GROUP BY item_id, s1),
        d2 AS (SELECT item_id, s1, s2, count(DISTINCT w) / any_value(n) AS score FROM met GROUP BY item_id, s1, s2),
        a1 AS (SELECT *, {ranked("score", "s1")} AS rank, 1 + least(count(*) OVER (PARTITION BY item_id), 4) AS used FROM (SELECT item_id, s1, coalesce(score, 0) AS score FROM (SELECT item_id, s1 FROM qs, (SELECT DISTINCT s1 FROM l) WHERE len(ts) > 0) LEFT JOIN d1 USING (item_id, s1))),
        v1 AS (SELECT * FROM a1 WHERE rank <= 4),
        a2 AS (SELECT *, {ranked("score", "s1, s2")} AS rank, greatest((15 - used) // 2, least(1, 15 - used)) AS due, count(*) OVER (PARTITION BY item_id) AS n FROM (SELECT v1.item_id, p.s1, p.s2, coalesce(d2.score, 0) AS score, used FROM v1 JOIN (SELECT DISTINCT s1, s2 FROM l) p USING (s1) LEFT JOIN d2 ON d2.item_id = v1.item_id AND d2.s1 = p.s1 AND d2.s2 = p.s2)),
        v2 AS (SELECT *, used + least(n, due) AS total FROM a2 WHERE rank <= due),
        found AS (
            SELECT item_id, s1, s2, file, count(*) / any_value(n) AS score FROM met SEMI JOIN v2 USING (item_id, s1, s2) GROUP BY item_id, s1, s2, file
            UNION ALL SELECT item_id, s1, s2, file, 0 FROM v2 JOIN (SELECT s1, s2, file, row_number() OVER (PARTITION BY s1, s2 ORDER BY file) AS r FROM l) f USING (s1, s2) WHERE r <= 15
        ), a3 AS (SELECT *, {ranked("score", "file")} AS rank FROM (SELECT item_id, s1, s2, file, max(score) AS score FROM found GROUP BY ALL)),
        v3 AS (SELECT a3.* FROM a3 JOIN (SELECT item_id, any_value(total) AS total FROM v2 GROUP BY item_id) USING (item_id) WHERE rank <= 15 - total)
        SELECT item_id, 0::BIGINT AS depth, 1::BIGINT AS rank, '' AS path, NULL::VARCHAR AS file, 1.0::DOUBLE AS score FROM qs WHERE len(ts) > 0
        UNION ALL SELECT item_id, 1, rank, s1, NULL, round(score, 4) FROM v1 UNION ALL SELECT item_id, 2, rank, s1 || '/' || s2, NULL, round(score, 4) FROM v2
        UNION ALL SELECT item_id, 3, rank, s1 || '/' || s2, file, round(score, 4) FROM v3"""


def descent_visited() -> str:
    """Three documents for each item by shared words, then four levels of nodes by heading and first words, 25 peeks in all."""
    share = f"len(list_intersect(ts, list_distinct({tokens("title || ' ' || left(content, 200)")}))) / len(ts)"
    levels = ""
    for k in range(1, 5):
        before = "found d" if k == 1 else f"v{k - 1} d"
        on = "t.file = d.file AND len(t.path) = 1" if k == 1 else f"t.file = d.file AND len(t.path) = {k} AND t.path[1:{k - 1}] = d.path AND d.line_start IS NULL"
        used = "0::BIGINT" if k == 1 else "d.used"
        levels += f""",
        a{k} AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_rank, file, path) AS r, count(*) OVER (PARTITION BY item_id) AS n FROM (
            SELECT d.item_id, d.ts, d.doc_rank, {used} AS used, t.file, t.node_id, t.path, t.line_start, {share} AS score FROM {before} JOIN told t ON {on}) WHERE score > 0),
        v{k} AS (SELECT item_id, ts, doc_rank, file, node_id, path, line_start, score, used + least(n, greatest(25 - used, 0)) AS used FROM a{k} WHERE r <= 25 - used)"""
    every = " UNION ALL ".join(f"SELECT item_id, file, node_id, {k}::BIGINT AS depth, round(score, 4)::DOUBLE AS score FROM v{k}" for k in range(1, 5))
    head = sql("SELECT 1 FROM tree JOIN sized JOIN vault").removesuffix("SELECT 1 FROM tree JOIN sized JOIN vault").rstrip()
    return head + f""", told AS MATERIALIZED (SELECT t.file, t.node_id, t.path, t.title, t.line_start, z.content FROM tree t JOIN sized z ON z.task_id = {stem("t.file")} || ':' || t.node_id),
        qs AS (SELECT item_id, list_distinct({tokens("text")}) AS ts FROM benchmark), qw AS (SELECT item_id, unnest(ts) AS w, len(ts) AS n FROM qs),
        dw AS (SELECT file, unnest(list_distinct({tokens("content || ' ' || regexp_replace(file, '[/._]', ' ', 'g')")})) AS w FROM vault SEMI JOIN told USING (file)),
        found AS (SELECT item_id, ts, file, r AS doc_rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, file) AS r FROM (SELECT item_id, file, count(*) / any_value(n) AS score FROM qw JOIN dw USING (w) GROUP BY item_id, file)) JOIN qs USING (item_id) WHERE r <= 3){levels}
        {every}"""


ORACLE: dict[str, str] = {
    "routing_descent": routing_descent(),
    "descent_visited": descent_visited(),
    "vault": sql("SELECT file, content FROM vault"),
    "fingerprint": sql("SELECT file, len(ls)::BIGINT AS line_count, sha256(content) AS sha256 FROM raw"),
    "lines": sql("SELECT file, n::BIGINT AS n, text, in_code, substantive, level::BIGINT AS level, underline FROM lines"),
    "frontmatter": sql("SELECT file, front::BIGINT AS frontmatter_end, total::BIGINT AS total_lines FROM fronts"),
    "headings": sql("SELECT file, line::BIGINT AS line, level::BIGINT AS level, text, kind, underline_line::BIGINT AS underline_line FROM heads"),
    "fences": sql("SELECT file, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, unterminated FROM fences"),
    "page_markers": sql("SELECT file, line::BIGINT AS line, page::BIGINT AS page, pattern FROM markers"),
    "page_at_asof": sql("SELECT l.file, l.n::BIGINT AS n, m.page FROM lines l ASOF LEFT JOIN markers m ON l.file = m.file AND l.n >= m.line"),
    "links": sql("SELECT file, line::BIGINT AS line, idx::BIGINT AS idx, text, target FROM links"),
    "resolve_links": sql("SELECT file, line::BIGINT AS line, idx::BIGINT AS idx, target, resolved FROM resolved"),
    "doc_stats": sql("SELECT file, substantive::BIGINT AS substantive_count, last_line::BIGINT AS last_substantive_line, prose_words, non_link_words, code_blocks::BIGINT AS code_blocks FROM doc_stats"),
    "classify": sql(
        "SELECT t.file, classification, classification = 'substantive' AS indexed, CASE WHEN classification = 'redirect' THEN r.resolved END AS alias_target, doc_type FROM typed t "
        "LEFT JOIN (SELECT file, arg_min(resolved, line * 1000 + idx) AS resolved FROM resolved GROUP BY file) r USING (file)"
    ),
    "scan_summary": sql(
        "SELECT c.classification, count(t.file)::BIGINT AS documents, count(*) FILTER (t.classification = 'substantive')::BIGINT AS to_ingest, 0::BIGINT AS already_indexed, count(*) FILTER (t.file IS NOT NULL AND t.doc_type IS NULL)::BIGINT AS unmapped "
        "FROM (SELECT unnest(['substantive', 'redirect', 'placeholder', 'navigation_only', 'unsupported']) AS classification) c LEFT JOIN typed t USING (classification) GROUP BY c.classification"
    ),
    "aliases": sql(
        "SELECT t.file AS from_file, r.resolved AS to_file, coalesce(u.classification = 'substantive', false) AS resolved FROM typed t JOIN (SELECT file, arg_min(resolved, line * 1000 + idx) AS resolved FROM resolved GROUP BY file) r USING (file) "
        "LEFT JOIN typed u ON u.file = r.resolved WHERE t.classification = 'redirect'"
    ),
    "doc_type_prefix": sql(f"SELECT file, {doc_type('file')} AS doc_type FROM vault"),
    "sections": sql("SELECT file, line::BIGINT AS line, level::BIGINT AS level, title AS heading, parent_line::BIGINT AS parent_line, end_line::BIGINT AS end_line FROM sections"),
    "nodes": sql(
        "SELECT file, node_id, parent_id, array_to_string(path, '.') AS path, len(path)::BIGINT AS depth, level::BIGINT AS level, title AS heading, array_to_string(heading_path, ' > ') AS heading_path, "
        "line_start::BIGINT AS line_start, line_end::BIGINT AS line_end, line_start IS NOT NULL AS is_leaf, generated FROM tree"
    ),
    "generated_nodes": sql("SELECT file, generated, title AS heading, level::BIGINT AS level, line_start::BIGINT AS line_start, line_end::BIGINT AS line_end FROM proto WHERE generated IS NOT NULL AND line_start IS NOT NULL"),
    "tree_stats": sql("SELECT file, count(*)::BIGINT AS nodes, count(line_start)::BIGINT AS leaves, max(len(path))::BIGINT AS depth, count(*) FILTER (generated IS NULL)::BIGINT AS headings FROM tree GROUP BY file"),
    "subtree_range": sql("SELECT file, node_id, range_start::BIGINT AS range_start, range_end::BIGINT AS range_end FROM ranges"),
    "outline": sql("SELECT file, row_number() OVER (PARTITION BY file ORDER BY path)::BIGINT AS pre_order, node_id, array_to_string(heading_path, ' > ') AS heading_path FROM tree"),
    "sibling_headings": sql(
        "SELECT t.file, t.node_id, coalesce(string_agg(s.title, '|' ORDER BY s.ordinal), '') AS siblings FROM tree t LEFT JOIN tree s ON s.file = t.file AND s.parent_id IS NOT DISTINCT FROM t.parent_id AND s.node_id <> t.node_id GROUP BY t.file, t.node_id"
    ),
    "coverage": sql(
        "SELECT c.file, coverable_lines::BIGINT AS coverable_lines, covered_lines::BIGINT AS covered_lines, CASE WHEN coverable_lines = 0 THEN 1.0 ELSE round(covered_lines / coverable_lines, 4) END::DOUBLE AS coverage_ratio, "
        "uncovered_count::BIGINT AS uncovered_count, structural_heading_lines::BIGINT AS structural_heading_lines, overlapping FROM covered c"
    ),
    "coverage_histogram": sql(
        "SELECT b.bucket, count(c.file)::BIGINT AS documents FROM (SELECT unnest(['1.0', '0.9-1.0', '0.75-0.9', '0.5-0.75', '<0.5']) AS bucket) b LEFT JOIN (SELECT file, CASE WHEN r >= 1 THEN '1.0' WHEN r >= 0.9 THEN '0.9-1.0' WHEN r >= 0.75 THEN '0.75-0.9' WHEN r >= 0.5 THEN '0.5-0.75' ELSE '<0.5' END AS bucket "
        "FROM (SELECT file, CASE WHEN coverable_lines = 0 THEN 1.0 ELSE round(covered_lines / coverable_lines, 4) END AS r FROM covered)) c USING (bucket) GROUP BY b.bucket"
    ),
    "tokenize": f"SELECT doc_id, array_to_string({tokens("coalesce(text, '')")}, ' ') AS tokens FROM documents",
    "content_slice": sql("SELECT task_id, file, content, length(content)::BIGINT AS size FROM sized"),
    "packing": sql(
        "SELECT task_id, batch::BIGINT AS batch FROM (SELECT s.task_id, max(b.batch) AS batch FROM sized s JOIN batch_starts b ON b.pos <= s.pos AND s.pos < b.pos + 12 GROUP BY s.task_id, s.pos)"
    ),
    "batches": sql(
        "SELECT 'batch-' || CASE WHEN batch < 1000 THEN lpad(batch::VARCHAR, 3, '0') ELSE batch::VARCHAR END AS batch_id, count(*)::BIGINT AS tasks, count(DISTINCT file)::BIGINT AS documents FROM "
        "(SELECT s.task_id, s.file, max(b.batch) AS batch FROM sized s JOIN batch_starts b ON b.pos <= s.pos AND s.pos < b.pos + 12 GROUP BY s.task_id, s.file, s.pos) GROUP BY batch"
    ),
    "merge_results": sql(f"SELECT t.file, t.node_id, CASE WHEN r.summary <> '' THEN r.summary END AS summary FROM tree t LEFT JOIN last_results r ON r.task_id = {stem('t.file')} || ':' || t.node_id"),
    "missing_results": sql("SELECT t.task_id, t.file FROM sized t LEFT JOIN last_results r USING (task_id) WHERE coalesce(r.summary, '') = ''"),
    "rejected_fields": sql("SELECT task_id, 'children' AS field, source FROM results WHERE length(task_id) % 7 = 0"),
    "quality_codes": f"""
        WITH l AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) AS n, ls FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS ls FROM documents)),
        s AS (SELECT doc_id, n, coalesce(CASE WHEN n > 1 THEN ls[n - 1] END, '') AS heading, n = 1 AS is_root, CASE n % 8
            WHEN 0 THEN text WHEN 1 THEN 'This section describes ' || text WHEN 2 THEN 'Documentation covering ' || text WHEN 3 THEN 'Information about ' || text
            WHEN 4 THEN 'Redirecting ' || text WHEN 5 THEN 'An overview of the main section.' WHEN 6 THEN coalesce(CASE WHEN n > 1 THEN ls[n - 1] END, '') ELSE 'This document contains information on ' || text END AS summary FROM l)
        SELECT doc_id, n::BIGINT AS n, {code_cases("summary", "heading", "is_root")} AS codes FROM s""",
    "similar_siblings": f"""
        WITH l AS (SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n') AS ls FROM documents)),
        t AS (SELECT doc_id, n, list_distinct({tokens("text")}) AS s FROM l),
        p AS (SELECT a.doc_id, a.n AS a, b.n AS b, CASE WHEN len(a.s) = 0 AND len(b.s) = 0 THEN 1.0 WHEN len(a.s) = 0 OR len(b.s) = 0 THEN 0.0
            ELSE round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) END::DOUBLE AS score FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.n < b.n)
        SELECT doc_id, a::BIGINT AS a, b::BIGINT AS b, score FROM p WHERE score > 0.5""",
    "root_collisions": f"""
        WITH d AS (SELECT doc_id, list_distinct({tokens("coalesce(text, '')")}) AS s FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''),
        w AS (SELECT doc_id, unnest(s) AS w, len(s) AS n FROM d),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 4) AS score FROM w a JOIN w b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2
            UNION ALL SELECT a.doc_id, b.doc_id, 1.0 FROM d a JOIN d b ON a.doc_id < b.doc_id WHERE len(a.s) = 0 AND len(b.s) = 0)
        SELECT b AS doc_id, min(a) AS other, arg_min(score, a)::DOUBLE AS score FROM p WHERE score > 0.9 GROUP BY b""",
    "tree_findings": sql(
        "SELECT file, node_id, code FROM (SELECT file, node_id, 'content_ref_order' AS code FROM broken WHERE line_start > line_end "
        "UNION ALL SELECT b.file, node_id, 'content_ref_out_of_bounds' FROM broken b JOIN typed USING (file) WHERE b.line_end > total "
        "UNION ALL SELECT file, node_id, 'heading_missing' FROM broken WHERE heading IS NULL "
        "UNION ALL SELECT file, NULL, 'overlapping_leaf_ranges' FROM (SELECT b.file, x.n FROM broken b JOIN (SELECT unnest(generate_series(1, 100000)) AS n) x ON x.n BETWEEN b.line_start AND b.line_end JOIN fronts f ON f.file = b.file AND x.n <= f.total WHERE b.line_start IS NOT NULL GROUP BY b.file, x.n HAVING count(*) > 1) "
        "UNION ALL SELECT file, NULL, 'uncovered_substantive_lines' FROM (SELECT DISTINCT l.file FROM lines l JOIN (SELECT DISTINCT file FROM tree) USING (file) LEFT JOIN broken b ON b.file = l.file AND l.n BETWEEN b.line_start AND b.line_end WHERE l.substantive AND l.level = 0 AND b.file IS NULL))"
    ),
    "leaf_build": sql("SELECT file, doc_type, doc_group, tree_index, summary, CASE WHEN doc_type IN ('article', 'report') THEN lang END AS lang, CASE WHEN doc_type = 'article' THEN edition END AS edition, "
        "concat_ws(',', CASE WHEN doc_type = 'article' AND edition IS NULL THEN 'edition' END, CASE WHEN doc_group IS NULL THEN 'doc_group' END) AS null_fields FROM leaves"),
    "routing_rollup": sql("SELECT coalesce(doc_group, 'unknown') AS doc_group, coalesce(lang, 'unknown') AS lang, count(*)::BIGINT AS documents, 2::BIGINT AS level FROM leaves2 GROUP BY ALL UNION ALL SELECT coalesce(doc_group, 'unknown'), NULL, count(*), 1 FROM leaves2 GROUP BY ALL UNION ALL SELECT NULL, NULL, count(*), 0 FROM leaves2"),
    "routing_nodes": sql("SELECT 'root' AS type, '' AS path, count(*)::BIGINT AS documents FROM leaves2 UNION ALL SELECT 'intermediate', coalesce(doc_group, 'unknown'), count(*) FROM leaves2 GROUP BY ALL UNION ALL SELECT 'intermediate', coalesce(doc_group, 'unknown') || '/' || coalesce(lang, 'unknown'), count(*) FROM leaves2 GROUP BY ALL"),
    "unknown_fields": sql("SELECT file, concat_ws(',', CASE WHEN doc_group IS NULL THEN 'doc_group' END, CASE WHEN lang IS NULL THEN 'lang' END) AS unknown_fields, doc_type AS value FROM leaves2"),
    "unknown_groupings": sql("SELECT path, count(*)::BIGINT AS documents, array_to_string(list_sort(list(file))[:20], ',') AS files FROM (SELECT file, 'unknown' AS path FROM leaves2 WHERE doc_group IS NULL UNION ALL SELECT file, coalesce(doc_group, 'unknown') || '/unknown' FROM leaves2 WHERE lang IS NULL) GROUP BY path"),
    "remove_prune": sql("SELECT coalesce(doc_group, 'unknown') AS doc_group, count(*)::BIGINT AS documents FROM leaves WHERE doc_type <> 'web' AND doc_type <> 'report' GROUP BY ALL"),
    "alias_upsert": sql("SELECT coalesce(n.from_file, o.from_file) AS from_file, coalesce(n.to_file, o.to_file) AS to_file FROM (SELECT file AS from_file, arg_min(resolved, line * 1000 + idx) AS to_file FROM resolved GROUP BY file) o FULL JOIN (SELECT file AS from_file, file || '.new' AS to_file FROM vault WHERE length(file) % 3 = 0) n USING (from_file)"),
    "sync_diff": sql(
        "SELECT coalesce(c.file, l.file) AS file, CASE WHEN c.file IS NULL THEN 'remove' WHEN l.file IS NULL AND classification = 'substantive' THEN 'ingest' WHEN l.file IS NULL THEN 'exclude' WHEN classification <> 'substantive' THEN 'remove' WHEN kind = 1 THEN 'modify' WHEN kind = 2 THEN 'unchanged' WHEN kind = 3 THEN 'modify' ELSE 'unchanged' END AS action, "
        "CASE WHEN l.file IS NULL OR c.file IS NULL OR kind = 1 THEN NULL WHEN kind = 2 THEN 'unknown' WHEN kind = 3 THEN 'stale' ELSE 'current' END AS staleness FROM typed c FULL JOIN synced l USING (file)"
    ),
    "sync_totals": sql(
        "SELECT count(c.file)::BIGINT AS on_disk, count(l.file)::BIGINT AS indexed, count(*) FILTER (c.file IS NOT NULL AND l.file IS NULL AND classification = 'substantive')::BIGINT AS to_ingest, count(*) FILTER (c.file IS NOT NULL AND l.file IS NOT NULL AND classification = 'substantive' AND kind IN (1, 3))::BIGINT AS to_modify, "
        "count(*) FILTER (c.file IS NULL OR (l.file IS NOT NULL AND classification <> 'substantive'))::BIGINT AS to_remove, count(*) FILTER (c.file IS NOT NULL AND l.file IS NOT NULL AND classification = 'substantive' AND kind NOT IN (1, 3))::BIGINT AS unchanged, count(*) FILTER (c.file IS NOT NULL AND l.file IS NULL AND classification <> 'substantive')::BIGINT AS excluded FROM typed c FULL JOIN synced l USING (file)"
    ),
    "rebuild": sql("SELECT file, doc_type, doc_group, tree_index, coalesce(summary, CASE WHEN last_line % 2 = 0 THEN 'recovered' END) AS summary FROM leaves WHERE coalesce(summary, CASE WHEN last_line % 2 = 0 THEN 'recovered' END) IS NOT NULL"),
    "schema_diff": sql("SELECT file, CASE doc_type WHEN 'article' THEN '' WHEN 'report' THEN 'region' ELSE '' END AS missing, CASE doc_type WHEN 'article' THEN '' WHEN 'report' THEN 'edition' ELSE 'edition,lang' END AS obsolete FROM leaves"),
    "migrate": sql("SELECT file, CASE WHEN doc_type = 'article' THEN coalesce(edition, 'null') || '|' || coalesce(lang, 'null') WHEN doc_type = 'report' THEN coalesce(lang, 'null') || '|null' ELSE '' END AS ext FROM leaves"),
    "doctor_counts": sql("SELECT 'doc_group' AS kind, coalesce(doc_group, 'unknown') AS value, count(*)::BIGINT AS documents FROM leaves GROUP BY ALL UNION ALL SELECT 'doc_type', coalesce(doc_type, 'unknown'), count(*) FROM leaves GROUP BY ALL"),
    "null_metadata": sql("SELECT file, fields FROM (SELECT file, concat_ws(',', CASE WHEN doc_group IS NULL THEN 'doc_group' END, CASE WHEN doc_type = 'article' AND edition IS NULL THEN 'edition' END, CASE WHEN doc_type = 'article' AND lang IS NULL THEN 'lang' END, CASE WHEN doc_type = 'report' AND lang IS NULL THEN 'lang' END, CASE WHEN doc_type = 'report' THEN 'region' END) AS fields FROM leaves) WHERE fields <> ''"),
    "orphans_dangling": sql("SELECT 'dangling_leaf' AS code, tree_index, file FROM leaves WHERE last_line % 7 = 1 UNION ALL SELECT 'orphaned_tree', tree_index, NULL FROM leaves WHERE last_line % 7 = 0"),
    "index_findings": sql("SELECT file, 'leaf_summary_missing' AS code FROM leaves WHERE summary IS NULL UNION ALL SELECT file, 'leaf_tree_index_dangling' FROM leaves WHERE last_line % 7 = 1"),
    "doctor": sql("SELECT severity, code, count(*)::BIGINT AS findings FROM (SELECT 'warn' AS severity, 'null_metadata' AS code FROM leaves WHERE doc_group IS NULL OR (doc_type = 'article' AND (edition IS NULL OR lang IS NULL)) OR doc_type = 'report' UNION ALL SELECT 'error', 'dangling_leaf' FROM leaves WHERE last_line % 7 = 1 UNION ALL SELECT 'warn', 'orphaned_tree' FROM leaves WHERE last_line % 7 = 0 UNION ALL (SELECT DISTINCT 'warn', 'unknown_grouping' FROM leaves WHERE doc_group IS NULL)) GROUP BY ALL"),
    "cross_type_join": sql("SELECT 'language' AS label, lang AS value, count(DISTINCT doc_type)::BIGINT AS types, count(*)::BIGINT AS documents FROM leaves WHERE doc_type IN ('article', 'report', 'brief') AND lang IS NOT NULL GROUP BY lang HAVING count(DISTINCT doc_type) > 1"),
    "cross_refs": sql("SELECT r.file, t.node_id, r.target AS raw, r.resolved AS target, CASE WHEN d.file IS NOT NULL THEN r.resolved ELSE a.to_file END AS resolved_file FROM resolved r JOIN leaf_nodes t ON t.file = r.file AND r.line BETWEEN t.line_start AND t.line_end LEFT JOIN (SELECT file FROM typed WHERE classification = 'substantive' AND doc_type IS NOT NULL) d ON d.file = r.resolved LEFT JOIN known_aliases a ON a.from_file = r.resolved"),
    "routing_candidates": f"""
        WITH l AS (SELECT doc_id, lang || '/doc_' || doc_id || '.md' AS file, list_distinct({tokens("coalesce(text, '') || ' ' || lang || ' doc ' || doc_id || ' md'")}) AS s FROM documents WHERE text IS NOT NULL),
        ql AS (SELECT item_id, list_distinct({tokens("text")}) AS s FROM benchmark), w AS (SELECT file, unnest(s) AS w FROM l), qw AS (SELECT item_id, unnest(s) AS w, len(s) AS n FROM ql),
        h AS (SELECT item_id, file, count(*) / any_value(n) AS score FROM qw JOIN w USING (w) GROUP BY ALL)
        SELECT item_id, file, round(score, 4)::DOUBLE AS score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, file) AS rank FROM h) WHERE rank <= 15""",
    "citations": sql("SELECT file || ' > ' || array_to_string(heading_path, ' > ') || ' > lines ' || line_start || '-' || line_end || CASE WHEN p1 IS NULL AND p2 IS NULL THEN '' WHEN a = b THEN ' > page ' || a ELSE ' > pages ' || a || '-' || b END || CASE WHEN length(file) % 3 = 0 THEN ' > STALE' ELSE '' END AS citation FROM (SELECT *, coalesce(p1, p0) AS a, greatest(coalesce(p1, p0), coalesce(p2, coalesce(p1, p0))) AS b FROM paged)"),
    "staleness": sql("SELECT file, CASE WHEN length(file) % 3 = 0 THEN 'stale' WHEN length(file) % 3 = 1 THEN 'unknown' ELSE 'current' END AS staleness FROM typed WHERE classification = 'substantive' AND doc_type IS NOT NULL"),
    "pdf_assembly": "SELECT conv_id || '.md' AS file, '# ' || conv_id || chr(10) || chr(10) || 'Source PDF: ' || conv_id || '.pdf' || chr(10) || chr(10) || string_agg('<!-- page:' || turn || ' -->' || chr(10) || chr(10) || '## Page ' || turn || chr(10) || chr(10) || " + trim("coalesce(text, '')") + ", chr(10) || chr(10) ORDER BY turn, text) || chr(10) AS content FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id",
}
