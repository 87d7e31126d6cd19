"""Common table expressions the check queries are put together from.

Each fragment names the fragments it needs; ``build`` lists them in order.  The
formulations are set-based (windows, range joins, recursion) where the library
works inside the row, so the two check each other.
"""

from __future__ import annotations

from codeaudit.operators import code, dependencies, injection, rules, secrets, signals
from codeaudit.sources import constants as k
from codeaudit.sources.catalogue import FIX_GUIDANCE, RULES
from codeaudit.sources.snippets import SNIPPETS


def lit(text: str) -> str:
    """A quoted text; possessive loops, which only the library's engine has, become plain ones."""
    return "'" + text.replace(")*+", ")*").replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def text_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def part(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def parts(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def swap(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def strip(text: str) -> str:
    return f"trim({text}, {BLANKS})"


def lstrip(text: str) -> str:
    return f"ltrim({text}, {BLANKS})"


def newlines(text: str) -> str:
    return f"(length({text}) - length(replace({text}, chr(10), '')))"


def entropy(text: str) -> str:
    return (
        f"(CASE WHEN length({text}) = 0 THEN 0.0 ELSE round(-list_sum(list_transform("
        f"list_distinct(string_split({text}, '')), lambda ch: "
        f"(len(list_filter(string_split({text}, ''), lambda x: x = ch)) / length({text})::DOUBLE) * "
        f"log2(len(list_filter(string_split({text}, ''), lambda x: x = ch)) / length({text})::DOUBLE)"
        f")), 6) END)"
    )


def version(text: str) -> str:
    head = part(strip(text), r"^\d+(\.\d+){0,2}")
    return (
        f"(CASE WHEN {head} = '' THEN [0::BIGINT] ELSE "
        f"list_transform(string_split({head}, '.'), lambda v: v::BIGINT) END)"
    )


N = len(SNIPPETS)


def _snippets() -> str:
    rows = ",\n".join(
        f"({i}, {lit(d)}, {lit(n)}, {lit(m)}, {lit(c)})" for i, (d, n, m, c) in enumerate(SNIPPETS)
    )
    return f"SELECT * FROM (VALUES {rows}) t(snippet_id, dir, name, mode, head)"


def _language(name: str, ext: str) -> str:
    whens = " ".join(
        f"WHEN {ext} = {lit(e)} THEN {lit(v)}" for e, v in k.LANGUAGE_BY_EXTENSION.items()
    )
    return f"CASE WHEN {name} = 'Dockerfile' THEN 'dockerfile' {whens} ELSE '' END"


def _files() -> str:
    def commented(mark):
        return f"head || '{mark}' || replace(text, chr(10), chr(10) || '{mark}')"

    quoted = swap(
        "replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')",
        r"[\x00-\x1f]", " ",
    )
    return f"""
    SELECT file_id, repo_id, root, root || '/' || rel_path AS path, rel_path, file_name,
           regexp_extract(file_name, '^.+(\\.[^.]+)$', 1) AS ext,
           {_language("file_name", part("file_name", "^.+([.][^.]+)$", 1))} AS language, content
    FROM (
      SELECT d.doc_id AS file_id, d.source AS repo_id,
             d.source || '/p' || CAST(d.doc_id // {20 * N} AS VARCHAR) AS root,
             s.dir || s.name AS rel_path, s.name AS file_name,
             CASE WHEN text = '' OR substr(md5(text), 1, 1) IN ('0', '4', '8', 'c') THEN text ELSE
             CASE mode WHEN 'hash' THEN {commented('# ')}
                       WHEN 'slash' THEN {commented('// ')}
                       WHEN 'dash' THEN {commented('-- ')}
                       WHEN 'json' THEN replace(head, '@TEXT@', {quoted})
                       ELSE head || text END END AS content
      FROM (SELECT doc_id, source, coalesce(text, '') AS text FROM documents) d
      JOIN snippets s ON ((d.doc_id % {N}) + {N}) % {N} = s.snippet_id)
    """


def _skipped(path: str) -> str:
    pieces = f"string_split({path}, '/')"
    return (
        f"(list_has_any({pieces}, {text_list(k.SKIP_DIRS)}) OR "
        f"len(list_filter({pieces}, lambda p: ends_with(p, '{k.SKIP_DIR_SUFFIX}'))) > 0)"
    )


def _source() -> str:
    return f"""
    SELECT * FROM files
    WHERE (ext IN {in_list(k.SOURCE_EXTENSIONS)} OR file_name = 'Dockerfile')
      AND NOT {_skipped('rel_path')}
    """


_SPLIT = r"\r\n|\n|\r"


def split_lines(content: str) -> str:
    body = swap(content, r"(\r\n|\n|\r)\z", "")
    return f"(CASE WHEN {content} = '' THEN []::VARCHAR[] ELSE string_split_regex({body}, {lit(_SPLIT)}) END)"


def _coded() -> str:
    py = "language = 'python'"
    start = lstrip("m")
    blank_py = swap(swap("m", code.PY_COMMENT, r"\1"), code.PY_STRING, '""')
    blank_js = swap(swap("m", code.JS_COMMENT, r"\1"), code.JS_STRING, '""')
    masked = (
        "array_to_string(list_transform(string_split_regex(content, '\"\"\"|'''''''), "
        "lambda s, i: CASE WHEN i % 2 = 0 THEN chr(2) || "
        "regexp_replace(s, '[^\\r\\n]', ' ', 'g') || chr(3) ELSE s END), '')"
    )
    delta_py = "length(translate(b, ')]}' || chr(3), '')) - length(translate(b, '([{' || chr(2), ''))"
    delta_js = "length(translate(b, ')]', '')) - length(translate(b, '([', ''))"
    return f"""
    WITH structured AS (
      SELECT file_id, language, {split_lines('content')} AS raw,
             CASE WHEN {py} THEN {split_lines(masked)} ELSE {split_lines('content')} END AS masked
      FROM source WHERE language IN ('python', 'javascript', 'typescript')),
    numbered AS (
      SELECT file_id, language, unnest(raw) AS raw, unnest(masked[1:len(raw)]) AS m,
             generate_subscripts(raw, 1) AS n FROM structured),
    blanked AS (
      SELECT *, CASE WHEN {py} AND starts_with({start}, '#') THEN ''
                     WHEN NOT {py} AND starts_with({start}, '//') THEN ''
                     WHEN {py} THEN {blank_py} ELSE {blank_js} END AS b FROM numbered),
    measured AS (
      SELECT *, length(m) - length(ltrim(m, ' ' || chr(9))) AS indent,
             CASE WHEN {py} THEN {delta_py} ELSE {delta_js} END AS delta,
             coalesce(CASE WHEN {py} THEN {has('m', code.PY_HEADER)}
                  ELSE regexp_matches(lag(b) OVER (PARTITION BY file_id ORDER BY n),
                                      {lit(code.JS_BLOCK_OPENER)}) END, false) AS seg,
             {strip('b')} <> '' AS sig FROM blanked),
    segmented AS (
      SELECT *, sum(seg::INT) OVER (PARTITION BY file_id ORDER BY n) AS sid FROM measured),
    summed AS (
      SELECT *, sum(delta) OVER (PARTITION BY file_id, sid ORDER BY n) AS total FROM segmented),
    floored AS (
      SELECT *, total - least(min(total) OVER (PARTITION BY file_id, sid ORDER BY n), 0) AS depth
      FROM summed),
    started AS (
      SELECT *, coalesce(lag(depth) OVER (PARTITION BY file_id, sid ORDER BY n), 0) = 0 AS starts
      FROM floored),
    grouped AS (
      SELECT *, sum(starts::INT) OVER (PARTITION BY file_id ORDER BY n) AS stmt FROM started)
    SELECT file_id, language, n, raw, m, b, indent, seg, sig, stmt, starts,
           CASE WHEN starts THEN max(n) OVER (PARTITION BY file_id, stmt) ELSE 0 END AS stmt_end
    FROM grouped
    """


def _statements() -> str:
    resolve = (
        "list_reduce([text] || aliases, lambda acc, e: CASE WHEN contains(acc, "
        "split_part(e, '=', 1) || '.') THEN regexp_replace(acc, '\\b' || split_part(e, '=', 1) || "
        "'\\.', split_part(e, '=', 2) || '.', 'g') ELSE acc END)"
    )
    return f"""
    WITH logical AS (
      SELECT file_id, language, min(n) AS n, max(n) AS e, arg_min(indent, n) AS indent,
             arg_min(sig, n) AS sig, string_agg(raw, chr(10) ORDER BY n) AS text
      FROM coded GROUP BY file_id, language, stmt),
    physical AS (
      SELECT file_id, language, unnest({split_lines('content')}) AS text,
             generate_subscripts({split_lines('content')}, 1) AS n
      FROM source WHERE language NOT IN ('python', 'javascript', 'typescript')),
    every AS (
      SELECT file_id, language, n, e, indent, text FROM logical WHERE sig
      UNION ALL
      SELECT file_id, language, n, n AS e,
             length(text) - length(ltrim(text, ' ' || chr(9))) AS indent, text
      FROM physical WHERE {strip('text')} <> '')
    SELECT file_id, language, n, e, indent, text AS plain,
           CASE WHEN aliases IS NULL THEN text ELSE {resolve} END AS text,
           row_number() OVER (PARTITION BY file_id ORDER BY n) AS idx
    FROM every LEFT JOIN (
      SELECT file_id, list(short || '=' || full_name ORDER BY n) AS aliases
      FROM aliases GROUP BY file_id) USING (file_id)
    """


def _aliases() -> str:
    return f"""
    SELECT file_id, n, {part('raw', code.IMPORT_ALIAS, 2)} AS short,
           {part('raw', code.IMPORT_ALIAS, 1)} AS full_name
    FROM coded WHERE language = 'python' AND contains(raw, 'import ') AND contains(raw, ' as ')
      AND {has('raw', code.IMPORT_ALIAS)}
    """


def _variants() -> str:
    """Statements with imported names written out; the latest binding that holds decides."""
    text = f"replace({swap('text', '#[^' + chr(92) + 'n]*', '')}, chr(92), '')"
    return f"""
    WITH imports AS (
      SELECT file_id, n, indent, {text} AS t FROM statements
      WHERE language = 'python' AND contains(text, 'import ') AND {has('text', r'^\s*(?:from|import)\s')}),
    pieces AS (
      SELECT file_id, n, indent, {part('t', code.FROM_IMPORT, 1)} AS module,
             unnest(string_split({part('t', code.FROM_IMPORT, 2)}, ',')) AS item
      FROM imports WHERE {has('t', code.FROM_IMPORT)}
      UNION ALL
      SELECT file_id, n, indent, '', unnest(string_split({part('t', code.PLAIN_IMPORT, 1)}, ','))
      FROM imports WHERE NOT {has('t', code.FROM_IMPORT)}),
    bound AS (
      SELECT file_id, n, indent, coalesce(nullif({part('item', code.FROM_ITEM, 2)}, ''), {part('item', code.FROM_ITEM, 1)}) AS name,
             module || '.' || {part('item', code.FROM_ITEM, 1)} AS full_name
      FROM pieces WHERE module <> '' AND {has('item', code.FROM_ITEM)}
      UNION ALL
      SELECT file_id, n, indent, {part('item', code.AS_ITEM, 2)}, {part('item', code.AS_ITEM, 1)}
      FROM pieces WHERE module = '' AND {has('item', code.AS_ITEM)}),
    rebound AS (
      SELECT file_id, n, indent, {part('text', code.DEFINED, 1)} || {part('text', code.ASSIGNED, 1)} AS name
      FROM statements WHERE language = 'python'),
    every AS (
      SELECT * FROM bound UNION ALL
      SELECT r.file_id, r.n, r.indent, r.name, NULL FROM rebound r
      WHERE EXISTS (SELECT 1 FROM bound b WHERE b.file_id = r.file_id AND b.name = r.name)),
    held AS (
      SELECT e.*, CASE WHEN e.indent = 0 THEN 1 << 30 ELSE coalesce((
        SELECT min(x.n) - 1 FROM statements x
        WHERE x.file_id = e.file_id AND x.n > e.n AND x.indent < e.indent), 1 << 30) END AS last
      FROM every e),
    decided AS (
      SELECT s.file_id, s.n, h.name, max_by(coalesce(h.full_name, ''), [h.n, (h.full_name IS NOT NULL)::INT]) AS full_name
      FROM statements s JOIN held h ON h.file_id = s.file_id AND s.n <= h.last
        AND (h.n < s.n OR h.n = s.n AND h.full_name IS NULL)
      WHERE contains(s.text, h.name) GROUP BY s.file_id, s.n, h.name),
    listed AS (
      SELECT file_id, n, list(name || '=' || full_name ORDER BY name) AS names
      FROM decided WHERE full_name <> '' GROUP BY file_id, n)
    SELECT * FROM (
      SELECT s.file_id, s.language, s.n, s.text AS own, list_reduce([s.text] || names, lambda acc, e:
        regexp_replace(acc, '(^|[^\\w.])' || split_part(e, '=', 1) || '\\b', '\\1' || split_part(e, '=', 2), 'g')) AS text
      FROM statements s JOIN listed USING (file_id, n))
    WHERE text <> own
    """


def _blocks() -> str:
    header = code.DEF_LINE
    return f"""
    WITH py AS (SELECT * FROM coded WHERE language = 'python' AND sig),
    defs AS (
      SELECT file_id, n AS line, indent,
             CASE WHEN {part('m', header, 1)} <> '' THEN 'async ' ELSE '' END
               || {part('m', header, 2)} AS kind,
             {part('m', header, 3)} AS name
      FROM py WHERE seg AND {has('m', header)}),
    nexts AS (
      SELECT d.file_id, d.line, min(l.n) AS nxt
      FROM defs d LEFT JOIN py l ON l.file_id = d.file_id AND l.n > d.line
           AND l.indent <= d.indent AND NOT regexp_matches({lstrip('l.m')}, '^[)\\]}}\\x03]')
      GROUP BY 1, 2),
    ends AS (
      SELECT x.file_id, x.line, max(l.n) AS "end"
      FROM nexts x JOIN py l ON l.file_id = x.file_id AND l.n >= x.line
           AND (x.nxt IS NULL OR l.n < x.nxt) GROUP BY 1, 2),
    spans AS (SELECT d.*, e."end" FROM defs d JOIN ends e USING (file_id, line))
    SELECT s.file_id, s.line, s."end", s.indent, s.kind, s.name,
           coalesce(max(p.line), 0) AS parent_line,
           coalesce(arg_max(p.kind, p.line), '') AS parent_kind
    FROM spans s LEFT JOIN spans p
      ON p.file_id = s.file_id AND p.line < s.line AND p."end" >= s.line
    GROUP BY ALL
    """


def _functions() -> str:
    doc_chars = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || 'rRuU\"'''"
    return f"""
    WITH f AS (SELECT * FROM blocks WHERE kind <> 'class'),
    heads AS (
      SELECT f.file_id, f.line, coalesce(min(l.n), any_value(f."end")) AS header_end
      FROM f LEFT JOIN coded l ON l.file_id = f.file_id AND l.n BETWEEN f.line AND f."end"
           AND l.sig AND ends_with({strip('l.b')}, ':') GROUP BY 1, 2),
    firsts AS (
      SELECT f.file_id, f.line, min(l.n) AS first_n
      FROM f JOIN heads h USING (file_id, line)
      JOIN coded l ON l.file_id = f.file_id AND l.n > h.header_end AND l.n <= f."end" AND l.sig
      GROUP BY 1, 2),
    based AS (
      SELECT f.*, h.header_end, x.first_n, c.m AS first_m, c.indent AS first_indent,
             c.stmt_end AS first_end
      FROM f JOIN heads h USING (file_id, line) LEFT JOIN firsts x USING (file_id, line)
      LEFT JOIN coded c ON c.file_id = f.file_id AND c.n = x.first_n),
    docs AS (
      SELECT b.file_id, b.line, count(*) AS doc_lines
      FROM based b JOIN coded l ON l.file_id = b.file_id AND l.n BETWEEN b.first_n AND b.first_end
      WHERE {has('b.first_m', signals.DOC_OPENING)} AND contains(b.first_m, chr(2))
        AND trim(l.raw, {doc_chars}) <> '' GROUP BY 1, 2),
    heading AS (
      SELECT b.file_id, b.line, string_agg(l.b, chr(10) ORDER BY l.n) AS header
      FROM based b JOIN coded l ON l.file_id = b.file_id AND l.n BETWEEN b.line AND b.header_end
      GROUP BY 1, 2)
    SELECT b.*, coalesce({has('b.first_m', signals.DOC_OPENING)}, false) AS has_doc,
           coalesce(d.doc_lines, 0) AS doc_lines, b."end" - b.first_n + 1 AS body_span,
           h.header
    FROM based b LEFT JOIN docs d USING (file_id, line) JOIN heading h USING (file_id, line)
    """


def _direct() -> str:
    return f"""
    SELECT f.file_id, f.line, l.n, l.b,
           row_number() OVER (PARTITION BY f.file_id, f.line ORDER BY l.n) AS pos,
           row_number() OVER (PARTITION BY f.file_id, f.line ORDER BY l.n DESC) AS back,
           count(*) OVER (PARTITION BY f.file_id, f.line) AS total
    FROM functions f JOIN coded l ON l.file_id = f.file_id AND l.n > f.header_end
      AND l.n <= f."end" AND l.sig AND l.stmt_end > 0 AND l.indent = f.first_indent
    WHERE NOT {has('l.m', signals.CONTINUATION)}
    """


def _params() -> str:
    text = part("header", signals.PARAMETERS, 1)
    brackets = f"length({text}) - length(translate({text}, '([{{', ''))"
    inner = swap("a", r"\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}", "")
    text = f"list_reduce([{text}] || list_transform(range({brackets}), lambda i: ''), lambda a, b: {inner})"
    return f"""
    WITH items AS (
      SELECT file_id, line, list_transform(string_split({text}, ','), lambda p: {strip('p')}) AS items
      FROM functions),
    cut AS (
      SELECT file_id, line, items,
             coalesce(list_position(list_transform(items, lambda p: starts_with(p, '*')), true), 0) AS star
      FROM items),
    kept AS (
      SELECT file_id, line, CASE WHEN star > 0 THEN items[1:star - 1] ELSE items END AS items FROM cut)
    SELECT file_id, line, list_filter(items, lambda p: {has('p', r'^[A-Za-z_]\w*')}
             AND {part('p', r'^\w+')} NOT IN ('self', 'cls')) AS params
    FROM kept
    """


def _feature(name: str, select: str) -> str:
    return f"SELECT s.file_id, coalesce(x.v, 0) AS {name} FROM source s LEFT JOIN ({select}) x USING (file_id)"


def _f_restating() -> str:
    words = "list_distinct(list_transform(" + parts("{}", k.IDENTIFIER) + ", lambda t: lower(t)))"
    comment = f"starts_with({lstrip('raw')}, '#')"
    return f"""
    WITH l AS (
      SELECT file_id, n, raw, {comment} AS is_comment, {strip('raw')} AS body FROM lines),
    c AS (SELECT * FROM l WHERE is_comment AND {has('raw', r'^\s*#+\s*[^#\s]\S*(\s+\S+){5}')}),
    near AS (
      SELECT c.file_id, c.n, c.raw, x.raw AS code,
             row_number() OVER (PARTITION BY c.file_id, c.n ORDER BY x.n) AS pos
      FROM c JOIN l x ON x.file_id = c.file_id AND x.n BETWEEN c.n - 3 AND c.n + 3
      WHERE x.body <> '' AND NOT x.is_comment),
    joined AS (
      SELECT file_id, n, any_value(raw) AS raw, string_agg(code, chr(10) ORDER BY pos) AS code
      FROM near WHERE pos <= 3 GROUP BY 1, 2)
    {_feature('f_restating', f'''SELECT file_id, count(*) AS v FROM joined
      WHERE len(list_intersect({words.format("raw")}, {words.format("code")})) >= 3 GROUP BY 1''')}
    """


def _f_stock() -> str:
    target = (
        f"CASE WHEN {has('text', signals.COMPOUND_WORD)} THEN '' "
        f"WHEN {has('text', signals.ASSIGN_TARGETS)} THEN {part('text', signals.ASSIGN_TARGETS, 1)} "
        f"ELSE {part('text', signals.ANNOTATED_ONLY, 1)} END"
    )
    inner = f"""
      SELECT file_id, sum(len(list_filter(string_split_regex({target}, '\\s*,\\s*'),
             lambda t: list_contains({text_list(k.STOCK_NAMES)}, t))))::BIGINT AS v
      FROM statements WHERE language = 'python' GROUP BY 1"""
    return _feature("f_stock", inner)


def _f_variation() -> str:
    return """
    WITH spans AS (SELECT file_id, "end" - line + 1 AS n FROM functions WHERE "end" - line + 1 > 3)
    SELECT s.file_id, x.v AS f_variation FROM source s LEFT JOIN (
      SELECT file_id, round(stddev_pop(n) / avg(n), 6) AS v FROM spans
      GROUP BY 1 HAVING count(*) >= 3) x USING (file_id)
    """


def _f_documented() -> str:
    return """
    SELECT s.file_id, x.v AS f_documented FROM source s LEFT JOIN (
      SELECT file_id, round(avg(has_doc::INT), 6) AS v FROM functions
      WHERE NOT starts_with(name, '_') AND "end" - line + 1 > 5
      GROUP BY 1 HAVING count(*) >= 2) x USING (file_id)
    """


def _f_assign_return() -> str:
    names = parts("coalesce(e.text, '')", r"(?:^|[^.\w])([A-Za-z_]\w*)", 1)
    return f"""
    WITH pair AS (
      SELECT f.file_id, f.line, f.header_end, a.n AS assign_n,
             {part('a.b', signals.NAME_ASSIGN, 1)} AS name,
             {part('r.b', signals.RETURN_NAME, 1)} AS returned
      FROM functions f
      JOIN direct r ON r.file_id = f.file_id AND r.line = f.line AND r.back = 1
      JOIN direct a ON a.file_id = f.file_id AND a.line = f.line AND a.back = 2
      WHERE f.kind = 'def'),
    earlier AS (
      SELECT p.file_id, p.line, string_agg(l.b, chr(10) ORDER BY l.n) AS text
      FROM pair p JOIN coded l ON l.file_id = p.file_id AND l.n > p.header_end
           AND l.n < p.assign_n AND l.sig GROUP BY 1, 2)
    {_feature('f_assign_return', f'''SELECT p.file_id, count(*) AS v
      FROM pair p LEFT JOIN earlier e USING (file_id, line)
      WHERE name <> '' AND name = returned AND NOT list_contains({names}, name) GROUP BY 1''')}
    """


def _f_guards() -> str:
    return f"""
    WITH sized AS (
      SELECT f.file_id, f.line, f.header_end, f."end",
             list_transform(p.params, lambda x: {part('x', r'^[A-Za-z0-9_]+')}) AS params,
             greatest(1, (coalesce(d.total, 0) + 1) // 2) AS half
      FROM functions f JOIN params p USING (file_id, line)
      LEFT JOIN (SELECT file_id, line, max(total) AS total FROM direct GROUP BY 1, 2) d
        USING (file_id, line)
      WHERE f.kind = 'def'),
    stops AS (
      SELECT s.*, coalesce(d.n, s."end" + 1) AS stop
      FROM sized s LEFT JOIN direct d
        ON d.file_id = s.file_id AND d.line = s.line AND d.pos = s.half + 1),
    texts AS (
      SELECT s.file_id, s.line, any_value(s.params) AS params,
             string_agg(l.b, chr(10) ORDER BY l.n) AS text
      FROM stops s JOIN coded l ON l.file_id = s.file_id AND l.n > s.header_end AND l.n < s.stop
           AND l.n <= s."end"
      GROUP BY 1, 2),
    shared AS (
      SELECT *, len(list_intersect(list_distinct(params),
                {parts('text', signals.ISINSTANCE_CALL, 1)})) AS hits FROM texts)
    {_feature('f_guards', '''SELECT file_id, count(*) AS v FROM shared
      WHERE len(params) >= 2 AND hits > 0 AND hits * 2 >= len(params) GROUP BY 1''')}
    """


def _f_gets() -> str:
    return f"""
    WITH texts AS (
      SELECT f.file_id, f.line, string_agg(l.b, chr(10) ORDER BY l.n) AS text
      FROM functions f JOIN coded l ON l.file_id = f.file_id AND l.n BETWEEN f.line AND f."end"
      WHERE f.kind = 'def' GROUP BY 1, 2),
    calls AS (SELECT file_id, line, text, unnest({parts('text', signals.GET_CALL, 1)}) AS name FROM texts),
    counted AS (SELECT file_id, line, any_value(text) AS text, name, count(*) AS n FROM calls GROUP BY 1, 2, 4)
    {_feature('f_gets', f'''SELECT file_id, count(DISTINCT line) AS v FROM counted
      WHERE n >= 3 AND NOT list_contains({parts("text", signals.SUBSCRIPT, 1)}, name) GROUP BY 1''')}
    """


def _f_annotated() -> str:
    annotated, plain = has("l.b", signals.ANNOTATED_ASSIGN), has("l.b", signals.PLAIN_ASSIGN)
    return f"""
    WITH counted AS (
      SELECT f.file_id, f.line, count_if({annotated}) AS a, count_if({plain} AND NOT {annotated}) AS p
      FROM functions f JOIN coded l ON l.file_id = f.file_id AND l.n > f.header_end
           AND l.n <= f."end" AND l.stmt_end > 0 AND l.sig
      WHERE f.kind = 'def' AND NOT {has('l.b', signals.COMPOUND_WORD)} GROUP BY 1, 2)
    {_feature('f_annotated', f'''SELECT c.file_id, count(*) AS v FROM counted c JOIN params p USING (file_id, line)
      WHERE len(p.params) >= 2 AND c.a > 0.60 * (c.a + c.p)
        AND len(list_filter(p.params, lambda x: NOT {has("x", r"^[A-Za-z0-9_]+\s*:")})) = 0 GROUP BY 1''')}
    """


def _s_uniform() -> str:
    return """
    WITH classes AS (SELECT file_id, line FROM blocks WHERE kind = 'class'),
    counts AS (
      SELECT c.file_id, c.line, count(b.line) AS n
      FROM classes c LEFT JOIN blocks b ON b.file_id = c.file_id AND b.parent_line = c.line
           AND b.kind = 'def' GROUP BY 1, 2)
    SELECT s.file_id, coalesce(x.v, 0.0) AS s_uniform FROM source s LEFT JOIN (
      SELECT file_id, CASE WHEN count(*) > 1 AND max(n) - min(n) <= 1 THEN 0.25 ELSE 0.0 END AS v
      FROM counts GROUP BY 1) x USING (file_id)
    """


def _t_swallowed() -> str:
    return f"""
    SELECT s.file_id, coalesce(x.v, 0.0) AS t_swallowed FROM source s LEFT JOIN (
      SELECT file_id, CASE WHEN {has("string_agg(m, chr(10) ORDER BY n)", k.SWALLOWED_EXCEPTION)}
             THEN 0.25 ELSE 0.0 END AS v
      FROM coded WHERE language = 'python' GROUP BY 1) x USING (file_id)
    """


def _text_features() -> str:
    density = (
        "(SELECT count(*) FROM lines l WHERE l.file_id = s.file_id AND "
        f"starts_with({lstrip('l.raw')}, '#')) / greatest((SELECT count(*) FROM lines l "
        "WHERE l.file_id = s.file_id), 1)"
    )
    return f"""
    SELECT file_id,
      CASE WHEN {has('content', k.SECTION_HEADING)} THEN 0.25 ELSE 0.0 END AS c_headings,
      CASE WHEN {has('content', k.PARAMETER_UNDERLINE)} THEN 0.20 ELSE 0.0 END AS c_underline,
      CASE WHEN {has('content', k.FEATURE_TODO)} THEN 0.20 ELSE 0.0 END AS c_todo,
      CASE WHEN {density} > 0.33 THEN 0.10 ELSE 0.0 END AS c_density,
      CASE WHEN language = 'python' AND list_has_any({parts('content', k.STAR_IMPORT, 1)},
           {parts('content', k.NAMED_IMPORT, 1)}) THEN 0.15 ELSE 0.0 END AS t_double_import,
      {strip('content')} = '' AS is_blank
    FROM source s
    """


def _parts_of_score() -> str:
    def capped(col, weight, limit):
        return f"round(least({col} * {weight}::DOUBLE, {limit}::DOUBLE), 4)"

    return f"""
    SELECT s.file_id, s.repo_id, s.path, is_blank, c_headings, c_underline, c_todo, c_density,
      {capped('f_restating', 0.05, 0.15)} AS c_restating,
      {capped('f_long_doc', 0.08, 0.15)} AS c_long_doc,
      CASE WHEN f_variation < 0.30 THEN 0.30 WHEN f_variation < 0.60 THEN 0.15 ELSE 0.0 END AS s_regularity,
      round(least(f_stock / 5.0, 1.0) * 0.25, 4) AS s_stock, s_uniform,
      CASE WHEN f_documented >= 0.80 THEN 0.20 ELSE 0.0 END AS s_documented,
      t_swallowed, {capped('f_assign_return', 0.15, 0.20)} AS t_assign_return,
      {capped('f_guards', 0.15, 0.20)} AS t_guards, t_double_import,
      CASE WHEN f_gets > 0 THEN 0.10 ELSE 0.0 END AS t_gets,
      {capped('f_annotated', 0.05, 0.10)} AS t_annotated
    FROM source s JOIN text_features USING (file_id) JOIN f_restating USING (file_id)
    JOIN f_long_doc USING (file_id) JOIN f_variation USING (file_id) JOIN f_stock USING (file_id)
    JOIN s_uniform USING (file_id) JOIN f_documented USING (file_id) JOIN t_swallowed USING (file_id)
    JOIN f_assign_return USING (file_id) JOIN f_guards USING (file_id) JOIN f_gets USING (file_id)
    JOIN f_annotated USING (file_id)
    """


def _detector() -> str:
    return f"""
    WITH sums AS (
      SELECT file_id, repo_id, path,
        CASE WHEN is_blank THEN 0.0 ELSE round(least(1.0::DOUBLE, c_headings + c_underline + c_restating + c_todo
             + c_long_doc + c_density), 4) END AS comments,
        round(least(1.0::DOUBLE, s_regularity + s_stock + s_uniform + s_documented), 4) AS structure,
        round(least(1.0::DOUBLE, t_swallowed + t_assign_return + t_guards + t_double_import + t_gets
             + t_annotated), 4) AS tokens
      FROM score_parts),
    weighed AS (
      SELECT *, round(least(1.0::DOUBLE, 0.30 * comments + 0.35 * structure + 0.35 * tokens), 4) AS confidence
      FROM sums)
    SELECT *, CASE WHEN confidence >= {k.AI_THRESHOLD} THEN 'FULL'
                   WHEN confidence >= {k.MEDIUM_THRESHOLD} THEN 'MEDIUM'
                   ELSE 'CRITICAL_ONLY' END AS scan_tier,
           confidence >= {k.AI_THRESHOLD} AS is_ai
    FROM weighed
    """


# --- rules ------------------------------------------------------------------------


def _rules() -> str:
    rows = ",\n".join(
        "(" + ", ".join(
            [lit(r.rule_id), lit(r.pack), text_list(r.languages), lit(r.severity), lit(r.category),
             lit(r.cwe), lit(r.scope), text_list(r.tier_names), lit(rules.effective_pattern(r)),
             lit(r.message), lit(FIX_GUIDANCE[r.category])]
        ) + ")"
        for r in RULES
    )
    return (
        f"SELECT * FROM (VALUES {rows}) t(rule_id, pack, languages, severity, category, cwe, scope, "
        "tiers, pos_regex, message, fix_guidance)"
    )


def _rule_matches() -> str:
    def languages(r):
        return f"language IN {in_list(r.languages)}"

    cases = []
    for r in RULES:
        if r.scope != "L":
            continue
        cond = f"{languages(r)} AND {has('text', rules.effective_pattern(r))}"
        if r.negative:
            cond += f" AND NOT {has('text', '(?s)' + r.negative)}"
        if r.rule_id == "python-log-injection":
            cond += (
                f" AND len(list_filter({parts('text', rules.PLACED_VALUE, 1)}, "
                f"lambda v: NOT {has('v', rules.CONSTANT_NAME)})) > 0"
            )
        cases.append(f"CASE WHEN {cond} THEN {lit(r.rule_id)} END")
    def hits(table):
        return (
            "SELECT file_id, rule_id, n, text FROM (SELECT file_id, n, text, unnest(list_filter(["
            + ",\n".join(cases) + f"], lambda x: x IS NOT NULL)) AS rule_id FROM {table})"
        )

    out = [
        hits("statements"),
        f"SELECT * FROM ({hits('variants')}) v WHERE NOT EXISTS (SELECT 1 FROM ({hits('statements')}) o "
        "WHERE o.file_id = v.file_id AND o.rule_id = v.rule_id AND o.n = v.n)",
    ]
    for r in RULES:
        if r.scope != "F":
            continue
        cond = f"{languages(r)} AND {has('text', r.positive)}"
        if r.negative:
            cond += f" AND NOT {has('text', r.negative)}"
        if r.rule_id == "dockerfile-missing-user":
            users = parts("text", r"(?im)^USER\s+(\S+)", 1)
            cond += f" AND len(list_filter({users}, lambda u: lower(u) <> 'root')) = 0"
        out.append(f"SELECT file_id, {lit(r.rule_id)} AS rule_id, 1 AS n, text FROM whole WHERE {cond}")
    names = " || ".join(
        f"{parts('text', p, 1)}"
        for p in (rules.FUNCTION_PARAMETERS, rules.ARROW_PARAMETERS, rules.ARROW_PARAMETER)
    )
    for r in RULES:
        if r.scope != "S":
            continue
        cond = f"{languages(r)} AND {has('piece', rules.effective_pattern(r))}"
        if r.negative:
            cond += f" AND NOT {has('piece', '(?s)' + r.negative)}"
        if r.rule_id == "js-prototype-pollution-unsafe-assign":
            source = part("piece", rules.effective_pattern(r), 1)
            listed = (
                f"list_transform(flatten(list_transform({names}, lambda p: string_split(p, ','))), "
                r"lambda x: regexp_extract(x, '\w+'))"
            )
            cond += f" AND (contains({source}, '.') OR list_contains({listed}, {source}))"
        out.append(
            f"SELECT file_id, {lit(r.rule_id)} AS rule_id, first_line AS n, piece AS text "
            f"FROM pieces WHERE {cond}"
        )
    by_id = {r.rule_id: r for r in RULES}

    def block(rule_id, condition):
        r = by_id[rule_id]
        out.append(
            f"SELECT s.file_id, {lit(rule_id)} AS rule_id, s.n, s.text FROM statements s "
            f"WHERE {languages(r)} AND {has('s.text', rules.effective_pattern(r))} AND {condition(r)}"
        )

    def no_line_before(r):
        return (
            "NOT EXISTS (SELECT 1 FROM coded c WHERE c.file_id = s.file_id AND c.n < s.n AND c.sig "
            f"AND {has('c.m', r.negative)})"
        )

    def outside_guard(r):
        return (
            "(s.indent = 0 OR NOT coalesce((SELECT "
            f"regexp_matches(arg_max(c.m, c.n), {lit(r.negative)}) FROM coded c "
            "WHERE c.file_id = s.file_id AND c.n < s.n AND c.sig AND c.indent = 0 AND c.starts), false))"
        )

    def unowned(r):
        rx = rules.effective_pattern(r)
        return (
            f"{part('s.text', rx, 1)} = {part('s.text', rx, 2)} AND NOT EXISTS (SELECT 1 FROM coded c "
            f"WHERE c.file_id = s.file_id AND c.n < s.n AND c.sig AND {has('c.m', r.negative)} "
            f"AND {part('c.m', rules.OWNER_GUARD, 1)} = {part('s.text', rx, 3)})"
        )

    def unlimited(r):
        run = (
            "SELECT 1 FROM statements d WHERE d.file_id = s.file_id AND d.idx < s.idx "
            "AND d.idx > coalesce((SELECT max(o.idx) FROM statements o WHERE o.file_id = s.file_id "
            "AND o.idx < s.idx AND NOT starts_with(ltrim(o.text, ' ' || chr(9)), '@')), 0)"
        )
        return (
            f"EXISTS ({run} AND {has('d.text', rules.APP_DECORATOR)}) "
            f"AND NOT EXISTS ({run} AND {has('d.text', r.negative)})"
        )

    def racing(r):
        after = (
            "SELECT 1 FROM coded c WHERE c.file_id = s.file_id AND c.n > s.e AND c.sig "
            f"AND {has('c.m', rules.METHOD_CALL)} AND c.n < coalesce((SELECT min(o.n) FROM coded o "
            "WHERE o.file_id = s.file_id AND o.n > s.e AND o.sig AND o.indent <= s.indent), 1e9)"
        )
        enclosing = (
            "SELECT 1 FROM coded w WHERE w.file_id = s.file_id AND w.n < s.n AND w.sig "
            f"AND w.indent < s.indent AND {has('w.m', r.negative)} AND NOT EXISTS (SELECT 1 FROM coded o "
            "WHERE o.file_id = s.file_id AND o.n > w.n AND o.n < s.n AND o.sig AND o.indent <= w.indent)"
        )
        return f"EXISTS ({after}) AND NOT EXISTS ({enclosing})"

    def no_policy(r):
        return (
            "NOT EXISTS (SELECT 1 FROM lines l WHERE l.file_id = s.file_id AND l.n >= s.n "
            f"AND {has('l.raw', r.negative)})"
        )

    def plain_login(r):
        return (
            f"NOT {has('s.text', r.negative)} AND EXISTS (SELECT 1 FROM source f "
            f"WHERE f.file_id = s.file_id AND {has('f.content', rules.CREDENTIAL_ROUTE)})"
        )

    block("python-crlf-injection", no_line_before)
    block(rules.MAIN_GUARD_RULE, outside_guard)
    block("python-idor", unowned)
    block("python-missing-rate-limit", unlimited)
    block("python-race-condition-balance", racing)
    block("sql-missing-rls", no_policy)
    block("python-missing-tls", plain_login)
    return "\nUNION ALL\n".join(out)


def _located(matches: str) -> str:
    return f"""
    WITH split_at AS (
      SELECT h.file_id, f.repo_id, f.path, f.language, h.n, h.text, r.*,
             CASE WHEN r.pos_regex = '' THEN [''] ELSE regexp_extract_all(h.text, r.pos_regex) END AS hits,
             CASE WHEN r.pos_regex = '' THEN [''] ELSE regexp_split_to_array(h.text, r.pos_regex) END AS gaps
      FROM {matches} h JOIN rules r USING (rule_id) JOIN source f USING (file_id)),
    numbered AS (SELECT *, unnest(hits) AS hit, generate_subscripts(hits, 1) AS i FROM split_at),
    -- where a pattern takes the character before a name, the place is that of the name
    led AS (SELECT *, CASE WHEN contains(pos_regex, '(^|[^') AND regexp_matches(hit, '^\\W') THEN hit[1] ELSE '' END AS lead
            FROM numbered),
    found AS (
      SELECT *, {strip('hit[length(lead) + 1:]')} AS matched, array_to_string(list_transform(range(1, i + 1),
             lambda j: gaps[j] || CASE WHEN j < i THEN hits[j] ELSE '' END), '') || lead AS pre FROM led)
    SELECT file_id, repo_id, path, language, rule_id, severity, category, cwe, message, fix_guidance,
           n, text, (n + {newlines('pre')})::BIGINT AS line,
           length(string_split(pre, chr(10))[-1]) + 1 AS col,
           array_to_string(string_split(matched, chr(10))[1:3], chr(10)) AS snippet, tiers, pack
    FROM found
    """


# --- secrets, env, config, dependencies, injection -----------------------------------


def _secret_lines() -> str:
    values = parts("raw", secrets.NAMED_VALUE, 2)
    tokens = parts("raw", secrets.QUOTED_TOKEN, 1)
    return f"""
    SELECT l.file_id, l.n AS line FROM lines l
    WHERE len(list_filter({values}, lambda v: NOT {has('v', k.PLACEHOLDER)})) > 0
       OR len(list_filter({tokens}, lambda t: {entropy('t')} > {k.TOKEN_ENTROPY_LIMIT}
              AND NOT {has('t', k.PLACEHOLDER)})) > 0
    """


def _env_entries() -> str:
    text = strip("raw")
    value = f"trim({strip(part(text, k.ENV_ENTRY, 2))}, '''\"')"
    return f"""
    WITH l AS (
      SELECT repo_id, file_id, path, unnest({split_lines('content')}) AS raw,
             generate_subscripts({split_lines('content')}, 1) AS line
      FROM files WHERE rel_path = file_name AND file_name IN {in_list(k.ENV_FILES)})
    SELECT repo_id, file_id, path, line, {part(text, k.ENV_ENTRY, 1)} AS key, {value} AS value
    FROM l WHERE {has(text, k.ENV_ENTRY)}
    """


def _env_secrets() -> str:
    return f"""
    SELECT * FROM env_entries WHERE value <> '' AND {has('key', k.SECRET_NAME)}
      AND NOT {has('value', k.PLACEHOLDER)}
      AND (length(value) > 20 OR {entropy('value')} > {k.ENTROPY_LIMIT})
    """


def _ignores() -> str:
    return f"""
    WITH l AS (
      SELECT repo_id, root, {strip('raw')} AS text FROM (
        SELECT repo_id, root, unnest({split_lines('content')}) AS raw FROM files
        WHERE rel_path = '.gitignore'))
    SELECT DISTINCT repo_id, root, rtrim(text, '/') AS pattern FROM l
    WHERE text <> '' AND NOT starts_with(text, '#')
    """


def _env_open() -> str:
    return f"""
    SELECT repo_id, root, file_id, path, file_name FROM files f
    WHERE rel_path = file_name AND file_name IN {in_list(k.ENV_FILES)}
      AND NOT EXISTS (SELECT 1 FROM ignores i WHERE i.repo_id = f.repo_id AND i.root = f.root
        AND (i.pattern = f.file_name OR i.pattern IN ('.env*', '*.env')))
    """


def _configs() -> str:
    return f"""
    SELECT * FROM files WHERE rel_path IN {in_list(k.AGENT_CONFIG_PATHS)}
      OR (ends_with(file_name, '.json') AND
          (lower(file_name) LIKE 'mcp%' OR lower(file_name) LIKE '%mcp.json'))
    """


def _config_strings() -> str:
    return "SELECT repo_id, file_id, path, key, v ->> '$' AS value FROM walk WHERE json_type(v) = 'VARCHAR'"


def _walk() -> str:
    return """
    SELECT repo_id, file_id, path, ''::VARCHAR AS key, content::JSON AS v
    FROM configs WHERE json_valid(content)
    UNION ALL
    SELECT repo_id, file_id, path, key, v FROM (
      SELECT w.repo_id, w.file_id, w.path, e.key, e.value AS v
      FROM walk w, json_each(w.v) e WHERE json_type(w.v) = 'OBJECT'
      UNION ALL
      SELECT w.repo_id, w.file_id, w.path, w.key, e.value AS v
      FROM walk w, json_each(w.v) e WHERE json_type(w.v) = 'ARRAY')
    """


def _config_secrets() -> str:
    return f"""
    SELECT *, CASE WHEN length(value) > 6 THEN substr(value, 1, 6) || '...' ELSE '***' END AS masked
    FROM config_strings
    WHERE length(value) >= 8 AND NOT starts_with(value, 'http://')
      AND NOT starts_with(value, 'https://')
      AND ({has('key', k.SECRET_NAME)} OR (length(value) > 15 AND {entropy('value')} > {k.ENTROPY_LIMIT}))
    """


def _config_open() -> str:
    return """
    SELECT repo_id, root, file_id, path, rel_path, file_name FROM configs f
    WHERE NOT EXISTS (SELECT 1 FROM ignores i WHERE i.repo_id = f.repo_id AND i.root = f.root AND (
      i.pattern = f.rel_path OR i.pattern = f.file_name
      OR (ends_with(i.pattern, '/*') AND starts_with(f.rel_path, left(i.pattern, -1)))
      OR starts_with(f.rel_path, i.pattern || '/')
      OR (starts_with(i.pattern, '*') AND ends_with(f.rel_path, substr(i.pattern, 2)))))
    """


def _manifests() -> str:
    eco = " ".join(f"WHEN {lit(n)} THEN {lit(e)}" for n, e in k.DEPENDENCY_FILES.items())
    return f"""
    SELECT *, CASE file_name {eco} END AS ecosystem FROM files
    WHERE rel_path = file_name AND file_name IN {in_list(k.DEPENDENCY_FILES)}
    """


def _requirements() -> str:
    text = strip("raw")
    return f"""
    WITH l AS (
      SELECT repo_id, file_id, path, file_name, ecosystem, unnest({split_lines('content')}) AS raw,
             generate_subscripts({split_lines('content')}, 1) AS line
      FROM manifests WHERE file_name NOT IN ('package.json', 'pyproject.toml'))
    SELECT repo_id, file_id, path, file_name, ecosystem, line,
           {part(text, k.REQUIREMENT, 1)} AS name, {part(text, k.REQUIREMENT, 3)} AS version
    FROM l WHERE NOT starts_with({text}, '#') AND NOT starts_with({text}, '-')
      AND {has(text, k.REQUIREMENT)}
    """


def _package_json() -> str:
    def section(name):
        return f"""
        SELECT m.repo_id, m.file_id, m.path, m.file_name, m.ecosystem, e.key AS name, e.value AS spec
        FROM manifests m, json_each(m.content::JSON, '$.{name}') e
        WHERE m.file_name = 'package.json' AND json_valid(m.content)"""

    return f"""
    WITH entries AS ({section('dependencies')} UNION ALL {section('devDependencies')})
    SELECT repo_id, file_id, path, file_name, ecosystem, 1::BIGINT AS line, name,
           {part("coalesce(spec ->> '$', '')", k.NPM_VERSION, 1)} AS version FROM entries
    """


def _pyproject() -> str:
    listed = part(
        part("content", dependencies.PROJECT_SECTION, 1), dependencies.DEPENDENCY_LIST, 1
    )
    text = strip("substr(q, 2, length(q) - 2)")
    return f"""
    WITH l AS (
      SELECT repo_id, file_id, path, file_name, ecosystem,
             unnest({parts(listed, dependencies.QUOTED)}) AS q,
             generate_subscripts({parts(listed, dependencies.QUOTED)}, 1) AS line
      FROM manifests WHERE file_name = 'pyproject.toml')
    SELECT repo_id, file_id, path, file_name, ecosystem, line,
           {part(text, k.REQUIREMENT, 1)} AS name, {part(text, k.REQUIREMENT, 3)} AS version
    FROM l WHERE {has(text, k.REQUIREMENT)}
    """


def _bad_names() -> str:
    rows = ", ".join(f"({lit(e)}, {lit(n)})" for e, ns in k.BAD_PACKAGES.items() for n in ns)
    return f"SELECT * FROM (VALUES {rows}) t(ecosystem, package)"


def _vulns() -> str:
    rows = ", ".join(
        f"({lit(e)}, {lit(n)}, {lit(s)}, {lit(', '.join(c))}, {lit(v)})"
        for e, n, s, c, v in k.VULNERABILITIES
    )
    return f"SELECT * FROM (VALUES {rows}) t(ecosystem, package, safe_from, advisories, severity)"


def _vulnerable() -> str:
    return f"""
    SELECT d.*, v.safe_from, v.advisories, v.severity FROM deps d JOIN vulns v USING (ecosystem, package)
    WHERE d.version <> '' AND {version('d.version')} < {version('v.safe_from')}
    """


def _unknown() -> str:
    return f"""
    SELECT d.* FROM deps d
    WHERE d.ecosystem IN {in_list(k.REGISTRY_ECOSYSTEMS)}
      AND (d.ecosystem, d.package) NOT IN (SELECT (ecosystem, package) FROM bad_names)
      AND (d.ecosystem, d.package) NOT IN (SELECT (ecosystem, package) FROM deps WHERE version <> '')
    """


def _unlocked() -> str:
    rows = ", ".join(f"({lit(m)}, {lit(x)})" for m, xs in k.LOCK_FILES.items() for x in xs)
    return f"""
    SELECT repo_id, root, file_id, path, file_name FROM files f
    WHERE rel_path = file_name AND file_name IN {in_list(k.LOCK_FILES)}
      AND NOT EXISTS (SELECT 1 FROM files g JOIN (VALUES {rows}) t(manifest, lock)
        ON g.rel_path = t.lock WHERE t.manifest = f.file_name AND g.repo_id = f.repo_id
        AND g.root = f.root)
    """


INJECTION = "(?i)(" + "|".join(k.INJECTION_PATTERNS) + ")"


def _literals() -> str:
    listed = (
        f"CASE WHEN NOT {has('raw', injection.STRING_LITERAL)} AND ext IN "
        f"{in_list(injection.WHOLE_LINE_EXTENSIONS)} THEN [raw] ELSE "
        f"list_transform({parts('raw', injection.STRING_LITERAL)}, "
        "lambda s: substr(s, 2, length(s) - 2)) END"
    )
    return f"""
    WITH l AS (
      SELECT repo_id, file_id, path, ext, unnest({split_lines('content')}) AS raw,
             generate_subscripts({split_lines('content')}, 1) AS line
      FROM files WHERE ext IN {in_list(k.INJECTION_EXTENSIONS)}),
    x AS (SELECT repo_id, file_id, path, line, {listed} AS items FROM l WHERE {strip('raw')} <> '')
    SELECT repo_id, file_id, path, line, unnest(items) AS literal,
           generate_subscripts(items, 1) AS seq FROM x
    """


# --- findings -----------------------------------------------------------------------


def finding(select_from: str, rank: int, **columns) -> str:
    defaults = {
        "repo_id": "repo_id", "file_id": "file_id", "file_path": "path", "line": "line",
        "col": "1", "snippet": "''", "file_confidence": "0.0", "ai_context": "''",
    }
    merged = {**defaults, **columns}
    names = (
        "repo_id", "file_id", "rule_id", "severity", "file_path", "line", "col", "message",
        "fix_guidance", "cwe_id", "ai_context", "file_confidence", "rule_category", "snippet",
    )
    casts = {"line": "BIGINT", "col": "BIGINT", "file_confidence": "DOUBLE"}
    cols = ", ".join(
        f"CAST({merged[n]} AS {casts[n]}) AS {n}" if n in casts else f"{merged[n]} AS {n}"
        for n in names
    )
    return f"SELECT {cols}, CAST({rank} AS BIGINT) AS source_rank FROM {select_from}"


SEVERITY_RANK = (
    "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 "
    "WHEN 'LOW' THEN 3 ELSE 99 END"
)
TIER_RANK = "CASE scan_tier WHEN 'FULL' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"


def _rule_findings() -> str:
    return finding(
        "(SELECT l.*, d.confidence, d.scan_tier FROM placed l JOIN detector d USING (file_id) "
        "WHERE list_contains(l.tiers, d.scan_tier))",
        TIER_RANK, rule_id="rule_id", severity="severity", col="col", message="message",
        fix_guidance="fix_guidance", cwe_id="cwe", file_confidence="confidence",
        rule_category="category", snippet="snippet",
    )


def _secret_findings() -> str:
    ids = in_list([r.rule_id for r in RULES if r.category == "secrets"])
    return finding(
        f"""(SELECT s.repo_id, s.file_id, s.path, x.line, d.confidence
            FROM secret_lines x JOIN source s USING (file_id) JOIN detector d USING (file_id)
            WHERE NOT EXISTS (SELECT 1 FROM placed h WHERE h.file_id = x.file_id
              AND h.rule_id IN {ids} AND list_contains(h.tiers, d.scan_tier)
              AND x.line BETWEEN h.n AND h.n + {newlines('h.text')}))""",
        3, rule_id="'secret-in-text'", severity="'CRITICAL'",
        message="'A credential is written in the file'",
        fix_guidance=lit(FIX_GUIDANCE["secrets"]), cwe_id="'CWE-798'",
        file_confidence="confidence", rule_category="'secrets'",
    )


def _dep_findings() -> str:
    return "\nUNION ALL\n".join([
        finding(
            "deps SEMI JOIN bad_names USING (ecosystem, package)", 4,
            rule_id="'dep-unknown-package'", severity="'CRITICAL'",
            message="'Package ''' || package || ''' is a known invented name'",
            fix_guidance="'Check that the package exists before it is installed'",
            cwe_id="'CWE-829'", rule_category="'sca'"),
        finding(
            "vulnerable", 4, rule_id="'dep-known-vulnerability'", severity="severity",
            message="'Package ''' || package || ''' ' || version || ' has known advisories: ' || advisories",
            fix_guidance="'Upgrade to ' || package || '>=' || safe_from",
            cwe_id="'CWE-1395'", rule_category="'sca'"),
        finding(
            "deps WHERE version = ''", 4, rule_id="'dep-unpinned'", severity="'MEDIUM'",
            message="'Package ''' || package || ''' has no version'",
            fix_guidance="'Pin the package to a version'", cwe_id="'CWE-1357'",
            rule_category="'sca'"),
        finding(
            "unlocked", 4, rule_id="'dep-no-lock-file'", severity="'MEDIUM'", line="1",
            message="'''' || file_name || ''' has no lock file'",
            fix_guidance="'Write a lock file'", cwe_id="'CWE-1357'", rule_category="'sca'"),
    ])


def _project_findings() -> str:
    return "\nUNION ALL\n".join([
        finding(
            "env_open", 5, rule_id="'env-not-ignored'", severity="'CRITICAL'", line="1",
            message="'The environment file is not in the ignore file'",
            fix_guidance="'Add the file to the ignore file'", cwe_id="'CWE-538'",
            rule_category="'dotenv'"),
        finding(
            "env_secrets", 5, rule_id="'env-exposed-secret'", severity="'CRITICAL'",
            message="'The value of ' || key || ' looks like a live credential'",
            fix_guidance="'Keep the file out of version control and rotate the value'",
            cwe_id="'CWE-798'", rule_category="'dotenv'"),
        finding(
            "config_secrets", 6, rule_id="'config-secret'", severity="'CRITICAL'", line="1",
            message="'The configuration holds a secret under ''' || key || ''': ' || masked",
            fix_guidance="'Pass the credential at run time instead'", cwe_id="'CWE-798'",
            rule_category="'mcp_config'"),
        finding(
            "config_open", 6, rule_id="'config-not-ignored'", severity="'CRITICAL'", line="1",
            message="'The agent configuration is not in the ignore file'",
            fix_guidance="'Add ' || rel_path || ' to the ignore file'", cwe_id="'CWE-538'",
            rule_category="'mcp_config'"),
    ])


def _injection_findings() -> str:
    return finding(
        f"(SELECT DISTINCT repo_id, file_id, path, line FROM literals WHERE {has('literal', INJECTION)})",
        7, rule_id="'prompt-injection-text'", severity="'CRITICAL'",
        message="'A text tries to steer a reviewing model'",
        fix_guidance=lit(FIX_GUIDANCE["prompt_injection"]), cwe_id="'CWE-116'",
        rule_category="'prompt_injection'",
    )


def _dedupe(source: str) -> str:
    return f"""
    SELECT * EXCLUDE (rn) FROM (
      SELECT *, row_number() OVER (PARTITION BY rule_id, file_path, line
        ORDER BY source_rank, file_id, col, message) AS rn FROM {source}) WHERE rn = 1
    """


# name: (needs, sql)
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "snippets": ((), _snippets()),
    "files": (("snippets",), _files()),
    "source": (("files",), _source()),
    "lines": (("source",), f"""
      SELECT file_id, language, unnest({split_lines('content')}) AS raw,
             generate_subscripts({split_lines('content')}, 1) AS n FROM source"""),
    "coded": (("source",), _coded()),
    "aliases": (("coded",), _aliases()),
    "statements": (("coded", "aliases", "source"), _statements()),
    "blocks": (("coded",), _blocks()),
    "functions": (("coded", "blocks"), _functions()),
    "direct": (("functions", "coded"), _direct()),
    "params": (("functions",), _params()),
    "text_features": (("source", "lines"), _text_features()),
    "f_restating": (("lines", "source"), _f_restating()),
    "f_long_doc": (("functions", "source"), _feature(
        "f_long_doc",
        "SELECT file_id, count(*) AS v FROM functions WHERE doc_lines > 12 AND body_span < 20 GROUP BY 1")),
    "f_variation": (("functions", "source"), _f_variation()),
    "f_stock": (("statements", "source"), _f_stock()),
    "f_documented": (("functions", "source"), _f_documented()),
    "f_assign_return": (("functions", "direct", "coded", "source"), _f_assign_return()),
    "f_guards": (("functions", "direct", "params", "coded", "source"), _f_guards()),
    "f_gets": (("functions", "coded", "source"), _f_gets()),
    "f_annotated": (("functions", "params", "coded", "source"), _f_annotated()),
    "s_uniform": (("blocks", "source"), _s_uniform()),
    "t_swallowed": (("coded", "source"), _t_swallowed()),
    "score_parts": (
        ("source", "text_features", "f_restating", "f_long_doc", "f_variation", "f_stock",
         "s_uniform", "f_documented", "t_swallowed", "f_assign_return", "f_guards", "f_gets",
         "f_annotated"), _parts_of_score()),
    "detector": (("score_parts",), _detector()),
    "rules": ((), _rules()),
    "whole": (("source",), f"""
      SELECT file_id, language, array_to_string({split_lines('content')}, chr(10)) AS text FROM source"""),
    "pieces": (("whole",), f"""
      SELECT file_id, language, text, piece, i,
             1 + coalesce(sum({newlines('piece')}) OVER (PARTITION BY file_id ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line
      FROM (SELECT file_id, language, text, unnest(string_split(text, ';')) AS piece,
                   generate_subscripts(string_split(text, ';'), 1) AS i
            FROM whole WHERE language IN ('javascript', 'typescript'))"""),
    "rule_matches": (
        ("statements", "variants", "whole", "pieces", "coded", "lines", "source"), _rule_matches()),
    "variants": (("statements",), _variants()),
    "placed": (("rule_matches", "rules", "source"), _located("rule_matches")),
    "secret_lines": (("lines",), _secret_lines()),
    "env_entries": (("files",), _env_entries()),
    "env_secrets": (("env_entries",), _env_secrets()),
    "ignores": (("files",), _ignores()),
    "env_open": (("files", "ignores"), _env_open()),
    "configs": (("files",), _configs()),
    "walk": (("configs",), _walk()),
    "config_strings": (("walk",), _config_strings()),
    "config_secrets": (("config_strings",), _config_secrets()),
    "config_open": (("configs", "ignores"), _config_open()),
    "manifests": (("files",), _manifests()),
    "requirements": (("manifests",), _requirements()),
    "package_json": (("manifests",), _package_json()),
    "pyproject": (("manifests",), _pyproject()),
    "deps": (("requirements", "package_json", "pyproject"), """
      SELECT *, lower(trim(name)) AS package FROM (
        SELECT * FROM requirements UNION ALL BY NAME SELECT * FROM package_json
        UNION ALL BY NAME SELECT * FROM pyproject)"""),
    "bad_names": ((), _bad_names()),
    "vulns": ((), _vulns()),
    "vulnerable": (("deps", "vulns"), _vulnerable()),
    "unknown": (("deps", "bad_names"), _unknown()),
    "unlocked": (("files",), _unlocked()),
    "literals": (("files",), _literals()),
    "rule_findings": (("placed", "detector"), _rule_findings()),
    "secret_findings": (("secret_lines", "source", "detector", "placed"), _secret_findings()),
    "dep_findings": (("deps", "bad_names", "vulnerable", "unlocked"), _dep_findings()),
    "project_findings": (
        ("env_open", "env_secrets", "config_secrets", "config_open"), _project_findings()),
    "injection_findings": (("literals",), _injection_findings()),
    "every_finding": (
        ("rule_findings", "secret_findings", "dep_findings", "project_findings",
         "injection_findings"),
        "SELECT * FROM rule_findings UNION ALL SELECT * FROM secret_findings "
        "UNION ALL SELECT * FROM dep_findings UNION ALL SELECT * FROM project_findings "
        "UNION ALL SELECT * FROM injection_findings"),
    "findings": (
        ("every_finding",),
        _dedupe(f"(SELECT * FROM every_finding WHERE {SEVERITY_RANK} <= 2)")),
    "changed": (("files",), """
      SELECT DISTINCT f.repo_id, f.path FROM files f JOIN labels l ON l.doc_id = f.file_id"""),
}


def build(select: str, *needs: str) -> str:
    """``select`` with every fragment it needs in front, each once and in order."""
    order: list[str] = []

    def visit(name):
        if name in order:
            return
        for other in FRAGMENTS[name][0]:
            visit(other)
        order.append(name)

    for name in needs:
        visit(name)
    ctes = ",\n".join(
        f"{n} AS ({FRAGMENTS[n][1]})" if n == "walk" else f"{n} AS MATERIALIZED ({FRAGMENTS[n][1]})"
        for n in order
    )
    return f"WITH RECURSIVE {ctes}\n{select}"
