"""One SQL text per registered query."""

from __future__ import annotations

from codeaudit.plans.registry import SUPPRESSED
from codeaudit.sources import constants as k
from codeaudit.sources.catalogue import RULES
from sqlcheck.fragments import (
    INJECTION,
    SEVERITY_RANK,
    build,
    entropy,
    has,
    in_list,
    lit,
    strip,
    version,
)

SQL: dict[str, str] = {}


def add(name: str, select: str, *needs: str) -> None:
    SQL[name] = build(select, *needs)


add("corpus_files",
    "SELECT file_id, repo_id, root, path, ext, language, length(content) AS n_chars, "
    "md5(content) AS digest FROM files", "files")
add("source_scan", "SELECT file_id, path, language FROM source", "source")
add("corpus_lines",
    f"SELECT file_id, n AS line, length(raw) - length(ltrim(raw, ' ' || chr(9))) AS indent, "
    f"{strip('raw')} = '' AS is_blank, starts_with({strip('raw')}, '#') AS is_comment, "
    "md5(raw) AS digest FROM lines", "lines")
add("logical_statements",
    "SELECT file_id, n AS line, e AS last_line, indent, plain AS text FROM statements", "statements")
add("import_aliases", "SELECT file_id, short AS alias, full_name AS module FROM aliases", "aliases")
add("block_spans",
    'SELECT file_id, line, "end" AS last_line, indent, kind, name, parent_line, parent_kind FROM blocks',
    "blocks")

SQL["long_statements"] = SQL["logical_statements"]
SQL["long_blocks"] = SQL["block_spans"]

for _name, _col, _frag in (
    ("sig_section_headings", "c_headings", "text_features"),
    ("sig_param_underline", "c_underline", "text_features"),
    ("sig_todo", "c_todo", "text_features"),
    ("sig_comment_density", "c_density", "text_features"),
    ("sig_double_import", "t_double_import", "text_features"),
    ("sig_restating_comments", "f_restating", "f_restating"),
    ("sig_long_docstring", "f_long_doc", "f_long_doc"),
    ("sig_function_regularity", "f_variation", "f_variation"),
    ("sig_stock_names", "f_stock", "f_stock"),
    ("sig_uniform_classes", "s_uniform", "s_uniform"),
    ("sig_documented_share", "f_documented", "f_documented"),
    ("sig_swallowed_exception", "t_swallowed", "t_swallowed"),
    ("sig_assign_return", "f_assign_return", "f_assign_return"),
    ("sig_isinstance_guards", "f_guards", "f_guards"),
    ("sig_exclusive_get", "f_gets", "f_gets"),
    ("sig_annotation", "f_annotated", "f_annotated"),
):
    _type = "BIGINT" if _col in (
        "f_restating", "f_long_doc", "f_stock", "f_assign_return", "f_guards", "f_gets", "f_annotated"
    ) else "DOUBLE"
    add(_name, f"SELECT file_id, CAST({_col} AS {_type}) AS value FROM {_frag}", _frag)

_D = "CAST({} AS DOUBLE) AS {}"
add("signal_scores",
    "SELECT file_id, path, " + ", ".join(_D.format(c, c) for c in ("comments", "structure", "tokens"))
    + " FROM detector", "detector")
add("ai_confidence", "SELECT file_id, path, CAST(confidence AS DOUBLE) AS confidence FROM detector",
    "detector")
add("scan_tier",
    "SELECT file_id, CAST(confidence AS DOUBLE) AS confidence, scan_tier, is_ai FROM detector",
    "detector")
add("detector_ranking",
    "SELECT file_id, path, CAST(confidence AS DOUBLE) AS confidence, scan_tier FROM detector "
    "WHERE confidence > 0 ORDER BY confidence DESC, file_id", "detector")
add("ai_file_ratio",
    "SELECT repo_id, count(*) AS files_scanned, count_if(is_ai)::BIGINT AS ai_files, "
    "round(count_if(is_ai) / count(*)::DOUBLE, 4) AS ratio FROM detector GROUP BY 1", "detector")

for _name, _language in {
    "rules_python": "python", "rules_javascript": "javascript", "rules_typescript": "typescript",
    "rules_bash": "bash", "rules_yaml": "yaml", "rules_dockerfile": "dockerfile",
    "rules_sql": "generic",
}.items():
    add(_name,
        f"SELECT file_id, path, rule_id, line, col, snippet FROM placed WHERE language = {lit(_language)}",
        "placed")
for _category in sorted({r.category for r in RULES}):
    add(f"rule_{_category}",
        f"SELECT file_id, rule_id, severity, cwe, line FROM placed WHERE category = {lit(_category)}",
        "placed")
add("hardcoded_secret",
    "SELECT file_id, path, rule_id, line FROM placed WHERE rule_id LIKE '%-hardcoded-secret'", "placed")
add("rule_catalogue",
    "SELECT r.rule_id, array_to_string(r.languages, ',') AS languages, r.severity, r.category, r.cwe, "
    "CASE WHEN length(r.message) > 60 THEN rtrim(substr(r.message, 1, 57)) || '...' ELSE r.message END "
    "AS description, coalesce(h.files, 0) AS files, coalesce(h.hits, 0) AS hits FROM rules r LEFT JOIN "
    "(SELECT rule_id, count(DISTINCT file_id) AS files, count(*) AS hits FROM placed GROUP BY 1) h "
    "USING (rule_id)", "rules", "placed")
add("rules_per_language",
    "SELECT f.language, f.files, coalesce(r.rules, 0) AS rules FROM "
    "(SELECT language, count(*) AS files FROM source GROUP BY 1) f LEFT JOIN "
    "(SELECT language, count(*) AS rules FROM (SELECT unnest(languages) AS language FROM rules) "
    "GROUP BY 1) r USING (language)", "source", "rules")
add("tier_rules",
    "SELECT d.file_id, d.scan_tier AS tier, t.rules, t.packs FROM detector d JOIN "
    "(SELECT tier, count(*) AS rules, count(DISTINCT pack) AS packs FROM "
    "(SELECT pack, unnest(tiers) AS tier FROM rules) GROUP BY 1) t ON t.tier = d.scan_tier",
    "detector", "rules")
add("tier_containment",
    "SELECT d.scan_tier, d.files, p.packs, p.missing FROM "
    "(SELECT scan_tier, count(*) AS files FROM detector GROUP BY 1) d JOIN ("
    "SELECT n.tier AS scan_tier, count(*) AS packs, count_if(NOT EXISTS (SELECT 1 FROM tp w "
    "WHERE w.pack = n.pack AND w.tier = CASE n.tier WHEN 'MEDIUM' THEN 'FULL' ELSE 'MEDIUM' END))"
    "::BIGINT AS missing FROM tp n WHERE n.tier <> 'FULL' GROUP BY 1) p USING (scan_tier)",
    "detector", "rules")
SQL["tier_containment"] = SQL["tier_containment"].replace(
    "\nSELECT d.scan_tier",
    ",\ntp AS (SELECT DISTINCT pack, unnest(tiers) AS tier FROM rules)\nSELECT d.scan_tier")
add("tiered_rule_scan",
    "SELECT p.file_id, p.path, d.scan_tier, p.rule_id, p.severity, p.line, p.col FROM placed p "
    "JOIN detector d USING (file_id) WHERE list_contains(p.tiers, d.scan_tier)", "placed", "detector")
add("rule_cross_match",
    "SELECT language, rule_id, count(DISTINCT file_id) AS files, count(*) AS hits FROM placed "
    "GROUP BY 1, 2", "placed")
add("rules_applied",
    "SELECT count(DISTINCT pack) + 4 AS rules_applied FROM (SELECT pack, unnest(tiers) AS tier "
    "FROM rules) WHERE tier IN (SELECT scan_tier FROM detector)", "rules", "detector")

add("token_entropy",
    f"SELECT file_id, line, seq, {entropy('literal')} AS entropy FROM literals "
    "WHERE length(literal) >= 8", "literals")
add("secret_scan",
    "SELECT file_id, rule_id, severity, file_path, line, file_confidence, rule_category "
    "FROM secret_findings", "secret_findings")
add("env_entries", "SELECT * FROM env_entries", "env_entries")
add("env_secrets", "SELECT * FROM env_secrets", "env_secrets")
add("ignore_patterns", "SELECT * FROM ignores", "ignores")
add("env_not_ignored", "SELECT repo_id, root, path FROM env_open", "env_open")
add("config_json_walk", "SELECT * FROM config_strings", "config_strings")
add("config_secrets", "SELECT repo_id, file_id, path, key, masked FROM config_secrets", "config_secrets")
add("config_not_ignored", "SELECT repo_id, root, path FROM config_open", "config_open")
add("string_literals", "SELECT file_id, line, seq, literal FROM literals", "literals")
add("prompt_injection",
    f"SELECT DISTINCT repo_id, file_id, path, line FROM literals WHERE {has('literal', INJECTION)}",
    "literals")
SQL["prompt_injection_given"] = SQL["prompt_injection"]
SQL["prompt_injection_chat"] = (
    f"SELECT role, count(*) AS turns, count_if({has('text', INJECTION)})::BIGINT AS flagged "
    "FROM conversations GROUP BY 1")

_PARSED = "file_id, path, ecosystem, line, name, version"
add("parse_requirements", f"SELECT {_PARSED} FROM requirements", "requirements")
add("parse_package_json", f"SELECT {_PARSED} FROM package_json", "package_json")
add("parse_pyproject", f"SELECT {_PARSED} FROM pyproject", "pyproject")
add("version_order",
    "SELECT d.file_id, d.line, d.package, d.version, v.safe_from, "
    f"array_to_string({version('d.version')}, '.') AS key, "
    f"{version('d.version')} < {version('v.safe_from')} AS older "
    "FROM deps d JOIN vulns v USING (ecosystem, package)", "deps", "vulns")
add("bad_packages",
    "SELECT file_id, path, ecosystem, line, package FROM deps SEMI JOIN bad_names "
    "USING (ecosystem, package)", "deps", "bad_names")
add("vulnerable_versions",
    "SELECT file_id, path, line, package, version, safe_from, advisories, severity FROM vulnerable",
    "vulnerable")
add("unpinned_deps",
    "SELECT file_id, path, ecosystem, line, package FROM deps WHERE version = ''", "deps")
add("missing_lock", "SELECT repo_id, root, file_name, path FROM unlocked", "unlocked")
add("unknown_packages", "SELECT file_id, path, ecosystem, line, package FROM unknown", "unknown")

add("assemble_findings", "SELECT * FROM rule_findings", "rule_findings")
add("all_findings", "SELECT * EXCLUDE (fix_guidance) FROM every_finding", "every_finding")
add("finding_confidence",
    "SELECT f.file_id, f.rule_id, f.line, coalesce(d.confidence, 0)::DOUBLE AS file_confidence "
    "FROM injection_findings f LEFT JOIN detector d USING (file_id)", "injection_findings", "detector")
add("severity_filter",
    f"SELECT rule_id, severity, file_path, line, source_rank FROM every_finding WHERE {SEVERITY_RANK} <= 1",
    "every_finding")
add("dedupe_findings",
    "SELECT rule_id, severity, file_path, line, col, message, source_rank FROM findings", "findings")
add("suppressed_findings",
    f"SELECT rule_id, file_path, line FROM findings WHERE rule_id NOT IN {in_list(SUPPRESSED)}",
    "findings")
add("findings_ordered",
    f"SELECT severity, file_path, line, col, rule_id FROM findings ORDER BY {SEVERITY_RANK}, "
    "file_path, line, col, rule_id", "findings")
add("diff_scan",
    "SELECT rule_id, file_path, line, source_rank, file_confidence FROM findings "
    "WHERE source_rank > 3 OR file_path IN (SELECT path FROM changed)", "findings", "changed")
add("finding_context",
    "SELECT f.file_id, f.rule_id, f.line, string_agg(l.raw, chr(10) ORDER BY l.n) AS context "
    "FROM (SELECT *, row_number() OVER () AS fid FROM rule_findings) f JOIN lines l "
    "ON l.file_id = f.file_id AND l.n BETWEEN f.line - 5 AND f.line + 5 "
    "GROUP BY f.fid, f.file_id, f.rule_id, f.line", "rule_findings", "lines")
add("apply_verdicts",
    "SELECT f.rule_id, f.severity, f.file_path, f.line FROM rule_findings f "
    "LEFT JOIN labels l ON l.doc_id = f.file_id "
    "WHERE NOT (f.severity IN ('CRITICAL', 'HIGH') AND coalesce(l.quality = 0, false))",
    "rule_findings")
add("finding_explanations",
    "SELECT f.rule_id, f.file_path, f.line, f.col, CASE WHEN l.quality = 1 "
    "THEN 'See line ' || f.line || ': ' || f.rule_id ELSE nullif(f.fix_guidance, '') END AS explanation "
    "FROM rule_findings f LEFT JOIN labels l ON l.doc_id = f.file_id", "rule_findings")
_FIXED = (
    "SELECT l.file_id, l.n, CASE WHEN h.line IS NULL THEN l.raw "
    "ELSE 'fixed(1)' || chr(10) || 'fixed(2)' END "
    "|| coalesce(regexp_extract_all(f.content, '\\r\\n|\\n|\\r')[l.n], '') AS raw "
    "FROM lines l JOIN source f USING (file_id) "
    "LEFT JOIN (SELECT DISTINCT file_id, line FROM placed) h ON h.file_id = l.file_id AND h.line = l.n "
    "WHERE l.file_id IN (SELECT file_id FROM placed)")
add("apply_line_fixes",
    "SELECT file_id, path, length(t) AS n_chars, md5(t) AS digest FROM (SELECT file_id, "
    f"string_agg(raw, '' ORDER BY n) AS t FROM ({_FIXED}) GROUP BY 1) "
    "JOIN source USING (file_id)", "lines", "placed", "source")
add("fix_diff_rows",
    "SELECT f.path AS file_path, l.n AS line, x.mark, x.seq::BIGINT AS seq, coalesce(x.text, l.raw) AS text "
    "FROM (SELECT DISTINCT file_id, line FROM placed) h JOIN lines l ON l.file_id = h.file_id "
    "AND l.n = h.line JOIN source f ON f.file_id = h.file_id CROSS JOIN (VALUES ('-', 1, NULL), "
    "('+', 1, 'fixed(1)'), ('+', 2, 'fixed(2)')) x(mark, seq, text)", "placed", "lines", "source")

_COUNTS = ", ".join(
    f"count_if(severity = '{s}')::BIGINT AS n_{s.lower()}" for s in k.SEVERITIES)


def _score(files, ai, c, h, m, low):
    return (
        f"greatest(0, least(100, 100 - 25 * {c} - 10 * {h} - 3 * {m} - {low} "
        f"+ CASE WHEN {files} > 0 AND {ai} / {files}::DOUBLE < 0.10 THEN 10 "
        f"WHEN {files} > 0 AND {ai} / {files}::DOUBLE < 0.30 THEN 5 ELSE 0 END "
        f"+ CASE WHEN {c} = 0 AND {h} = 0 THEN 5 ELSE 0 END))::BIGINT"
    )


_SCORE = _score("files_scanned", "ai_files", "n_critical", "n_high", "n_medium", "n_low")
_GRADE = (
    "CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' "
    "WHEN score >= 40 THEN 'D' ELSE 'F' END")
_SCORED = f"""
SELECT *, {_GRADE} AS grade FROM (
  SELECT *, {_SCORE} AS score FROM (
    SELECT repo_id, coalesce(files_scanned, 0) AS files_scanned, coalesce(ai_files, 0) AS ai_files,
           coalesce(n_critical, 0) AS n_critical, coalesce(n_high, 0) AS n_high,
           coalesce(n_medium, 0) AS n_medium, coalesce(n_low, 0) AS n_low
    FROM (SELECT repo_id, count(*) AS files_scanned, count_if(is_ai)::BIGINT AS ai_files
          FROM detector GROUP BY 1)
    FULL JOIN (SELECT repo_id, {_COUNTS} FROM findings GROUP BY 1) USING (repo_id)))
"""
_BOTH = ("detector", "findings")

add("findings_by_severity",
    "SELECT t.severity, t.severity_rank::BIGINT AS severity_rank, count(f.rule_id) AS findings "
    "FROM (VALUES ('CRITICAL', 0), ('HIGH', 1), ('MEDIUM', 2), ('LOW', 3)) t(severity, severity_rank) "
    "LEFT JOIN findings f USING (severity) GROUP BY 1, 2", "findings")
add("highest_severity",
    f"SELECT repo_id, arg_min(severity, {SEVERITY_RANK}) AS highest_severity FROM findings GROUP BY 1",
    "findings")
add("scan_summary",
    f"""SELECT *, files_scanned || ' files scanned (' || ai_files || ' AI-generated), ' || findings
      || ' findings [' || array_to_string(list_filter([
        CASE WHEN n_critical > 0 THEN n_critical || ' CRITICAL' END,
        CASE WHEN n_high > 0 THEN n_high || ' HIGH' END,
        CASE WHEN n_medium > 0 THEN n_medium || ' MEDIUM' END,
        CASE WHEN n_low > 0 THEN n_low || ' LOW' END], lambda x: x IS NOT NULL), ', ') || ']' AS summary
    FROM (SELECT count(*) AS files_scanned, count_if(is_ai)::BIGINT AS ai_files FROM detector),
         (SELECT count(*) AS findings, {_COUNTS} FROM findings),
         (SELECT count(DISTINCT pack) + 4 AS rules_applied
          FROM (SELECT pack, unnest(tiers) AS tier FROM rules)
          WHERE tier IN (SELECT scan_tier FROM detector))""", *_BOTH, "rules")
add("security_score", f"SELECT * EXCLUDE (grade) FROM ({_SCORED})", *_BOTH)
add("security_grade", f"SELECT repo_id, score, grade FROM ({_SCORED})", *_BOTH)
add("score_breakdown",
    "SELECT repo_id, severity, count(*) AS findings, (count(*) * CASE severity WHEN 'CRITICAL' THEN 25 "
    "WHEN 'HIGH' THEN 10 WHEN 'MEDIUM' THEN 3 ELSE 1 END)::BIGINT AS points FROM findings GROUP BY 1, 2",
    "findings")
add("badge_url",
    "SELECT repo_id, 'https://img.shields.io/badge/codeaudit-' || grade || '%20(' || score || ')-' || "
    "CASE grade WHEN 'A' THEN 'brightgreen' WHEN 'B' THEN 'green' WHEN 'C' THEN 'yellow' "
    f"WHEN 'D' THEN 'orange' ELSE 'red' END AS url FROM ({_SCORED})", *_BOTH)
add("quality_gate",
    "SELECT repo_id, n_critical + n_high + n_medium + n_low AS findings, score, "
    "NOT (n_critical + n_high + n_medium + n_low > 0 OR score < 60) AS passed "
    f"FROM ({_SCORED})", *_BOTH)
SQL["score_trend"] = f"""
WITH daily AS (
  SELECT 'repo' || user_id AS repo_id, date_trunc('day', ts)::DATE AS day, count(*) AS files_scanned,
         count_if(event_type = 'view') AS ai_files, count_if(event_type = 'error') AS n_critical,
         count_if(event_type = 'purchase') AS n_high, count_if(event_type = 'signup') AS n_medium,
         count_if(event_type = 'click') AS n_low FROM events GROUP BY 1, 2),
scored AS (SELECT repo_id, day, {_SCORE} AS score FROM daily),
lagged AS (
  SELECT *, lag(score) OVER (PARTITION BY repo_id ORDER BY day) AS previous,
         lag(day) OVER (PARTITION BY repo_id ORDER BY day) AS previous_day FROM scored)
SELECT repo_id, strftime(day, '%Y-%m-%d') AS day, score, previous, score - previous AS delta,
       CASE WHEN score > previous THEN '▲ +' || (score - previous)
            WHEN score < previous THEN '▼ ' || (score - previous)
            WHEN score = previous THEN '── unchanged' END
       || ' from last scan on ' || strftime(previous_day, '%Y-%m-%d') AS trend
FROM lagged"""
_PASCAL = (
    "array_to_string(list_transform(list_filter(string_split(replace(rule_id, '_', '-'), '-'), "
    "lambda p: p <> ''), lambda p: upper(substr(p, 1, 1)) || lower(substr(p, 2))), '')")
_SARIF_RULES = f"""
SELECT rule_id, row_number() OVER (ORDER BY source_rank, file_id, line, col, rule_id) - 1 AS rule_index,
       {_PASCAL} AS name, message AS short_description,
       trim(message || '. ' || fix_guidance) AS full_description,
       rule_category || ',security,ai-generated' AS tags, severity, cwe_id AS cwe
FROM (SELECT *, row_number() OVER (PARTITION BY rule_id
        ORDER BY source_rank, file_id, line, col, message) AS first_n FROM findings)
WHERE first_n = 1"""
add("sarif_rules", _SARIF_RULES, "findings")
add("sarif_results",
    "SELECT f.rule_id, r.rule_index, CASE f.severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' "
    "WHEN 'MEDIUM' THEN 'warning' WHEN 'LOW' THEN 'note' ELSE 'warning' END AS level, f.file_path AS uri, "
    "f.line AS start_line, f.col AS start_column, round(f.file_confidence, 4) AS file_confidence "
    f"FROM findings f JOIN ({_SARIF_RULES}) r USING (rule_id)", "findings")
add("stream_scan", "SELECT file_id, path, rule_id, line, col FROM placed", "placed")
add("stream_dedupe",
    "SELECT DISTINCT 'prompt-injection-text' AS rule_id, path AS file_path, line FROM literals "
    f"WHERE {has('literal', INJECTION)}", "literals")
_NAMES = (
    "rule_id", "severity", "file_path", "line", "col", "message", "fix_guidance", "cwe_id",
    "ai_context", "file_confidence", "rule_category", "snippet")
add("json_findings",
    "SELECT repo_id, to_json({"
    + ", ".join(f"{n}: round({n}, 4)" if n == "file_confidence" else f"{n}: {n}" for n in _NAMES)
    + "})::VARCHAR AS value FROM findings", "findings")
_SIDE = r"[\w.\[\]\"'']+"
_COMPARED = rf"({_SIDE})[ \t]*==[ \t]*({_SIDE})"
_SECRET = "(?i)token|secret|key|password|passwd|pwd|auth|credential|hash|digest|signature|nonce"
_LOOKUP = r"db\.query\((\w+)\)\.filter\((\w+)\.id[ \t]*==[ \t]*(\w+)\)"
_OWNERS = (
    r"if[ \t]+current_user\.id[ \t]*==[ \t]*(\w+)[ \t]*:",
    r'if[ \t]+session\["user_id"\][ \t]*==[ \t]*(\w+)[ \t]*:',
)
_WIDTH = "(length({0}.raw) - length(ltrim({0}.raw, ' ' || chr(9))))"
add("composed_rules", f"""
SELECT 'composed-timing-unsafe-compare' AS rule_id, file_id, line, places FROM (
  SELECT file_id, n AS line, len(list_filter(list_zip(regexp_extract_all(raw, '{_COMPARED}', 1),
           regexp_extract_all(raw, '{_COMPARED}', 2)),
         lambda p: regexp_matches(p[1], '{_SECRET}') OR regexp_matches(p[2], '{_SECRET}'))) AS places
  FROM lines WHERE language = 'python') WHERE places > 0
UNION ALL
SELECT 'composed-idor', file_id, n, count(*) FROM (
  SELECT file_id, n, raw, unnest(regexp_extract_all(raw, '{_LOOKUP}', 1)) AS model,
         unnest(regexp_extract_all(raw, '{_LOOKUP}', 2)) AS again, unnest(regexp_extract_all(raw, '{_LOOKUP}', 3)) AS id
  FROM lines WHERE language = 'python') AS b
WHERE model = again AND regexp_matches(id, '(?i)id') AND NOT EXISTS (
  SELECT 1 FROM lines AS h WHERE h.file_id = b.file_id AND h.n < b.n
    AND b.id IN (regexp_extract(h.raw, '{_OWNERS[0]}', 1), regexp_extract(h.raw, '{_OWNERS[1]}', 1))
    AND NOT EXISTS (SELECT 1 FROM lines AS l WHERE l.file_id = b.file_id AND l.n > h.n AND l.n <= b.n
      AND trim(l.raw, ' ' || chr(9) || chr(13)) <> '' AND {_WIDTH.format('l')} <= {_WIDTH.format('h')}))
GROUP BY file_id, n
""", "lines", "source")

add("stream_rescan",
    "SELECT file_id, path, rule_id, line, col FROM placed "
    "WHERE file_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)", "placed")
