"""Named queries: each reads the tables of one folder and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import spread, written
from codeaudit.functions.text import entropy, version_key, version_lt
from codeaudit.operators import agentconfig, dependencies, envfiles, injection, longfiles, patterns, score, signals
from codeaudit.operators import findings as fx
from codeaudit.operators.code import (
    line_table,
    with_aliases,
    with_blocks,
    with_code,
    with_lines,
    with_resolved_statements,
    with_statements,
)
from codeaudit.operators.rules import (
    listed_rules,
    located,
    rule_table,
    rule_tiers,
    with_rule_hits,
)
from codeaudit.plans import scan
from codeaudit.sinks import report
from codeaudit.sources.catalogue import RULES, TIER_NAMES
from codeaudit.sources.composed import COMPOSED, DESCRIPTIONS
from codeaudit.sources.corpus import corpus_from_documents, read_table, source_files
from codeaudit.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

SUPPRESSED = ("python-log-injection", "dep-unpinned")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wide(fn(spark, sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def _wide(df: DataFrame) -> DataFrame:
    """Integers as bigint, so the types do not depend on how a number was made."""
    return df.select(
        *[
            F.col(f"`{c}`").cast("bigint").alias(c) if t in ("int", "smallint") else F.col(f"`{c}`")
            for c, t in df.dtypes
        ]
    )


# --- inputs -----------------------------------------------------------------------


def files_of(spark, sf_dir) -> DataFrame:
    return corpus_from_documents(spread(read_table(spark, sf_dir, "documents")))


def source_of(spark, sf_dir) -> DataFrame:
    return source_files(files_of(spark, sf_dir))


def model_of(spark, sf_dir) -> DataFrame:
    return signals.code_model(source_of(spark, sf_dir))


def detector_of(spark, sf_dir) -> DataFrame:
    return signals.detect(source_of(spark, sf_dir))


def labels_of(spark, sf_dir) -> DataFrame:
    return read_table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id")


def changed_of(spark, sf_dir) -> DataFrame:
    """The files whose document has been labelled stand for the changed ones."""
    named = files_of(spark, sf_dir).select("repo_id", "path", "file_id")
    return named.join(labels_of(spark, sf_dir).select("file_id"), "file_id", "left_semi").drop(
        "file_id"
    )


def ungated_hits(spark, sf_dir, rules=RULES) -> DataFrame:
    languages = sorted({lang for r in rules for lang in r.languages})
    files = source_of(spark, sf_dir).where(F.col("language").isin(*languages))
    statements = with_resolved_statements(with_statements(with_code(files)))
    model = with_rule_hits(statements, rules=rules)
    return located(
        model.select("file_id", "repo_id", "path", "language", "rule_hits"), spark, rules
    )


# --- files and lines -----------------------------------------------------------------


@query
def corpus_files(spark, sf_dir):
    return files_of(spark, sf_dir).select(
        "file_id", "repo_id", "root", "path", "ext", "language",
        F.length("content").alias("n_chars"), F.md5("content").alias("digest"),
    )


@query
def source_scan(spark, sf_dir):
    return source_of(spark, sf_dir).select("file_id", "path", "language")


@query
def corpus_lines(spark, sf_dir):
    lines = line_table(source_of(spark, sf_dir))
    return lines.select(
        "file_id", "line", "indent", "is_blank", "is_comment", F.md5("raw").alias("digest")
    )


@query
def logical_statements(spark, sf_dir):
    rows = with_statements(with_code(source_of(spark, sf_dir)))
    return rows.select("file_id", F.explode("statements").alias("s")).select(
        "file_id", F.col("s.n").alias("line"), F.col("s.e").alias("last_line"),
        F.col("s.indent").alias("indent"), F.col("s.text").alias("text"),
    )


@query
def import_aliases(spark, sf_dir):
    rows = with_aliases(with_lines(source_of(spark, sf_dir)))
    return rows.select("file_id", F.inline("aliases")).select(
        "file_id", F.col("short").alias("alias"), F.col("full").alias("module")
    )


@query
def block_spans(spark, sf_dir):
    rows = with_blocks(with_code(source_of(spark, sf_dir)))
    return rows.select("file_id", F.inline("blocks")).select(
        "file_id", "line", F.col("end").alias("last_line"), "indent", "kind", "name",
        "parent_line", "parent_kind",
    )


@query
def long_statements(spark, sf_dir):
    """Statements of files cut into buckets of lines, as for files too long for one task."""
    return longfiles.statements(longfiles.buckets_of(source_of(spark, sf_dir), 256))


@query
def long_blocks(spark, sf_dir):
    return longfiles.blocks(longfiles.buckets_of(source_of(spark, sf_dir), 256))


# --- signals --------------------------------------------------------------------------

_TEXT_ONLY = {
    "sig_section_headings": signals.section_headings,
    "sig_param_underline": signals.parameter_underline,
    "sig_todo": signals.feature_todo,
    "sig_double_import": signals.double_import,
}
_LINES_ONLY = {
    "sig_restating_comments": signals.restating_comment_count,
    "sig_comment_density": signals.comment_density,
}
_MODEL = {
    "sig_long_docstring": (signals.long_docstring_count, 0),
    "sig_function_regularity": (
        lambda: signals.length_variation(signals.function_lengths()), None),
    "sig_stock_names": (signals.stock_name_count, 0),
    "sig_uniform_classes": (lambda: signals.uniform_classes(signals.class_method_counts()), 0.0),
    "sig_documented_share": (signals.documented_share, None),
    "sig_swallowed_exception": (signals.swallowed_exception, 0.0),
    "sig_assign_return": (signals.assign_return_count, 0),
    "sig_isinstance_guards": (signals.isinstance_guard_count, 0),
    "sig_exclusive_get": (signals.exclusive_get_count, 0),
    "sig_annotation": (signals.annotation_count, 0),
}


def _text_signal(name, feature):
    def run(spark, sf_dir):
        value = feature()
        if name == "sig_double_import":
            value = F.when(F.col("language") == "python", value).otherwise(0.0)
        return source_of(spark, sf_dir).select("file_id", value.alias("value"))

    run.__name__ = name
    return run


def _line_signal(name, feature):
    def run(spark, sf_dir):
        return with_lines(source_of(spark, sf_dir)).select("file_id", feature().alias("value"))

    run.__name__ = name
    return run


def _model_signal(name, feature, default):
    def run(spark, sf_dir):
        value = F.when(F.col("language") == "python", feature()).otherwise(default)
        return model_of(spark, sf_dir).select("file_id", value.alias("value"))

    run.__name__ = name
    return run


for _name, _f in _TEXT_ONLY.items():
    query(_text_signal(_name, _f))
for _name, _f in _LINES_ONLY.items():
    query(_line_signal(_name, _f))
for _name, (_f, _d) in _MODEL.items():
    query(_model_signal(_name, _f, _d))


@query
def signal_scores(spark, sf_dir):
    return detector_of(spark, sf_dir).select(
        "file_id", "path", "comments", "structure", "tokens"
    )


@query
def ai_confidence(spark, sf_dir):
    return detector_of(spark, sf_dir).select("file_id", "path", "confidence")


@query
def scan_tier(spark, sf_dir):
    return detector_of(spark, sf_dir).select("file_id", "confidence", "scan_tier", "is_ai")


@query
def detector_ranking(spark, sf_dir):
    return (
        detector_of(spark, sf_dir)
        .where(F.col("confidence") > 0)
        .select("file_id", "path", "confidence", "scan_tier")
        .orderBy(F.desc("confidence"), "file_id")
    )


@query
def ai_file_ratio(spark, sf_dir):
    counts = score.file_counts(detector_of(spark, sf_dir))
    return counts.withColumn("ratio", F.round(F.col("ai_files") / F.col("files_scanned"), 4))


# --- rules -----------------------------------------------------------------------------


def _language_rules(name, language):
    mine = [r for r in RULES if language in r.languages]

    def run(spark, sf_dir):
        return (
            ungated_hits(spark, sf_dir, mine)
            .where(F.col("language") == language)
            .select("file_id", "path", "rule_id", "line", "col", "snippet")
        )

    run.__name__ = name
    return run


for _name, _language in {
    "rules_python": "python", "rules_javascript": "javascript", "rules_typescript": "typescript",
    "rules_bash": "bash", "rules_yaml": "yaml", "rules_dockerfile": "dockerfile",
    "rules_sql": "generic",
}.items():
    query(_language_rules(_name, _language))


def _category_rules(category):
    mine = [r for r in RULES if r.category == category]

    def run(spark, sf_dir):
        return ungated_hits(spark, sf_dir, mine).select(
            "file_id", "rule_id", "severity", "cwe", "line"
        )

    run.__name__ = f"rule_{category}"
    return run


for _category in sorted({r.category for r in RULES}):
    query(_category_rules(_category))


@query
def hardcoded_secret(spark, sf_dir):
    mine = [r for r in RULES if r.rule_id.endswith("-hardcoded-secret")]
    return ungated_hits(spark, sf_dir, mine).select("file_id", "path", "rule_id", "line")


@query
def rule_catalogue(spark, sf_dir):
    """The listed catalogue with the number of files and hits each rule has."""
    hits = ungated_hits(spark, sf_dir).groupBy("rule_id").agg(
        F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("hits")
    )
    return (
        listed_rules(rule_table(spark))
        .join(hits, "rule_id", "left")
        .na.fill(0, ["files", "hits"])
    )


@query
def rules_per_language(spark, sf_dir):
    """Files per language next to the rules that apply to it."""
    files = source_of(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    rules = (
        rule_table(spark)
        .select(F.explode("languages").alias("language"))
        .groupBy("language")
        .agg(F.count(F.lit(1)).alias("rules"))
    )
    return files.join(F.broadcast(rules), "language", "left").na.fill(0, ["rules"])


@query
def tier_rules(spark, sf_dir):
    """The number of rules and packs each file's tier selects."""
    per_tier = rule_tiers(spark).groupBy("tier").agg(
        F.count(F.lit(1)).alias("rules"), F.countDistinct("pack").alias("packs")
    )
    return (
        detector_of(spark, sf_dir)
        .select("file_id", F.col("scan_tier").alias("tier"))
        .join(F.broadcast(per_tier), "tier")
    )


@query
def tier_containment(spark, sf_dir):
    """Per tier in use, the packs it has and those the next wider tier lacks (none)."""
    packs = rule_tiers(spark).select("tier", "pack").distinct()
    wider = packs.select(F.col("tier").alias("wide"), "pack", F.lit(1).alias("kept"))
    narrow = packs.where(F.col("tier") != TIER_NAMES[0]).withColumn(
        "wide", F.when(F.col("tier") == TIER_NAMES[1], TIER_NAMES[0]).otherwise(TIER_NAMES[1])
    )
    checked = (
        narrow.join(F.broadcast(wider), ["wide", "pack"], "left")
        .groupBy(F.col("tier").alias("scan_tier"))
        .agg(
            F.count(F.lit(1)).alias("packs"),
            F.count_if(F.col("kept").isNull()).alias("missing"),
        )
    )
    files = detector_of(spark, sf_dir).groupBy("scan_tier").agg(F.count(F.lit(1)).alias("files"))
    return files.join(F.broadcast(checked), "scan_tier").select(
        "scan_tier", "files", "packs", "missing"
    )


@query
def tiered_rule_scan(spark, sf_dir):
    hits = scan.tiered_model(source_of(spark, sf_dir)).select(
        "file_id", "repo_id", "path", "scan_tier", "rule_hits"
    )
    return located(hits, spark).select(
        "file_id", "path", "scan_tier", "rule_id", "severity", "line", "col"
    )


@query
def rule_cross_match(spark, sf_dir):
    return (
        ungated_hits(spark, sf_dir)
        .groupBy("language", "rule_id")
        .agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("hits"))
    )


@query
def rules_applied(spark, sf_dir):
    return scan.rules_applied(detector_of(spark, sf_dir), rule_tiers(spark))


# --- secrets, env files, agent configs, injection ------------------------------------------


@query
def token_entropy(spark, sf_dir):
    rows = injection.string_literals(files_of(spark, sf_dir))
    return rows.where(F.length("literal") >= 8).select(
        "file_id", "line", "seq", entropy(F.col("literal")).alias("entropy")
    )


@query
def secret_scan(spark, sf_dir):
    return scan.secret_findings(source_of(spark, sf_dir)).select(
        "file_id", "rule_id", "severity", "file_path", "line", "file_confidence", "rule_category"
    )


@query
def env_entries(spark, sf_dir):
    return envfiles.env_entries(files_of(spark, sf_dir))


@query
def env_secrets(spark, sf_dir):
    return envfiles.env_secrets(files_of(spark, sf_dir))


@query
def ignore_patterns(spark, sf_dir):
    return envfiles.ignore_patterns(files_of(spark, sf_dir))


@query
def env_not_ignored(spark, sf_dir):
    return envfiles.env_not_ignored(files_of(spark, sf_dir)).select("repo_id", "root", "path")


@query
def config_json_walk(spark, sf_dir):
    return agentconfig.config_strings(files_of(spark, sf_dir))


@query
def config_secrets(spark, sf_dir):
    return agentconfig.config_secrets(files_of(spark, sf_dir)).select(
        "repo_id", "file_id", "path", "key", "masked"
    )


@query
def config_not_ignored(spark, sf_dir):
    return agentconfig.config_not_ignored(files_of(spark, sf_dir)).select(
        "repo_id", "root", "path"
    )


@query
def string_literals(spark, sf_dir):
    return injection.string_literals(files_of(spark, sf_dir)).select(
        "file_id", "line", "seq", "literal"
    )


@query
def prompt_injection(spark, sf_dir):
    return injection.injection_rows(files_of(spark, sf_dir))


@query
def prompt_injection_given(spark, sf_dir):
    """A tree without the files labelled as poor, and all labelled files given besides."""
    files, labels = files_of(spark, sf_dir), labels_of(spark, sf_dir)
    tree = files.join(labels.where("quality = 0").select("file_id"), "file_id", "left_anti")
    given = files.join(labels.select("file_id"), "file_id", "left_semi")
    return injection.injection_rows(tree, given)


@query
def prompt_injection_chat(spark, sf_dir):
    return injection.chat_injections(read_table(spark, sf_dir, "conversations"))


# --- dependencies ---------------------------------------------------------------------------

_PARSED = ("file_id", "path", "ecosystem", "line", "name", "version")


@query
def parse_requirements(spark, sf_dir):
    return dependencies.parse_requirements(files_of(spark, sf_dir)).select(*_PARSED)


@query
def parse_package_json(spark, sf_dir):
    return dependencies.parse_package_json(files_of(spark, sf_dir)).select(*_PARSED)


@query
def parse_pyproject(spark, sf_dir):
    return dependencies.parse_pyproject(files_of(spark, sf_dir)).select(*_PARSED)


@query
def version_order(spark, sf_dir):
    """Every known vulnerable package in use, its version key and whether it is too old."""
    deps = dependencies.dependencies(files_of(spark, sf_dir))
    vulns = F.broadcast(
        dependencies.vulnerability_table(spark).select(
            "ecosystem", F.col("name").alias("package"), "safe_from"
        )
    )
    return deps.join(vulns, ["ecosystem", "package"]).select(
        "file_id",
        "line",
        "package",
        "version",
        "safe_from",
        F.array_join(version_key(F.col("version")).cast("array<string>"), ".").alias("key"),
        version_lt(F.col("version"), F.col("safe_from")).alias("older"),
    )


@query
def bad_packages(spark, sf_dir):
    deps = dependencies.dependencies(files_of(spark, sf_dir))
    return dependencies.bad_packages(deps, dependencies.bad_package_table(spark)).select(
        "file_id", "path", "ecosystem", "line", "package"
    )


@query
def vulnerable_versions(spark, sf_dir):
    deps = dependencies.dependencies(files_of(spark, sf_dir))
    return dependencies.vulnerable_versions(deps, dependencies.vulnerability_table(spark)).select(
        "file_id", "path", "line", "package", "version", "safe_from", "advisories", "severity"
    )


@query
def unpinned_deps(spark, sf_dir):
    deps = dependencies.dependencies(files_of(spark, sf_dir))
    return dependencies.unpinned(deps).select("file_id", "path", "ecosystem", "line", "package")


@query
def missing_lock(spark, sf_dir):
    return dependencies.missing_locks(files_of(spark, sf_dir)).select(
        "repo_id", "root", "file_name", "path"
    )


@query
def unknown_packages(spark, sf_dir):
    """Packages that no manifest of the corpus pins stand for those a registry lacks."""
    deps = dependencies.dependencies(files_of(spark, sf_dir))
    registry = deps.where(F.col("version") != "").select("ecosystem", "package")
    names = dependencies.bad_package_table(spark)
    return dependencies.unknown_packages(deps, registry, names).select(
        "file_id", "path", "ecosystem", "line", "package"
    )


# --- findings ---------------------------------------------------------------------------------


def findings_of(spark, sf_dir) -> DataFrame:
    return scan.scan_tables(files_of(spark, sf_dir))[1]


@query
def assemble_findings(spark, sf_dir):
    return scan.rule_findings(source_of(spark, sf_dir))


@query
def all_findings(spark, sf_dir):
    return scan.all_findings(files_of(spark, sf_dir)).drop("fix_guidance")


@query
def finding_confidence(spark, sf_dir):
    found = scan.injection_findings(files_of(spark, sf_dir))
    return fx.with_confidence(found, detector_of(spark, sf_dir)).select(
        "file_id", "rule_id", "line", "file_confidence"
    )


@query
def severity_filter(spark, sf_dir):
    found = scan.all_findings(files_of(spark, sf_dir))
    return fx.filter_severity(found, "HIGH").select(
        "rule_id", "severity", "file_path", "line", "source_rank"
    )


@query
def dedupe_findings(spark, sf_dir):
    return findings_of(spark, sf_dir).select(
        "rule_id", "severity", "file_path", "line", "col", "message", "source_rank"
    )


@query
def suppressed_findings(spark, sf_dir):
    ignored = spark.createDataFrame([(r,) for r in SUPPRESSED], "rule_id string")
    found = scan.scan_tables(files_of(spark, sf_dir), ignore_rules=ignored)[1]
    return found.select("rule_id", "file_path", "line")


@query
def findings_ordered(spark, sf_dir):
    return fx.ordered(findings_of(spark, sf_dir)).select(
        "severity", "file_path", "line", "col", "rule_id"
    )


@query
def diff_scan(spark, sf_dir):
    found = scan.diff_scan(files_of(spark, sf_dir), changed_of(spark, sf_dir))
    return found.select("rule_id", "file_path", "line", "source_rank", "file_confidence")


@query
def finding_context(spark, sf_dir):
    found = scan.rule_findings_with_context(source_of(spark, sf_dir))
    return found.select("file_id", "rule_id", "line", "context")


def verdicts_of(spark, sf_dir, found) -> DataFrame:
    """Findings in files labelled as poor stand for those a reviewer judged false."""
    return found.join(labels_of(spark, sf_dir), "file_id").select(
        "rule_id", "file_path", "line",
        F.when(F.col("quality") == 0, "FALSE").otherwise("TRUE").alias("verdict"),
    )


@query
def apply_verdicts(spark, sf_dir):
    found = written(scan.rule_findings(source_of(spark, sf_dir)), "findings")
    kept = fx.apply_verdicts(found, verdicts_of(spark, sf_dir, found))
    return kept.select("rule_id", "severity", "file_path", "line")


@query
def finding_explanations(spark, sf_dir):
    found = written(scan.rule_findings(source_of(spark, sf_dir)), "findings")
    texts = (
        found.join(
            labels_of(spark, sf_dir).where(F.col("quality") == 1), "file_id", "left_semi"
        )
        .select("rule_id", "file_path", "line")
        .distinct()
        .withColumn("text", F.concat(F.lit("See line "), F.col("line"), F.lit(": "), "rule_id"))
    )
    return fx.with_explanations(found, texts).select(
        "rule_id", "file_path", "line", "col", "explanation"
    )


def replacements_of(spark, sf_dir) -> DataFrame:
    hits = ungated_hits(spark, sf_dir).select(F.col("path").alias("file_path"), "line").distinct()
    return written(hits.withColumn("new_text", F.lit("fixed(1)\nfixed(2)")), "replacements")


@query
def apply_line_fixes(spark, sf_dir):
    fixed = fx.apply_line_fixes(source_of(spark, sf_dir), replacements_of(spark, sf_dir))
    return fixed.select(
        "file_id", "path", F.length("fixed_content").alias("n_chars"),
        F.md5("fixed_content").alias("digest"),
    )


@query
def fix_diff_rows(spark, sf_dir):
    return fx.fix_diff_rows(source_of(spark, sf_dir), replacements_of(spark, sf_dir))


# --- aggregates and reports ---------------------------------------------------------------------


def scored_of(spark, sf_dir) -> DataFrame:
    detector, found = scan.scan_tables(files_of(spark, sf_dir))
    return score.security_score(score.score_inputs(detector, found))


@query
def findings_by_severity(spark, sf_dir):
    return score.findings_by_severity(findings_of(spark, sf_dir))


@query
def highest_severity(spark, sf_dir):
    return score.highest_severity(findings_of(spark, sf_dir))


@query
def scan_summary(spark, sf_dir):
    return score.scan_summary(*scan.scan_tables(files_of(spark, sf_dir)))


@query
def security_score(spark, sf_dir):
    return scored_of(spark, sf_dir).drop("grade")


@query
def security_grade(spark, sf_dir):
    return scored_of(spark, sf_dir).select("repo_id", "score", "grade")


@query
def score_breakdown(spark, sf_dir):
    return score.score_breakdown(findings_of(spark, sf_dir))


@query
def badge_url(spark, sf_dir):
    return scored_of(spark, sf_dir).select(
        "repo_id", score.badge_url(F.col("grade"), F.col("score")).alias("url")
    )


@query
def quality_gate(spark, sf_dir):
    return score.quality_gate(scored_of(spark, sf_dir), fail_below=60)


def history_of(spark, sf_dir) -> DataFrame:
    """Daily scores: each user's events of a day, counted as findings of four severities."""
    events = read_table(spark, sf_dir, "events")

    def count(kind):
        return F.count_if(F.col("event_type") == kind)

    daily = events.groupBy(
        F.concat(F.lit("repo"), F.col("user_id").cast("string")).alias("repo_id"),
        F.date_trunc("day", "ts").cast("timestamp").alias("ts"),
    ).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        count("view").alias("ai_files"),
        count("error").alias("n_critical"),
        count("purchase").alias("n_high"),
        count("signup").alias("n_medium"),
        count("click").alias("n_low"),
    )
    return score.security_score(daily)


@query
def score_trend(spark, sf_dir):
    return score.score_trend(history_of(spark, sf_dir)).select(
        "repo_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "score", "previous", "delta",
        "trend",
    )


@query
def sarif_rules(spark, sf_dir):
    return report.sarif_rules(findings_of(spark, sf_dir))


@query
def sarif_results(spark, sf_dir):
    found = written(findings_of(spark, sf_dir), "findings")
    return report.sarif_results(found).select(
        "rule_id", "rule_index", "level", "uri", "start_line", "start_column", "file_confidence"
    )


@query
def json_findings(spark, sf_dir):
    return report.finding_objects(findings_of(spark, sf_dir))


@query
def stream_scan(spark, sf_dir):
    return incremental.stream_scan(spark, sf_dir)


@query
def stream_dedupe(spark, sf_dir):
    return incremental.stream_dedupe(spark, sf_dir)


@query
def stream_rescan(spark, sf_dir):
    return incremental.stream_rescan(spark, sf_dir)


# --- rules given as rows -----------------------------------------------------------------


@query
def composed_rules(spark, sf_dir):
    """Places per line of the rules that compose alternatives, captures and blocks around."""
    rows = patterns.matches(
        source_of(spark, sf_dir), COMPOSED, {d.rule_id: d.languages for d in DESCRIPTIONS}
    )
    return rows.where("rule_id <> 'composed-object-assign'").groupBy("rule_id", "file_id", "line").agg(
        F.countDistinct("start").alias("places")
    )
