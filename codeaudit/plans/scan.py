"""Whole scans: from a file table to findings, as one lazy plan.

Everything that depends on one file's text (signals, tier, rules, credentials,
injection texts) is computed in one pass over the files, and only findings leave
it.  The checks that compare files of one project look at a few file names and
shuffle only those.  The remaining shuffle is the one that removes duplicate
findings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.plan import broadcast_if_small, once, written
from codeaudit.functions.text import split_lines
from codeaudit.operators import injection, secrets
from codeaudit.operators.agentconfig import config_findings
from codeaudit.operators.dependencies import dependency_findings
from codeaudit.operators.envfiles import env_findings
from codeaudit.operators.findings import (
    SOURCE_RANK,
    as_findings,
    deduplicate,
    filter_severity,
    suppress,
    tier_rank,
)
from codeaudit.operators.project import is_project_file, project_findings
from codeaudit.operators.rules import located, with_lines_around, with_rule_hits
from codeaudit.operators.signals import Signal, code_model, scan_tier, with_features
from codeaudit.sources.catalogue import FIX_GUIDANCE, RULES, Rule
from codeaudit.sources.constants import AI_THRESHOLD, SOURCE_EXTENSIONS
from codeaudit.sources.corpus import changed_only, is_skipped, is_source, source_files

# A detector turns the file table into findings; scans take any number of them.
Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """A detector with a name and a test of whether it can run; a scan leaves out those that cannot."""

    name: str
    detect: Detector
    is_available: Callable[[], bool] = lambda: True

    def __call__(self, files: DataFrame) -> DataFrame:
        return self.detect(files)


def available(detectors: Iterable[Detector]) -> tuple[Detector, ...]:
    return tuple(d for d in detectors if not isinstance(d, Plugin) or d.is_available())

PROJECT_DETECTORS: tuple[Detector, ...] = (
    dependency_findings, env_findings, config_findings, project_findings,
)

# Detectors that report lines found inside a file, described like rules.
_LINE_RULES = [
    Rule(secrets.RULE_ID, "", "CRITICAL", "secrets", "CWE-798", "FMC", "L", "", "", "",
         "A credential is written in the file"),
    Rule(injection.RULE_ID, "", "CRITICAL", "prompt_injection", "CWE-116", "FMC", "L", "", "", "",
         "A text tries to steer a reviewing model"),
]

SECRET_RULES = [r.rule_id for r in RULES if r.category == "secrets"]
_RANKED = "array<struct<rank:int,rule_id:string,n:int,text:string>>"


def tiered_model(
    files: DataFrame, threshold: float = AI_THRESHOLD, rules: Iterable[Rule] = RULES,
    signals: Iterable[Signal] = (),
) -> DataFrame:
    """Code model, signals, confidence, tier and the tier's rule hits of source files."""
    scored = with_features(code_model(files), signals).withColumn(
        "scan_tier", once(scan_tier(F.col("confidence"), threshold))
    )
    return with_rule_hits(scored, "scan_tier", tuple(rules))


def unreported_secrets(model: DataFrame) -> DataFrame:
    """Add ``secret_hits``: credential lines outside statements a secrets rule has reported."""
    reported = F.filter("rule_hits", lambda h: h.rule_id.isin(*SECRET_RULES))
    fresh = F.filter(
        secrets.secret_lines(),
        lambda l: ~F.exists(
            F.col("_reported"),
            lambda h: (l.n >= h.n)
            & (l.n <= h.n + F.length(h.text) - F.length(F.replace(h.text, F.lit("\n"), F.lit("")))),
        ),
    )
    return (
        model.withColumn("_reported", once(reported))
        .withColumn("secret_hits", once(fresh))
        .drop("_reported")
    )


def rule_findings(files: DataFrame, threshold: float = AI_THRESHOLD) -> DataFrame:
    """Findings of the rules each file's tier selects."""
    hits = tiered_model(files, threshold).select(
        "repo_id", "file_id", "path", "confidence", "scan_tier", "rule_hits"
    )
    return _placed_findings(located(hits, files.sparkSession))


def rule_findings_with_context(
    files: DataFrame, window: int = 5, threshold: float = AI_THRESHOLD
) -> DataFrame:
    """Rule findings with the lines around them, taken while the file is at hand.

    Looking the lines up afterwards would join findings back to file contents;
    here each hit takes its slice of the line array in the same pass, and no finding
    carries the file's lines.
    """
    hits = with_lines_around(tiered_model(files, threshold), window).select(
        "repo_id", "file_id", "path", "confidence", "scan_tier", "rule_hits"
    )
    return _placed_findings(located(hits, files.sparkSession, window=window), "context")


def _placed_findings(placed: DataFrame, *extra: str) -> DataFrame:
    return as_findings(
        placed,
        *extra,
        file_path=F.col("path"),
        cwe_id=F.col("cwe"),
        rule_category=F.col("category"),
        file_confidence=F.col("confidence"),
        snippet=F.col("snippet"),
        fix_guidance=F.col("fix_guidance"),
        col=F.col("col"),
        source_rank=tier_rank(F.col("scan_tier")),
    )


def secret_findings(files: DataFrame, threshold: float = AI_THRESHOLD) -> DataFrame:
    """Credential lines of source files that no rule of the file's tier has reported."""
    rows = (
        unreported_secrets(tiered_model(files, threshold))
        .select("repo_id", "file_id", "path", "confidence", F.explode("secret_hits").alias("hit"))
    )
    return as_findings(
        rows,
        rule_id=secrets.RULE_ID,
        severity="CRITICAL",
        file_path=F.col("path"),
        line=F.col("hit.n"),
        message="A credential is written in the file",
        fix_guidance=FIX_GUIDANCE["secrets"],
        cwe_id="CWE-798",
        rule_category="secrets",
        file_confidence=F.col("confidence"),
        source_rank=SOURCE_RANK["secrets"],
    )


def injection_findings(files: DataFrame) -> DataFrame:
    return as_findings(
        injection.injection_rows(files),
        rule_id=injection.RULE_ID,
        severity="CRITICAL",
        file_path=F.col("path"),
        message="A text tries to steer a reviewing model",
        fix_guidance=FIX_GUIDANCE["prompt_injection"],
        cwe_id="CWE-116",
        rule_category="prompt_injection",
        source_rank=SOURCE_RANK["injection"],
    )


def marked_files(
    files: DataFrame,
    changed_paths: DataFrame | None = None,
    extensions=SOURCE_EXTENSIONS,
    exclude_paths=(),
) -> DataFrame:
    """The whole tree with ``is_scanned``, set where a file is scored and meets rules."""
    keep = is_source(F.col("file_name"), F.col("ext"), extensions) & ~is_skipped(F.col("rel_path"))
    for prefix in exclude_paths:
        keep = keep & ~F.col("rel_path").startswith(prefix)
    if changed_paths is None:
        return files.withColumn("is_scanned", keep)
    keys = changed_paths.select("repo_id", "path").distinct().withColumn("_changed", F.lit(True))
    return (
        files.join(broadcast_if_small(keys), ["repo_id", "path"], "left")
        .withColumn("is_scanned", keep & F.coalesce(F.col("_changed"), F.lit(False)))
        .drop("_changed")
    )


def file_results(
    marked: DataFrame,
    threshold: float = AI_THRESHOLD,
    keep_projects: bool = False,
    rules: Iterable[Rule] = RULES,
    signals: Iterable[Signal] = (),
) -> DataFrame:
    """One row per scanned or injection-checked file: its scores and the hits in its text.

    Its rows are small next to the contents.  With ``keep_projects`` the files the
    project detectors read are kept with their text, so that a run that writes
    the results has read the contents exactly once.
    """
    keep = F.col("is_scanned") | F.col("ext").isin(*injection.INJECTION_EXTENSIONS)
    extra, kept = [], F.lit(None).cast("string")
    if keep_projects:
        is_project = is_project_file(F.col("rel_path"), F.col("file_name"))
        keep = keep | is_project
        kept = F.when(is_project, F.col("content"))
        extra = [
            "root", "rel_path", "file_name", "ext", is_project.alias("is_project"),
            F.col("_kept").alias("content"),
        ]
    wanted = marked.where(keep)
    gated = wanted.withColumn(
        "language", once(F.when(F.col("is_scanned"), F.col("language")).otherwise(""))
    )
    # other files than the scanned ones only meet the injection search: to the model they are empty
    content = F.col("content")
    steered = gated.withColumns({
        "_steering": once(injection.injection_lines(split_lines(content))),
        "_kept": once(kept),
        "content": once(F.when(F.col("is_scanned"), content).otherwise("")),
    })
    model = unreported_secrets(tiered_model(steered, threshold, rules, signals))

    def ranked(hits, rank, rule_id):
        return F.transform(
            hits,
            lambda h: F.struct(
                F.lit(rank).alias("rank"), F.lit(rule_id).alias("rule_id"),
                h.n.alias("n"), h.text.alias("text"),
            ),
        )

    by_rules = F.transform(
        "rule_hits",
        lambda h: F.struct(
            tier_rank(F.col("scan_tier")).alias("rank"), h.rule_id.alias("rule_id"),
            h.n.alias("n"), h.text.alias("text"),
        ),
    )
    found_secrets = F.when(
        F.col("is_scanned"), ranked(F.col("secret_hits"), SOURCE_RANK["secrets"], secrets.RULE_ID)
    ).otherwise(F.array().cast(_RANKED))
    hits = F.concat(
        by_rules.cast(_RANKED),
        found_secrets,
        ranked(F.col("_steering"), SOURCE_RANK["injection"], injection.RULE_ID),
    )
    return model.withColumn("rule_hits", once(hits)).select(
        "repo_id", "file_id", "path", "is_scanned", "comments", "structure", "tokens",
        "confidence", "scan_tier", "rule_hits", *extra,
    )


def project_files(results: DataFrame) -> DataFrame:
    """The file table of the project detectors, held in ``file_results``."""
    return results.where("is_project").select(
        "file_id", "repo_id", "root", "path", "rel_path", "file_name", "ext",
        F.lit("").alias("language"), "content",
    )


def content_findings(results: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The findings held in ``file_results``, looked up in the catalogue and placed."""
    rows = results.select("repo_id", "file_id", "path", "confidence", "rule_hits")
    placed = located(rows, results.sparkSession, [*rules, *_LINE_RULES], keep_rank=True)
    by_rule = F.col("rank") < SOURCE_RANK["secrets"]
    return as_findings(
        placed,
        file_path=F.col("path"),
        cwe_id=F.col("cwe"),
        rule_category=F.col("category"),
        col=F.when(by_rule, F.col("col")).otherwise(1),
        snippet=F.when(by_rule, F.col("snippet")).otherwise(""),
        fix_guidance=F.col("fix_guidance"),
        file_confidence=F.when(
            F.col("rank") <= SOURCE_RANK["secrets"], F.col("confidence")
        ).otherwise(0.0),
        source_rank=F.col("rank"),
    )


def detector_rows(results: DataFrame) -> DataFrame:
    """The detector's rows held in ``file_results``."""
    return results.where("is_scanned").select(
        "file_id", "repo_id", "path", "comments", "structure", "tokens", "confidence", "scan_tier",
        (F.col("confidence") >= AI_THRESHOLD).alias("is_ai"),
    )


def _with_project_checks(found: DataFrame, files: DataFrame, detectors) -> DataFrame:
    for detector in detectors:
        found = found.unionByName(detector(files))
    return found


def scanned(
    files: DataFrame,
    threshold: float = AI_THRESHOLD,
    changed_paths: DataFrame | None = None,
    detectors: Iterable[Detector] = PROJECT_DETECTORS,
    rules: Iterable[Rule] = RULES,
    signals: Iterable[Signal] = (),
    folder: str | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """(per-file results, findings of every detector before filtering), from one read.

    The results are written to ``folder`` (by default below the shared checkpoint
    folder) with the text of the few files that project detectors look at, and
    everything else is derived from there.  With ``changed_paths`` only changed
    files are scored and meet rules; the project checks and the injection search
    still see the whole tree.  ``rules`` may hold rules of the caller's own, ``signals``
    features of their own that add to the score and so to the tier.
    """
    detectors, rules = available(detectors), tuple(rules)
    marked = marked_files(files, changed_paths, **options)
    results = written(
        file_results(marked, threshold, keep_projects=True, rules=rules, signals=signals),
        "results", folder,
    )
    found = _with_project_checks(
        content_findings(results, rules),
        project_files(results),
        [d for d in detectors if d in PROJECT_DETECTORS],
    )
    own = [d for d in detectors if d not in PROJECT_DETECTORS]
    return results, _with_project_checks(found, files, own)


def all_findings(files: DataFrame, threshold: float = AI_THRESHOLD, **options) -> DataFrame:
    """Findings of every detector, before filtering; options as for ``scanned``."""
    return scanned(files, threshold, **options)[1]


def _visible(found: DataFrame, minimum_severity: str, ignore_rules: DataFrame | None) -> DataFrame:
    kept = filter_severity(found, minimum_severity)
    if ignore_rules is not None:
        kept = suppress(kept, ignore_rules)
    return deduplicate(kept)


def scan_tables(
    files: DataFrame,
    threshold: float = AI_THRESHOLD,
    minimum_severity: str = "MEDIUM",
    ignore_rules: DataFrame | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Detector rows and findings of one scan, with file contents read once.

    Both tables are derived from the written results, so a lost executor costs a
    read of a small table and not a second scan.  Options as for ``scanned``.
    """
    results, found = scanned(files, threshold, **options)
    return detector_rows(results), _visible(found, minimum_severity, ignore_rules)


def scan(
    files: DataFrame,
    threshold: float = AI_THRESHOLD,
    minimum_severity: str = "MEDIUM",
    ignore_rules: DataFrame | None = None,
    **options,
) -> DataFrame:
    """The findings a user sees: filtered by severity, suppressed rules and duplicates removed."""
    return _visible(all_findings(files, threshold, **options), minimum_severity, ignore_rules)


def diff_scan(files: DataFrame, changed_paths: DataFrame, **options) -> DataFrame:
    """A scan of changed files; an empty list of changes means a full scan."""
    if changed_paths.isEmpty():
        return scan(files, **options)
    return scan(files, changed_paths=changed_paths, **options)


def rules_applied(
    detector: DataFrame, rule_packs: DataFrame, active_detectors: int = 4
) -> DataFrame:
    """Distinct rule packs the tiers in use select, plus the active detectors."""
    tiers = detector.select(F.col("scan_tier").alias("tier")).distinct()
    return rule_packs.join(F.broadcast(tiers), "tier", "left_semi").agg(
        (F.countDistinct("pack") + active_detectors).alias("rules_applied")
    )
