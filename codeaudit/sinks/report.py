"""JSON and SARIF reports as tables and as text files.

A report is a set of rows, one JSON object per finding, rule or file, written by
all tasks; no report is gathered in one place.  The reports that are one document a
repository stream each through one task, as one file must be.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.functions.text import pascal_case
from codeaudit.operators.score import scan_summary
from codeaudit.sinks.document import write_documents
from codeaudit.sources.constants import REPORT_LEVELS

VERSION = "0.1.0"
TOOL_NAME = "codeaudit"


def report_level(severity: Column) -> Column:
    level = F.lit("warning")
    for name, value in REPORT_LEVELS.items():
        level = F.when(severity == name, value).otherwise(level)
    return level


def relative_uri(path: Column, root: str = "") -> Column:
    prefix = root.rstrip("/") + "/"
    if root:
        return F.when(
            path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))
        ).otherwise(path)
    return path


def _arrival() -> list[str]:
    return ["source_rank", "file_id", "line", "col", "rule_id", "message"]


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One row per rule in order of first appearance, described by its first finding.

    The first finding is a minimum over an ordered struct, combined in each task
    before the shuffle; only one row per rule reaches the numbering window.
    """
    order = F.struct(*[F.col(c) for c in _arrival()])
    first = findings.groupBy("rule_id").agg(
        F.min(order).alias("_first"),
        F.min_by(
            F.struct("message", "fix_guidance", "rule_category", "severity", "cwe_id"), order
        ).alias("f"),
    )
    position = F.row_number().over(
        Window.orderBy(
            "_first.source_rank", "_first.file_id", "_first.line", "_first.col", "rule_id"
        )
    )
    return first.select(
        "rule_id",
        (position - 1).alias("rule_index"),
        pascal_case(F.col("rule_id")).alias("name"),
        F.col("f.message").alias("short_description"),
        F.trim(F.concat(F.col("f.message"), F.lit(". "), F.col("f.fix_guidance"))).alias(
            "full_description"
        ),
        F.array_join(
            F.array(F.col("f.rule_category"), F.lit("security"), F.lit("ai-generated")), ","
        ).alias("tags"),
        F.col("f.severity").alias("severity"),
        F.col("f.cwe_id").alias("cwe"),
    )


def sarif_results(findings: DataFrame, root: str = "", *extra: str) -> DataFrame:
    """One row per finding with the index of its rule; the rule list is small and broadcast."""
    rules = F.broadcast(sarif_rules(findings).select("rule_id", "rule_index"))
    return findings.join(rules, "rule_id").select(
        "repo_id",
        "rule_id",
        "rule_index",
        report_level(F.col("severity")).alias("level"),
        F.trim(F.concat(F.col("message"), F.lit(". AI context: "), F.col("ai_context"))).alias(
            "message"
        ),
        relative_uri(F.col("file_path"), root).alias("uri"),
        F.col("line").alias("start_line"),
        F.col("col").alias("start_column"),
        F.round("file_confidence", 4).alias("file_confidence"),
        "severity",
        *extra,
    )


def sarif_result_objects(findings: DataFrame, root: str = "", *extra: str) -> DataFrame:
    """SARIF result objects, one JSON text per finding."""
    rows = sarif_results(findings, root, *extra)
    return rows.select(
        "repo_id",
        *extra,
        F.to_json(
            F.struct(
                F.col("rule_id").alias("ruleId"),
                F.col("rule_index").alias("ruleIndex"),
                "level",
                F.struct(F.col("message").alias("text")).alias("message"),
                F.array(
                    F.struct(
                        F.struct(
                            F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias(
                                "artifactLocation"
                            ),
                            F.struct(
                                F.col("start_line").alias("startLine"),
                                F.col("start_column").alias("startColumn"),
                            ).alias("region"),
                        ).alias("physicalLocation")
                    )
                ).alias("locations"),
                F.struct(
                    "file_confidence", F.col("severity").alias("severity")
                ).alias("properties"),
            )
        ).alias("value"),
    )


def sarif_rule_objects(findings: DataFrame) -> DataFrame:
    return sarif_rules(findings).orderBy("rule_index").select(
        F.to_json(
            F.struct(
                F.col("rule_id").alias("id"),
                "name",
                F.struct(F.col("short_description").alias("text")).alias("shortDescription"),
                F.struct(F.col("full_description").alias("text")).alias("fullDescription"),
                F.struct(F.split("tags", ",").alias("tags"), "severity", "cwe").alias("properties"),
            )
        ).alias("value")
    )


def finding_objects(findings: DataFrame, *extra: str) -> DataFrame:
    """Report entries, one JSON text per finding, confidences rounded to four places."""
    names = (
        "rule_id", "severity", "file_path", "line", "col", "message", "fix_guidance", "cwe_id",
        "ai_context", "file_confidence", "rule_category", "snippet",
    )
    values = [
        F.round(c, 4).alias(c) if c == "file_confidence" else F.col(c) for c in names
    ]
    return findings.select("repo_id", *extra, F.to_json(F.struct(*values)).alias("value"))


def detector_objects(detector: DataFrame, *extra: str) -> DataFrame:
    signals = F.struct(*[F.round(s, 4).alias(s) for s in ("comments", "structure", "tokens")])
    return detector.select(
        "repo_id",
        *extra,
        F.to_json(
            F.struct(
                F.col("path").alias("file_path"),
                F.round("confidence", 4).alias("confidence"),
                "scan_tier",
                signals.alias("signals"),
            )
        ).alias("value"),
    )


def summary_object(
    detector: DataFrame, findings: DataFrame, duration_seconds: float = 0.0
) -> DataFrame:
    row = scan_summary(detector, findings)
    return row.select(
        F.to_json(
            F.struct(
                F.lit(VERSION).alias("version"),
                F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias(
                    "scan_timestamp"
                ),
                F.struct(
                    "files_scanned",
                    F.col("ai_files").alias("ai_files_detected"),
                    F.col("findings").alias("total_findings"),
                    F.struct(
                        F.col("n_critical").alias("CRITICAL"),
                        F.col("n_high").alias("HIGH"),
                        F.col("n_medium").alias("MEDIUM"),
                        F.col("n_low").alias("LOW"),
                    ).alias("findings_by_severity"),
                    F.lit(round(duration_seconds, 4)).alias("scan_duration_seconds"),
                    "rules_applied",
                ).alias("summary"),
            )
        ).alias("value")
    )


def write_json_report(detector: DataFrame, findings: DataFrame, path: str) -> None:
    """Write the summary, the detector rows and the findings as three JSON-lines folders."""
    summary_object(detector, findings).write.mode("overwrite").text(f"{path}/summary")
    detector_objects(detector).select("value").write.mode("overwrite").text(f"{path}/detector")
    finding_objects(findings).select("value").write.mode("overwrite").text(f"{path}/findings")


def write_sarif_report(detector: DataFrame, findings: DataFrame, path: str) -> None:
    """Write SARIF rule and result objects as two JSON-lines folders."""
    sarif_rule_objects(findings).write.mode("overwrite").text(f"{path}/rules")
    sarif_result_objects(findings).select("value").write.mode("overwrite").text(f"{path}/results")


def write_text_report(detector: DataFrame, findings: DataFrame, path: str) -> None:
    scan_summary(detector, findings).select("summary").write.mode("overwrite").text(path)


SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"


def _repositories(detector: DataFrame, findings: DataFrame) -> DataFrame:
    names = detector.select("repo_id").unionByName(findings.select("repo_id"))
    return names.distinct().select(F.col("repo_id").alias("name"))


def _place() -> Column:
    """A text that sorts findings by place."""
    return F.concat_ws("|", "file_path", F.lpad(F.col("line").cast("string"), 12, "0"),
                       F.lpad(F.col("col").cast("string"), 12, "0"), "rule_id")


def write_sarif_documents(detector: DataFrame, findings: DataFrame, path: str) -> None:
    """One SARIF 2.1.0 document a repository, also for those without findings.

    Every document lists the rules of the run, whose number the catalogue bounds; results
    stream into the file of their repository in the order of their places.
    """
    rules = [r.value for r in sarif_rule_objects(findings).collect()]  # one a rule
    listed = F.array(*[F.lit(r) for r in rules]).cast("array<string>")
    heads = _repositories(detector, findings).select(
        "name", F.lit(0).alias("section"), F.posexplode_outer(listed).alias("n", "value")
    ).select("name", "section", F.lpad(F.col("n").cast("string"), 12, "0").alias("position"), "value")
    objects = sarif_result_objects(findings.withColumn("_place", _place()), "", "_place")
    results = objects.select(
        F.col("repo_id").alias("name"), F.lit(1).alias("section"), F.col("_place").alias("position"), "value"
    )
    head = {"$schema": SARIF_SCHEMA, "version": "2.1.0"}
    tool = json.dumps({"name": TOOL_NAME, "version": VERSION})
    texts = [
        json.dumps(head)[:-1] + ', "runs": [{"tool": {"driver": ' + tool[:-1] + ', "rules": [',
        ']}}, "columnKind": "unicodeCodePoints", "results": [', "]}]}\n",
    ]
    write_documents(heads.unionByName(results), path, texts, ".sarif")


def write_json_documents(detector: DataFrame, findings: DataFrame, path: str) -> None:
    """One JSON document a repository: its detector rows and its findings."""
    repositories = _repositories(detector, findings).select(
        "name", F.lit(0).alias("section"), F.lit("").alias("position"),
        F.to_json(F.struct(F.col("name").alias("repository"))).alias("value"),
    )
    files = detector_objects(detector, "path").select(
        F.col("repo_id").alias("name"), F.lit(1).alias("section"), F.col("path").alias("position"), "value"
    )
    objects = finding_objects(findings.withColumn("_place", _place()), "_place").select(
        F.col("repo_id").alias("name"), F.lit(2).alias("section"), F.col("_place").alias("position"), "value"
    )
    texts = [f'{{"version": {json.dumps(VERSION)}, "about": ', ', "files": [', '], "findings": [', "]}\n"]
    write_documents(repositories.unionByName(files).unionByName(objects), path, texts)


Reporter = Callable[[DataFrame, DataFrame, str], None]

REPORTERS: dict[str, Reporter] = {
    "json": write_json_report,
    "sarif": write_sarif_report,
    "text": write_text_report,
    "sarif-documents": write_sarif_documents,
    "json-documents": write_json_documents,
}


def get_reporter(name: str) -> Reporter:
    if name not in REPORTERS:
        raise ValueError(f"unknown report format: {name}")
    return REPORTERS[name]
