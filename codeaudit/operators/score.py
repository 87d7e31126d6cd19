"""Counts, the security score, grades, gates and trends per repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeaudit.operators.findings import severity_rank, severity_table
from codeaudit.sources.catalogue import RULES, TIER_NAMES
from codeaudit.sources.constants import (
    AI_THRESHOLD,
    DEDUCTIONS,
    GRADE_COLORS,
    GRADES,
    SEVERITIES,
)


def findings_by_severity(findings: DataFrame) -> DataFrame:
    """One row per severity in fixed order, zero where there is no finding."""
    counts = findings.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return (
        severity_table(findings.sparkSession)
        .join(counts, "severity", "left")
        .select("severity", "severity_rank", F.coalesce("n", F.lit(0)).alias("findings"))
    )


def highest_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("repo_id").agg(
        F.min_by("severity", severity_rank(F.col("severity"))).alias("highest_severity")
    )


def file_counts(detector: DataFrame) -> DataFrame:
    """Files and machine-written files per repository; the flag ignores the tier threshold."""
    return detector.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count_if(F.col("confidence") >= AI_THRESHOLD).alias("ai_files"),
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    """One column per severity and repository; partial sums before the shuffle."""
    return findings.groupBy("repo_id").agg(
        *[
            F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}")
            for s in SEVERITIES
        ]
    )


def score_inputs(detector: DataFrame, findings: DataFrame) -> DataFrame:
    counts = severity_counts(findings)
    joined = file_counts(detector).join(counts, "repo_id", "full")
    return joined.na.fill(0)


def score(
    files: Column, ai_files: Column, critical: Column, high: Column, medium: Column, low: Column
) -> Column:
    """100 less the deductions, plus bonuses, kept between 0 and 100."""
    counts = {"CRITICAL": critical, "HIGH": high, "MEDIUM": medium, "LOW": low}
    lost = reduce(lambda a, b: a + b, [counts[s] * p for s, p in DEDUCTIONS.items()])
    ratio = ai_files / F.when(files > 0, files)
    bonus = F.when(ratio < 0.10, 10).when(ratio < 0.30, 5).otherwise(0)
    clean = F.when((critical == 0) & (high == 0), 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - lost + bonus + clean)).cast("int")


def grade(value: Column) -> Column:
    banded = F.lit(GRADES[-1][1])
    for limit, letter in reversed(GRADES):
        banded = F.when(value >= limit, letter).otherwise(banded)
    return banded


def security_score(inputs: DataFrame) -> DataFrame:
    names = ("files_scanned", "ai_files", "n_critical", "n_high", "n_medium", "n_low")
    scored = inputs.withColumn("score", score(*[F.col(c) for c in names]))
    return scored.withColumn("grade", grade(F.col("score")))


def score_breakdown(findings: DataFrame) -> DataFrame:
    """Findings and points lost per repository and severity."""
    points = F.lit(0)
    for name, value in DEDUCTIONS.items():
        points = F.when(F.col("severity") == name, value).otherwise(points)
    counts = findings.groupBy("repo_id", "severity").agg(F.count(F.lit(1)).alias("findings"))
    return counts.withColumn("points", F.col("findings") * points)


def badge_url(letter: Column, value: Column, label: str = "codeaudit") -> Column:
    color = F.lit("lightgrey")
    for name, c in GRADE_COLORS.items():
        color = F.when(letter == name, c).otherwise(color)
    return F.concat(
        F.lit(f"https://img.shields.io/badge/{label}-"), letter, F.lit("%20("),
        value.cast("string"), F.lit(")-"), color,
    )


def quality_gate(scored: DataFrame, fail_below: int = 0, no_fail: bool = False) -> DataFrame:
    """A repository fails when it has findings or scores below the limit."""
    total = F.col("n_critical") + F.col("n_high") + F.col("n_medium") + F.col("n_low")
    failed = (total > 0) | (F.col("score") < fail_below)
    return scored.select(
        "repo_id",
        total.alias("findings"),
        "score",
        (~failed | F.lit(no_fail)).alias("passed"),
    )


def applied_rules(tier: Column, active_detectors: int = 4) -> Column:
    """Rule packs of the widest tier in use, which holds those of the others, plus detectors."""
    used = F.lit(0)
    for name in reversed(TIER_NAMES):
        packs = len({r.pack for r in RULES if name in r.tier_names})
        used = F.when(F.count_if(tier == name) > 0, packs).otherwise(used)
    return used + active_detectors


def scan_summary(
    detector: DataFrame,
    findings: DataFrame,
    changed_files: int | None = None,
    removed: int = 0,
) -> DataFrame:
    """One row for the whole scan with its summary line."""
    scored = detector.select(
        (F.col("confidence") >= AI_THRESHOLD).alias("ai"),
        F.col("scan_tier").alias("tier"),
        F.lit(None).cast("string").alias("severity"),
    )
    found = findings.select(
        F.lit(None).cast("boolean").alias("ai"), F.lit(None).cast("string").alias("tier"), "severity"
    )
    counts = scored.unionByName(found).agg(
        F.count("ai").alias("files_scanned"),
        F.count_if("ai").alias("ai_files"),
        F.count("severity").alias("findings"),
        applied_rules(F.col("tier")).alias("rules_applied"),
        *[F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES],
    )
    parts = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col(f"n_{s.lower()}") > 0,
                    F.concat(F.col(f"n_{s.lower()}").cast("string"), F.lit(" " + s)),
                )
                for s in SEVERITIES
            ]
        )
    )
    listed = F.when(
        F.size(parts) > 0, F.concat(F.lit(" ["), F.array_join(parts, ", "), F.lit("]"))
    ).otherwise("")
    head = (
        F.concat(F.col("files_scanned").cast("string"), F.lit(" files scanned"))
        if changed_files is None
        else F.lit(f"Diff mode: {changed_files} changed files scanned")
    )
    tail = f" (smart filter: removed {removed} likely false positives)" if removed else ""
    line = F.concat(
        head, F.lit(" ("), F.col("ai_files").cast("string"), F.lit(" AI-generated), "),
        F.col("findings").cast("string"), F.lit(" findings"), listed, F.lit(tail),
    )
    return counts.withColumn("summary", line)


def append_history(scored: DataFrame, path: str, timestamp: Column | None = None) -> None:
    """Append one row per repository to the score history."""
    at = F.current_timestamp() if timestamp is None else timestamp
    counts = [F.col(f"n_{s.lower()}").alias(f"{s.lower()}_count") for s in SEVERITIES]
    total = reduce(lambda a, b: a + b, [F.col(f"n_{s.lower()}") for s in SEVERITIES])
    scored.select(
        "repo_id", at.alias("ts"), "score", "grade", total.alias("findings_count"), *counts
    ).write.mode("append").parquet(path)


def score_trend(history: DataFrame) -> DataFrame:
    """Change of each score against the run before; no text for the first run."""
    runs = Window.partitionBy("repo_id").orderBy("ts")
    delta = F.col("score") - F.col("previous")
    since = F.concat(F.lit(" from last scan on "), F.date_format("previous_ts", "yyyy-MM-dd"))
    moved = (
        F.when(delta > 0, F.concat(F.lit("▲ +"), delta.cast("string"), since))
        .when(delta < 0, F.concat(F.lit("▼ "), delta.cast("string"), since))
        .when(delta == 0, F.concat(F.lit("── unchanged"), since))
    )
    return (
        history.withColumn("previous", F.lag("score").over(runs))
        .withColumn("previous_ts", F.lag("ts").over(runs))
        .withColumn("delta", delta)
        .withColumn("trend", moved)
        .drop("previous_ts")
    )
