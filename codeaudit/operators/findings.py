"""The findings table: its shape, and the operators over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.plan import broadcast_if_small, once
from codeaudit.operators.code import with_lines
from codeaudit.sources.constants import MATCHER_SEVERITIES, SEVERITIES

FINDING_COLUMNS = (
    "repo_id", "file_id", "rule_id", "severity", "file_path", "line", "col", "message",
    "fix_guidance", "cwe_id", "ai_context", "file_confidence", "rule_category", "snippet",
    "source_rank",
)

# Arrival order of the detectors; the first finding of a key wins.
SOURCE_RANK = {
    "FULL": 0, "MEDIUM": 1, "CRITICAL_ONLY": 2,
    "secrets": 3, "dependencies": 4, "env": 5, "config": 6, "injection": 7,
}
UNKNOWN_SEVERITY_RANK = 99


def severity_rank(severity: Column) -> Column:
    rank = F.lit(UNKNOWN_SEVERITY_RANK)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def severity_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(s, i) for i, s in enumerate(SEVERITIES)], "severity string, severity_rank int"
    )


def severity_label(label: Column, matcher_severity: Column) -> Column:
    """A rule's own label, else the matcher's severity translated, else MEDIUM."""
    fallback = F.lit("MEDIUM")
    for name, value in MATCHER_SEVERITIES.items():
        fallback = F.when(matcher_severity == name, value).otherwise(fallback)
    return F.coalesce(F.nullif(label, F.lit("")), fallback)


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "FULL", 0).when(tier == "MEDIUM", 1).otherwise(2)


def as_findings(df: DataFrame, *extra: str, **columns) -> DataFrame:
    """Project detector output to the finding shape; plain values become literals.

    Missing columns get the defaults every detector shares: column 1, no
    snippet, no confidence.
    """
    defaults = {
        "col": 1, "snippet": "", "file_confidence": 0.0, "fix_guidance": "", "ai_context": "",
    }
    merged = {**defaults, **columns}

    def value(name):
        if name in merged:
            v = merged[name]
            return v if isinstance(v, Column) else F.lit(v)
        return F.col(name)

    typed = {
        "line": "int", "col": "int", "source_rank": "int", "file_confidence": "double",
    }
    out = [
        (value(c).cast(typed[c]) if c in typed else value(c)).alias(c) for c in FINDING_COLUMNS
    ]
    return df.select(*out, *extra).where((F.col("rule_id") != "") & (F.col("file_path") != ""))


def filter_severity(findings: DataFrame, minimum: str = "MEDIUM") -> DataFrame:
    """Keep findings at least as severe as ``minimum``; unknown severities are dropped."""
    limit = SEVERITIES.index(minimum) if minimum in SEVERITIES else SEVERITIES.index("MEDIUM")
    return findings.where(severity_rank(F.col("severity")) <= limit)


def is_critical_or_high(severity: Column) -> Column:
    return severity.isin("CRITICAL", "HIGH")


def deduplicate(findings: DataFrame) -> DataFrame:
    """Keep the first finding per rule, file and line in arrival order.

    The path is part of the key, so a hot rule or repository spreads over the
    cluster, and each task drops its own later duplicates before the shuffle.
    """
    order = Window.partitionBy("rule_id", "file_path", "line").orderBy(
        "source_rank", "file_id", "col", "message"
    )
    return (
        findings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") == 1).drop("_n")
    )


def suppress(findings: DataFrame, ignore_rules: DataFrame) -> DataFrame:
    """Drop findings of the rules listed in ``ignore_rules(rule_id)``."""
    return findings.join(ignore_rules.select("rule_id").distinct(), "rule_id", "left_anti")


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drop CRITICAL and HIGH findings judged false; anything else stays."""
    rejected = (
        verdicts.where(F.upper("verdict") == "FALSE")
        .select("rule_id", "file_path", "line")
        .distinct()
        .withColumn("reviewed", F.lit(True))
    )
    return findings.withColumn("reviewed", is_critical_or_high(F.col("severity"))).join(
        rejected, ["rule_id", "file_path", "line", "reviewed"], "left_anti"
    ).drop("reviewed")


def with_confidence(findings: DataFrame, detector: DataFrame) -> DataFrame:
    """Look up the confidence of each finding's file; 0 where the file was not scored."""
    scores = detector.select("file_id", F.col("confidence").alias("_c"))
    return (
        findings.join(scores, "file_id", "left")
        .withColumn("file_confidence", F.coalesce("_c", F.lit(0.0)))
        .drop("_c")
    )


def ordered(findings: DataFrame) -> DataFrame:
    """Most severe first, then by place."""
    return findings.orderBy(
        severity_rank(F.col("severity")), "file_path", "line", "col", "rule_id"
    )


def context_of(window: int = 5) -> Column:
    """The lines of ``raw`` from ``window`` before to ``window`` after ``line``."""
    first = F.greatest(F.col("line") - window, F.lit(1))
    last = F.least(F.col("line") + window, F.size("raw"))
    return F.array_join(F.slice("raw", first, F.greatest(last - first + 1, F.lit(0))), "\n")


def with_context(findings: DataFrame, files: DataFrame, window: int = 5) -> DataFrame:
    """Add the lines around findings that were stored without them.

    Only files with findings are split into lines, and the window is a slice of
    the line array, so no line table is shuffled.
    """
    keys = broadcast_if_small(findings.select("file_id").distinct())
    lines = with_lines(files.join(keys, "file_id", "left_semi")).select("file_id", "raw")
    return (
        findings.join(lines, "file_id").withColumn("context", context_of(window)).drop("raw")
    )


def with_explanations(findings: DataFrame, explanations: DataFrame) -> DataFrame:
    """A generated text where there is one, else the rule's guidance."""
    texts = explanations.select("rule_id", "file_path", "line", F.col("text").alias("_text"))
    return (
        findings.join(texts, ["rule_id", "file_path", "line"], "left")
        .withColumn(
            "explanation", F.coalesce("_text", F.nullif(F.col("fix_guidance"), F.lit("")))
        )
        .drop("_text")
    )


def apply_line_fixes(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Replace single lines of files by new text; lines that do not exist are ignored.

    ``replacements(file_path, line, new_text)`` is grouped per file, at most one
    entry per line, so a group is bounded by the length of its file.  Every line
    keeps the line break it had, and a last line without one stays so.
    """
    per_file = (
        replacements.groupBy("file_path", "line")
        .agg(F.min("new_text").alias("new_text"))
        .groupBy("file_path")
        .agg(F.map_from_entries(F.collect_list(F.struct("line", "new_text"))).alias("_fixes"))
        .withColumnRenamed("file_path", "path")
    )
    breaks = F.regexp_extract_all("content", F.lit(r"\r\n|\n|\r"), F.lit(0))
    fixed = F.transform(
        "raw",
        lambda x, i: F.concat(
            F.coalesce(F.element_at(F.col("_fixes"), i + 1), x),
            F.coalesce(F.get(F.col("_breaks"), i), F.lit("")),
        ),
    )
    return (
        with_lines(files)
        .join(broadcast_if_small(per_file), "path")
        .withColumn("_breaks", once(breaks))
        .withColumn("fixed_content", F.array_join(fixed, ""))
        .drop("raw", "_fixes", "_breaks")
    )


def fix_diff_rows(files: DataFrame, replacements: DataFrame) -> DataFrame:
    """Removed and added lines of each replacement; an unchanged line gives no row."""
    per_file = replacements.groupBy(F.col("file_path").alias("path")).agg(
        F.collect_list(F.struct("line", "new_text")).alias("_fixes")
    )
    lines = with_lines(files.join(broadcast_if_small(per_file), "path"))
    raw = F.col("raw")

    def rows(fix):
        old = F.get(raw, fix["line"] - 1)
        new = F.split(fix["new_text"], "\n", -1)
        removed = F.struct(
            fix["line"].alias("line"), F.lit("-").alias("mark"), F.lit(1).alias("seq"),
            old.alias("text"),
        )
        added = F.transform(
            new,
            lambda x, i: F.struct(
                fix["line"].alias("line"), F.lit("+").alias("mark"), (i + 1).alias("seq"),
                x.alias("text"),
            ),
        )
        return F.when(
            (fix["line"] >= 1) & (fix["line"] <= F.size(raw)) & (old != fix["new_text"]),
            F.concat(F.array(removed), added),
        )

    # a file with its replacements gives only the rows that differ; its text goes no further
    found = F.flatten(F.array_compact(F.transform("_fixes", rows)))
    return lines.select(F.col("path").alias("file_path"), F.inline(found))


def fix_diffs(files: DataFrame, replacements: DataFrame, context: int = 3) -> DataFrame:
    """(file_path, diff): the unified diff of each file that replacements change.

    Only lines within ``context`` of a change leave their file.  A replaced line that stands
    among its new lines stays; lines removed one after another come before what is added for
    them; changes with more than twice ``context`` lines between them are hunks of their own.
    Lines that do not exist and replacements that change nothing are ignored.
    """
    per_file = replacements.groupBy("file_path", "line").agg(F.min("new_text").alias("new_text"))
    per_file = per_file.groupBy(F.col("file_path").alias("path")).agg(
        F.map_from_entries(F.collect_list(F.struct("line", "new_text"))).alias("_fixes")
    )
    lines = with_lines(files.join(broadcast_if_small(per_file), "path")).select("path", "raw", "_fixes")
    size = F.size("raw")
    changed = F.filter(F.map_keys("_fixes"), lambda n: (n >= 1) & (n <= size)
                       & (F.element_at("_fixes", n) != F.get("raw", n - 1)))

    def sides(n):
        new = F.split(F.element_at("_fixes", n), "\n", -1)
        return F.get("raw", n - 1), new, F.array_position(new, F.get("raw", n - 1)).cast("int")

    def around(n):
        _, new, kept = sides(n)  # a kept line with changes on one side only is context itself
        first = n - context + (kept == 1).cast("int")
        last = n + context - (kept == F.size(new)).cast("int")
        return F.sequence(F.greatest(first, F.lit(1)), F.least(last, size))

    near = F.array_distinct(F.flatten(F.transform(changed, around)))

    def items(n):
        old, new, kept = sides(n)
        added = F.transform(new, lambda x, i: F.struct(
            F.when(i + 1 == kept, " ").otherwise("+").alias("mark"), x.alias("text")))
        gone = F.struct(F.lit("-").alias("mark"), old.alias("text"))
        own = F.struct(F.lit(" ").alias("mark"), old.alias("text"))
        return F.when(~F.array_contains(changed, n), F.array(own)).when(kept > 0, added).otherwise(
            F.concat(F.array(gone), added)
        )

    rows = lines.select("path", F.explode(F.transform(
        near, lambda n: F.struct(n.cast("int").alias("n"), items(n).alias("items")))).alias("l"))
    rows = rows.select("path", "l.n", F.posexplode("l.items").alias("seq", "item"))
    rows = rows.select("path", "n", "seq", "item.mark", "item.text")
    # windows hold the lines around the changes of one file
    order = Window.partitionBy("path").orderBy("n", "seq")
    is_old = (F.col("mark") != "+").cast("int")
    is_new = (F.col("mark") != "-").cast("int")
    opens = F.coalesce(F.col("n") - F.lag("n").over(order) > 1, F.lit(True)).cast("int")
    placed = rows.withColumns({
        "hunk": F.sum(opens).over(order), "run": F.sum((F.col("mark") == " ").cast("int")).over(order),
        "ahead": F.sum(is_new - is_old).over(order) - (is_new - is_old),
    })
    rank = F.when(F.col("mark") == " ", 0).when(F.col("mark") == "-", 1).otherwise(2)
    line = F.concat("mark", "text")
    hunks = placed.groupBy("path", "hunk").agg(
        F.min("n").alias("first"), F.sum(is_old).alias("old"), F.sum(is_new).alias("new"),
        F.min_by("ahead", F.struct("n", "seq")).alias("ahead"),
        F.sort_array(F.collect_list(F.struct("run", rank.alias("rank"), "n", "seq", line.alias("line")))).alias("lines"),
    )

    def span(start, count):
        return F.when(count == 1, start.cast("string")).otherwise(F.concat_ws(",", start, count))

    text = F.concat(
        F.lit("@@ -"), span(F.col("first"), F.col("old")), F.lit(" +"),
        span(F.col("first") + F.col("ahead"), F.col("new")), F.lit(" @@\n"),
        F.array_join(F.transform("lines", lambda l: F.concat(l["line"], F.lit("\n"))), ""),
    )
    whole = F.sort_array(F.collect_list(F.struct("first", text.alias("text"))))
    return hunks.groupBy(F.col("path").alias("file_path")).agg(F.concat(
        F.lit("--- a/"), F.first("path"), F.lit("\n+++ b/"), F.first("path"), F.lit("\n"),
        F.array_join(F.transform(whole, lambda h: h["text"]), ""),
    ).alias("diff"))
