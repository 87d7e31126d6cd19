"""Environment files in project roots: exposed values and missing ignore entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.plan import once
from codeaudit.functions.text import entropy, stripped
from codeaudit.operators.code import with_lines
from codeaudit.operators.findings import SOURCE_RANK, as_findings
from codeaudit.sources.constants import (
    ENTROPY_LIMIT,
    ENV_ENTRY,
    ENV_FILES,
    PLACEHOLDER,
    SECRET_NAME,
)


#: Copies of a project's ignore keys, over which its files are dealt.
SALTS = 16


def at_root(files: DataFrame) -> DataFrame:
    return files.where(F.col("rel_path") == F.col("file_name"))


def env_files(files: DataFrame) -> DataFrame:
    return at_root(files).where(F.col("file_name").isin(*ENV_FILES))


def ignore_patterns(files: DataFrame) -> DataFrame:
    """Distinct patterns of each project's ignore file, without trailing slashes."""
    lines = with_lines(at_root(files).where(F.col("file_name") == ".gitignore"))
    rows = lines.select("repo_id", "root", F.explode("raw").alias("raw"))
    text = stripped(F.col("raw"))
    return (
        rows.where((text != "") & ~text.startswith("#"))
        .select("repo_id", "root", F.rtrim(text, F.lit("/")).alias("pattern"))
        .distinct()
    )


def env_entries(files: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Key and value per line of each environment file, or of its first ``max_lines`` lines."""
    lines = with_lines(env_files(files))
    rows = lines.select(
        "repo_id",
        "file_id",
        "path",
        F.posexplode("raw" if max_lines is None else F.slice("raw", 1, max_lines)).alias("pos", "raw"),
    )
    text = stripped(F.col("raw"))
    value = F.btrim(
        stripped(F.regexp_extract(text, ENV_ENTRY, 2)), F.lit("'\"")
    )
    return rows.where(text.rlike(ENV_ENTRY)).select(
        "repo_id",
        "file_id",
        "path",
        (F.col("pos") + 1).alias("line"),
        F.regexp_extract(text, ENV_ENTRY, 1).alias("key"),
        once(value).alias("value"),
    )


def env_secrets(files: DataFrame) -> DataFrame:
    """Entries with a secret-like key and a value that is random or long."""
    value = F.col("value")
    return env_entries(files).where(
        (value != "")
        & F.col("key").rlike(SECRET_NAME)
        & ~value.rlike(PLACEHOLDER)
        & ((F.length(value) > 20) | (entropy(value) > ENTROPY_LIMIT))
    )


def uncovered(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """Candidates none of whose ``keys`` is a fact of their project.

    ``facts(repo_id, root, key)`` is distinct, and each candidate meets it once
    per key by an equi join.  All candidates of a project share some keys, so these
    are dealt over ``SALTS`` copies of the facts.  The verdict is an aggregate per
    file, combined before the shuffle, so the candidates are read a single time.
    """
    names = [c for c in candidates.columns if c != "keys"]
    salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
    present = facts.select("*", F.explode(salts).alias("_salt"), F.lit(1).alias("_found"))
    return (
        candidates.withColumn("key", F.explode("keys"))
        .withColumn("_salt", F.pmod(F.xxhash64("file_id"), F.lit(SALTS)).cast("int"))
        .drop("keys")
        .join(present, ["repo_id", "root", "key", "_salt"], "left")
        .drop("_salt")
        .groupBy(*names)
        .agg(F.count("_found").alias("_found"))
        .where(F.col("_found") == 0)
        .drop("_found")
    )


def ignore_keys(patterns: DataFrame) -> DataFrame:
    return patterns.withColumnRenamed("pattern", "key")


def env_keys(file_name: Column) -> Column:
    """The patterns that cover an environment file: its name and two fixed globs."""
    return F.array(file_name, F.lit(".env*"), F.lit("*.env"))


def env_not_ignored(files: DataFrame) -> DataFrame:
    """Environment files no ignore pattern covers."""
    candidates = env_files(files).select(
        "repo_id", "root", "file_id", "path", "file_name",
        env_keys(F.col("file_name")).alias("keys"),
    )
    return uncovered(candidates, ignore_keys(ignore_patterns(files)))


def env_findings(files: DataFrame) -> DataFrame:
    """Exposed values; whether the files are ignored is a check of the whole project."""
    return as_findings(
        env_secrets(files),
        rule_id="env-exposed-secret",
        severity="CRITICAL",
        file_path=F.col("path"),
        message=F.format_string("The value of %s looks like a live credential", F.col("key")),
        fix_guidance="Keep the file out of version control and rotate the value",
        cwe_id="CWE-798",
        rule_category="dotenv",
        source_rank=SOURCE_RANK["env"],
    )
