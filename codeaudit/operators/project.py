"""Checks that compare the files of one project: ignore entries and lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.operators.agentconfig import config_keys, is_config
from codeaudit.operators.dependencies import lock_facts, lock_keys
from codeaudit.operators.envfiles import env_keys, ignore_keys, ignore_patterns, uncovered
from codeaudit.operators.findings import SOURCE_RANK, as_findings
from codeaudit.sources.constants import DEPENDENCY_FILES, ENV_FILES, LOCK_FILES


def is_project_file(rel_path: Column, file_name: Column) -> Column:
    """Files the project detectors read: manifests, locks, environment, ignore and config files."""
    locks = {lock for names in LOCK_FILES.values() for lock in names}
    at_top = sorted({*DEPENDENCY_FILES, *locks, *ENV_FILES, ".gitignore"})
    return ((rel_path == file_name) & file_name.isin(*at_top)) | is_config(rel_path, file_name)


def project_findings(files: DataFrame) -> DataFrame:
    """Unignored environment files and agent configurations, and missing lock files.

    The three checks have one shape: a file is fine when one of its keys is a
    fact of its project.  The candidates are read in one pass over the names,
    the facts in two, and everything shuffled is a name or a pattern.
    """
    name, rel = F.col("file_name"), F.col("rel_path")
    at_top = rel == name
    is_env = at_top & name.isin(*ENV_FILES)
    is_manifest = at_top & name.isin(*LOCK_FILES)

    def marked(space, keys):
        return F.transform(keys, lambda k: F.concat(F.lit(space), k))

    candidates = files.where(is_env | is_manifest | is_config(rel, name)).select(
        "repo_id", "root", "file_id", "path", "rel_path", "file_name",
        F.when(is_env, "env").when(is_manifest, "lock").otherwise("config").alias("check"),
        F.when(is_env, marked("ignore:", env_keys(name)))
        .when(is_manifest, marked("lock:", lock_keys(name)))
        .otherwise(marked("ignore:", config_keys(rel, name)))
        .alias("keys"),
    )
    facts = (
        ignore_keys(ignore_patterns(files))
        .withColumn("key", F.concat(F.lit("ignore:"), "key"))
        .unionByName(lock_facts(files).withColumn("key", F.concat(F.lit("lock:"), "key")))
    )
    check = F.col("check")

    def choose(env, lock, config):
        return F.when(check == "env", env).when(check == "lock", lock).otherwise(config)

    return as_findings(
        uncovered(candidates, facts),
        rule_id=choose(
            F.lit("env-not-ignored"), F.lit("dep-no-lock-file"), F.lit("config-not-ignored")
        ),
        severity=choose(F.lit("CRITICAL"), F.lit("MEDIUM"), F.lit("CRITICAL")),
        file_path=F.col("path"),
        line=1,
        message=choose(
            F.lit("The environment file is not in the ignore file"),
            F.format_string("'%s' has no lock file", name),
            F.lit("The agent configuration is not in the ignore file"),
        ),
        fix_guidance=choose(
            F.lit("Add the file to the ignore file"),
            F.lit("Write a lock file"),
            F.concat(F.lit("Add "), rel, F.lit(" to the ignore file")),
        ),
        cwe_id=choose(F.lit("CWE-538"), F.lit("CWE-1357"), F.lit("CWE-538")),
        rule_category=choose(F.lit("dotenv"), F.lit("sca"), F.lit("mcp_config")),
        source_rank=choose(
            F.lit(SOURCE_RANK["env"]),
            F.lit(SOURCE_RANK["dependencies"]),
            F.lit(SOURCE_RANK["config"]),
        ),
    )
