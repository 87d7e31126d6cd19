"""Agent configuration files: secrets in their JSON, and missing ignore entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.plan import once, written
from codeaudit.functions.text import entropy, masked
from codeaudit.operators.envfiles import ignore_keys, ignore_patterns, uncovered
from codeaudit.operators.findings import SOURCE_RANK, as_findings
from codeaudit.sources.constants import (
    AGENT_CONFIG_PATHS,
    ENTROPY_LIMIT,
    SECRET_NAME,
)

_NODES = "array<struct<key:string,value:variant>>"
#: Levels of nesting opened in one pass.
LEVELS = 20


def is_config(rel_path: Column, file_name: Column) -> Column:
    name = F.lower(file_name)
    by_name = file_name.endswith(".json") & (name.startswith("mcp") | name.endswith("mcp.json"))
    return rel_path.isin(*AGENT_CONFIG_PATHS) | by_name


def config_files(files: DataFrame) -> DataFrame:
    return files.where(is_config(F.col("rel_path"), F.col("file_name")))


def config_strings(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every string value with the key above it; list items keep theirs.

    ``LEVELS`` levels are one pass over the row's own nodes, so the walk neither
    recurses over rows nor shuffles.  What is nested deeper is the frontier of a further
    round, until there is none: few configurations need a second one.  Only with
    ``max_depth`` are deeper strings left out.  Text that is not JSON, or nested deeper
    than the JSON reader goes (1,000 levels), gives no rows.
    """
    # A key repeated in one object takes its last value; by default Spark refuses the text.
    files.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    at = ["repo_id", "file_id", "path"]
    open_ = config_files(files).select(*at, F.lit("").alias("key"), F.col("content").alias("text"))
    if max_depth is not None:
        return _leaves(_opened(open_, max_depth)).select(*at, "key", "value")
    found = None
    while True:
        nodes = written(_leaves(_opened(open_, LEVELS), nested=True), "config-nodes")
        leaves = nodes.where("NOT is_open").select(*at, "key", "value")
        found = leaves if found is None else found.unionByName(leaves)
        open_ = nodes.where("is_open").withColumnRenamed("value", "text").drop("is_open")
        if open_.isEmpty():
            return found


def _opened(texts: DataFrame, levels: int) -> DataFrame:
    """``nodes``: what JSON ``texts`` hold ``levels`` levels down, and strings above that."""
    start = F.struct(F.col("key").alias("key"), F.try_parse_json(F.col("text")).alias("value"))
    df = texts.select(
        "repo_id", "file_id", "path", once(F.array(start).cast(_NODES)).alias("nodes")
    )
    kind = "schema_of_variant(n.value)"
    for _ in range(levels):
        children = F.expr(
            f"""
            flatten(transform(nodes, n -> CASE
              WHEN {kind} LIKE 'OBJECT%' THEN
                transform(map_entries(CAST(n.value AS MAP<STRING, VARIANT>)),
                          e -> named_struct('key', e.key, 'value', e.value))
              WHEN {kind} LIKE 'ARRAY%' THEN
                transform(CAST(n.value AS ARRAY<VARIANT>),
                          v -> named_struct('key', n.key, 'value', v))
              ELSE array(n) END))
            """
        )
        nested = F.expr(
            f"exists(nodes, n -> {kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%')"
        )
        df = df.withColumn(
            "nodes", once(F.when(nested, children.cast(_NODES)).otherwise(F.col("nodes")))
        )
    return df


def _leaves(opened: DataFrame, nested: bool = False) -> DataFrame:
    """String values of ``nodes``; with ``nested`` also the values still to be opened, as JSON."""
    kind = "schema_of_variant(n.value)"
    open_ = f"{kind} LIKE 'OBJECT%' OR {kind} LIKE 'ARRAY%'" if nested else "false"
    kept = F.expr(f"filter(nodes, n -> {kind} = 'STRING' OR {open_})")
    rows = opened.select("repo_id", "file_id", "path", F.inline(kept))
    is_open = F.expr("schema_of_variant(value) <> 'STRING'")
    text = F.when(is_open, F.to_json("value")).otherwise(F.col("value").cast("string"))
    columns = ["repo_id", "file_id", "path", "key", text.alias("value")]
    return rows.select(*columns, *([is_open.alias("is_open")] if nested else []))


def config_secrets(files: DataFrame) -> DataFrame:
    value = F.col("value")
    is_url = value.startswith("http://") | value.startswith("https://")
    random = (F.length(value) > 15) & (entropy(value) > ENTROPY_LIMIT)
    return (
        config_strings(files)
        .where((F.length(value) >= 8) & ~is_url & (F.col("key").rlike(SECRET_NAME) | random))
        .withColumn("masked", masked(value))
    )


def config_keys(rel_path: Column, file_name: Column) -> Column:
    """Every pattern that covers a configuration file, spelled out from its path.

    A pattern covers a file as its path or name, as a folder above it (``dir``
    or ``dir/*``) or as ``*`` and an ending of the path.  Their number is bounded
    by the length of the path.
    """
    parts = F.split(rel_path, "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    below = F.transform(
        F.slice(folders, F.lit(1), F.size(folders) - 1), lambda d: F.concat(d, F.lit("/*"))
    )
    endings = F.transform(
        F.sequence(F.lit(1), F.length(rel_path) + 1),
        lambda n: F.concat(F.lit("*"), F.substring(rel_path, n, F.length(rel_path))),
    )
    return F.array_union(F.concat(F.array(rel_path, file_name), folders, below), endings)


def config_not_ignored(files: DataFrame) -> DataFrame:
    """Configuration files no ignore pattern covers, as an equi join on (project, pattern)."""
    candidates = config_files(files).select(
        "repo_id", "root", "file_id", "path", "rel_path",
        config_keys(F.col("rel_path"), F.col("file_name")).alias("keys"),
    )
    return uncovered(candidates, ignore_keys(ignore_patterns(files)))


def config_findings(files: DataFrame) -> DataFrame:
    """Secrets in configurations; whether the files are ignored is a project check."""
    return as_findings(
        config_secrets(files),
        rule_id="config-secret",
        severity="CRITICAL",
        file_path=F.col("path"),
        line=1,
        message=F.format_string(
            "The configuration holds a secret under '%s': %s", F.col("key"), F.col("masked")
        ),
        fix_guidance="Pass the credential at run time instead",
        cwe_id="CWE-798",
        rule_category="mcp_config",
        source_rank=SOURCE_RANK["config"],
    )
