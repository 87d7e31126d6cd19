"""Dependency manifests: parsing, known-bad and vulnerable packages, pins and lock files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import once
from codeaudit.functions.text import split_lines, stripped, version_lt
from codeaudit.operators.envfiles import SALTS, at_root, uncovered
from codeaudit.operators.findings import SOURCE_RANK, as_findings
from codeaudit.sources.constants import (
    BAD_PACKAGES,
    DEPENDENCY_FILES,
    LOCK_FILES,
    NPM_VERSION,
    REGISTRY_ECOSYSTEMS,
    REQUIREMENT,
    VULNERABILITIES,
)

PROJECT_SECTION = r"(?s)(?:^|\n)\[project\][ \t]*\n(.*?)(?:\n\[|\z)"
DEPENDENCY_LIST = (
    r"""(?:^|\n)dependencies\s*=\s*\[([^\]"']*(?:(?:"[^"]*"|'[^']*')[^\]"']*)*+)\]"""
)
QUOTED = r""""[^"]*"|'[^']*'"""
_CHECK_ADVICE = "Check that the package exists before it is installed"

_ENTRIES = "array<struct<line:int,name:string,version:string>>"


def bad_package_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Known invented package names, from a JSON file (ecosystem → names) or built in."""
    if path:
        loaded = spark.read.json(path, multiLine=True)
        lists = [
            F.struct(F.lit(c).alias("ecosystem"), F.col(c).alias("names"))
            for c, t in loaded.dtypes
            if t == "array<string>"
        ]
        return (
            loaded.select(F.explode(F.array(*lists)).alias("x"))
            .select("x.ecosystem", F.explode("x.names").alias("name"))
        )
    rows = [(eco, n) for eco, names in BAD_PACKAGES.items() for n in names]
    return spark.createDataFrame(rows, "ecosystem string, name string")


def vulnerability_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Known vulnerable packages, from a JSON snapshot (ecosystem → package → row) or built in."""
    if path:
        row = "struct<safe_from:string,known_cves:array<string>,severity:string>"
        loaded = spark.read.schema(f"packages map<string,map<string,{row}>>").json(
            path, multiLine=True
        )
        return (
            loaded.select(F.explode("packages").alias("ecosystem", "p"))
            .select("ecosystem", F.explode("p").alias("name", "v"))
            .select("ecosystem", "name", "v.*")
        )
    rows = [(e, n, s, list(c), v) for e, n, s, c, v in VULNERABILITIES]
    return spark.createDataFrame(
        rows,
        "ecosystem string, name string, safe_from string, known_cves array<string>, "
        "severity string",
    )


def manifests(files: DataFrame) -> DataFrame:
    """Dependency files in project roots with their ecosystem."""
    eco = F.lit(None).cast("string")
    for name, value in DEPENDENCY_FILES.items():
        eco = F.when(F.col("file_name") == name, value).otherwise(eco)
    named = at_root(files).where(F.col("file_name").isin(*DEPENDENCY_FILES))
    return named.withColumn("ecosystem", eco)


def _entry(line: Column, text: Column) -> Column:
    return F.struct(
        line.cast("int").alias("line"),
        F.regexp_extract(text, REQUIREMENT, 1).alias("name"),
        F.regexp_extract(text, REQUIREMENT, 3).alias("version"),
    )


def requirement_entries(content: Column) -> Column:
    """Name and version per requirement line; other manifests are read the same way."""
    lines = F.transform(
        split_lines(content), lambda x, i: F.struct(stripped(x).alias("x"), (i + 1).alias("n"))
    )
    wanted = F.filter(
        lines,
        lambda l: ~l.x.startswith("#") & ~l.x.startswith("-") & l.x.rlike(REQUIREMENT),
    )
    return F.transform(wanted, lambda l: _entry(l.n, l.x))


def package_json_entries(content: Column) -> Column:
    """Both dependency sections of package.json; every entry is on line 1."""
    sections = F.from_json(
        content, "dependencies MAP<STRING,STRING>, devDependencies MAP<STRING,STRING>"
    )
    none = F.array().cast("array<struct<key:string,value:string>>")
    entries = F.concat(
        F.coalesce(F.map_entries(sections.dependencies), none),
        F.coalesce(F.map_entries(sections.devDependencies), none),
    )
    return F.transform(
        entries,
        lambda e: F.struct(
            F.lit(1).alias("line"),
            e.key.alias("name"),
            F.regexp_extract(F.coalesce(e.value, F.lit("")), NPM_VERSION, 1).alias("version"),
        ),
    )


def pyproject_entries(content: Column) -> Column:
    """The project's dependency list; the line is the place in the list."""
    section = F.regexp_extract(content, PROJECT_SECTION, 1)
    quoted = F.regexp_extract_all(
        F.regexp_extract(section, DEPENDENCY_LIST, 1), F.lit(QUOTED), F.lit(0)
    )
    items = F.transform(
        quoted,
        lambda q, i: F.struct(
            stripped(F.substring(q, F.lit(2), F.length(q) - 2)).alias("x"), (i + 1).alias("n")
        ),
    )
    return F.transform(F.filter(items, lambda l: l.x.rlike(REQUIREMENT)), lambda l: _entry(l.n, l.x))


def dependencies(files: DataFrame) -> DataFrame:
    """All dependencies of all manifests in one pass, with the name as it is compared."""
    name, content = F.col("file_name"), F.col("content")
    entries = (
        F.when(name == "package.json", package_json_entries(content).cast(_ENTRIES))
        .when(name == "pyproject.toml", pyproject_entries(content).cast(_ENTRIES))
        .otherwise(requirement_entries(content).cast(_ENTRIES))
    )
    rows = manifests(files).withColumn("_e", once(entries)).select(
        "repo_id", "file_id", "path", "file_name", "ecosystem", F.inline("_e")
    )
    return rows.withColumn("package", F.lower(F.trim("name")))


def parse_requirements(files: DataFrame) -> DataFrame:
    other = ("package.json", "pyproject.toml")
    return dependencies(files.where(~F.col("file_name").isin(*other)))


def parse_package_json(files: DataFrame) -> DataFrame:
    return dependencies(files.where(F.col("file_name") == "package.json"))


def parse_pyproject(files: DataFrame) -> DataFrame:
    return dependencies(files.where(F.col("file_name") == "pyproject.toml"))


def bad_packages(deps: DataFrame, names: DataFrame) -> DataFrame:
    """Dependencies on known invented names; the list is a fixed small table."""
    known = F.broadcast(names.select("ecosystem", F.col("name").alias("package")))
    return deps.join(known, ["ecosystem", "package"], "left_semi")


def vulnerable_versions(deps: DataFrame, vulns: DataFrame) -> DataFrame:
    known = F.broadcast(vulns.withColumnRenamed("name", "package"))
    return (
        deps.where(F.col("version") != "")
        .join(known, ["ecosystem", "package"])
        .where((F.col("safe_from") != "") & version_lt(F.col("version"), F.col("safe_from")))
        .withColumn("advisories", F.array_join("known_cves", ", "))
        .drop("known_cves")
    )


def unpinned(deps: DataFrame) -> DataFrame:
    return deps.where(F.col("version") == "")


def unknown_packages(deps: DataFrame, registry: DataFrame, names: DataFrame) -> DataFrame:
    """Dependencies a registry snapshot ``(ecosystem, package)`` does not list.

    Names are compared once each, so a package used by a third of all projects
    costs one row in the anti join.  On the way back to its uses an unlisted name is
    copied over ``SALTS``, among which the uses are dealt.
    """
    known_bad = F.broadcast(names.select("ecosystem", F.col("name").alias("package")))
    asked = deps.where(F.col("ecosystem").isin(*REGISTRY_ECOSYSTEMS)).join(
        known_bad, ["ecosystem", "package"], "left_anti"
    )
    missing = (
        asked.select("ecosystem", "package")
        .distinct()
        .join(registry.select("ecosystem", "package").distinct(), ["ecosystem", "package"], "left_anti")
    )
    salted = missing.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = asked.withColumn("_salt", F.pmod(F.xxhash64("file_id", "line"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["ecosystem", "package", "_salt"], "left_semi").drop("_salt")


def lock_keys(file_name: Column) -> Column:
    """The lock files that go with a manifest; null for any other file."""
    keys = F.lit(None).cast("array<string>")
    for manifest, locks in LOCK_FILES.items():
        keys = F.when(file_name == manifest, F.array(*[F.lit(x) for x in locks])).otherwise(keys)
    return keys


def lock_facts(files: DataFrame) -> DataFrame:
    """Lock files present in each project root."""
    names = sorted({lock for locks in LOCK_FILES.values() for lock in locks})
    return (
        at_root(files)
        .where(F.col("file_name").isin(*names))
        .select("repo_id", "root", F.col("file_name").alias("key"))
        .distinct()
    )


def missing_locks(files: DataFrame) -> DataFrame:
    """Manifests in whose project root none of their lock files exists."""
    candidates = at_root(files).where(F.col("file_name").isin(*LOCK_FILES)).select(
        "repo_id", "root", "file_id", "path", "file_name",
        lock_keys(F.col("file_name")).alias("keys"),
    )
    return uncovered(candidates, lock_facts(files))


def dependency_findings(files: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Invented, vulnerable and unpinned packages in one pass over the manifests.

    Both lists are small fixed tables, looked up for every dependency at once;
    each dependency then gives the findings that apply to it.  A registry
    snapshot, whose size is not known, takes a join of its own.
    """
    spark = files.sparkSession
    deps = dependencies(files)
    names = bad_package_table(spark)
    bad = F.broadcast(
        names.select("ecosystem", F.col("name").alias("package"), F.lit(True).alias("is_bad"))
    )
    vulns = F.broadcast(vulnerability_table(spark).withColumnRenamed("name", "package"))
    looked_up = deps.join(bad, ["ecosystem", "package"], "left").join(
        vulns, ["ecosystem", "package"], "left"
    )
    package, version = F.col("package"), F.col("version")

    def found(condition, rule_id, severity, message, advice, cwe):
        return F.when(
            condition,
            F.struct(
                F.lit(rule_id).alias("rule_id"), severity.alias("severity"),
                message.alias("message"), advice.alias("fix_guidance"), F.lit(cwe).alias("cwe_id"),
            ),
        )

    hits = F.array_compact(
        F.array(
            found(
                F.col("is_bad"), "dep-unknown-package", F.lit("CRITICAL"),
                F.format_string("Package '%s' is a known invented name", package),
                F.lit(_CHECK_ADVICE), "CWE-829",
            ),
            found(
                (version != "")
                & (F.col("safe_from") != "")
                & version_lt(version, F.col("safe_from")),
                "dep-known-vulnerability", F.col("severity"),
                F.format_string(
                    "Package '%s' %s has known advisories: %s",
                    package, version, F.array_join("known_cves", ", "),
                ),
                F.concat(F.lit("Upgrade to "), package, F.lit(">="), F.col("safe_from")),
                "CWE-1395",
            ),
            found(
                version == "", "dep-unpinned", F.lit("MEDIUM"),
                F.format_string("Package '%s' has no version", package),
                F.lit("Pin the package to a version"), "CWE-1357",
            ),
        )
    )
    rows = looked_up.withColumn("hits", once(hits)).select(
        "repo_id", "file_id", "path", "line", F.inline("hits")
    )
    common = {
        "file_path": F.col("path"),
        "rule_category": "sca",
        "source_rank": SOURCE_RANK["dependencies"],
    }
    out = as_findings(rows, fix_guidance=F.col("fix_guidance"), **common)
    if registry is None:
        return out
    missing = as_findings(
        unknown_packages(deps, registry, names),
        rule_id="dep-unknown-package",
        severity="CRITICAL",
        message=F.format_string("Package '%s' is not in the registry", package),
        fix_guidance=_CHECK_ADVICE,
        cwe_id="CWE-829",
        **common,
    )
    return out.unionByName(missing)
