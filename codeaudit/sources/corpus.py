"""File tables: from a folder tree, and from the document table.

The common shape is ``file_id, repo_id, root, path, rel_path, file_name, ext,
language, content``; ``root`` is the project folder, ``rel_path`` the path below
it.
"""

from __future__ import annotations

import os
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import broadcast_if_small
from codeaudit.functions.text import extension_of
from codeaudit.sources.constants import (
    LANGUAGE_BY_EXTENSION,
    SKIP_DIR_SUFFIX,
    SKIP_DIRS,
    SOURCE_EXTENSIONS,
)
from codeaudit.sources.snippets import SNIPPETS
from codeaudit.sources.tree import tree_reader

FILE_COLUMNS = (
    "file_id", "repo_id", "root", "path", "rel_path", "file_name", "ext", "language", "content",
)


def language_of(file_name: Column, ext: Column) -> Column:
    """Rule language of a file; an empty text when no rule applies."""
    by_ext = F.when(file_name == "Dockerfile", "dockerfile")
    for suffix, language in LANGUAGE_BY_EXTENSION.items():
        by_ext = by_ext.when(ext == suffix, language)
    return by_ext.otherwise("")


def is_skipped(path: Column, skip_dirs=SKIP_DIRS) -> Column:
    """True when a part of the path is a folder that is never scanned."""
    parts = F.split(path, "/")
    named = F.arrays_overlap(parts, F.array(*[F.lit(d) for d in skip_dirs]))
    return named | F.exists(parts, lambda p: p.endswith(SKIP_DIR_SUFFIX))


def is_source(file_name: Column, ext: Column, extensions=SOURCE_EXTENSIONS) -> Column:
    dotted = [e if e.startswith(".") else f".{e}" for e in extensions]
    return ext.isin(*dotted) | (file_name == "Dockerfile")


def source_files(files: DataFrame, extensions=SOURCE_EXTENSIONS, exclude_paths=()) -> DataFrame:
    """The files the detector scores: right extension, not below a skipped folder."""
    kept = files.where(
        is_source(F.col("file_name"), F.col("ext"), extensions) & ~is_skipped(F.col("rel_path"))
    )
    for prefix in exclude_paths:
        kept = kept.where(~F.col("rel_path").startswith(prefix))
    return kept


def changed_only(files: DataFrame, changed_paths: DataFrame) -> DataFrame:
    """Keep the files named by ``changed_paths(repo_id, path)``.

    A short list is broadcast, so contents stay where they are read; a long one
    takes a shuffle join whose key holds the path, so a hot repository spreads.
    """
    keys = changed_paths.select("repo_id", "path").distinct()
    return files.join(broadcast_if_small(keys), ["repo_id", "path"], "left_semi")


def scan_tree(
    spark: SparkSession,
    root: str,
    repo_id: str = "local",
    project_depth: int = 0,
    skip_dirs=SKIP_DIRS,
    hidden: bool = True,
) -> DataFrame:
    """File table of a folder tree or of one file; bytes are decoded leniently.

    Files below ``skip_dirs`` are left out by their path before they are opened; parts of
    ``root`` itself do not count.  With ``project_depth`` the tree holds many projects that
    many folders down: the folders name the repository, and paths start below them.
    Unreadable files are left out.  Spark's file readers pass over files and folders whose
    names start with a dot or an underscore; with ``hidden`` those are read by the data
    source of ``sources.tree``, which needs a root that Python can reach as well.
    """
    top = root if "://" in root or root.startswith("/") else os.path.abspath(root)
    top = top.rstrip("/") or "/"
    place = re.sub(r"^[a-z0-9]+:/*", "/", top) if top.startswith("file:") else top
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .load(top)
    )

    def below(path: Column, base: str) -> Column:
        base = base.rstrip("/") + "/"
        name = F.element_at(F.split(path, "/"), -1)
        return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(name)

    # the listed path, in which characters are escaped; a filter on it prunes the listing
    listed = F.regexp_replace("_metadata.file_path", "^file:/*", "/")
    raw = raw.where(~is_skipped(below(listed, quote(place, safe="/:@")), skip_dirs))
    raw = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    if hidden:
        raw = raw.unionByName(hidden_files(spark, top, skip_dirs))
    path = F.col("path")
    rel = below(path, place)
    if project_depth:
        parts = F.split(rel, "/")
        project = F.array_join(F.slice(parts, 1, project_depth), "/")
        repo, home = project, F.concat(F.lit(place.rstrip("/") + "/"), project)
        rel = F.array_join(F.slice(parts, project_depth + 1, 1 << 30), "/")
    else:
        repo, home = F.lit(repo_id), F.lit(root)
    name = F.element_at(F.split(path, "/"), -1)
    ext = extension_of(name)
    return raw.select(
        F.xxhash64(path).alias("file_id"),
        repo.alias("repo_id"),
        home.alias("root"),
        path.alias("path"),
        rel.alias("rel_path"),
        name.alias("file_name"),
        ext.alias("ext"),
        language_of(name, ext).alias("language"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
    ).where(F.col("rel_path") != "")


def hidden_files(spark: SparkSession, root: str, skip_dirs=SKIP_DIRS) -> DataFrame:
    """(path, content) of the files below ``root`` that Spark's file readers pass over."""
    source = tree_reader(spark).option("path", root).option("hidden", "true")
    source = source.option("skip", "\n".join(skip_dirs)).option("skipSuffix", SKIP_DIR_SUFFIX)
    return source.load().select("path", "content")


def snippet_table(spark: SparkSession) -> DataFrame:
    rows = [(i, d, n, m, c) for i, (d, n, m, c) in enumerate(SNIPPETS)]
    return spark.createDataFrame(
        rows, "snippet_id int, dir string, name string, mode string, head string"
    )


def _attached(mode: Column, head: Column, text: Column) -> Column:
    def commented(mark):
        return F.concat(head, F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)))

    quoted = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    quoted = F.replace(quoted, F.lit("\n"), F.lit("\\n"))
    quoted = F.regexp_replace(quoted, r"[\x00-\x1f]", " ")
    return (
        F.when(mode == "hash", commented("# "))
        .when(mode == "slash", commented("// "))
        .when(mode == "dash", commented("-- "))
        .when(mode == "json", F.replace(head, F.lit("@TEXT@"), quoted))
        .otherwise(F.concat(head, text))
    )


def _content(mode: Column, head: Column, text: Column) -> Column:
    """What the file of a document holds; it depends on the text, whatever the head.

    A document without text is an empty file.  One text in four, told by its digest,
    stands in its file bare, so its lines are read as code, entries or manifest lines.
    """
    bare = (text == "") | F.substring(F.md5(text.cast("binary")), 1, 1).isin("0", "4", "8", "c")
    return F.when(bare, text).otherwise(_attached(mode, head, text))


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """One file per document: its whole text, mostly below or inside a literal head.

    The list of heads has a fixed size, so it is broadcast; the documents are
    read once and never shuffled.
    """
    spark = documents.sparkSession
    n = len(SNIPPETS)
    heads = F.broadcast(snippet_table(spark))
    joined = documents.join(heads, F.pmod(F.col("doc_id"), F.lit(n)).cast("int") == F.col("snippet_id"))
    project = F.concat(
        F.col("source"), F.lit("/p"), F.floor(F.col("doc_id") / (20 * n)).cast("string")
    )
    rel = F.concat("dir", "name")
    ext = extension_of(F.col("name"))
    return joined.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("repo_id"),
        project.alias("root"),
        F.concat(project, F.lit("/"), rel).alias("path"),
        rel.alias("rel_path"),
        F.col("name").alias("file_name"),
        ext.alias("ext"),
        language_of(F.col("name"), ext).alias("language"),
        _content(F.col("mode"), F.col("head"), F.coalesce("text", F.lit(""))).alias("content"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_from_documents(read_table(spark, sf_dir, "documents"))
