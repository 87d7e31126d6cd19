"""Texts that try to steer a reviewing model, in source files and conversations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let
from codeaudit.functions.plan import broadcast_if_small
from codeaudit.functions.text import any_of, is_blank, matches_any
from codeaudit.operators.code import with_lines
from codeaudit.sources.constants import INJECTION_EXTENSIONS, INJECTION_PATTERNS

RULE_ID = "prompt-injection-text"
STRING_LITERAL = r""""[^"\\]*(?:\\.[^"\\]*)*+"|'[^'\\]*(?:\\.[^'\\]*)*+'"""
WHOLE_LINE_EXTENSIONS = (".json", ".yaml", ".yml")

#: Parts of words that every match of a pattern holds, in lower case.  They begin with rare letters,
#: since a search stops at each place of the first one.
PATTERN_WORDS = dict(zip(INJECTION_PATTERNS, (
    ("gnore", "instruction"),
    ("forget", "verything"),
    ("gard", "disregard"),
    ("fferent", "you", "are", "now"),
    ("prompt", "ystem", "new"),
    ("code", "this"),
    ("do", "this"),
    ("kip", "skip"),
    ("vironment",),
    ("curity",),
    ("prompt", "print"),
    ("veal", "reveal"),
    ("what", "your", "instructions"),
), strict=True))


def injection_files(files: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """Files of eight extensions anywhere in the tree, and the given ones, once each.

    A given file is told by its repository and path: one that the tree has too is left out.
    """
    kept = files.where(F.col("ext").isin(*INJECTION_EXTENSIONS))
    if given is None:
        return kept
    key = ["repo_id", "path"]
    others = given.where(F.col("ext").isin(*INJECTION_EXTENSIONS)).dropDuplicates(key)
    return kept.unionByName(others.join(broadcast_if_small(kept.select(*key)), key, "left_anti").select(*kept.columns))


def literals_of(line: Column, ext: Column) -> Column:
    """String literals of a line without their quotes; a JSON or YAML line without any, whole."""
    quoted = F.transform(
        F.regexp_extract_all(line, F.lit(STRING_LITERAL), F.lit(0)),
        lambda s: F.substring(s, F.lit(2), F.length(s) - 2),
    )
    whole = ~line.rlike(STRING_LITERAL) & ext.isin(*WHOLE_LINE_EXTENSIONS)
    return F.when(whole, F.array(line)).otherwise(quoted)


def string_literals(files: DataFrame) -> DataFrame:
    lines = with_lines(injection_files(files)).select(
        "file_id", "path", "ext", F.posexplode("raw").alias("pos", "text")
    )
    return (
        lines.where(~is_blank(F.col("text")))
        .select(
            "file_id",
            "path",
            (F.col("pos") + 1).alias("line"),
            F.posexplode(literals_of(F.col("text"), F.col("ext"))).alias("seq", "literal"),
        )
        .withColumn("seq", F.col("seq") + 1)
    )


def is_injection(text: Column) -> Column:
    return matches_any(text, INJECTION_PATTERNS)


def may_steer(text: Column) -> Column:
    """``is_injection`` for long texts: a pattern is tried only where the text holds its words.

    Thirteen patterns that ignore case are tried at every character otherwise.  Patterns
    without known words are always tried.
    """
    def found(lower: Column) -> Column:
        def tried(pattern: str) -> Column:
            words = PATTERN_WORDS.get(pattern, ())
            held = [lower.contains(w) for w in words]
            return reduce(lambda a, b: a & b, [*held, matches_any(text, (pattern,))])

        return any_of([tried(p) for p in INJECTION_PATTERNS])

    return let(F.lower(text), found)


def _searched(raw: Column) -> Column:
    """What of a file can hold such a text: lines with a quote, or all where lines count whole."""
    content = F.col("content")
    quoted = F.filter(raw, lambda x: x.contains('"') | x.contains("'"))
    return (
        F.when(F.col("ext").isin(*WHOLE_LINE_EXTENSIONS), content)
        .when(content.contains('"') | content.contains("'"), F.array_join(quoted, "\n"))
        .otherwise("")
    )


def injection_lines(raw: Column | None = None) -> Column:
    """(n, text) of the lines of ``raw`` with such a text; files without any cost one search."""
    ext, raw = F.col("ext"), F.col("raw") if raw is None else raw
    lines = F.filter(
        F.transform(raw, lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"))),
        lambda l: is_injection(l.text) & F.exists(literals_of(l.text, ext), is_injection),
    )
    wanted = ext.isin(*INJECTION_EXTENSIONS) & let(_searched(raw), may_steer)
    return F.when(wanted, lines).otherwise(F.array().cast("array<struct<n:int,text:string>>"))


def injection_rows(files: DataFrame, given: DataFrame | None = None) -> DataFrame:
    found = with_lines(injection_files(files, given)).select(
        "repo_id", "file_id", "path", F.explode(injection_lines()).alias("hit")
    )
    return found.select("repo_id", "file_id", "path", F.col("hit.n").alias("line"))


def chat_injections(conversations: DataFrame) -> DataFrame:
    """Turns and steering turns by role."""
    return conversations.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(is_injection(F.col("text"))).alias("flagged"),
    )
