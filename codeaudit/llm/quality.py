"""Quality rules: counts within a text, and line frequency across the documents of a host.

A line is normalised (lower case, runs of blanks to one blank, digits to 0) and hashed.
For each host (``source``) the distinct texts that hold the line are counted; a line in
more than ``MAX_LINE_SHARE`` of the host's distinct texts, and in more than
``MIN_LINE_TEXTS`` of them, is boilerplate; ``clean`` removes it from the texts.  A document
is depleted, and rejected, when less than ``MIN_LEFT_SHARE`` of its words are left.

Texts, not rows, are counted: a document copied ten thousand times is one text, so copies
neither make their own lines frequent nor are they rejected for being copies; that is for
deduplication to judge.  Verdicts belong to (source, text), so no row id is needed.

Defined cases: a null or blank text has no words, fails the base rule and is rejected; a
null source is a host of its own; equal rows get equal verdicts; an empty table gives an
empty result; other columns are carried by ``keep`` and ignored by the query.

Everything here is built-in functions; window values and lines are compared by 64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import once, written
from codeaudit.llm.common import BLANK, free_name, table, word_count

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
MAX_LINE_SHARE = 0.05
MIN_LINE_TEXTS = 10
MIN_LEFT_SHARE = 0.2

SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{BLANK}]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``BASE``, in place of any of these names it had.

    Windows are found twice by sorting their hashes with their places: places next to an
    equal hash are the repeated ones, and their union is summed over the sorted places.
    Texts whose window hashes are all distinct skip that.
    """
    kept = [c for c in docs.columns if c not in BASE]
    value = F.coalesce(F.col(text), F.lit(""))
    squeezed = _without(value, BLANKS)
    words = F.filter(F.split(value, rf"[{BLANK}]+"), lambda w: w != "")
    counted = docs.select(
        *kept,
        F.length(squeezed).cast("long").alias("word_chars"),
        (F.length(squeezed) - F.length(_without(squeezed, SYMBOLS))).cast("long")
        .alias("n_symbols"),
        duplicate_lines(value).alias("n_dup_lines"),
        once(F.transform(words, lambda w: F.xxhash64(w))).alias("word_hashes"),
    )
    hashes = F.col("word_hashes")
    n = F.size(hashes) - (REPEAT_WINDOW - 1)
    windows = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(REPEAT_WINDOW)]),
    )
    counted = counted.withColumn(
        "windows", once(F.when(n >= 2, windows).otherwise(F.array().cast("array<long>")))
    )
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    counted = counted.withColumn(
        "placed", once(F.when(repeats, placed))
    )
    at = F.col("placed")
    twice = F.filter(
        F.transform(
            at,
            lambda x, k: F.when(
                (F.get(at, k - 1)["h"] == x["h"]) | (F.get(at, k + 1)["h"] == x["h"]), x["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )
    counted = counted.withColumn("places", once(F.when(repeats, F.array_sort(twice))))
    places = F.col("places")
    covered = F.aggregate(
        F.transform(
            places,
            lambda p, k: F.least(
                F.lit(REPEAT_WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(REPEAT_WINDOW))
            ),
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    repeated = F.coalesce(F.when(repeats, covered), F.lit(0)).cast("long")
    counted = counted.select(
        *kept, F.size(hashes).cast("long").alias("n_words"), "word_chars", "n_symbols",
        "n_dup_lines", once(repeated).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return counted.withColumn("base_failed", failed)


def normal_line(line: Column) -> Column:
    return F.regexp_replace(
        F.trim(F.regexp_replace(F.lower(line), rf"[{BLANK}]+", " ")), "[0-9]", "0"
    )


def host_of(source: str | Column) -> Column:
    """Name of the host in a form that is never null, so it can be a join key."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def text_key(text: str = "text") -> Column:
    """Digest that stands for the text; a null text stands for an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each distinct text of a host: (host, text_key, n_words, lines).

    ``lines`` has the hash and the words of every line with a word, and no text.
    """
    lines = F.filter(
        F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), lambda x: x.rlike(rf"[^{BLANK}]")
    )
    parts = F.transform(
        lines,
        lambda x: F.struct(F.xxhash64(normal_line(x)).alias("line"), word_count(x).alias("words")),
    )
    rows = docs.select(host_of("source").alias("host"), text_key().alias("text_key"),
                       parts.alias("lines"))
    return rows.groupBy("host", "text_key").agg(F.first("lines").alias("lines"))


def losses(docs: DataFrame) -> DataFrame:
    """(host, text_key, frequent, depleted) of the texts with frequent lines of their host.

    ``frequent`` has the hashes of these lines; a text is depleted that loses too many
    words with them.
    """
    texts = written(line_table(docs), "quality-lines")
    per_host = texts.groupBy("host").agg(F.count("*").alias("texts"))
    lines = texts.select("host", F.explode(F.array_distinct("lines.line")).alias("line"))
    frequent = (
        lines.groupBy("host", "line").agg(F.count("*").alias("n"))
        .filter(F.col("n") > MIN_LINE_TEXTS)
        .join(per_host, "host")
        .filter(F.col("n") > F.col("texts") * MAX_LINE_SHARE)
        .select("host", "line")
    )
    each = texts.select("host", "text_key", F.inline("lines"))
    # a text without any frequent line loses nothing, so an inner join is enough
    lost = (
        each.join(frequent, ["host", "line"])
        .groupBy("host", "text_key")
        .agg(F.sum("words").alias("lost"), F.collect_set("line").alias("frequent"))
    )
    total = F.aggregate("lines.words", F.lit(0).cast("long"), lambda a, x: a + x)
    few = F.col("n_words") - F.col("lost") < F.col("n_words") * MIN_LEFT_SHARE
    return (
        lost.join(texts.select("host", "text_key", total.alias("n_words")), ["host", "text_key"])
        .select("host", "text_key", "frequent", few.alias("depleted"))
    )


def depleted(docs: DataFrame) -> DataFrame:
    """(host, text_key) of the texts that lose too many words with their host's frequent lines."""
    return losses(docs).filter("depleted").select("host", "text_key")


def judged(docs: DataFrame, carried: DataFrame) -> DataFrame:
    """``carried`` rows of ``docs`` with the base counts and ``kept``."""
    host, key, rejected = (free_name(docs, n) for n in ("host", "text_key", "rejected"))
    rows = base_counts(carried.withColumns({host: host_of("source"), key: text_key()}))
    bad = depleted(docs).select(
        F.col("host").alias(host), F.col("text_key").alias(key), F.lit(True).alias(rejected)
    )
    ok = ~F.col("base_failed") & F.col(rejected).isNull()
    return rows.join(bad, [host, key], "left").withColumn("kept", ok).drop(host, key, rejected)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs`` as they were."""
    host, key = (free_name(docs, n) for n in ("host", "text_key"))
    passing = _passing(docs.withColumns({host: host_of("source"), key: text_key()}))
    bad = depleted(docs).select(F.col("host").alias(host), F.col("text_key").alias(key))
    return passing.join(bad, [host, key], "left_anti").select(docs.columns)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, their texts without the frequent lines of their host.

    All other lines stay as they are, blank ones too; ``n_chars``, where there is one, is the
    length of a text that lost lines.  The text rules judge the full text.
    """
    host, key, frequent, bad = (free_name(docs, n) for n in ("host", "text_key", "frequent", "depleted"))
    passing = _passing(docs.withColumns({host: host_of("source"), key: text_key()}))
    lost = losses(docs).select(
        F.col("host").alias(host), F.col("text_key").alias(key),
        F.col("frequent").alias(frequent), F.col("depleted").alias(bad),
    )
    rows = passing.join(lost, [host, key], "left").filter(~F.coalesce(bad, F.lit(False)))
    left = F.filter(
        F.split("text", "\n"),
        lambda x: ~(x.rlike(rf"[^{BLANK}]") & F.array_contains(F.col(frequent), F.xxhash64(normal_line(x)))),
    )
    hit = F.col(frequent).isNotNull()
    rows = rows.withColumn("text", F.when(hit, F.array_join(left, "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        length = F.when(hit, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def _passing(docs: DataFrame) -> DataFrame:
    whole = free_name(docs, "whole_row")
    rows = docs.select(F.struct(*docs.columns).alias(whole), F.col("text"))
    good = base_counts(rows).filter(~F.col("base_failed"))
    return good.select(f"{whole}.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judged(docs, docs).select("doc_id", *BASE, "kept")
