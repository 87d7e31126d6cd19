"""Text expressions: trimming, lines, entropy, versions, names.

Every function takes and returns a Column, so the work stays in the JVM and
inside the row: none of them needs a shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit.functions.arrays import let

BLANKS = " \t\r\n\x0b\x0c"


def stripped(text: Column) -> Column:
    """``text`` without white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is in ``text``; one end tells, so the other is not looked at."""
    return F.ltrim(text, F.lit(BLANKS)) == ""


def split_lines(content: Column) -> Column:
    """Lines of a text as an array; a final line break opens no further line."""
    def lines(separator: str) -> Column:
        parts = F.split(content, separator, -1)
        without_last = let(parts, lambda p: F.slice(p, F.lit(1), F.size(p) - 1))
        ended = content.endswith("\n") | content.endswith("\r")
        return F.when(ended, without_last).otherwise(parts)

    return (
        F.when(content == "", F.array().cast("array<string>"))
        .when(content.contains("\r"), lines(r"\r\n|\n|\r"))
        .otherwise(lines("\n"))
    )


# Characters of one byte are taken away, so bytes tell how many; they need not be counted.


def indent_of(line: Column) -> Column:
    return F.octet_length(line) - F.octet_length(F.ltrim(line, F.lit(" \t")))


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def identifiers(text: Column) -> Column:
    """Distinct lower-cased identifiers of a text."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))
    lowered = let(found, lambda f: F.when(F.size(f) > 0, F.split(F.lower(F.array_join(f, " ")), " ")).otherwise(f))
    return F.array_distinct(lowered)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character; 0 for an empty text."""
    n = F.length(text)
    shares = F.transform(
        F.array_distinct(F.split(text, "", -1)),
        lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n,
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(
        F.round(F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p)), 6)
    )


def version_key(version: Column) -> Column:
    """Up to three leading numbers of a version; ``[0]`` when there is none."""
    digits = F.regexp_extract(stripped(version), r"^\d+(\.\d+){0,2}", 0)
    return F.when(digits == "", F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.split(digits, r"\."), lambda x: x.try_cast("bigint"))
    )


def version_lt(left: Column, right: Column) -> Column:
    """Array order is lexicographic, the shorter one first: 2.0 < 2.0.0."""
    return version_key(left) < version_key(right)


def pascal_case(name: Column) -> Column:
    parts = F.filter(F.split(F.replace(name, F.lit("_"), F.lit("-")), "-"), lambda p: p != "")
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.concat(
                F.upper(F.substring(p, 1, 1)),
                F.lower(F.substring(p, F.lit(2), F.length(p))),
            ),
        ),
        "",
    )


def masked(secret: Column) -> Column:
    return F.when(F.length(secret) > 6, F.concat(F.substring(secret, 1, 6), F.lit("..."))).otherwise(
        F.lit("***")
    )


def truncated(text: Column, width: int = 60) -> Column:
    head = F.rtrim(F.substring(text, 1, width - 3))
    return F.when(F.length(text) > width, F.concat(head, F.lit("..."))).otherwise(text)


def matches_any(text: Column, patterns) -> Column:
    """True when one of several case-insensitive patterns occurs in ``text``."""
    return text.rlike("(?i)(" + "|".join(patterns) + ")")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def extension_of(file_name: Column) -> Column:
    """Suffix with its dot, or an empty text: a leading dot opens no suffix."""
    return F.regexp_extract(file_name, r"^.+(\.[^.]+)$", 1)
