"""Credentials in any scanned file, whatever its tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeaudit.functions.text import entropy
from codeaudit.sources.constants import PLACEHOLDER, SECRET_NAME, TOKEN_ENTROPY_LIMIT

RULE_ID = "secret-in-text"
ASSIGNED_VALUE = r"""[:=]\s*["']([^"'\s]{8,})["']"""
NAMED_VALUE = SECRET_NAME + r"""\w*["']?\s*""" + ASSIGNED_VALUE
QUOTED_TOKEN = r"""["']([A-Za-z0-9+/=_-]{21,})["']"""


def named_secret(line: Column) -> Column:
    """A secret-like name with a value of eight characters or more that is no placeholder."""
    values = F.regexp_extract_all(line, F.lit(NAMED_VALUE), F.lit(2))
    return line.rlike(ASSIGNED_VALUE) & line.rlike(NAMED_VALUE) & F.exists(values, lambda v: ~v.rlike(PLACEHOLDER))


def random_token(line: Column) -> Column:
    """A long quoted token with high entropy."""
    tokens = F.regexp_extract_all(line, F.lit(QUOTED_TOKEN), F.lit(1))
    return line.rlike(QUOTED_TOKEN) & F.exists(
        tokens, lambda t: (entropy(t) > TOKEN_ENTROPY_LIMIT) & ~t.rlike(PLACEHOLDER)
    )


def secret_lines() -> Column:
    """(n, text) of the lines of ``raw`` that hold a credential."""
    text = F.col("content")
    quoted = text.contains('"') | text.contains("'")
    # what a line holds, the text holds as well
    quoted = quoted & (text.rlike(QUOTED_TOKEN) | text.rlike(ASSIGNED_VALUE))
    lines = F.filter(
        F.transform(
            "raw", lambda x, i: F.struct((i + 1).alias("n"), x.alias("text"))
        ),
        lambda l: l.text.rlike("[\"']") & (named_secret(l.text) | random_token(l.text)),
    )
    return F.when(quoted, lines).otherwise(F.array().cast("array<struct<n:int,text:string>>"))
