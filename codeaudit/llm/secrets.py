"""Secret scan with corpus-wide ownership frequency.

Candidates are found in every text by patterns.  The digests of their values are then
counted over the whole corpus: by how many repositories and by how many owners a value
is held.  A value that many owners have is a copied example; one that a single owner has
and that looks random is taken for live.  Documents stand for repositories (doc_id) and
sources for owners unless other columns are named.

Values leave a task as digests only.  They are counted in three steps of partial sums
(value, owner and repository; value and owner; value), so a value copied into a third of
all documents is one row a task.

Defined cases: a null text is empty; a null owner or repository counts as one more owner
or repository; repeated documents are reported each and count once as repositories; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import table

# The base patterns, in the order of their kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

BASE_KINDS = ("assign", "access", "hex")

#: Kind, text that must be there, pattern; group 1, where there is one, is the secret value.
MORE = (
    ("github", "gh", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,255}"),
    ("gitlab", "glpat-", r"glpat-[A-Za-z0-9_-]{20,255}"),
    ("google", "AIza", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
    ("jwt", "eyJ", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("npm", "npm_", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}"),
    ("pem", "PRIVATE KEY", r"-----BEGIN (?:[A-Z0-9]{1,20} ){0,3}PRIVATE KEY-----"),
    ("slack", "xox", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,255}"),
    ("stripe", "_live_", r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{16,255}"),
    ("url", "://", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:([^\s/:@]{3,100})@"),
)
KINDS = (*BASE_KINDS, *(kind for kind, _, _ in MORE))

#: A value of more owners is an example that was copied around.
MAX_OWNERS = 2
#: Bits a character, and distinct characters, from which a value looks random.
MIN_ENTROPY = 3.0

NAMES = ("passw", "secret", "token", "apikey", "api_key")


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def candidates(text: str, patterns: dict[str, re.Pattern]) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, value) of every candidate in a text, kind by kind."""
    low = text.lower()
    if any(name in low for name in NAMES):
        for m in patterns["assign"].finditer(text):
            if len(m[2]) >= MIN_ASSIGN:
                yield "assign", m.start(), m.end(), m[2]
    if "AKIA" in text:
        for m in patterns["access"].finditer(text):
            if m.end() - m.start() >= MIN_ACCESS:
                yield "access", m.start(), m.end(), m[0]
    # a run of hexadecimal digits is matched whole, so the length may be part of the pattern
    for m in patterns["hex"].finditer(text):
        yield "hex", m.start(), m.end(), m[0]
    for kind, word, _ in MORE:
        if word in text:
            for m in patterns[kind].finditer(text):
                yield kind, m.start(), m.end(), m[m.re.groups and 1]


def compiled() -> dict[str, re.Pattern]:
    found = {
        "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII), "access": re.compile(ACCESS),
        "hex": re.compile(r"[0-9a-f]{%d,}" % MIN_HEX),
    }
    return found | {kind: re.compile(rule) for kind, _, rule in MORE}


SPAN = "struct<kind:string,start:int,end:int,value:string,random:boolean>"


def find(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """(row, doc_id, owner, repo, spans), written: the row numbers stay what they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = compiled()
        rank = {kind: i for i, kind in enumerate(KINDS)}
        for batch in batches:
            spans = []
            for text in batch.column("text"):
                found = sorted(candidates(text.as_py() or "", patterns), key=lambda c: (c[1], rank[c[0]]))
                spans.append([
                    {"kind": kind, "start": start, "end": end,
                     "value": hashlib.sha256(value.encode()).hexdigest(),
                     "random": entropy(value) >= MIN_ENTROPY}
                    for kind, start, end, value in found
                ])
            kept = [batch.column(c) for c in ("row", "doc_id", "owner", "repo")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, kind_of)],
                                             ["row", "doc_id", "owner", "repo", "spans"])

    kind_of = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
        ("value", pa.string()), ("random", pa.bool_()),
    ]))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id"),
        F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"), "text",
    )
    kind = dict(docs.dtypes)["doc_id"]
    out = f"row long, doc_id {kind}, owner string, repo string, spans array<{SPAN}>"
    return written(rows.mapInArrow(scan, out), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners): in how many repositories and with how many owners a value is."""
    held = found.select("owner", "repo", F.explode(F.array_distinct("spans.value")).alias("value"))
    by_owner = held.distinct().groupBy("value", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("value").agg(
        F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners")
    )


def judged(found: DataFrame) -> DataFrame:
    """One row a candidate: row, span fields, n_repos, n_owners and its class.

    ``copied`` for values of many owners, ``live`` for random-looking ones of few, ``weak``
    for the rest.
    """
    each = found.select("row", F.inline("spans"))
    verdict = (
        F.when(F.col("n_owners") > MAX_OWNERS, "copied").when(F.col("random"), "live")
        .otherwise("weak")
    )
    return each.join(ownership(found), "value").withColumn("class", verdict)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    per_row = judged(found).groupBy("row").agg(
        F.count_if(F.col("class") == "live").alias("n_live"),
        F.count_if(F.col("class") == "copied").alias("n_copied"),
    )

    def spelled(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
        )

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    zero = F.lit(0).cast("long")
    return found.join(per_row, "row", "left").select(
        "doc_id", *[number(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"),
    )
