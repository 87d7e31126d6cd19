"""Benchmark decontamination by a prefix-filtered containment join.

Benchmark items are cut into windows of 13 words (an item of fewer words is one window),
and a window is a set of short shingles that a document must hold all of.  For such a
containment join one shingle of each window is a sufficient prefix when shingles are
ordered by rarity: the window's rarest shingle in the corpus.  So

1. the corpus is counted for the shingles of the items only (a bitmap of bounded size
   lets each task drop all others before any shuffle);
2. a window with a shingle that no document has is dropped, of the others the rarest
   shingle is kept, with its place in the window;
3. document places of these prefix shingles are joined to the windows by an ordinary join;
   a place survives if the window fits into the document there (positional bound) and
   into its length (length bound), and the words of the document are compared in full;
4. the surviving intervals are merged for each document.

Texts are judged once for each distinct text, so copies cost one row each.

Defined cases: a null or empty text has no words and is clean; items without words are
ignored; a null item_id counts as an empty id; items repeated under one id are one item;
repeated documents get equal rows; without benchmark rows every document is clean; other
columns are carried by ``clean`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import free_name, table
from codeaudit.llm.tokens import (
    LETTERS, bitmap_of, in_bitmap, shingles, signed, words_of,
)

WINDOW = 13
SHINGLE = 4
#: A document is contaminated when hit words are at least one in so many.
ONE_IN = 20


def item_windows(items: DataFrame) -> DataFrame:
    """(item_id, length, window, offset, code): one row for each shingle of each window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").to_pylist()
            for row, words in words_of(batch.column("text"), LETTERS):
                out: dict[str, list] = {k: [] for k in ("item_id", "length", "window", "offset", "code")}
                for r in range(len(words.first) - 1):
                    lo, hi = int(words.first[r]), int(words.first[r + 1])
                    length = min(WINDOW, hi - lo)
                    if not length:
                        continue
                    k = min(SHINGLE, length)
                    row_words = words._replace(code=words.code[lo:hi], first=np.array([0, hi - lo]))
                    code = signed(shingles(row_words, k)[2])
                    for at in range(hi - lo - length + 1):
                        text = words.text(lo + at, lo + at + length, LETTERS.read_as)
                        for offset in range(length - k + 1):
                            for name, value in zip(out, (ids[row + r], length, text, offset, int(code[at + offset]))):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("item_id", pa.string()), ("length", pa.int32()), ("window", pa.string()),
                        ("offset", pa.int32()), ("code", pa.int64())])
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return named.mapInArrow(
        cut, "item_id string, length int, window string, offset int, code long"
    )


def _lengths(windows: DataFrame) -> list[int]:
    """Shingle lengths in use: at most ``SHINGLE`` numbers."""
    k = F.least(F.col("length"), F.lit(SHINGLE)).alias("k")
    return sorted(r.k for r in windows.select(k).distinct().collect())


def document_counts(docs: DataFrame, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """(code, n): how many documents hold a shingle whose bit is set."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in words_of(batch.column("text"), LETTERS):
                for k in lengths:
                    row, _, code = shingles(words, k)
                    hit = in_bitmap(wanted, code)
                    pairs = np.unique(np.stack([code[hit], row[hit].astype(np.uint64)]), axis=1)
                    found, n = np.unique(pairs[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(found)), pa.array(n.astype(np.int64))], ["code", "n"]
                    )

    rows = docs.select("text").mapInArrow(count, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """(doc_id, text_key, n_words, places): where each document holds a wanted shingle.

    A place carries the words around it, as far as any window through it can reach.
    """
    side = WINDOW - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, words in words_of(batch.column("text"), LETTERS):
                n = len(words.first) - 1
                found: list[list[dict]] = [[] for _ in range(n)]
                for k in lengths:
                    row, at, code = shingles(words, k)
                    hit = np.flatnonzero(in_bitmap(wanted, code))
                    codes = signed(code)
                    for i in hit:
                        r, a = int(row[i]), int(at[i])
                        first, last = int(words.first[r]), int(words.first[r + 1])
                        lo, hi = max(first, a - side), min(last, a + WINDOW)
                        found[r].append({
                            "at": a - first, "code": int(codes[i]), "before": a - lo,
                            "words": words.text(lo, hi, LETTERS.read_as),
                        })
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(start, n), batch.column("text_key").slice(start, n),
                    pa.array(np.diff(words.first).astype(np.int64)), pa.array(found, kind),
                ], ["doc_id", "text_key", "n_words", "places"])

    kind = pa.list_(pa.struct([("at", pa.int32()), ("code", pa.int64()), ("before", pa.int32()),
                               ("words", pa.string())]))
    id_type = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    return keyed.mapInArrow(
        find, f"doc_id {id_type}, text_key string, n_words long, "
        "places array<struct<at:int,code:long,before:int,words:string>>"
    )


def text_key(text: str = "text"):
    """Digest that stands for a text; a null text stands for an empty one."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, length, code, offset): the rarest shingle of every window that may occur."""
    counted = windows.select("window", "length", "offset", "code").distinct()
    counted = counted.join(counts, "code", "left")
    rarest = F.min(F.struct("n", "code", "offset")).alias("rarest")
    return (
        counted.groupBy("window", "length")
        .agg(rarest, F.count("n").alias("held"), F.count("*").alias("all"))
        .filter(F.col("held") == F.col("all"))
        .select("window", "length", "rarest.code", "rarest.offset")
    )


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): n_words of every document, and the windows found in each text.

    documents: doc_id, text_key, n_words; spans: text_key, first, length, window, item_id.
    """
    windows = written(item_windows(items), "benchmark-windows")
    codes = windows.select("code").distinct()
    lengths = _lengths(windows)
    counts = document_counts(docs, bitmap_of(codes), lengths)
    prefix = written(prefixes(windows, counts), "benchmark-prefixes")
    wanted = bitmap_of(prefix.select("code").distinct())
    found = written(places(docs, wanted, lengths), "benchmark-places")
    place = found.select("text_key", "n_words", F.inline("places"))
    first = F.col("at") - F.col("offset")
    fits = (first >= 0) & (first + F.col("length") <= F.col("n_words"))
    same = F.array_join(
        F.slice(F.split("words", " "), F.col("before") - F.col("offset") + 1, F.col("length")), " "
    ) == F.col("window")
    spans = (
        place.join(prefix, "code").filter(fits)
        .filter(F.when(F.col("before") >= F.col("offset"), same))
        .select("text_key", first.alias("first"), "length", "window").distinct()
    )
    owners = windows.select("window", "item_id").distinct()
    return found.select("doc_id", "text_key", "n_words"), spans.join(owners, "window")


def hits(spans: DataFrame) -> DataFrame:
    """(text_key, n_hit, item_ids) of the texts that hold a window."""
    order = Window.partitionBy("text_key").orderBy("first", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = spans.select("text_key", "first", (F.col("first") + F.col("length")).alias("end"))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("first", F.coalesce(reached, F.lit(0))))
    merged = (
        each.distinct().withColumn("new", new)
        .groupBy("text_key").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    ids = spans.select("text_key", "item_id").distinct().groupBy("text_key")
    ids = ids.agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    return merged.join(ids, "text_key")


def contaminated(n_hit, n_words):
    return (n_hit > 0) & (n_hit * ONE_IN >= n_words)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, item_ids, contaminated."""
    documents, spans = occurrences(docs, items)
    joined = documents.join(hits(spans), "text_key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns of ``docs``."""
    key = free_name(docs, "text_key")
    documents, spans = occurrences(docs, items)
    judged = documents.select("text_key", "n_words").distinct().join(hits(spans), "text_key")
    bad = judged.filter(contaminated(F.col("n_hit"), F.col("n_words")))
    bad = bad.select(F.col("text_key").alias(key)).distinct()
    return docs.withColumn(key, text_key()).join(bad, key, "left_anti").select(docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = report(docs, table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )
