"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

S(w | context) is c(context w) / c(context) where the n-gram occurs in another document,
else 0.4 times the score under the context without its first word; a word alone scores
c(w) / N, and one that no other document has counts as one occurrence more than there
are.  Counts leave out the document that is scored, else every n-gram would be known.

Texts are first written as blocks of word numbers, some million words each.  For every
order, from single words up, blocks send their distinct n-grams, with the counts in the
block, to buckets by hash; a bucket is a part of the count table, adds up what all blocks
say of its n-grams and answers each block.  An n-gram is only asked for if both parts of
it that are a word shorter occur in another document, for else it does not either.  In
the end each block has the counts of all its n-grams and sums them for each document.

An n-gram that stands in every document is one entry a block, so no bucket is hot, and
the number of buckets follows the corpus.  N-grams are compared by 48 bits of their code
within a bucket.

Defined cases: null, empty and blank texts have no words and no score (null); repeated
documents are separate ones and know each other; a single document has only unknown
words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import table
from codeaudit.llm.tokens import NONBLANK, scramble, words_of

ORDER = 3
BACKOFF = 0.4
#: Words of a block (a task holds some hundred bytes for each), and n-grams that a bucket holds on average.
BLOCK_WORDS = 500_000
BUCKET = 1 << 21

_LOW = np.uint64((1 << 48) - 1)


def squeezed(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(values) else b""
    return len(values).to_bytes(8, "little") + body


def spread_out(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).reshape(n)


def word_blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, lengths, vocabulary, words): the corpus as numbers, written."""

    def pack(ids: list, lengths: list, codes: list) -> pa.RecordBatch:
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        vocabulary, words = np.unique(code, return_inverse=True)
        return pa.RecordBatch.from_arrays([
            pa.array([ids], pa.list_(id_type)), pa.array([lengths], pa.list_(pa.int64())),
            pa.array([vocabulary.tobytes()], pa.binary()),
            pa.array([squeezed(words.astype(np.uint32))], pa.binary()),
        ], ["doc_ids", "lengths", "vocabulary", "words"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, codes, size = [], [], [], 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for start, words in words_of(batch.column("text"), NONBLANK):
                n = np.diff(words.first)
                ids += names[start:start + len(n)]
                lengths += n.tolist()
                codes.append(words.code)
                size += len(words.code)
                if size >= BLOCK_WORDS:
                    yield pack(ids, lengths, codes)
                    ids, lengths, codes, size = [], [], [], 0
        if ids:
            yield pack(ids, lengths, codes)

    kind = dict(docs.dtypes)["doc_id"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    docs = docs if kind in ("bigint", "int") else docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", "text").mapInArrow(
        read, f"doc_ids array<{kind}>, lengths array<long>, vocabulary binary, words binary"
    )
    return written(rows.withColumn("block", F.monotonically_increasing_id()), "lm-blocks")


class Block:
    """The words of a block and, order by order, how often others use its n-grams."""

    def __init__(self, lengths, vocabulary: bytes, words: bytes):
        self.lengths = np.array(lengths, np.int64)
        number = spread_out(words, np.uint32)
        self.code = np.frombuffer(vocabulary, np.uint64)[number]
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.code)) - starts[self.doc]
        self.elsewhere: list[np.ndarray] = []  # for each order, by the word an n-gram ends in

    def ask(self, order: int):
        """(where, n-gram number at these places, n-grams, their counts here) to be asked for."""
        if order == 1:
            where = np.arange(len(self.code))
        else:
            known = self.elsewhere[-1] > 0
            where = 1 + np.flatnonzero(known[1:] & known[:-1] & (self.place[1:] >= order - 1))
        total = np.full(len(where), order, np.uint64)
        for back in range(order - 1, -1, -1):
            total = total * np.uint64(0x2545F4914F6CDD1D) + self.code[where - back]
        grams, which, counts = np.unique(scramble(total), return_inverse=True, return_counts=True)
        return where, which, grams, counts

    def learn(self, order: int, answers: dict[int, bytes], n_buckets: int) -> None:
        """Counts of an order in all other documents, from the answers of the buckets."""
        where, which, grams, _ = self.ask(order)
        bucket, sequence = dealt(grams, n_buckets)
        total = np.zeros(len(grams), np.int64)
        at = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for b, answer in answers.items():
            total[sequence[at[b]:at[b + 1]]] = spread_out(answer, np.int64)
        pairs = which * len(self.lengths) + self.doc[where]
        _, back, own = np.unique(pairs, return_inverse=True, return_counts=True)
        out = np.zeros(len(self.code), np.int64)
        out[where] = total[which] - own[back]
        self.elsewhere.append(out)

    def scores(self, corpus: int, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log scores of each document, and its words scored by a full n-gram."""
        others = np.maximum(1, corpus - self.lengths[self.doc])
        score = np.where(self.elsewhere[0] > 0, self.elsewhere[0], 1) / (others + (self.elsewhere[0] <= 0))
        used = np.ones(len(self.code), np.int64)
        for k in range(2, order + 1):
            here = self.elsewhere[k - 1]
            context = np.concatenate([[1], self.elsewhere[k - 2][:-1]])
            has_context = self.place >= k - 1
            known = here > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(known, here / context, np.where(has_context, BACKOFF * score, score))
            used[known] = k
        n = len(self.lengths)
        return (np.bincount(self.doc, np.log(score), minlength=n),
                np.bincount(self.doc, used == order, minlength=n))


def dealt(grams: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, sorted, and the n-grams' numbers in that order."""
    bucket = ((grams >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
    sequence = np.lexsort((grams & _LOW, bucket))
    return bucket[sequence], sequence


ANSWERS = "array<struct<bucket:int,counts:binary>>"


def _block_of(row: dict, n_buckets: int) -> Block:
    block = Block(row["lengths"], row["vocabulary"], row["words"])
    order = 1
    while f"answers_{order}" in row:
        answers = {a["bucket"]: a["counts"] for a in row[f"answers_{order}"] or []}
        block.learn(order, answers, n_buckets)
        order += 1
    return block


def asked(blocks: DataFrame, order: int, n_buckets: int) -> DataFrame:
    """(bucket, block, grams, counts): what each block asks each bucket, one row for both."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, _, grams, counts = _block_of(row, n_buckets).ask(order)
                bucket, sequence = dealt(grams, n_buckets)
                grams, counts = (grams & _LOW)[sequence], counts[sequence].astype(np.uint32)
                at = np.searchsorted(bucket, np.arange(n_buckets + 1))
                out: list[tuple] = []
                for b in range(n_buckets):
                    part = grams[at[b]:at[b + 1]]
                    if len(part):
                        steps = np.diff(part, prepend=np.uint64(0))
                        out.append((b, row["block"], squeezed(steps), squeezed(counts[at[b]:at[b + 1]])))
                columns = list(zip(*out)) or [()] * 4
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "block", "grams", "counts"]
                )

    return blocks.mapInArrow(send, "bucket int, block long, grams binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """(block, bucket, counts): the counts of all blocks together, n-gram by n-gram as asked."""

    def add(group: pa.Table) -> pa.Table:
        parts = [np.cumsum(spread_out(g, np.uint64), dtype=np.uint64) for g in group.column("grams").to_pylist()]
        counts = [spread_out(c, np.uint32) for c in group.column("counts").to_pylist()]
        _, which = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(which, np.concatenate(counts)).astype(np.int64)
        ends = np.cumsum([len(p) for p in parts])
        out = [squeezed(total[which[e - len(p):e]]) for p, e in zip(parts, ends)]
        return pa.Table.from_arrays(
            [group.column("block"), group.column("bucket"), pa.array(out, pa.binary())],
            ["block", "bucket", "counts"],
        )

    return questions.groupBy("bucket").applyInArrow(add, "block long, bucket int, counts binary")


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_words, n_full, log_score): words, words scored by a full n-gram, sum of logs."""
    blocks = word_blocks(docs)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    corpus = blocks.agg(F.sum(total).alias("n")).first().n or 0
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(at_least, -(-corpus // BUCKET))
    known = blocks
    for k in range(1, order + 1):
        answers = answered(asked(known, k, n_buckets)).groupBy("block").agg(
            F.collect_list(F.struct("bucket", "counts")).alias(f"answers_{k}")
        )  # the counts of a block's own n-grams
        known = known.join(written(answers, "lm-counts"), "block", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = _block_of(row, n_buckets)
                logs, full = block.scores(corpus, order)
                logs = [x if n else None for x, n in zip(logs.tolist(), row["lengths"])]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids").slice(i, 1).flatten(), pa.array(row["lengths"], pa.int64()),
                    pa.array(full.astype(np.int64)), pa.array(logs, pa.float64()),
                ], ["doc_id", "n_words", "n_full", "log_score"])

    kind = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")
    return known.mapInArrow(read, f"doc_id {kind}, n_words long, n_full long, log_score double")


def op2_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", "n_words", "n_full", F.round("log_score", 4).alias("log_score"),
        F.round(F.col("log_score") / F.when(F.col("n_words") > 0, F.col("n_words")), 6).alias("score"),
    )
