"""How many sets hold a code, counted over packed blocks.

A code and its set take one row each in a plain count, many times the bytes that they
need.  Here a task packs the codes of some hundred sets, a block, into one row a bucket of
codes; a bucket counts with numpy and answers each block with one row; and the answers of
a block are put together set by set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from codeaudit.llm.tokens import signed

#: Codes that a bucket holds on average.
BUCKET = 1 << 20
#: Codes after which a block is sent.
BLOCK_CODES = 1 << 19

PACKED = "bucket int, block long, sets array<long>, owner binary, codes binary"


def packed(
    sets: Iterator[tuple[int, np.ndarray]], n_buckets: int
) -> Iterator[pa.RecordBatch]:
    """(set, codes) pairs of a task in blocks, dealt into buckets by code.

    A block is numbered by its partition and place, which a task that is run again repeats.
    """
    number = TaskContext.get().partitionId() << 32
    pending: list[tuple[int, np.ndarray]] = []
    size = 0
    for name, codes in sets:
        pending.append((name, codes))
        size += len(codes)
        if size >= BLOCK_CODES:
            yield _block(pending, n_buckets, number)
            pending, size, number = [], 0, number + 1
    if size:
        yield _block(pending, n_buckets, number)


def _block(sets: list[tuple[int, np.ndarray]], n_buckets: int, number: int) -> pa.RecordBatch:
    code = np.concatenate([c for _, c in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(c) for _, c in sets])
    bucket = ((code >> np.uint64(20)) % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    code, owner, bucket = code[order], owner[order], bucket[order]
    found, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    ids = np.array([i for i, _ in sets], np.int64)
    names, owners, codes = [], [], []
    for lo, hi in zip(starts, ends):
        there, local = np.unique(owner[lo:hi], return_inverse=True)
        names.append(ids[there])
        owners.append(local.astype(np.uint32).tobytes())
        codes.append(code[lo:hi].tobytes())
    return pa.RecordBatch.from_arrays([
        pa.array(found, pa.int32()), pa.array([number] * len(found), pa.int64()),
        pa.array(names, pa.list_(pa.int64())), pa.array(owners, pa.binary()),
        pa.array(codes, pa.binary()),
    ], ["bucket", "block", "sets", "owner", "codes"])


SHARED = "set_id long, shared long, codes array<long>, held array<int>"


def shared_codes(blocks: DataFrame, with_codes: bool = True) -> DataFrame:
    """(set_id, shared, codes, held): which codes of a set other sets hold too, how many do.

    One row for each set and block it was packed in; ``shared`` counts the codes, and
    without ``with_codes`` the lists are empty.  A bucket holds about ``BUCKET`` codes,
    whatever the input, since the number of buckets follows it; a set has a code once, so
    even one that all sets hold adds no more entries than sets.
    """

    def count(group: pa.Table) -> pa.Table:
        owners, codes = [], []
        columns = (group.column(c).to_pylist() for c in ("sets", "owner", "codes"))
        for ids, owner, code in zip(*columns):
            owners.append(np.array(ids, np.int64)[np.frombuffer(owner, np.uint32)])
            codes.append(np.frombuffer(code, np.uint64))
        ends = np.cumsum([len(c) for c in codes])
        owner, code = np.concatenate(owners), np.concatenate(codes)
        order = np.lexsort((owner, code))
        sorted_owner, sorted_code = owner[order], code[order]
        new_code = np.append(True, sorted_code[1:] != sorted_code[:-1])
        # copies of a set in several blocks are one set
        new_pair = new_code | np.append(True, sorted_owner[1:] != sorted_owner[:-1])
        which = np.cumsum(new_code) - 1
        held = np.empty(len(code), np.int32)
        held[order] = np.bincount(which, new_pair)[which]
        out: dict[str, list] = {"sets": [], "codes": [], "held": []}
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            keep = lo + np.flatnonzero(held[lo:hi] > 1)
            out["sets"].append(owner[keep].tobytes())
            out["codes"].append(code[keep].tobytes() if with_codes else b"")
            out["held"].append(held[keep].tobytes() if with_codes else b"")
        return pa.Table.from_arrays(
            [group.column("block"), *(pa.array(v, pa.binary()) for v in out.values())],
            ["block", *out],
        )

    def gather(group: pa.Table) -> pa.Table:
        def joined(name, kind):
            return np.frombuffer(b"".join(group.column(name).to_pylist()), kind)

        owner = joined("sets", np.int64)
        order = np.argsort(owner, kind="stable")
        sets, starts = np.unique(owner[order], return_index=True)
        bounds = np.append(starts, len(owner))
        if with_codes:
            lists = pa.array(bounds.astype(np.int32))
            codes = pa.ListArray.from_arrays(lists, pa.array(signed(joined("codes", np.uint64)[order])))
            held = pa.ListArray.from_arrays(lists, pa.array(joined("held", np.int32)[order]))
        else:
            codes = pa.array([[]] * len(sets), pa.list_(pa.int64()))
            held = pa.array([[]] * len(sets), pa.list_(pa.int32()))
        return pa.Table.from_arrays(
            [pa.array(sets, pa.int64()), pa.array(np.diff(bounds).astype(np.int64)), codes, held],
            ["set_id", "shared", "codes", "held"],
        )

    answers = blocks.groupBy("bucket").applyInArrow(
        count, "block long, sets binary, codes binary, held binary"
    )
    return answers.groupBy("block").applyInArrow(gather, SHARED)


def bucket_count(spark: SparkSession, entries: int) -> int:
    """Buckets for so many codes, and at least one for each task of a shuffle."""
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(at_least, -(-entries // BUCKET))
