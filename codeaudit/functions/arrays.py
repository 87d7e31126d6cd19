"""Array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(
    items: Column,
    zero: dict[str, Column],
    out: str,
    step: Callable[[Column, Column], Column],
    chunk: int = 256,
) -> Column:
    """Fold ``items`` into a struct whose field ``out`` is a growing array.

    The state is copied at each step, so a long output would make the fold
    quadratic.  The items are therefore folded in chunks, each with an output
    of its own that is appended once; the other fields pass from chunk to chunk.
    """
    last = F.greatest(F.floor((F.size(items) - 1) / chunk).cast("int"), F.lit(0))
    chunks = F.transform(
        F.sequence(F.lit(0), last), lambda c: F.slice(items, c * chunk + 1, F.lit(chunk))
    )

    def state(value: Callable[[str], Column]) -> Column:
        return F.struct(*[value(name).alias(name) for name in zero])

    def outer(st, part):
        begin = state(lambda name: zero[name] if name == out else st[name])
        joined = F.transform(
            F.array(F.aggregate(part, begin, step)),
            lambda r: state(
                lambda name: F.concat(st[name], r[name]) if name == out else r[name]
            ),
        )
        return F.get(joined, 0)

    return F.aggregate(chunks, state(lambda name: zero[name]), outer)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(values: Column, chunk: int = 64, levels: int = 2) -> Column:
    """For each of ``values`` (longs) the sum of those before it.

    A growing array is copied at each step of a fold, so the values are cut into chunks:
    the sums before the chunks are found first, the same way, and the folds run inside
    chunks only.  With two levels the copies stay below ``chunk`` a value up to
    chunk ** 3 values.
    """

    def inside(part: Column, offset: Column) -> Column:
        zero = F.struct(offset.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            part, zero,
            lambda st, x: F.struct(
                (st["sum"] + x).alias("sum"), F.array_append(st["out"], st["sum"]).alias("out")
            ),
            lambda st: st["out"],
        )

    if not levels:
        return inside(values, F.lit(0).cast("bigint"))

    def chunks(whole: Column) -> Column:
        last = F.greatest(F.floor((F.size(whole) - 1) / chunk).cast("int"), F.lit(0))
        return F.transform(
            F.sequence(F.lit(0), last), lambda c: F.slice(whole, c * chunk + 1, F.lit(chunk))
        )

    def joined(parts: Column) -> Column:
        totals = F.transform(
            parts, lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x)
        )
        return F.flatten(F.zip_with(parts, running_sums(totals, chunk, levels - 1), inside))

    def summed(whole: Column) -> Column:
        few = inside(whole, F.lit(0).cast("bigint"))  # one chunk, as of most texts
        return F.when(F.size(whole) <= chunk, few).otherwise(let(chunks(whole), joined))

    return let(values, summed)
