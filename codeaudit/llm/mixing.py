"""Mixing sources to target weights by weighted fair queueing.

Every source has a queue of its documents in a shuffled order that depends on the seed
only, and a virtual clock that runs from 0 to 1 while the source's target is consumed.
A document leaves its queue at the virtual time (words of the source up to its end) /
(target of the source); a second round through the queue follows the first one, as no
target exceeds twice the source.  Sorting all sources by that time gives the mix.  Since
the targets add up to the total budget, the budget is used up at virtual time 1: the
queue is cut there, inside a document where one straddles it.

Running sums are taken in two steps, over hash ranges of a source and inside a range, so
that a source holding a third of all rows is spread over thousands of groups.

Defined cases: null and blank texts have size 0, are taken with 0 words and never leave
a copy behind; a null source is a source of its own, the last one; repeated rows are
separate documents; an empty table gives an empty mix; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import BLANK, free_name, table, word_count

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix holds, in percent, and how often a document may be read.
BUDGET_PERCENT = 150
ROUNDS = 2
SEED = "mix-1"
#: Hash ranges of a source, in hexadecimal digits of the shuffle key.
RANGE_DIGITS = 3


def targets(sizes: DataFrame) -> DataFrame:
    """Target of every source, from (source, source_size).

    A level is looked for at which each source gets its weight times the level, or
    ``ROUNDS`` times its size where that is less: with sources in the order in which they
    reach their limit, the first k are at the limit and the others share what is left.
    One row a source, so the windows here see the list of sources and no document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1
    named = sizes.withColumn("weight", F.element_at(weights, place).cast("long"))
    named = named.withColumn("most", F.col("source_size") * ROUNDS)
    by_limit = Window.orderBy(
        (F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    everything = Window.partitionBy()
    seen = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    ranked = named.select(
        "*",
        (F.sum("source_size").over(everything) * BUDGET_PERCENT / 100).alias("budget"),
        F.sum("weight").over(everything).alias("all_weight"),
        F.coalesce(F.sum("most").over(seen), F.lit(0)).alias("full"),
        F.coalesce(F.sum("weight").over(seen), F.lit(0)).alias("full_weight"),
    )
    level = (F.col("budget") - F.col("full")) / (F.col("all_weight") - F.col("full_weight"))
    levelled = ranked.withColumn("level", level)
    fits = F.col("level") <= F.col("most") / F.col("weight")
    first = F.min(F.when(fits, F.struct(F.col("most") / F.col("weight"), "level"))).over(everything)
    shared = F.col("weight") * first["level"]
    target = F.when(first.isNull(), F.col("most").cast("double")).otherwise(
        F.least(shared, F.col("most").cast("double"))
    )
    return levelled.select("source", "source_size", "weight", target.alias("target"))


def schedule(docs: DataFrame, size: str, key: str) -> DataFrame:
    """``docs`` with source_size, target, taken and finish.

    ``size`` names the column of words, ``key`` the text that identifies a document for
    the shuffle.  ``finish`` is the virtual time at which the document's first copy ends.
    """
    order, part, queue_of, inside, start = (
        free_name(docs, n) for n in ("shuffled", "range", "queue", "inside", "start")
    )
    kept = docs.columns
    # text that also tells a null source from the others, so that window and join share keys
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    queue = docs.withColumn(order, F.md5(F.concat(F.lit(f"{SEED}|"), F.col(key))))
    queue = queue.withColumns({part: F.substring(order, 1, RANGE_DIGITS), queue_of: name})
    ranges = queue.groupBy(queue_of, part).agg(F.sum(size).alias("words"))
    ranges = written(ranges, "mix-ranges")
    sizes = ranges.groupBy(queue_of).agg(F.sum("words").alias("source_size"))
    named = F.when(F.col(queue_of) != "", F.expr(f"substring({queue_of}, 2)"))
    goals = targets(sizes.select(named.alias("source"), "source_size"))
    before = Window.partitionBy(queue_of).orderBy(part)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn(start, F.coalesce(F.sum("words").over(before), F.lit(0)))
        .drop("words")
        .join(goals.withColumn(queue_of, name).drop("source", "weight"), queue_of)
    )
    rest = [c for c in kept if c not in ("source", size)]
    earlier = (
        Window.partitionBy(queue_of, part)
        .orderBy(order, size, *rest)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = queue.withColumn(inside, F.coalesce(F.sum(size).over(earlier), F.lit(0)))
    rows = rows.join(starts, [queue_of, part])
    at = F.col(start) + F.col(inside)

    def words(lap: int):
        """Words of the document that its source's clock passes in this round before time 1."""
        left = F.floor("target") - (at + lap * F.col("source_size"))
        return F.greatest(F.lit(0).cast("long"), F.least(F.col(size), left))

    taken = sum((words(lap) for lap in range(1, ROUNDS)), words(0))
    finish = F.when(F.col("target") > 0, (at + F.col(size)) / F.col("target"))
    return rows.select(*kept, "source_size", "target", taken.cast("long").alias("taken"),
                       finish.alias("finish"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents, with the columns of ``docs``, in the order of the mix.

    A document taken more than once is there once a round; the copy at the end of a
    target is cut after the words that still fit.  Rows are range-partitioned by virtual
    finish time and sorted inside, so files written from them read in mix order.  There
    are as many ranges as shuffle partitions, which grow with the input and not with the
    cores, so that a task holds a small part of the texts; ranges that are next to each other
    and small may be merged.
    """
    work = docs.select(
        F.struct(*docs.columns).alias("row"), "source", word_count("text").alias("size"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
    )
    plan = schedule(work, "size", "key").filter("taken > 0")
    taken, full, text = F.col("taken"), F.col("size"), F.col("row.text")
    laps = F.sequence(F.lit(1), F.ceil(taken / full).cast("int"))
    out = plan.withColumn("lap", F.explode(laps))
    left = taken - (F.col("lap") - 1) * full
    ends = F.split(text, rf"(?<=[^{BLANK}])(?=[{BLANK}])")
    cut = F.array_join(F.slice(ends, F.lit(1), left.cast("int")), "")
    out = out.withColumn("text", F.when(left >= full, text).otherwise(cut))
    at = F.col("finish") + (F.col("lap") - 1) * F.col("source_size") / F.col("target")
    out = out.withColumn("at", at).repartitionByRange("at").sortWithinPartitions("at")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        length = F.when(left >= full, F.col("row.n_chars")).otherwise(F.length("text"))
        changed["n_chars"] = length.cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count("text").alias("size"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"),
    )
    return schedule(docs, "size", "key").select(
        "doc_id", "size", "source_size", "target", "taken", "finish"
    )
