"""Audit of how text filters overlap, whatever the order they are applied in.

Every document gets a mask of the filters it fails.  Documents are then counted by part
and mask, and for each of the 2^n coalitions of filters the documents that it removes
are tabulated.  All further figures come from that small table: what a filter removes at
a step is the difference of two coalitions, and its Shapley value is the exact solution
of the least squares problem with the Shapley kernel as weights and efficiency as
constraint.  The normal equations are the same for every part, so their bordered matrix
is inverted once, in rationals; right-hand sides are integers per part.

Texts are read once, into a written table of one slim row a document.  Equal texts are
found by their SHA-256: the smallest doc_id of a text is a partial aggregate, and the
documents that hold it are joined on digest and doc_id together, so a text that a third
of all documents share is no hot key.

Defined cases: a null or empty text has no words and counts like any text, so it fails
the word and duplicate filters as the rules say; a null part is the empty string; a
document without a doc_id is neither earlier nor later than another and has no label;
rows repeated in full count each, but none is a duplicate of the other, as their doc_id
is the same; several label rows of a doc_id count as one with all their marks; very long
texts are read whole, as one array of words inside their row; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial, lcm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import written
from codeaudit.llm.common import BLANK, table

#: The filter that looks at other documents; its condition is not one on the text alone.
DUPLICATE = "E"


def text_filters() -> dict[str, Column]:
    """The failure conditions on the columns text, words (an array) and n_words."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.size(F.array_distinct("words")) < 65 * F.col("n_words"),
        "C": 100 * F.regexp_count("text", F.lit("[A-Z]")) > 5 * F.length("text"),
        "D": F.col("text").rlike(r"[#$%&*|]"),
    }


def failures(
    docs: DataFrame, filters: dict[str, Column] | None = None, part: str = "source"
) -> DataFrame:
    """(doc_id, part, digest, mask): bit i is set where filter i of ``filters`` fails the text."""
    conditions = text_filters() if filters is None else filters
    texts = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    words = F.array_remove(F.split("text", f"[{BLANK}]+"), "")
    counted = texts.withColumn("words", words).withColumn("n_words", F.size("words"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions.values())), F.lit(0))
    return counted.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask")
    )


def cells(failed: DataFrame, labels: DataFrame, duplicate_bit: int) -> DataFrame:
    """(part, mask, good, toxic, rows) with the bit of later equal texts added to the masks."""
    rows = failed.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("rows"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL")
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    named = (
        rows.filter("doc_id IS NOT NULL")
        .join(first.withColumn("first", F.lit(True)), ["doc_id", "digest"], "left")
        .join(marks, "doc_id", "left")
    )
    mask = F.col("mask") + F.when(F.col("first"), 0).otherwise(duplicate_bit)
    keys = ["part", "mask", "good", "toxic"]
    marked = named.select(
        "part", mask.alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in keys[2:]], "rows"
    )
    nameless = rows.filter("doc_id IS NULL").select(
        "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "rows"
    )
    return marked.unionByName(nameless).groupBy(*keys).agg(F.sum("rows").alias("rows"))


def coalitions(counted: DataFrame, n_filters: int) -> DataFrame:
    """One row a part: its rows, and for every coalition the rows, good and toxic that it removes.

    ``removal`` is an array over coalitions, in the order of their masks.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))).alias("coalition")
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))

    tabulated = counted.select("*", every).groupBy("part", "coalition").agg(
        F.sum("rows").alias("all_rows"), total(hit).alias("rows"),
        total(hit & F.col("good")).alias("good"), total(hit & F.col("toxic")).alias("toxic"),
    )
    row = F.struct("coalition", "rows", "good", "toxic")
    return tabulated.groupBy("part").agg(
        F.first("all_rows").alias("all_rows"), F.sort_array(F.collect_list(row)).alias("removal")
    )


def kernel(n: int) -> dict[int, Fraction]:
    """The Shapley kernel's weight of every coalition but the empty and the full one."""
    size = {s: s.bit_count() for s in range(1, (1 << n) - 1)}
    return {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s, k in size.items()}


def inverse(matrix: list[list[Fraction]]) -> list[list[Fraction]]:
    """The inverse by elimination, in rationals."""
    n = len(matrix)
    rows = [list(r) + [Fraction(int(i == j)) for j in range(n)] for i, r in enumerate(matrix)]
    for i in range(n):
        at = next(k for k in range(i, n) if rows[k][i])
        rows[i], rows[at] = rows[at], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        for k in range(n):
            if k != i and rows[k][i]:
                rows[k] = [x - rows[k][i] * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [r[n:] for r in rows]


def solver(n: int) -> list[list[Fraction]]:
    """Rows (one a filter) that turn the right-hand sides and the total into Shapley values.

    With one unknown a filter and a multiplier for efficiency, the conditions are
    A x + m 1 = b and 1'x = v(all), where A and b are weighted sums over coalitions.
    """
    weight = kernel(n)

    def entry(i: int, j: int) -> Fraction:
        both = (1 << i) | (1 << j)
        return sum((w for s, w in weight.items() if s & both == both), Fraction(0))

    bordered = [[entry(i, j) for j in range(n)] + [Fraction(1)] for i in range(n)]
    bordered.append([Fraction(1)] * n + [Fraction(0)])
    return inverse(bordered)[:n]


def with_shapley(table: DataFrame, n: int) -> DataFrame:
    """``table`` with ``values``: for each filter its Shapley value times n!, a whole number.

    ``sides`` are the right-hand sides of the normal equations, scaled to integers, and the
    full coalition's removal; a filter's value is their product with its row of the solver.
    """
    weight = kernel(n)
    scale = lcm(*(w.denominator for w in weight.values())) if weight else 1
    rows = [[x * factorial(n) / (scale if j < n else 1) for j, x in enumerate(row)] for row in solver(n)]
    common = lcm(*(x.denominator for row in rows for x in row))

    def weighted(factors: dict[str, int]) -> str:
        return " + ".join(f"{x}L * {name}" for name, x in factors.items() if x) or "0L"

    sides = [
        weighted({f"removal[{s}].rows": int(w * scale) for s, w in weight.items() if s >> i & 1})
        for i in range(n)
    ]
    sides.append(f"removal[{(1 << n) - 1}].rows")
    values = [weighted({f"sides[{j}]": int(x * common) for j, x in enumerate(row)}) for row in rows]
    # the sums are multiples of ``common``, so the quotients are exact
    solved = table.withColumn("sides", F.expr(f"array({', '.join(sides)})"))
    return solved.withColumn("values", F.expr(f"array({', '.join(f'({v}) div {common}L' for v in values)})"))


def steps(table: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step in it."""
    everything, plan = (1 << len(names)) - 1, []
    for order in map("".join, permutations(names)):
        before = 0
        for step, name in enumerate(order, 1):
            i = names.index(name)
            plan.append(f"named_struct('o', '{order}', 's', {step}, 'f', {i}, 'bit', {1 << i}, 'before', {before})")
            before |= 1 << i
    solved = with_shapley(table, len(names))
    each = solved.select(
        "part", "all_rows", "removal", "values",
        F.inline(F.expr(f"array({', '.join(plan)})")).alias("filter_order", "step", "filter", "bit", "before"),
    )

    def removal(coalition: Column, what: str) -> Column:
        return F.element_at("removal", coalition + 1)[what]

    before, after = F.col("before"), F.col("before") + F.col("bit")
    removed = removal(after, "rows") - removal(before, "rows")
    full, without = F.lit(everything), F.lit(everything) - F.col("bit")
    return each.select(
        "part", "filter_order", "step",
        (F.col("all_rows") - removal(after, "rows")).alias("kept"),
        removed.alias("removed"),
        (removal(F.col("bit"), "rows") - removed).alias("redundant"),
        (removal(full, "rows") - removal(without, "rows")).alias("unique_fails"),
        (removal(after, "good") - removal(before, "good")).alias("good_lost"),
        (removal(after, "toxic") - removal(before, "toxic")).alias("toxic_lost"),
        F.element_at("values", F.col("filter") + 1).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "source"
) -> DataFrame:
    """What each filter removes at each step of each order, with its Shapley value times n!.

    ``filters`` names conditions on the text by one letter each; the filter of equal texts
    comes last.  Orders are spelled out, so a handful of filters is what it is for.
    """
    conditions = text_filters() if filters is None else filters
    failed = written(failures(docs, conditions, part), "failures")
    names = "".join(conditions) + DUPLICATE
    return steps(coalitions(cells(failed, labels, 1 << len(conditions)), len(names)), names)


def op11_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
