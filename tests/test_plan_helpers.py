"""The helpers that steer plans and keep work folders."""

import pytest
from pyspark.sql import functions as F

from codeaudit.functions.arrays import fold
from codeaudit.functions.plan import broadcast_if_small, once, settled, spread, work_folder, written


def test_work_folder_is_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first.startswith(base) and first != second


def test_written_table_keeps_rows_and_types(spark):
    df = spark.range(5).select("id", F.array("id").alias("a"), F.lit("x").alias("s"))
    back = written(df, "t")
    assert back.dtypes == df.dtypes
    assert sorted(back.collect()) == sorted(df.collect())
    assert "Range" not in back._jdf.queryExecution().optimizedPlan().toString()


def test_broadcast_only_when_small(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(spark.range(10), 10))
    assert not hinted(broadcast_if_small(spark.range(11), 10))


def test_once_keeps_filters_above(spark):
    df = spark.range(10).withColumn("x", once(F.col("id") * 2)).where("x > 4")
    assert df.count() == 7
    assert settled(df, "x").where("x > 10").count() == 4


def test_spread_uses_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    wide = spark.range(0, 100, 1, cores * 2)
    assert spread(wide).rdd.getNumPartitions() == cores * 2


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_fold_equals_a_loop(spark, n):
    def step(st, x):
        total = st.total + x
        return F.struct(
            total.alias("total"),
            F.when(total % 7 == 0, F.concat(st.out, F.array(total))).otherwise(st.out).alias("out"),
        )

    zero = {"total": F.lit(0).cast("bigint"), "out": F.array().cast("array<bigint>")}
    items = F.sequence(F.lit(1).cast("bigint"), F.col("n")) if n else F.array().cast("array<bigint>")
    df = spark.createDataFrame([(n,)], "n long").select(fold(items, zero, "out", step).alias("f"))
    got = df.select("f.*").collect()[0]
    total, out = 0, []
    for x in range(1, n + 1):
        total += x
        if total % 7 == 0:
            out.append(total)
    assert (got.total, got.out) == (total, out)
