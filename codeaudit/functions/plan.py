"""Helpers that steer the optimizer without leaving the DataFrame API."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


T = TypeVar("T")

_BUILT: dict[tuple, object] = {}


def built(key: tuple, make: Callable[[], T]) -> T:
    """Columns that refer to others by name only, built once per JVM and then reused.

    Each function call on a Column is a message to the JVM, and the expressions
    of the code model and the rules take thousands of them.
    """
    full = (id(SparkContext._active_spark_context._jvm), *key)
    if full not in _BUILT:
        _BUILT[full] = make()
    return _BUILT[full]


def once(value: Column) -> Column:
    """``value``, computed in exactly the projection that names it.

    The optimizer substitutes a column's definition into filters it pushes down
    and into projections it merges.  For a column built from other large
    columns that repeats the work many times over.  A condition on the partition
    id is always true but keeps the optimizer from moving or copying the value.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of ``df`` with columns whose definitions the optimizer no longer follows.

    Filters and joins on a column are traced back through every projection it
    came from.  Passing the row through a generator of one element ends the
    trace; it costs one small array per row.
    """
    return df.select(F.inline_outer(F.array(F.struct(*[F.col(c) for c in columns]))))


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input of so few splits that some cores would wait for others.

    Spark cuts a small input into about one split per core, but a file with one
    row group leaves all of them empty but one.  A little more than one split per core
    is nearly as bad: a few tasks run when all others are done, as long again as
    the first ones.  Rows of less than two splits per core are dealt evenly; an
    input of more is left as it is and never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= 2 * cores:
        return df
    return df.repartition(cores if splits <= cores else 2 * cores)


def broadcast_if_small(keys: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast a key table after counting it; a larger one is left to a shuffle join.

    It saves the other side, often file contents, from being shuffled when the
    keys are few, and never forces a broadcast that would not fit.
    """
    few = keys.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(keys) if few else keys


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the session.

    Only a session on one machine, such as a test, may go without and gets a local folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="codeaudit-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` written as a table and read back: later plans start from the files."""
    spark = df.sparkSession
    path = folder or work_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
