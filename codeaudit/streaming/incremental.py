"""Scans of files as they arrive, once or in new versions, and deduplication of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeaudit.functions.plan import broadcast_if_small, work_folder
from codeaudit.operators.code import (
    with_code,
    with_lines,
    with_resolved_statements,
    with_statements,
)
from codeaudit.operators.injection import is_injection, literals_of
from codeaudit.operators.rules import located, with_rule_hits
from codeaudit.sources.constants import INJECTION_EXTENSIONS
from codeaudit.sources.corpus import corpus_from_documents, source_files


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table as a stream of files; the schema comes from the table itself."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/documents*.parquet")


def rule_hit_rows(files: DataFrame, *extra: str) -> DataFrame:
    """Rule hits of each file on its own: stateless, so the same for batches and streams."""
    statements = with_resolved_statements(with_statements(with_code(source_files(files))))
    hits = with_rule_hits(statements).select("file_id", "path", *extra, "rule_hits")
    return located(hits, files.sparkSession).select("file_id", "path", *extra, "rule_id", "line", "col")


def injection_literal_rows(files: DataFrame) -> DataFrame:
    """One row per steering string literal; a line with two of them gives two rows.

    ``detected_at`` is the time at which the file arrived, that is of its micro-batch, so
    whatever order files land in, none is late.
    """
    wanted = files.where(
        F.col("ext").isin(*INJECTION_EXTENSIONS) & is_injection(F.col("content"))
    )
    rows = with_lines(wanted).select("file_id", "path", "ext", F.posexplode("raw"))
    literals = rows.select(
        F.lit("prompt-injection-text").alias("rule_id"),
        F.col("path").alias("file_path"),
        (F.col("pos") + 1).alias("line"),
        F.current_timestamp().alias("detected_at"),
        F.explode(literals_of(F.col("col"), F.col("ext"))).alias("literal"),
    )
    return literals.where(is_injection(F.col("literal")))


def deduplicate_stream(findings: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """First finding per key; a key is forgotten ``delay`` after it was last found.

    Without a delay keys are kept for good, and the stream equals a batch over everything
    that has landed.
    """
    keys = ["rule_id", "file_path", "line"]
    if delay is None:
        return findings.dropDuplicates(keys)
    return findings.withWatermark("detected_at", delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process everything that has landed and read the result back.

    Source offsets and state live in the checkpoint folder, so a restarted run
    continues where the last one stopped and the file sink stays exactly-once.
    """
    spark = stream.sparkSession
    folder = work_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


# --- files that land again ------------------------------------------------------------------


def land(stream: DataFrame, folder: str, run: str = "run") -> None:
    """Scan what has landed and add its findings and versions to the tables in ``folder``.

    ``stream`` is a stream of the file table with ``version`` (a number that grows with each
    change of a file) and ``is_deleted``.  Every micro-batch writes partitions of its own,
    and writes them again if it is run again, so a restart leaves no finding twice.  A file
    that changes is not looked up in older findings: ``current_findings`` tells which
    versions count.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        landed = f"{run}-{batch_id:012d}"
        files = batch.where(~F.col("is_deleted")).drop("is_deleted")
        hits = rule_hit_rows(files, "repo_id", "version")
        hits.write.mode("overwrite").parquet(f"{folder}/findings/landed={landed}")
        versions = batch.select("repo_id", "path", "version", "is_deleted").distinct()
        versions.write.mode("overwrite").parquet(f"{folder}/versions/landed={landed}")

    query = (
        stream.writeStream.foreachBatch(merge)
        .option("checkpointLocation", f"{folder}/state-{run}")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def current_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings of the last version of every file; none of files deleted in it.

    Of landings of one version the last counts.  The last version is a partial aggregate
    per path, and findings meet it by path, so neither contents nor old findings are
    rewritten when a file changes.
    """
    versions = spark.read.parquet(f"{folder}/versions").withColumn("landed", F.col("landed").cast("string"))
    last = versions.groupBy("repo_id", "path").agg(
        F.max(F.struct("version", "landed", "is_deleted")).alias("last")
    )
    kept = last.where("NOT last.is_deleted").select("repo_id", "path", "last.version", "last.landed")
    found = spark.read.parquet(f"{folder}/findings").withColumn("landed", F.col("landed").cast("string"))
    return found.join(kept, ["repo_id", "path", "version", "landed"], "left_semi").drop("landed")


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """Write the tables of ``folder`` to ``into`` without findings that no longer count."""
    found = current_findings(spark, folder)
    found.write.mode("overwrite").parquet(f"{into}/findings/landed=0")
    versions = spark.read.parquet(f"{folder}/versions").withColumn("landed", F.col("landed").cast("string"))
    last = versions.groupBy("repo_id", "path").agg(F.max(F.struct("version", "landed", "is_deleted")).alias("last"))
    last.select("repo_id", "path", "last.version", "last.is_deleted").write.mode("overwrite").parquet(
        f"{into}/versions/landed=0"
    )


def stream_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files land; the labelled ones land again, those of low quality as deleted."""
    folder = work_folder(spark, "rescan")
    first = corpus_from_documents(document_stream(spark, sf_dir))
    land(first.withColumns({"version": F.lit(1), "is_deleted": F.lit(False)}), folder, "first")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("file_id")).agg(
        F.coalesce(F.max(F.col("quality") == 0), F.lit(False)).alias("is_deleted")
    )
    again = corpus_from_documents(document_stream(spark, sf_dir)).join(broadcast_if_small(labels), "file_id")
    land(again.withColumn("version", F.lit(2)), folder, "second")
    return current_findings(spark, folder).select("file_id", "path", "rule_id", "line", "col")


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_from_documents(document_stream(spark, sf_dir))
    return run_to_table(rule_hit_rows(files), "scan")


def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus_from_documents(document_stream(spark, sf_dir))
    rows = deduplicate_stream(injection_literal_rows(files))
    return run_to_table(rows.select("rule_id", "file_path", "line"), "dedupe")
