"""Incremental sync: re-read overlap, idempotent arrival, vanished items, run status, and the same on a stream."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def since_overlap(rows: DataFrame, at: str, last_success: Column, hours: int = 48) -> DataFrame:
    """Rows at or after the last success less the overlap; all rows where there was no success."""
    start = F.timestamp_add("HOUR", F.lit(-hours), last_success.cast("timestamp"))
    return rows.where(last_success.isNull() | (F.col(at).cast("timestamp") >= start))


def vanished(known: DataFrame, listed: DataFrame, key: str, full_pass: Column | bool = True) -> DataFrame:
    """Known, available items that an uninterrupted full listing no longer has."""
    gate = full_pass if isinstance(full_pass, Column) else F.lit(full_pass)
    return known.where((F.col("availability") == "available") & gate).join(listed.select(key).distinct(), key, "left_anti")


def item_fate(row_ok: Column, trashed: Column, changed: Column) -> Column:
    """What becomes of a listed item: failed rows are routed aside, trashed ones count as unchanged."""
    return F.when(~row_ok, "failed").when(trashed, "deleted_external").when(changed, "stored").otherwise("unchanged")


def isolated(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """`rows` with error_class: the first test that a row does not pass, or null. A test that can't be told counts as failed, so one
    bad row never ends the run; what comes after goes on with `error_class IS NULL`."""
    return rows.withColumn("error_class", F.coalesce(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items())))


def run_status(items: DataFrame, run: str, failed: Column, at: str) -> DataFrame:
    """(run, discovered, failed, status, success_at): completed without failures, failed if all failed, else partial; a
    run that did not fail moves the last success."""
    out = items.groupBy(run).agg(F.count("*").alias("discovered"), F.sum(F.when(failed, 1).otherwise(0)).alias("failed"), F.max(at).alias("last_at"))
    status = F.when(F.col("failed") == 0, "completed").when(F.col("failed") >= F.col("discovered"), "failed").otherwise("partial")
    return out.withColumn("status", status).withColumn("success_at", F.when(F.col("status") != "failed", F.col("last_at"))).drop("last_at")


def deduplicated(stream: DataFrame, key: list[str], at: str, delay: str = "48 hours") -> DataFrame:
    """One row a key; the state of keys older than the delay is let go."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.dropDuplicatesWithinWatermark(key)


def ingest(stream: DataFrame, key: list[str], target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append rows whose key the target (Parquet) lacks, batch by batch, resumable from its checkpoint.

    A batch that is run again finds its own rows there and adds nothing, which makes delivery exactly once in effect.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.schema(batch.schema).parquet(target).select(*key), key, "left_anti")
        new.write.mode("append").parquet(target)

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
