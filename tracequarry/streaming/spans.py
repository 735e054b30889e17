"""Span streams: idempotent ingest into a table partitioned by day, and tumbling metrics. store.py has the table for large loads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracequarry.operators import metrics, traces
from tracequarry.scratch import written


BUCKETS = 64


def _exists(spark: SparkSession, table: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def add_batch(batch: DataFrame, table: str) -> None:
    """Appends the batch's spans that the table lacks. Only the batch's days are compared, so the work follows the batch."""
    spark = batch.sparkSession
    fresh = traces.first_spans(batch).withColumn("day", F.to_date("started_at"))
    days = [r["day"] for r in fresh.select("day").distinct().collect()]  # a batch spans a few days
    if not days:
        return
    if _exists(spark, table):
        stored = spark.read.schema(fresh.schema).parquet(table).where(F.col("day").isin(days))
        fresh = fresh.join(stored.select("day", "started_at", "span_id"), ["day", "started_at", "span_id"], "left_anti")
    fresh.write.mode("append").partitionBy("day").parquet(table)


def add_batch_with_rollups(batch: DataFrame, table: str, rollups: str) -> None:
    """add_batch, and the roll-ups of the batch's traces, recomputed from all stored spans: late and early spans count alike.

    Roll-ups are keyed by trace alone and lie in BUCKETS folders by a hash of it; only folders of touched traces are read
    and written again, so a trace whose begin moves leaves no second row."""
    spark = batch.sparkSession
    add_batch(batch, table)
    keys = ["project_id", "trace_id"]
    touched = batch.select(*keys).distinct()
    bucket = F.pmod(F.xxhash64("trace_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    numbers = [r["bucket"] for r in touched.select(bucket).distinct().collect()]  # BUCKETS numbers at most
    if not numbers:
        return
    new = traces.trace_rollup(spark.read.parquet(table).join(touched, keys, "left_semi")).withColumn("flagged_at", F.lit(None).cast("timestamp"))
    new = written(new.select("*", bucket), "rollups")
    if _exists(spark, rollups):
        stored = spark.read.schema(new.schema).parquet(rollups).where(F.col("bucket").isin(numbers))
        new = written(traces.upsert_rollup(stored, new), "rollups")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(rollups)


def ingest(spans: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Writes all that the stream has now. Nothing is ever too late: spans of old days are added to their day."""
    return spans.writeStream.foreachBatch(lambda batch, _: add_batch(batch, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(spans: DataFrame, bucket: str, lateness: str, by: list[str] | None = None) -> DataFrame:
    """Counts and errors of each bucket of a stream, for append mode: a bucket is given once no span can be late for it.

    Unlike ingest, spans later than `lateness` are left out; batch metrics over the table have them."""
    at = F.window("started_at", metrics.BUCKETS[bucket])
    out = spans.withWatermark("started_at", lateness).groupBy(*(by or []), at.alias("w")).agg(
        F.count("*").alias("span_count"), F.count_if(F.col("status") == "error").alias("error_count"), F.sum("duration_ms").alias("duration_ms")
    )
    return out.select(*(by or []), F.col("w.start").alias("bucket"), "span_count", "error_count", "duration_ms")


def live_timeseries(spans: DataFrame, bucket: str, lateness: str, by: list[str] | None = None) -> DataFrame:
    """All measures of span_timeseries, with exact percentiles, of a stream's buckets, for update mode: a bucket is given anew
    whenever spans come for it. The state of a bucket is a count for each distinct duration, which merges; it is dropped once
    the bucket is older than `lateness`."""
    at = F.window("started_at", metrics.BUCKETS[bucket])
    grouped = spans.withWatermark("started_at", lateness).groupBy(*(by or []), at.alias("w"))
    out = metrics.measured(grouped, spans.columns)
    return out.select(*(by or []), F.col("w.start").alias("bucket"), *[c for c in out.columns if c not in (*(by or []), "w")])
