"""Streams give what the same batch operators give."""

import datetime as dt
import tempfile

from helpers import SF_DIR
from pyspark.sql import functions as F

from tracequarry.operators import traces
from tracequarry.sources import fixtures
from tracequarry.streaming.spans import add_batch_with_rollups, ingest, tumbling


def source(spark, files=4):
    folder = tempfile.mkdtemp(prefix="spark-") + "/in"
    e = fixtures.espans(spark, SF_DIR).withColumn("started_at", F.col("started_at").cast("timestamp"))
    e = e.unionByName(e.where("duration_ms % 5 = 0"))  # some arrive twice
    e.repartition(files).write.parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return e, stream, folder


def test_ingest_is_idempotent(spark):
    e, stream, folder = source(spark)
    for k in range(2):  # the second time all spans are known
        query = ingest(stream, folder + "-table", f"{folder}-checkpoint-{k}")
        assert query.awaitTermination(120)
    got = spark.read.parquet(folder + "-table").drop("day").select(e.columns)
    assert got.count() == e.select("started_at", "span_id").distinct().count()
    assert got.exceptAll(traces.first_spans(e).select(e.columns)).count() == 0


def test_tumbling_counts(spark):
    e, stream, folder = source(spark)
    out = tumbling(stream, "1d", "60 days", ["project_id"]).writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    want = tumbling(e, "1d", "60 days", ["project_id"])
    got = spark.table("tumbled")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_append_mode_gives_closed_buckets_only(spark):
    e, stream, folder = source(spark)
    out = tumbling(stream, "1d", "0 seconds", ["project_id"]).writeStream.outputMode("append").format("memory").queryName("closed").trigger(availableNow=True).start()
    assert out.awaitTermination(120)
    got = spark.table("closed")
    last = e.agg(F.max("started_at")).first()[0].replace(hour=0, minute=0, second=0, microsecond=0)
    assert 0 < got.count() and got.where(F.col("bucket") >= F.lit(last)).count() == 0


def test_rollups_of_touched_traces(spark):
    """Batches in any order give the roll-ups of all spans, and flags stay."""
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    kinds = "project_id string, trace_id string, span_id string, parent_span_id string, kind string, status string, started_at timestamp, ended_at timestamp, duration_ms int, prompt_tokens int, completion_tokens int, cost_usd decimal(12,6)"
    row = lambda t, s, parent, at0, ms: ("p", t, s, parent, "llm", "ok", at(at0), at(at0 + 1), ms, 1, 2, None)
    folder = tempfile.mkdtemp(prefix="spark-")
    first = spark.createDataFrame([row("t", "b", "a", 5, 10), row("u", "x", None, 7, 70)], kinds)
    add_batch_with_rollups(first, folder + "/spans", folder + "/rollups")
    stored = spark.read.parquet(folder + "/rollups").collect()
    assert {(r["trace_id"], r["name"], r["started_at"], r["duration_ms"]) for r in stored} == {("t", "(root pending)", at(5), 1000), ("u", "llm", at(7), 70)}
    second = spark.createDataFrame([row("t", "a", None, 3, 30), row("t", "b", "a", 5, 10)], kinds)
    add_batch_with_rollups(second, folder + "/spans", folder + "/rollups")
    got = spark.read.parquet(folder + "/rollups").collect()
    assert {(r["trace_id"], r["name"], r["started_at"], r["duration_ms"], r["span_count"]) for r in got} == {("t", "llm", at(3), 30, 2), ("u", "llm", at(7), 70, 1)}
