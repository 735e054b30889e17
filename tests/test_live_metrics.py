"""Metrics of running jobs and streams against those of the same rows at rest."""

from __future__ import annotations

import tempfile

import pytest
from helpers import SF_DIR
from pyspark.sql import functions as F

from tracequarry.operators import metrics, process_metrics as M
from tracequarry.sources import fixtures
from tracequarry.streaming.spans import live_timeseries


def stream_of(spark, files=3):
    folder = tempfile.mkdtemp(prefix="spark-")
    e = fixtures.espans(spark, SF_DIR).withColumns({"started_at": F.col("started_at").cast("timestamp"), "cost_usd": (F.col("duration_ms") / 1000).cast("decimal(12,6)"), "prompt_tokens": F.col("duration_ms")})
    e.repartition(files).write.parquet(folder + "/in")
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in"), folder


def test_a_streams_percentiles_are_exact(spark):
    e, stream, folder = stream_of(spark)
    save = lambda d, n: d.withColumn("n", F.lit(n)).write.mode("append").parquet(folder + "/out")
    assert live_timeseries(stream, "1d", "90 days", ["project_id"]).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", folder + "/c").trigger(availableNow=True).start().awaitTermination(200)
    out = spark.read.parquet(folder + "/out")
    rest = [c for c in out.columns if c not in ("project_id", "bucket", "n")]
    got = out.groupBy("project_id", "bucket").agg(F.max_by(F.struct(*rest), "n").alias("r")).select("project_id", F.col("bucket").cast("timestamp_ntz").alias("bucket"), "r.*")
    want = metrics.span_timeseries(e, "1d", ["project_id"]).select(got.columns)
    assert out.count() > got.count() == want.count() and got.exceptAll(want).count() == 0 and {"p50_ms", "p95_ms", "p99_ms", "cost_usd"} <= set(got.columns)


def test_watched_batches_and_streams_add_up(spark):
    e, stream, folder = stream_of(spark)
    watch = M.Watch()
    labels = {"status": (F.col("status"), ("ok", "error"))}
    seen_df, seen = watch.over(e, "eval_run_duration_seconds", F.col("duration_ms") / 10, **labels)
    seen_df.write.format("noop").mode("overwrite").save()
    watch.take(seen)
    rest = {(r["sample"], r["labels"], r["le"]): r["value"] for r in M.measured(e, "eval_run_duration_seconds", F.col("duration_ms") / 10, status=F.col("status")).collect()}
    assert watch.totals.keys() == rest.keys() and all(watch.totals[k] == pytest.approx(v) for k, v in rest.items())
    streamed = M.Watch()
    spark.streams.addListener(streamed)
    try:
        counted, none = streamed.over(stream, "eval_run_duration_seconds", F.col("duration_ms") / 10, **labels)
        assert none is None
        query = counted.writeStream.format("noop").option("checkpointLocation", folder + "/c").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        import time

        for _ in range(100):
            if streamed.totals.get(("eval_run_duration_seconds_count", "status=ok", None)) == rest["eval_run_duration_seconds_count", "status=ok", None]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(streamed)
    assert streamed.totals.keys() == rest.keys() and all(streamed.totals[k] == pytest.approx(v) for k, v in rest.items())
    lines = streamed.exposed().splitlines()
    assert len(lines) == len(rest) and any(x.startswith('eval_run_duration_seconds_bucket{status="ok",le="+Inf"} ') for x in lines)


def test_parts_merge_and_quantiles(spark):
    df = spark.createDataFrame([(0.05, "a"), (0.2, "a"), (0.2, "a"), (400.0, "a"), (None, "b")], "v double, p string")
    take = lambda d: M.measured(d, "provider_request_duration_seconds", F.col("v"), provider=F.col("p"), operation=F.lit("chat"))
    whole = sorted(map(tuple, take(df).collect()), key=str)
    parts = M.merged(take(df.where("v < 0.1 or v is null")).unionByName(take(df.where("v >= 0.1"))))
    assert sorted(map(tuple, parts.select("sample", "labels", "le", "value").collect()), key=str) == whole
    at = lambda q: {r["labels"]: r["value"] for r in M.quantiles(take(df), "provider_request_duration_seconds", q).collect()}
    a, b = "provider=a,operation=chat", "provider=b,operation=chat"
    assert at(0.5)[a] == pytest.approx(0.1 + 0.15 * 0.5) and at(1.0)[a] == 120.0 and at(0.5)[b] is None
    with pytest.raises(ValueError, match="has the labels"):
        M.measured(df, "build_info", service=F.lit("x"))
    gauge = M.merged(M.measured(df, "queue_depth", F.col("v"), queue=F.col("p")).unionByName(M.measured(df, "queue_depth", F.lit(7), queue=F.col("p"))))
    assert {r["labels"]: r["value"] for r in gauge.collect()} == {"queue=a": 400.0, "queue=b": 7.0}
