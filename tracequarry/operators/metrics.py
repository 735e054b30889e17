"""Span and trace metrics over a time range: totals, buckets, breakdowns and alert values. Percentiles are exact."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tenancy import small

BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "15m": "15 minutes", "1h": "1 hour", "1d": "1 day"}
#: Window name, its length in seconds and its bucket.
WINDOWS = {"15m": (900, "1m"), "1h": (3600, "1m"), "6h": (21_600, "5m"), "24h": (86_400, "15m"), "7d": (604_800, "1h"), "30d": (2_592_000, "1d")}
LATENCIES = (50, 95, 99)
METRICS = ("error_rate", "p95_latency_ms", "p99_latency_ms", "total_cost_usd", "trace_count")


def window(name: str, now: datetime) -> tuple[datetime, str]:
    """Begin and bucket of a named window that ends now."""
    if name not in WINDOWS:
        raise ValueError(f"unknown window {name!r}; one of {', '.join(WINDOWS)}")
    seconds, bucket = WINDOWS[name]
    return now - timedelta(seconds=seconds), bucket


def in_range(df: DataFrame, since: datetime | None = None, until: datetime | None = None, **equal: str | None) -> DataFrame:
    """Rows with since <= started_at <= until and the given column values; conditions that are None do not apply."""
    if since is not None:
        df = df.where(F.col("started_at") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.where(F.col("started_at") <= F.lit(until).cast("timestamp_ntz"))
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def bucketed(ts: Column, bucket: str) -> Column:
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}; one of {', '.join(BUCKETS)}")
    return F.window(ts, BUCKETS[bucket])["start"].cast("timestamp_ntz")


def _measures(latencies: bool = True) -> list[Column]:
    out = [
        F.count("*").alias("span_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        F.round(F.coalesce(F.try_divide(F.count_if(F.col("status") == "error"), F.count("*")), F.lit(0.0)), 6).alias("error_rate"),
    ]
    if latencies:
        out.append(F.percentile("duration_ms", F.array(*[F.lit(p / 100) for p in LATENCIES])).alias("_latencies"))
    return out


def _spread(df: DataFrame) -> DataFrame:
    """The percentiles, taken at once, as columns."""
    return df.withColumns({f"p{p}_ms": F.round(F.get("_latencies", F.lit(i)), 6) for i, p in enumerate(LATENCIES)}).drop("_latencies")


def _money(columns: list[str]) -> list[Column]:
    tokens = [c for c in ("prompt_tokens", "completion_tokens") if c in columns]
    return [F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost_usd"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens]]


def measured(grouped, columns: list[str]) -> DataFrame:
    """The measures of grouped spans with the given columns: a count for each distinct duration is what percentiles keep, so
    partial results merge, in a stream too."""
    return _spread(grouped.agg(*_measures(), *(_money(columns) if "cost_usd" in columns else [])))


def span_summary(spans: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Measures and the number of traces. Traces are counted apart: with a distinct count in it, the aggregation would build
    the percentiles' buffers for each trace."""
    by = by or []
    measures = _spread(spans.groupBy(*by).agg(*_measures(), *_money(spans.columns)))
    traces = spans.select(*by, "trace_id").where("trace_id is not null").distinct().groupBy(*by).agg(F.count("*").alias("trace_count"))
    if not by:
        return measures.crossJoin(traces)  # one row each
    same = [measures[c].eqNullSafe(traces[c]) for c in by]
    out = measures.join(traces, reduce(lambda a, b: a & b, same), "left")
    return out.select(*[measures[c] for c in measures.columns], F.coalesce("trace_count", F.lit(0).cast("long")).alias("trace_count"))


def span_timeseries(spans: DataFrame, bucket: str, by: list[str] | None = None, money: bool = True) -> DataFrame:
    """Measures of each bucket that has spans."""
    return _spread(spans.groupBy(*(by or []), bucketed(F.col("started_at"), bucket).alias("bucket")).agg(*_measures(), *(_money(spans.columns) if money else [])))


def breakdown(spans: DataFrame, dimension: str, limit: int = 20) -> DataFrame:
    """The values of the dimension with most spans; ties by value."""
    if dimension not in ("model", "kind"):
        raise ValueError(f"no breakdown by {dimension!r}")
    p95 = F.round(F.percentile("duration_ms", 0.95), 6).alias("p95_ms")
    out = spans.where(F.col(dimension).isNotNull()).groupBy(dimension).agg(*_measures(latencies=False), p95, *_money([]))
    return out.orderBy(F.desc("span_count"), dimension).limit(limit)


def trace_timeseries(traces: DataFrame, bucket: str, by: list[str] | None = None) -> DataFrame:
    errors = F.count_if(F.col("status") == "error")
    return traces.groupBy(*(by or []), bucketed(F.col("started_at"), bucket).alias("bucket")).agg(
        F.count("*").alias("trace_count"),
        errors.alias("error_count"),
        F.round(F.coalesce(F.try_divide(errors, F.count("*")), F.lit(0.0)), 6).alias("error_rate"),
        F.round(F.percentile("duration_ms", 0.95), 6).alias("p95_ms"),
        *([F.coalesce(F.sum("cost_usd"), F.lit(0)).cast("double").alias("cost_usd")] if "cost_usd" in traces.columns else []),
    )


def total_cost(spans: DataFrame, by: list[str] | None = None, since: datetime | None = None) -> DataFrame:
    """The sum of costs, null where no span has one."""
    return in_range(spans, since).groupBy(*(by or [])).agg(F.sum("cost_usd").cast("double").alias("total_cost_usd"))


def alert_values(traces: DataFrame, rules: DataFrame, now: datetime) -> DataFrame:
    """rules (rule, project_id, metric, window_seconds) with sample_size and value over each trailing window.

    The longest window is a filter of the scan. Measures are taken once for each project and window length, with partial
    aggregation, and joined to the rules after; values over no traces are null, except counts and costs."""
    longest = rules.agg(F.max("window_seconds")).first()[0] or 0
    ended = F.lit(now).cast("timestamp_ntz")
    recent = traces.where((F.col("started_at") <= ended) & (F.col("started_at") >= F.lit(now - timedelta(seconds=longest)).cast("timestamp_ntz")))
    lengths = rules.select("project_id", "window_seconds").distinct()
    begin = ended - F.make_dt_interval(secs=F.col("window_seconds"))
    hit = recent.select("project_id", "started_at", "status", "duration_ms", "cost_usd").join(small(lengths), "project_id").where(F.col("started_at") >= begin)
    measured = hit.groupBy("project_id", "window_seconds").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "error").alias("errors"), F.percentile("duration_ms", F.array(F.lit(0.95), F.lit(0.99))).alias("p"), F.sum("cost_usd").alias("cost"),
    )
    n = F.coalesce("n", F.lit(0).cast("long"))
    value = (
        F.when(F.col("metric") == "error_rate", F.try_divide("errors", "n")).when(F.col("metric") == "p95_latency_ms", F.get("p", F.lit(0)))
        .when(F.col("metric") == "p99_latency_ms", F.get("p", F.lit(1))).when(F.col("metric") == "total_cost_usd", F.coalesce(F.col("cost").cast("double"), F.lit(0.0)))
        .when(F.col("metric") == "trace_count", n.cast("double"))
    )
    joined = rules.join(measured, ["project_id", "window_seconds"], "left")
    return joined.select("rule", "project_id", "metric", "window_seconds", n.alias("sample_size"), F.round(value, 6).alias("value"))
