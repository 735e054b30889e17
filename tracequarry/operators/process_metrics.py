"""Counters, gauges and histograms of what the jobs do.

Samples are rows (sample, labels, le, value). A histogram is a count for each fixed bound, a sum and a count, so that samples
of any parts of a load add up; quantiles are read from them by interpolation within a bound. measured() takes samples from
rows in one aggregation. Watch takes them while a job runs, by Spark's observe(), in batches and in streams."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTER, GAUGE, HISTOGRAM = "counter", "gauge", "histogram"


@dataclass(frozen=True)
class Series:
    kind: str
    labels: tuple[str, ...]
    bounds: tuple[float, ...] = ()


#: The series of a run, their labels and bounds.
SERIES = {
    "spans_ingested_total": Series(COUNTER, ("source",)),
    "spans_rejected_total": Series(COUNTER, ("source", "reason")),
    "ingest_batches_total": Series(COUNTER, ("source",)),
    "queue_depth": Series(GAUGE, ("queue",)),
    "eval_run_duration_seconds": Series(HISTOGRAM, ("status",), (1, 5, 15, 30, 60, 120, 300, 600, 1800, 3600)),
    "eval_examples_total": Series(COUNTER, ("outcome",)),
    "provider_request_duration_seconds": Series(HISTOGRAM, ("provider", "operation"), (0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 120)),
    "provider_errors_total": Series(COUNTER, ("provider", "retryable")),
    "http_requests_total": Series(COUNTER, ("method", "path", "status")),
    "http_request_duration_seconds": Series(HISTOGRAM, ("method", "path"), (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1, 2.5, 5, 7.5, 10)),
    "build_info": Series(GAUGE, ("service", "environment")),
}


def _parts(name: str, value: Column | None, when: Column | None = None) -> list[tuple[str, float | None, Column]]:
    """(sample, le, aggregate) of a series, of the rows for which `when` holds."""
    series = SERIES[name]
    own = (lambda c: c) if when is None else (lambda c: F.when(when, c))
    if series.kind == HISTOGRAM:
        n = F.count(own(value))
        bounds = [(f"{name}_bucket", float(b), F.count(own(F.when(value <= b, 1)))) for b in series.bounds]
        return [*bounds, (f"{name}_bucket", float("inf"), n), (f"{name}_sum", None, F.coalesce(F.sum(own(value)), F.lit(0.0))), (f"{name}_count", None, n)]
    if series.kind == GAUGE:
        return [(name, None, F.max(own(F.lit(1.0) if value is None else value)))]
    return [(name, None, F.count(own(F.lit(1))) if value is None else F.coalesce(F.sum(own(value)), F.lit(0)))]


def measured(df: DataFrame, name: str, value: Column | None = None, **labels: Column) -> DataFrame:
    """Samples of a series from rows: counters count them or add up `value`, gauges take its greatest, histograms spread it.
    Null values are not in a histogram. Labels are those of the series."""
    series = SERIES[name]
    if set(labels) != set(series.labels):
        raise ValueError(f"{name} has the labels {', '.join(series.labels)}")
    parts = _parts(name, F.col("_value"))
    d = df.select(*[labels[k].cast("string").alias(k) for k in series.labels], (F.lit(1.0) if value is None else value.cast("double")).alias("_value"))
    out = d.groupBy(*series.labels).agg(*[c.cast("double").alias(f"_{i}") for i, (_, _, c) in enumerate(parts)])
    rows = F.array(*[F.struct(F.lit(s).alias("sample"), F.lit(le).cast("double").alias("le"), F.col(f"_{i}").alias("value")) for i, (s, le, _) in enumerate(parts)])
    listed = F.concat_ws(",", *[F.concat(F.lit(k + "="), F.coalesce(k, F.lit(""))) for k in series.labels])
    return out.select(listed.alias("labels"), F.explode(rows).alias("r")).select("r.sample", "labels", "r.le", "r.value")


def merged(samples: DataFrame) -> DataFrame:
    """Samples of several parts of a load as those of the whole; gauges by their greatest value."""
    gauges = [n for n, s in SERIES.items() if s.kind == GAUGE]
    value = F.when(F.first("sample").isin(gauges), F.max("value")).otherwise(F.sum("value"))
    return samples.groupBy("sample", "labels", "le").agg(value.alias("value"))


def quantiles(samples: DataFrame, name: str, q: float) -> DataFrame:
    """labels, value: the q-quantile of a histogram by interpolation within its bound; beyond the last one, that bound; null
    without observations."""
    own = samples.where(F.col("sample") == f"{name}_bucket").groupBy("labels").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))
    total = F.element_at("b", -1)["value"]
    rank = total * q
    at = F.array_min(F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: F.get("b", i)["value"] >= rank))
    upper, here = F.get("b", at)["le"], F.get("b", at)["value"]
    lower = F.when(at > 0, F.get("b", at - 1)["le"]).otherwise(0.0)
    below = F.when(at > 0, F.get("b", at - 1)["value"]).otherwise(0.0)
    inside = lower + (upper - lower) * F.coalesce(F.try_divide(rank - below, here - below), F.lit(0.0))
    return own.select("labels", F.when(total > 0, F.when(upper == float("inf"), lower).otherwise(inside)).alias("value"))


@dataclass
class Watch(StreamingQueryListener):
    """Totals of a driver's jobs, by (sample, labels, le). Labels that are watched have known values, as what is observed is
    one row. Add it to spark.streams for streams: a batch's numbers come with its progress, once."""

    totals: dict[tuple[str, str, float | None], float] = field(default_factory=dict)
    _known: dict[str, list[tuple[str, str, float | None]]] = field(default_factory=dict)

    def over(self, df: DataFrame, name: str, value: Column | None = None, **labels: tuple[Column, Iterable[str]]) -> tuple[DataFrame, Observation | None]:
        """df that is counted as it runs; for a batch with the Observation that take() reads afterwards."""
        series = SERIES[name]
        keys, made = [], []
        for chosen in product(*(list(labels[k][1]) for k in series.labels)):
            when = F.lit(True)
            for k, v in zip(series.labels, chosen, strict=True):
                when = when & (labels[k][0].cast("string") == v)
            listed = ",".join(f"{k}={v}" for k, v in zip(series.labels, chosen, strict=True))
            for sample, le, part in _parts(name, value, when):
                keys.append((sample, listed, le))
                made.append(part.cast("double").alias(f"m{len(made)}"))
        about = f"{name}-{uuid.uuid4().hex}"
        self._known[about] = keys
        if df.isStreaming:
            return df.observe(about, *made), None
        seen = Observation(about)
        return df.observe(seen, *made), seen

    def take(self, seen: Observation) -> None:
        self._add(seen._name, seen.get)

    def _add(self, about: str, values: dict[str, float]) -> None:
        for i, key in enumerate(self._known.get(about, [])):
            if (v := values.get(f"m{i}")) is not None:
                gauge = key[0] in SERIES and SERIES[key[0]].kind == GAUGE
                self.totals[key] = max(self.totals.get(key, v), v) if gauge else self.totals.get(key, 0.0) + v

    def exposed(self) -> str:
        """The totals as lines of the public text format."""
        def line(key: tuple[str, str, float | None], value: float) -> str:
            sample, labels, le = key
            pairs = [f'{k}="{v}"' for k, v in (p.split("=", 1) for p in labels.split(",") if p)]
            pairs += [] if le is None else ['le="+Inf"' if le == float("inf") else f'le="{le:g}"']
            return f"{sample}{{{','.join(pairs)}}} {value:g}"

        return "\n".join(line(k, v) for k, v in sorted(self.totals.items(), key=lambda x: (x[0][0], x[0][1], x[0][2] or 0))) + "\n"

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for about, row in event.progress.observedMetrics.items():
            self._add(about, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
