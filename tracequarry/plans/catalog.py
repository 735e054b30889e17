"""The queries that the package registers; oracle.py has their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import alerts, comparison, evaluators, guardrails, metrics, registry, review, traces
from tracequarry.sources import fixtures

from . import platform
from .oracle import ORACLE_SQL as RELATIONAL_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(platform.QUERIES)
ORACLE_SQL: dict[str, str] = RELATIONAL_SQL | platform.ORACLE_SQL
NOW = datetime(2024, 1, 31)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.first_spans(fixtures.spans(spark, sf_dir), ("project_id", "trace_id", "span_id"), ("started_at", "duration_ms"))


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_rollup(_deduped(spark, sf_dir))


def _espan_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.espans(spark, sf_dir).withColumn("cost_usd", (F.col("duration_ms").cast("decimal(12,0)") / 1000).cast("decimal(12,6)"))
    return e.groupBy("project_id", "trace_id").agg(
        F.min("started_at").alias("started_at"), F.sum("duration_ms").alias("duration_ms"), F.sum("cost_usd").alias("cost_usd"),
        F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("ok").alias("status"),
    )


@query
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_summary(fixtures.spans(spark, sf_dir), ["project_id"])


@query
def span_summary_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.in_range(fixtures.spans(spark, sf_dir), datetime(1994, 1, 1), datetime(1996, 12, 31), kind="llm", model="model-1")
    return metrics.span_summary(found, ["project_id"])


@query
def span_timeseries_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_timeseries(fixtures.spans(spark, sf_dir), "1d")


@query
def span_timeseries_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.span_timeseries(fixtures.espans(spark, sf_dir), "15m", ["project_id"], money=False)


@query
def breakdown_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breakdown(fixtures.spans(spark, sf_dir), "model")


@query
def breakdown_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.breakdown(fixtures.spans(spark, sf_dir), "kind")


@query
def span_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _deduped(spark, sf_dir).select("project_id", "trace_id", "span_id", "started_at", "duration_ms", "status")


@query
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.ingest_report(fixtures.spans(spark, sf_dir))


@query
def trace_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir).withColumn("cost_usd", F.col("cost_usd").cast("double")).drop("metadata")


@query
def trace_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.trace_timeseries(_rollup(spark, sf_dir), "1d")


@query
def trace_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_list(_rollup(spark, sf_dir), limit=200, status="error").select("trace_id", "started_at", "span_count", "status")


@query
def total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_cost(fixtures.spans(spark, sf_dir), since=datetime(1994, 6, 1))


@query
def trace_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.total_cost(fixtures.spans(spark, sf_dir), ["trace_id"]).withColumnRenamed("total_cost_usd", "cost_usd")


def _rules(spark: SparkSession) -> DataFrame:
    """One rule of each metric for each project and two windows."""
    bounds = {"error_rate": 0.2, "p95_latency_ms": 3000.0, "p99_latency_ms": 5000.0, "total_cost_usd": 50.0, "trace_count": 5.0}
    rows = [
        (f"{m}-{p}-{w}", p, m, w, "below" if m == "trace_count" else "above", b, 3, 600, True, datetime(2024, 1, 30, 23, 55) if p == "p2" else None, 0)
        for m, b in bounds.items() for p in ("p0", "p1", "p2") for w in (3600, 604_800)
    ]
    kinds = "rule string, project_id string, metric string, window_seconds int, comparison string, threshold double, min_sample_size int, cooldown_seconds int, enabled boolean, last_fired_at timestamp_ntz, consecutive_failures int"
    return spark.createDataFrame(rows, kinds)


@query
def alert_metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.alert_values(_espan_traces(spark, sf_dir), _rules(spark), NOW).select("rule", "sample_size", "value")


@query
def alert_fire_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark)
    values = metrics.alert_values(_espan_traces(spark, sf_dir), rules, NOW).select("rule", "sample_size", "value")
    return alerts.decide(rules.join(values, "rule"), NOW).select("rule", "decision")


@query
def sample_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sample_decision(_rollup(spark, sf_dir), 0.1, 0.05).select("trace_id", "in_sample", "in_control")


@query
def sample_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.sample_batch(_espan_traces(spark, sf_dir), NOW, datetime(2024, 1, 10)).select("trace_id", "started_at")


@query
def guardrail_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(guardrails.pii_matches(F.col("text"), "email")).alias("emails")).where("emails > 0")


@query
def guardrail_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = docs.select("doc_id", F.array_join(guardrails.toxic_terms(F.col("text")), ",").alias("terms"), guardrails.toxicity_severity(F.col("text")).alias("severity"))
    return out.where("severity is not null")


@query
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fixtures.review_items(spark, sf_dir)
    severity = F.coalesce(guardrails.toxicity_severity(F.col("output")), F.lit(0.0))
    return review.queue_order(items, severity).select("doc_id", "severity", "sampled_as")


@query
def review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.queue_stats(fixtures.review_items(spark, sf_dir))


@query
def review_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labelled items that are not promoted yet, after the skipped ones as the dataset's items so far."""
    items = fixtures.review_items(spark, sf_dir).withColumn("corrected_output", F.concat(F.lit("corrected: "), "output"))
    skipped = items.where("status = 'skipped'").select("trace_id", F.col("doc_id").cast("long").alias("item_index"), F.col("output").alias("expected_output"), F.lit("{}").alias("metadata"))
    selected = items.where("status = 'labeled' and promoted_at is null and output is not null")
    return review.promote(items, selected, skipped).select("part", "item_index", "trace_id", F.md5("expected_output").alias("expected_md5"), "metadata")


@query
def eval_exact_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.eval_results(spark, sf_dir)
    return r.select("dataset_item_id", evaluators.exact_match(F.col("output"), F.col("expected_output")).alias("r")).select("dataset_item_id", "r.score", "r.passed", "r.error")


@query
def eval_regex_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.eval_results(spark, sf_dir)
    return r.select("dataset_item_id", evaluators.regex_match(F.col("output"), "^[A-M]", ignore_case=True).alias("r")).select("dataset_item_id", "r.score", "r.passed")


@query
def eval_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluators.retrieval_scores(*fixtures.retrievals(spark, sf_dir), k=5)
    return out.select(F.col("query_id").alias("vec_id"), *[F.round(n, 6).alias(n) for n in ("precision", "recall", "mrr")])


@query
def eval_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(evaluators.embedding_similarity(F.col("embedding"), F.col("other"))["score"], 6).alias("score"))


@query
def eval_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluators.aggregates(fixtures.eval_scores(spark, sf_dir), ["run_id", "evaluator"])


@query
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluators.run_status(fixtures.run_results(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = fixtures.eval_scores(spark, sf_dir)
    return s.where("run_id = 'A'"), s.where("run_id = 'B'")


@query
def compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_scores(*_sides(spark, sf_dir))


@query
def compare_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_examples(*_sides(spark, sf_dir)).select("dataset_item_id", "verdict")


@query
def compare_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare_aggregates(*_sides(spark, sf_dir))


@query
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fixtures.run_results(spark, sf_dir).where("run_id = 'A'")
    return evaluators.pending_items(fixtures.eval_results(spark, sf_dir), results).select("dataset_item_id")


@query
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest_version(fixtures.prompt_versions(spark, sf_dir))


def _labels(versions: DataFrame) -> DataFrame:
    top = versions.groupBy("prompt_slug").agg(F.max("version").alias("m"))
    production = top.select("prompt_slug", F.lit("production").alias("label"), F.greatest(F.lit(1), F.col("m") - 1).alias("version"))
    return production.unionByName(top.select("prompt_slug", F.lit("staging").alias("label"), F.col("m").alias("version")))


@query
def resolve_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.prompt_versions(spark, sf_dir)
    refs = F.explode(F.array(*map(F.lit, ("production", "staging", "2", "none"))))
    wanted = v.select("prompt_slug").distinct().select("prompt_slug", refs.alias("ref"))
    return registry.resolve(v, _labels(v), wanted).select("prompt_slug", "ref", "version", "version_id")


@query
def prompt_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fixtures.prompt_versions(spark, sf_dir)
    return registry.prompt_listing(v, _labels(v))


@query
def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([(f"model-{i}", f"{i + 1}.25", f"{i + 2}.50") for i in range(3)], "model string, i string, o string")
    prices = prices.select("model", F.col("i").cast("decimal(8,2)").alias("input_rate"), F.col("o").cast("decimal(8,2)").alias("output_rate"))
    s = fixtures.spans(spark, sf_dir).where("model is not null").select("model", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("duration_ms").cast("long").alias("completion_tokens"))
    return registry.costs(s, prices).groupBy("model").agg(F.sum("cost_usd").cast("double").alias("cost_usd"), F.count("*").alias("n"))


@query
def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.span_forest(_deduped(spark, sf_dir)).select("trace_id", "span_id", "depth", "placement")


@query
def span_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.orphans(_deduped(spark, sf_dir)).select("trace_id", "span_id", "parent_span_id")


@query
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.waterfall(fixtures.espans(spark, sf_dir)).select("span_id", "left_pct", "width_pct")


@query
def rate_limit_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fixtures.espans(spark, sf_dir).withColumn("cost", F.lit(1).cast("long"))
    return registry.rate_usage(e, 3600).select("span_id", "window_cost")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series with each day's share of all spans of its project."""
    s = fixtures.spans(spark, sf_dir)
    daily = metrics.span_timeseries(s, "1d", ["project_id"])
    total = metrics.span_summary(s, ["project_id"]).select("project_id", F.col("span_count").alias("total_spans"), F.col("p95_ms").alias("overall_p95_ms"))
    return daily.join(total, "project_id").withColumn("share", F.round(F.col("span_count") / F.col("total_spans"), 6))
