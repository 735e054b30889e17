"""Two runs side by side: results and scores aligned by full outer joins, what changed, and what makes it doubtful."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9
CHANGES = ("regressed", "improved", "added", "removed")


def classify(baseline: Column, candidate: Column) -> Column:
    d = candidate - baseline
    return (
        F.when(baseline.isNull() & candidate.isNull(), "unchanged").when(baseline.isNull(), "added").when(candidate.isNull(), "removed")
        .when(F.abs(d) <= EPSILON, "unchanged").when(d > 0, "improved").otherwise("regressed")
    )


def compare_scores(baseline: DataFrame, candidate: DataFrame, key: str = "dataset_item_id") -> DataFrame:
    """Scores by item, or by place with key='item_index', and evaluator."""
    keys = [key, "evaluator"]
    out = baseline.select(*keys, F.col("score").alias("baseline")).join(candidate.select(*keys, F.col("score").alias("candidate")), keys, "full_outer")
    return out.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6)).withColumn("change", classify(F.col("baseline"), F.col("candidate")))


def compare_examples(baseline: DataFrame, candidate: DataFrame, key: str = "dataset_item_id") -> DataFrame:
    """A verdict for each item, its scores and changes by evaluator: a mixed item is unchanged, one that only one run has is
    added or removed. An evaluator's null score on one side does not make the item added."""
    sides = baseline.select(key, F.lit(True).alias("_b"), F.lit(None).cast("boolean").alias("_c")).unionByName(
        candidate.select(key, F.lit(None).cast("boolean").alias("_b"), F.lit(True).alias("_c"))
    )
    there = sides.groupBy(key).agg(F.coalesce(F.bool_or("_b"), F.lit(False)).alias("_b"), F.coalesce(F.bool_or("_c"), F.lit(False)).alias("_c"))
    compared = compare_scores(baseline, candidate, key)
    listed = F.array_sort(F.collect_list(F.struct("evaluator", "baseline", "candidate", "delta", "change")))  # one entry an evaluator
    has = {c: F.bool_or(F.col("change") == c).alias(f"_{c}") for c in ("regressed", "improved")}
    out = compared.groupBy(key).agg(*has.values(), listed.alias("evaluators")).join(there, key)
    verdict = (
        F.when(F.col("_regressed") & ~F.col("_improved"), "regressed").when(F.col("_improved") & ~F.col("_regressed"), "improved")
        .when(~F.col("_b"), "added").when(~F.col("_c"), "removed").otherwise("unchanged")
    )
    return out.select(key, verdict.alias("verdict"), "evaluators")


def compare_aggregates(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    mean = lambda d, n: d.groupBy("evaluator").agg(F.round(F.avg("score"), 6).alias(n))
    out = mean(baseline, "baseline").join(mean(candidate, "candidate"), "evaluator", "full_outer")
    return out.withColumn("delta", F.round(F.col("candidate") - F.col("baseline"), 6)).withColumn("change", classify(F.col("baseline"), F.col("candidate")))


def counts(examples: DataFrame) -> DataFrame:
    """One row: regressed, improved and all items."""
    return examples.agg(*[F.count_if(F.col("verdict") == v).alias(f"{v}_count") for v in CHANGES], F.count("*").alias("example_count"))


def in_order(examples: DataFrame, key: str = "dataset_item_id") -> DataFrame:
    return examples.orderBy(key)


def warnings(baseline: dict[str, Any], candidate: dict[str, Any], align: str = "identity") -> list[str]:
    """What else than the outputs differs between two runs (dataset_version_id, prompt_version_id, judge_prompt_version_id,
    model). ValueError if items cannot be aligned by identity."""
    if align not in ("identity", "positional"):
        raise ValueError(f"no alignment {align!r}")
    differ = lambda name: baseline.get(name) != candidate.get(name)
    out = []
    if differ("dataset_version_id"):
        if align == "identity":
            raise ValueError("runs use different dataset versions; align them by position instead")
        out.append("runs use different dataset versions; items are aligned by place, so unrelated items may be compared")
    if differ("prompt_version_id"):
        out.append("runs used different prompt versions")
    if differ("judge_prompt_version_id"):
        out.append("runs used different judge rubric versions; a score may have changed with the rubric")
    if differ("model"):
        out.append(f"runs used different models ({baseline.get('model')} -> {candidate.get('model')})")
    return out
