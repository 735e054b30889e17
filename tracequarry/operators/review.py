"""Sampling traces into a review queue, labelling, the queue's order and statistics, and promotion into datasets."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.functions import json_text as J

from . import guardrails
from .ordering import positions
from .tenancy import small
from .traces import sample_bucket

BATCH = 500
LOOKBACK_SECONDS = 86_400
MOST_CARRIED = 10_000
#: JSON values that stand for nothing where another field can be told instead.
NOTHING = ("null", "false", "0", "0.0", '""', "[]", "{}")


def sample_decision(traces: DataFrame, rate: float | str, control_rate: float | str) -> DataFrame:
    """traces with in_sample (errors always; others by their bucket) and in_control (were their checks clean).

    Rates are numbers or names of columns."""
    at = lambda r: F.col(r) if isinstance(r, str) else F.lit(r)
    return traces.withColumns({
        "in_sample": (F.col("status") == "error") | (sample_bucket(F.col("trace_id")) < at(rate)),
        "in_control": sample_bucket(F.concat(F.lit("control:"), F.col("trace_id"))) < at(control_rate),
    })


def sample_batch(traces: DataFrame, now: datetime, mark: datetime | None, limit: int = BATCH) -> DataFrame:
    """The oldest traces after the mark, up to now; ties by trace_id."""
    out = traces.where(F.col("started_at") <= F.lit(now).cast("timestamp_ntz"))
    if mark is not None:
        out = out.where(F.col("started_at") > F.lit(mark).cast("timestamp_ntz"))
    return out.orderBy("started_at", "trace_id").limit(limit)


def snapshots(spans: DataFrame, context_field: str = "context") -> DataFrame:
    """What a reviewer needs of each trace, in one aggregation: name, inputs (the root's, else the first span's), output (text
    of the last llm span, else the root's), context (of the first span that has one), model and prompt version.

    input and output are JSON texts; ties in time go by span_id."""
    filled = lambda v: F.when(~v.isin(*NOTHING), v)
    either = lambda c, a, b: F.coalesce(filled(J.field(F.col(c), a)), J.field(F.col(c), b))
    said = either("output", "text", "value")
    found = either("output", "documents", "value")
    given = J.field(F.col("input"), context_field)
    has_field = F.array_contains(F.coalesce(F.json_object_keys("input"), F.array().cast("array<string>")), context_field)
    as_list = F.when(J.is_list(given), given).otherwise(F.concat(F.lit("["), F.coalesce(given, F.lit("null")), F.lit("]")))
    context = F.when((F.col("kind") == "retrieval") & J.is_list(found), found).when(has_field, as_list)
    d = spans.withColumns({"_said": F.when(J.is_string(said), J.text_of(said)), "_context": context})
    order = ["started_at", "span_id"]
    first = lambda when, *cols: F.min(F.when(when, F.struct(*order, *cols)))
    root = ("name", "input", "_said")
    out = d.groupBy("project_id", "trace_id").agg(
        first(F.col("parent_span_id").isNull(), *root).alias("_root"), first(F.lit(True), *root).alias("_first"),
        F.max(F.when(F.col("kind") == "llm", F.struct(*order, "_said", "model", "prompt_version_id"))).alias("_llm"),
        first(F.col("_context").isNotNull(), "_context").alias("_ctx"),
    )
    top = F.coalesce("_root", "_first")
    return out.select(
        "project_id", "trace_id", top["name"].alias("trace_name"), F.coalesce(top["input"], F.lit("{}")).alias("inputs"),
        F.coalesce(F.col("_llm._said"), top["_said"]).alias("output"), F.col("_ctx._context").alias("context"),
        F.col("_llm.model").alias("model"), F.col("_llm.prompt_version_id").alias("prompt_version_id"),
    )


def to_review(snapshots: DataFrame, queue: DataFrame, rate: float | str, control_rate: float | str, enabled: dict[str, Column] | None = None) -> DataFrame:
    """New queue items of snapshots (project_id, trace_id, status, output, context as array): flagged ones and clean controls."""
    d = sample_decision(snapshots, rate, control_rate).where("in_sample")
    d = d.withColumn("findings", guardrails.findings(F.coalesce("output", F.lit("")), F.col("context"), enabled))
    d = d.where((F.size("findings") > 0) | F.col("in_control"))
    d = d.withColumn("sampled_as", F.when(F.size("findings") > 0, "flagged").otherwise("control")).withColumn("severity", guardrails.worst(F.col("findings")))
    return d.join(queue.select("project_id", "trace_id").distinct(), ["project_id", "trace_id"], "left_anti").withColumn("status", F.lit("pending"))


def sample_projects(traces: DataFrame, spans: DataFrame, queue: DataFrame, configs: DataFrame, now: datetime, limit: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """New queue items of all projects at once, and each project's next mark.

    configs: project_id, enabled, sample_rate, control_sample_rate, check_pii, check_grounding, check_toxicity, last_scanned_at
    (null: a day ago). Of each project the `limit` oldest traces after its mark count; the mark moves to the last of them, or
    to now. The checks are Spark's own functions and give null for odd values, so one project's odd trace stops no other."""
    ended = F.lit(now).cast("timestamp_ntz")
    active = configs.where("enabled").withColumn("_since", F.coalesce("last_scanned_at", ended - F.expr(f"INTERVAL {LOOKBACK_SECONDS} SECONDS")))
    oldest = active.agg(F.min("_since")).first()[0]  # reaches the scan as a filter
    recent = traces.where((F.col("started_at") <= ended) & (F.col("started_at") > F.lit(oldest).cast("timestamp_ntz")))
    recent = recent.join(small(active), "project_id").where(F.col("started_at") > F.col("_since"))
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("started_at", "trace_id"))
    batch = recent.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")
    marks = active.select("project_id").join(batch.groupBy("project_id").agg(F.max("started_at").alias("_last")), "project_id", "left")
    marks = marks.select("project_id", F.coalesce("_last", ended).alias("last_scanned_at"))
    sampled = sample_decision(batch, "sample_rate", "control_sample_rate").where("in_sample").drop("in_sample", "in_control")
    own = spans.where(F.col("started_at") >= F.lit(oldest).cast("timestamp_ntz"))  # a trace begins with its first span
    seen = snapshots(own.join(sampled.select("project_id", "trace_id"), ["project_id", "trace_id"], "left_semi"))
    seen = seen.withColumn("context", F.transform(J.elements(F.col("context")), J.text_of))
    columns = ["project_id", "trace_id", "status", "sample_rate", "control_sample_rate", "check_pii", "check_grounding", "check_toxicity"]
    checks = {name: F.col(f"check_{name}") for name in ("pii", "grounding", "toxicity")}
    items = to_review(seen.join(sampled.select(*columns), ["project_id", "trace_id"]), queue, "sample_rate", "control_sample_rate", checks)
    return items.drop("in_sample", "in_control", *columns[3:]), marks


#: What a label says besides its verdict, where the items have columns for it.
ABOUT_LABELS = ("corrected_output", "label_reason", "notes", "labelled_by", "labelled_at")


def label(items: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with labels (trace_id, project_id if the items have it, verdict, and of ABOUT_LABELS what there is; a null verdict
    skips) applied, and labels that are refused: those of promoted or unknown items and of verdicts other than good and bad.

    Of several labels of one item that are not refused the last by labelled_at counts, ties by the labels' values."""
    keys = [k for k in ("project_id", "trace_id") if k in items.columns]
    about = [c for c in ABOUT_LABELS if c in items.columns and c in labels.columns]
    known = items.groupBy(*keys).agg(F.max(F.col("promoted_at").isNotNull()).alias("_promoted"), F.lit(True).alias("_there"))
    judged = labels.join(known, keys, "left")
    reason = (
        F.when(F.col("_there").isNull(), "not found").when(F.col("_promoted") & F.col("verdict").isNotNull(), "already promoted")
        .when(F.col("verdict").isNotNull() & ~F.col("verdict").isin("good", "bad"), "unknown verdict")
    )
    judged = judged.withColumn("reason", reason)
    said = F.struct(*[c for c in ["labelled_at"] if c in labels.columns], F.col("verdict").alias("_v"), *[F.col(c).alias(f"_{c}") for c in about])
    new = judged.where("reason is null").groupBy(*keys).agg(F.max(said).alias("_new"))
    out = items.join(new, keys, "left")
    labelled = F.col("_new").isNotNull() & F.col("_new._v").isNotNull()
    out = out.withColumns({
        "status": F.when(labelled, "labeled").when(F.col("_new").isNotNull(), "skipped").otherwise(F.col("status")),
        "verdict": F.when(labelled, F.col("_new._v")).otherwise(F.col("verdict")),
    } | {c: F.when(labelled, F.col(f"_new._{c}")).otherwise(F.col(c)) for c in about})
    return out.select(*items.columns), judged.where("reason is not null").select(*labels.columns, "reason")


def queue_order(items: DataFrame, severity: Column) -> DataFrame:
    """Pending items, worst first; ties by doc_id."""
    return items.where("status = 'pending'").withColumn("severity", severity).orderBy(F.desc("severity"), "doc_id")


def queue_stats(items: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts by status, promoted items, and what the checks missed: bad ones among the labelled control items."""
    control = (F.col("sampled_as") == "control") & (F.col("status") == "labeled")
    missed = (F.col("sampled_as") == "control") & (F.col("verdict") == "bad")
    return items.groupBy(*(by or [])).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "labeled", "skipped")],
        F.count("promoted_at").alias("promoted"),
        F.count_if(control).alias("control_reviewed"),
        F.count_if(missed).alias("control_missed"),
        F.round(F.try_divide(F.count_if(missed), F.count_if(control)), 6).alias("estimated_miss_rate"),
    )


def expected_of(verdict: Column, corrected: Column, output: Column) -> Column:
    """A bad item's expected output is its correction, a good one's the output."""
    return F.when(verdict == "bad", corrected).otherwise(output)


def not_promotable(items: DataFrame) -> DataFrame:
    """Items that forbid a promotion, with the reason; it may go on if this is empty."""
    reason = (
        F.when(F.col("status") != "labeled", "not labeled").when(F.col("promoted_at").isNotNull(), "already promoted")
        .when(expected_of(F.col("verdict"), F.col("corrected_output"), F.col("output")).isNull(), "no expected output")
    )
    return items.withColumn("reason", reason).where(F.col("reason").isNotNull())


def promote(items: DataFrame, selected: DataFrame, existing: DataFrame) -> DataFrame:
    """The items of a new dataset version: the existing ones, the MOST_CARRIED first, then the selected review items in order
    of trace_id, with their provenance. ValueError or LookupError if any selected item may not be promoted."""
    wanted = selected.select("trace_id").distinct()
    if wanted.isEmpty():
        raise ValueError("no items selected")
    if not wanted.join(items, "trace_id", "left_anti").isEmpty():
        raise LookupError("one or more review items were not found")
    chosen = items.join(wanted, "trace_id", "left_semi")
    if refused := not_promotable(chosen).select("trace_id", "reason").take(1):
        raise ValueError(f"{refused[0]['trace_id']}: {refused[0]['reason']}")
    text = lambda c: F.coalesce(J.quoted(F.col(c)), F.lit("null"))
    source = [("source", F.lit('"review_queue"')), ("trace_id", text("trace_id")), ("verdict", text("verdict"))]
    provenance = J.object_of(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in source]))
    new = chosen.select(
        F.lit(1).alias("part"), F.lit(None).cast("long").alias("_at"), "trace_id",
        expected_of(F.col("verdict"), F.col("corrected_output"), F.col("output")).alias("expected_output"), provenance.alias("metadata"),
    )
    carried = existing.orderBy("item_index").limit(MOST_CARRIED)
    old = carried.select(F.lit(0).alias("part"), F.col("item_index").cast("long").alias("_at"), "trace_id", "expected_output", "metadata")
    return positions(old.unionByName(new), "item_index", "part", "_at", "trace_id").drop("_at")
