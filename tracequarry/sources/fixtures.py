"""Views over the test tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODEL_ROWS = 4


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hex16(prefix: str, *parts) -> F.Column:
    return F.substring(F.md5(F.concat(F.lit(prefix), *parts)), 1, 16)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from order lines: (order, line) is the span, line // 2 its parent; line numbers repeat, so ids do."""
    joined = _read(spark, sf_dir, "lineitem").join(_read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    llm = lambda c: F.when(line == 3, c)
    kind = F.when(line == 1, "chain").when(line == 2, "retrieval").when(line == 3, "llm").when(line == 4, "rerank").when(line == 5, "tool").when(line == 6, "embedding")
    return joined.select(
        F.concat(F.lit("p"), (F.col("o_custkey") % 3).cast("string")).alias("project_id"),
        F.md5(F.concat(F.lit("t"), order)).alias("trace_id"),
        _hex16("s", order, F.lit("-"), line.cast("string")).alias("span_id"),
        F.when(line != 1, _hex16("s", order, F.lit("-"), F.floor(line / 2).cast("string"))).alias("parent_span_id"),
        kind.otherwise("other").alias("kind"),
        F.when((F.col("l_returnflag") == "R") & (line > 3), "error").otherwise("ok").alias("status"),
        F.col("o_orderdate").alias("started_at"),
        (F.col("o_orderdate") + F.make_dt_interval(secs=(cents % 5000) / F.lit(1000).cast("decimal(8,3)"))).alias("ended_at"),
        (cents % 5000).cast("int").alias("duration_ms"),
        llm(F.concat(F.lit("model-"), (F.col("l_suppkey") % MODEL_ROWS).cast("string"))).alias("model"),
        llm(F.col("l_quantity").cast("int")).alias("prompt_tokens"),
        llm(F.col("l_quantity").cast("int") * 2).alias("completion_tokens"),
        llm((cents.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(12,6)")).alias("cost_usd"),
    )


def espans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from events: timestamps within a month, for buckets under a day."""
    user, day = F.col("user_id").cast("string"), F.to_date("ts").cast("string")
    kind = F.when(F.col("event_type") == "purchase", "llm").when(F.col("event_type") == "view", "retrieval").when(F.col("event_type") == "click", "tool")
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"),
        F.md5(F.concat(F.lit("t"), user, F.lit("-"), day)).alias("trace_id"),
        _hex16("s", F.col("event_id").cast("string")).alias("span_id"),
        F.col("ts").alias("started_at"),
        kind.when(F.col("event_type") == "signup", "chain").otherwise("other").alias("kind"),
        F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
        F.round(F.col("value") * 10).cast("int").alias("duration_ms"),
    )


def eval_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation for each user turn with an answer right after it."""
    c = _read(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    expected = F.when(F.col("conv_id") % 7 == 0, None).when(F.col("conv_id") % 3 == 0, F.col("output")).otherwise(F.col("question"))
    return u.join(a, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("dataset_item_id"), "question", "output", expected.alias("expected_output"))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two runs by three evaluators; some are null, some items are missing on either side."""
    item = F.col("dataset_item_id")
    runs = F.array(*[F.struct(F.lit(r).alias("run_id"), F.lit(o).alias("off")) for r, o in (("A", 0), ("B", 1))])
    names = F.array(*[F.struct(F.lit(e).alias("evaluator"), F.lit(k).alias("k")) for e, k in (("exact_match", 1), ("regex_match", 2), ("retrieval_recall", 3))])
    wide = eval_results(spark, sf_dir).select("dataset_item_id", F.explode(runs).alias("r")).select("dataset_item_id", "r.*", F.explode(names).alias("e")).select("dataset_item_id", "run_id", "off", "e.*")
    wide = wide.where(~((F.col("run_id") == "A") & (item % 17 == 0)) & ~((F.col("run_id") == "B") & (item % 19 == 0)))
    score = ((item * 7 + F.col("k") * 3 + F.col("off") * (item % 4)) % 11).cast("double") / 10
    known = (item + F.col("k")) % 13 != 0
    passed = F.when(known & (F.col("k") < 3), score >= 0.5).alias("passed")
    return wide.select("run_id", "dataset_item_id", "evaluator", F.when(known, score).alias("score"), passed)


def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of three runs, one for each item: in A some items failed, in B none, in C all."""
    items = eval_scores(spark, sf_dir).select("run_id", "dataset_item_id").distinct()
    items = items.unionByName(items.where("run_id = 'B'").withColumn("run_id", F.lit("C")))
    failed = (F.col("run_id") == "C") | ((F.col("run_id") == "A") & (F.col("dataset_item_id") % 5 == 2))
    return items.withColumn("error", F.when(failed, "TimeoutError: no reply"))


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    j = d.join(l, d["doc_id"] == l["label_id"], "left")
    plain = F.col("label_id").isNull() | (F.col("doc_id") % 11 == 0)
    lowered = F.lower("text")
    flagged = lowered.contains("idiot") | lowered.contains("stupid") | lowered.contains("worthless")
    return j.select(
        "doc_id", F.md5(F.concat(F.lit("t"), F.col("doc_id").cast("string"))).alias("trace_id"), F.col("text").alias("output"),
        F.when(F.col("label_id").isNull(), "pending").when(F.col("doc_id") % 11 == 0, "skipped").otherwise("labeled").alias("status"),
        F.when(flagged, "flagged").otherwise("control").alias("sampled_as"),
        F.when(~plain, F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "bad").otherwise("good")).alias("verdict"),
        F.when(~plain & (F.col("doc_id") % 13 == 0), F.lit("2024-01-15").cast("timestamp_ntz")).alias("promoted_at"),
    )


def retrievals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ten retrieved vectors of each vector, and all vectors by label; the vectors of a label are relevant to each other."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "label")
    total = e.agg((F.max("vec_id") + 1).alias("total"))  # one row
    ranks = F.explode(F.sequence(F.lit(1), F.lit(10)))
    got = e.crossJoin(F.broadcast(total)).select(F.col("vec_id").alias("query_id"), F.col("label").alias("group"), ranks.alias("rank"), "total")
    key = (F.col("query_id") + F.col("rank") * 7) % F.col("total")
    return got.select("query_id", "group", "rank", key.alias("key")), e.select(F.col("vec_id").alias("key"), F.col("label").alias("group"))


def prompt_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    number = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return p.select(F.col("p_brand").alias("prompt_slug"), number.alias("version"), F.col("p_partkey").alias("version_id"), F.sha2("p_name", 256).alias("content_hash"))
