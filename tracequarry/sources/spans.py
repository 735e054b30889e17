"""Native span batches: JSON objects with a strict schema; what does not fit goes to a frame of rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.operators.tenancy import rejected

KINDS = ["chain", "llm", "retrieval", "rerank", "tool", "embedding", "guardrail", "other"]
STATUSES = ["ok", "error"]
MAX_BATCH = 500
SCHEMA = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("trace_id", T.StringType()), ("span_id", T.StringType()), ("parent_span_id", T.StringType()), ("name", T.StringType()), ("kind", T.StringType()),
            ("status", T.StringType()), ("started_at", T.TimestampType()), ("ended_at", T.TimestampType()), ("duration_ms", T.IntegerType()), ("input", T.StringType()),
            ("output", T.StringType()), ("metadata", T.StringType()), ("model", T.StringType()), ("prompt_tokens", T.IntegerType()), ("completion_tokens", T.IntegerType()),
            ("cost_usd", T.DecimalType(12, 6)), ("prompt_version_id", T.StringType()), ("error_type", T.StringType()), ("error_message", T.StringType()),
        ]
    ]
)
_CORRUPT = "_corrupt_record"


def validated(spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans that the schema admits, with defaults filled in and ids in lower case; and rejects with reasons."""
    hexed = lambda c, n: F.lower(F.col(c)).rlike(f"^[0-9a-f]{{{n}}}$")
    optional = lambda c, rule: F.col(c).isNull() | rule
    counted = lambda c: optional(c, F.col(c) >= 0)
    objects = lambda c: optional(c, F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False)))
    rules = {
        "trace_id": hexed("trace_id", 32), "span_id": hexed("span_id", 16), "parent_span_id": optional("parent_span_id", hexed("parent_span_id", 16)),
        "name": F.length("name").between(1, 200), "kind": optional("kind", F.col("kind").isin(KINDS)), "status": optional("status", F.col("status").isin(STATUSES)),
        "started_at": F.col("started_at").isNotNull(), "duration_ms": counted("duration_ms"), "prompt_tokens": counted("prompt_tokens"),
        "completion_tokens": counted("completion_tokens"), "input": objects("input"), "output": objects("output"), "metadata": objects("metadata"),
        "model": optional("model", F.length("model") <= 100), "error_type": optional("error_type", F.length("error_type") <= 200),
        "prompt_version_id": optional("prompt_version_id", F.lower("prompt_version_id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
    }
    if _CORRUPT in spans.columns:
        rules = {"record": F.col(_CORRUPT).isNull()} | rules
    good, bad = rejected(spans, rules)
    filled = {"kind": F.coalesce("kind", F.lit("other")), "status": F.coalesce("status", F.lit("ok")), "metadata": F.coalesce("metadata", F.lit("{}"))}
    lowered = {c: F.lower(c) for c in ("trace_id", "span_id", "parent_span_id")}
    return good.withColumns(filled | lowered).drop(_CORRUPT), bad


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected spans of lines (value: one JSON span). Fields that the schema does not name are no spans."""
    as_read = F.from_json("value", T.StructType([*SCHEMA.fields, T.StructField(_CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    # a generator, so that the optimiser does not parse again for each column and rule
    found = lines.select(F.inline(F.array(F.struct("value", as_read.alias("s"), F.json_object_keys("value").alias("_keys")))))
    unknown = F.size(F.array_except("_keys", F.array(*[F.lit(f.name) for f in SCHEMA.fields]))) > 0
    corrupt = F.when(F.col("_keys").isNull() | unknown | F.col("s").isNull(), F.col("value")).otherwise(F.col(f"s.{_CORRUPT}"))
    return validated(found.select(*[F.col(f"s.{f.name}").alias(f.name) for f in SCHEMA.fields], corrupt.alias(_CORRUPT)))


def read_spans(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files of one JSON span a line, compressed or not."""
    return parsed(spark.read.text(path))


def batches(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (body: {"spans": [...]}) as lines for parsed(), and requests that hold no or over MAX_BATCH spans."""
    spans = F.try_variant_get(F.try_parse_json("body"), "$.spans", "array<variant>")
    d = requests.withColumn("_spans", spans)
    fits = F.coalesce(F.size("_spans").between(1, MAX_BATCH), F.lit(False))
    return d.where(fits).select(F.explode(F.transform("_spans", lambda s: F.to_json(s))).alias("value")), d.where(~fits).drop("_spans")
