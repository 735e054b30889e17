"""Queries over the platform's own flows (payloads, review, runs, registry), each with its SQL for DuckDB.

Inputs are built from the test tables in the shapes that clients send: OTLP payloads, JSON lines, uploads, templates."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Callable
from datetime import date, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.functions import formats, generation, templates
from tracequarry.functions import json_text as J
from tracequarry.operators import admission, alerts, comparison, evaluators, guardrails, metrics, process_metrics, registry, review, runner, tenancy, traces
from tracequarry.scratch import delete_at_end, scratch_root, written
from tracequarry.sources import datasets, fixtures, otlp, otlp_protobuf
from tracequarry.sources import spans as native
from tracequarry.streaming import store

from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = datetime(2024, 1, 31)


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- OTLP -----------------------------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload for each order: ids in hexadecimal or base64, all ways to say 'no parent', attributes of three generations."""
    l = _table(spark, sf_dir, "lineitem")
    order, line = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    own = F.substring(F.md5(F.concat(F.lit("s"), order, F.lit("-"), line.cast("string"))), 1, 16)
    above = F.substring(F.md5(F.concat(F.lit("s"), order, F.lit("-"), F.floor(line / 2).cast("string"))), 1, 16)
    start = F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000 + line * 1_000_000
    text = lambda k, v: F.concat(F.lit('{"key":"' + k + '","value":{"stringValue":"'), v, F.lit('"}}'))
    part = F.concat(F.lit("part "), F.col("l_partkey").cast("string"))
    by_line = [
        (1, [text("team", F.lit('a\\"b'))]),
        (2, [text("db.system", F.lit("Qdrant")), text("traceloop.entity.output", F.concat(F.lit('{\\"documents\\": [\\"'), part, F.lit('\\"]}')))]),
        (3, [
            text("gen_ai.prompt.0.role", F.lit("user")), text("gen_ai.prompt.0.content", part), text("llm.request.model", F.lit("old")),
            text("gen_ai.response.model", F.concat(F.lit("model-"), (F.col("l_suppkey") % 4).cast("string"))),
            F.concat(F.lit('{"key":"gen_ai.usage.input_tokens","value":{"intValue":"'), F.col("l_quantity").cast("int").cast("string"), F.lit('"}}')),
            F.lit('{"key":"gen_ai.usage.output_tokens","value":{"boolValue":true}}'),
            text("gen_ai.usage.cost", (cents.cast("decimal(18,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(12,6)").cast("string")),
        ]),
        (4, [text("gen_ai.operation.name", F.lit("")), text("llm.request.type", F.lit("rerank"))]),
        (5, [text("traceloop.span.kind", F.lit("tool")), F.concat(F.lit('{"key":"n","value":{"arrayValue":{"values":[{"intValue":'), line.cast("string"), F.lit("},{\"stringValue\":\"x\"}]}}}"))]),
    ]
    attributes = F.lit("")
    for n, listed in by_line:
        attributes = F.when(line == n, F.concat_ws(",", *listed)).otherwise(attributes)
    end = F.when(line == 7, start - 1_000_000).when(line != 6, start + (cents % 5000) * 1_000_000)
    failed = (F.col("l_returnflag") == "R") & (line > 3)
    span = F.concat(
        F.lit('{"traceId":"'), F.upper(F.md5(F.concat(F.lit("t"), order))), F.lit('","spanId":"'), F.when(line % 2 == 0, F.base64(F.unhex(own))).otherwise(own),
        F.lit('","parentSpanId":"'), F.when(line > 1, above).when(F.col("l_orderkey") % 2 == 0, "0000000000000000").otherwise(""),
        F.lit('","name":"'), F.when(line == 7, "").otherwise(F.concat(F.lit("step "), line.cast("string"))), F.lit('","startTimeUnixNano":"'), start.cast("string"), F.lit('"'),
        F.when(end.isNull(), "").otherwise(F.concat(F.lit(',"endTimeUnixNano":'), end.cast("string"))),
        F.when(failed, ',"status":{"code":2,"message":"failed"}').otherwise(""), F.lit(',"attributes":['), attributes, F.lit("]"),
        F.when(line == 5, F.concat(F.lit(',"events":[{"name":"log"},{"name":"exception","attributes":['), text("exception.type", F.lit("TypeError")), F.lit(","), text("exception.message", part), F.lit("]}]"))).otherwise(""),
        F.lit("}"),
    )
    d = l.select("l_orderkey", span.alias("span")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("span"), ",").alias("spans"))  # an order's lines
    head = '{"resourceSpans":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"shop"}}]},"scopeSpans":[{"scope":{"name":"lib"},"spans":['
    good = F.concat(F.lit(head), "spans", F.lit("]}]}]}"))
    broken = F.when(F.col("l_orderkey") % 50 == 7, F.lit("[]")).when(F.col("l_orderkey") % 50 == 8, F.regexp_replace(good, '"spanId":"', '"spanId":"zz')).otherwise(good)
    return d.select(broken.alias("body"))


_OTLP_SQL = """WITH s AS (SELECT *, CAST(round(l_extendedprice*100) AS BIGINT) AS cents, epoch_us(l_shipdate) + l_linenumber * 1000 AS us,
  'part ' || l_partkey::VARCHAR AS part, l_returnflag = 'R' AND l_linenumber > 3 AS failed FROM lineitem WHERE l_orderkey % 50 NOT IN (7, 8))
SELECT md5('t' || l_orderkey::VARCHAR) AS trace_id, substr(md5('s' || l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 16) AS span_id,
  CASE WHEN l_linenumber > 1 THEN substr(md5('s' || l_orderkey::VARCHAR || '-' || (l_linenumber // 2)::VARCHAR), 1, 16) END AS parent_span_id,
  CASE WHEN l_linenumber = 7 THEN 'unnamed' ELSE 'step ' || l_linenumber::VARCHAR END AS name,
  CASE l_linenumber WHEN 1 THEN 'chain' WHEN 2 THEN 'retrieval' WHEN 3 THEN 'llm' WHEN 4 THEN 'rerank' WHEN 5 THEN 'tool' ELSE 'other' END AS kind,
  CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, make_timestamp(us) AS started_at,
  CASE WHEN l_linenumber = 7 THEN make_timestamp(us - 1000) WHEN l_linenumber <> 6 THEN make_timestamp(us + (cents % 5000) * 1000) END AS ended_at,
  CASE WHEN l_linenumber < 6 THEN cents % 5000 END AS duration_ms,
  CASE WHEN l_linenumber = 3 THEN '{"messages":[{"role":"user","content":"' || part || '"}]}' END AS input,
  CASE WHEN l_linenumber = 2 THEN '{"documents":["' || part || '"]}' END AS output,
  CASE l_linenumber WHEN 1 THEN '{"team":"a\\"b",' WHEN 2 THEN '{"db.system":"Qdrant",' WHEN 5 THEN '{"n":[5,"x"],' ELSE '{' END || '"resource":{"service.name":"shop"},"otel.scope":"lib","otel.ingest":"otlp"}' AS metadata,
  CASE WHEN l_linenumber = 3 THEN 'model-' || (l_suppkey % 4)::VARCHAR END AS model, CASE WHEN l_linenumber = 3 THEN l_quantity::INT::BIGINT END AS prompt_tokens, NULL::BIGINT AS completion_tokens,
  CASE WHEN l_linenumber = 3 THEN round(cents / 1000000.0, 6)::DOUBLE END AS cost_usd, CASE WHEN l_linenumber = 5 THEN 'TypeError' END AS error_type,
  CASE WHEN l_linenumber = 5 THEN part WHEN failed THEN 'failed' END AS error_message FROM s"""


@query(_OTLP_SQL)
def otlp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = otlp.to_spans(otlp.decode(_payloads(spark, sf_dir))[0])
    return spans.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")} | {"cost_usd": F.col("cost_usd").cast("double")})


@query("""SELECT CASE WHEN l_orderkey % 50 = 7 THEN 'payload is not a JSON object' ELSE 'spanId is no identifier' END AS reason, count(DISTINCT l_orderkey) AS payloads
FROM lineitem WHERE l_orderkey % 50 IN (7, 8) GROUP BY 1""")
def otlp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.decode(_payloads(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("payloads"))


def _to_protobuf(body: pd.Series) -> pd.Series:
    """The payloads of _payloads in protobuf; one kind is cut off, one damaged."""
    plain = {"stringValue": "string", "intValue": "int", "boolValue": "bool"}

    def value(v: dict) -> dict:
        (kind, x), *_ = v.items()
        if kind == "arrayValue":
            return {"list": {"values": [value(one) for one in x["values"]]}}
        return {plain[kind]: int(x) if kind == "intValue" else x}

    pairs = lambda of: [{"key": a["key"], "value": value(a["value"])} for a in of]
    number = lambda text: bytes.fromhex(text) if len(text) in (16, 32) else base64.b64decode(text)

    def span(s: dict) -> dict:
        out = {"trace_id": number(s["traceId"]), "span_id": number(s["spanId"]), "parent_span_id": number(s["parentSpanId"]), "name": s["name"], "start": int(s["startTimeUnixNano"])}
        if "endTimeUnixNano" in s:
            out["end"] = int(s["endTimeUnixNano"])
        if "status" in s:
            out["status"] = s["status"]
        return out | {"attributes": pairs(s["attributes"]), "events": [{"name": e["name"], "attributes": pairs(e.get("attributes", []))} for e in s.get("events", [])]}

    def one(text: str) -> bytes:
        if not text.startswith("{"):
            return b"\x0a\x05cut"
        if re.search('"spanId":"zz[^"]{12}', text):
            return b"\x0a\x02\x0f\x00"
        groups = [
            {"resource": {"attributes": pairs(g["resource"]["attributes"])}, "scope_spans": [{"scope": c["scope"], "spans": [span(x) for x in c["spans"]]} for c in g["scopeSpans"]]}
            for g in json.loads(text)["resourceSpans"]
        ]
        return otlp_protobuf.write({"resource_spans": groups}, "request")

    return body.map(one)


def _binary_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _payloads(spark, sf_dir).select(F.pandas_udf(_to_protobuf, "binary")("body").alias("body"))


@query(_OTLP_SQL)
def otlp_protobuf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = otlp_protobuf.decode(_binary_payloads(spark, sf_dir)).where("reason is null").drop("reason")
    return otlp.to_spans(decoded).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "ended_at")} | {"cost_usd": F.col("cost_usd").cast("double")})


@query("""SELECT 'malformed protobuf: ' || CASE WHEN l_orderkey % 50 = 7 THEN 'cut off within a field' ELSE 'unknown wire type 7' END AS reason, count(DISTINCT l_orderkey) AS payloads
FROM lineitem WHERE l_orderkey % 50 IN (7, 8) GROUP BY 1""")
def otlp_protobuf_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp_protobuf.decode(_binary_payloads(spark, sf_dir)).where("reason is not null").groupBy("reason").agg(F.count("*").alias("payloads"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, CASE WHEN l_linenumber > 4 THEN 14 ELSE 16 END) AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber > 4 ORDER BY id) AS n FROM s)
SELECT l_orderkey, count(*) FILTER (l_linenumber <= 4) AS accepted, count(*) FILTER (l_linenumber > 4) AS rejected_spans,
coalesce(string_agg(id || ': span_id cannot be stored', '; ' ORDER BY id) FILTER (l_linenumber > 4 AND n <= 3), '') AS error_message FROM b GROUP BY 1""")
def otlp_partial_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary payloads of an order each, in which later lines have span ids of seven bytes."""
    l = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    id_ = F.substring(F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))), 1, 16)
    d = l.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_linenumber") > 4, F.substring(id_, 1, 14)).otherwise(id_)).alias("ids"))  # an order's lines

    def request(orders: pd.Series, ids: pd.Series) -> pd.Series:
        spans = lambda order, own: [{"trace_id": order.to_bytes(16), "span_id": bytes.fromhex(i), "start": 1} for i in own]
        return pd.Series([otlp_protobuf.write({"resource_spans": [{"scope_spans": [{"spans": spans(o, own)}]}]}, "request") for o, own in zip(orders, ids, strict=True)])

    bodies = d.select("l_orderkey", F.pandas_udf(request, "binary")("l_orderkey", "ids").alias("body"))
    return otlp.partial_success(*otlp.split(otlp.to_spans(otlp_protobuf.decode(bodies).where("reason is null").drop("reason"))), "l_orderkey")


# ---- native spans ---------------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, some of which the schema forbids."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    fields = F.struct(
        F.upper(F.md5(n.cast("string"))).alias("trace_id"), F.when(n % 40 == 0, "short").otherwise(F.substring(F.md5(n.cast("string")), 1, 16)).alias("span_id"),
        F.when(n % 60 == 0, "").otherwise(F.col("event_type")).alias("name"), F.when(n % 80 == 0, "weird").when(n % 3 == 0, "llm").alias("kind"),
        F.col("ts").cast("timestamp").alias("started_at"), F.when(n % 90 == 0, -1).otherwise(F.round("value").cast("int")).alias("duration_ms"),
        F.when(n % 7 == 0, "x").alias("surplus"),
    )
    return e.select(F.when(n % 110 == 0, "{broken").otherwise(F.to_json(fields)).alias("value"))


_NATIVE_SQL = """n AS (SELECT event_id AS n, event_type, round(value) AS v FROM events),
r AS (SELECT *, list_filter([CASE WHEN n % 110 = 0 OR n % 7 = 0 THEN 'record' END, CASE WHEN n % 110 = 0 THEN 'trace_id' END, CASE WHEN n % 110 = 0 OR n % 40 = 0 THEN 'span_id' END,
  CASE WHEN n % 110 = 0 OR n % 60 = 0 THEN 'name' END, CASE WHEN n % 110 <> 0 AND n % 80 = 0 THEN 'kind' END, CASE WHEN n % 110 = 0 THEN 'started_at' END,
  CASE WHEN n % 110 <> 0 AND n % 90 = 0 THEN 'duration_ms' END], lambda x: x IS NOT NULL) AS why FROM n)"""


@query(f"WITH {_NATIVE_SQL} SELECT array_to_string(why, ',') AS reasons, count(*) AS spans FROM r WHERE len(why) > 0 GROUP BY 1")
def span_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = native.parsed(_lines(spark, sf_dir))[1]
    return bad.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("spans"))


@query(f"""WITH {_NATIVE_SQL} SELECT md5(n::VARCHAR) AS trace_id, CASE WHEN n % 3 = 0 THEN 'llm' ELSE 'other' END AS kind, 'ok' AS status, event_type AS name, v::INT AS duration_ms FROM r WHERE len(why) = 0""")
def span_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.parsed(_lines(spark, sf_dir))[0].select("trace_id", "kind", "status", "name", "duration_ms")


# ---- review ---------------------------------------------------------------------------------------------------------


def _told_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deduplicated spans with payloads: the root asks, a retrieval finds, an llm answers."""
    s = traces.first_spans(fixtures.spans(spark, sf_dir), ("project_id", "trace_id", "span_id"), ("started_at", "duration_ms"))
    n = F.col("duration_ms").cast("string")
    said = lambda key, what: F.concat(F.lit('{"' + key + '":'), what, F.lit("}"))
    quoted = lambda what: F.concat(F.lit('"' + what), n, F.lit('"'))
    kind = F.col("kind")
    return s.withColumns({
        "name": kind, "prompt_version_id": F.lit(None).cast("string"),
        "input": F.when(kind == "chain", said("question", quoted("q"))).when(kind == "tool", said("context", quoted("c"))),
        "output": F.when(kind == "retrieval", said("documents", F.concat(F.lit("["), quoted("d"), F.lit(',"e"]')))).when(kind == "llm", said("text", quoted("a"))).when(kind == "chain", said("value", quoted("r"))),
    })


@query(f"""WITH {O.DEDUPED}, one AS (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id, parent_span_id IS NULL ORDER BY span_id) AS k,
  row_number() OVER (PARTITION BY project_id, trace_id ORDER BY span_id) AS f,
  CASE WHEN kind = 'retrieval' THEN '["d' || duration_ms::VARCHAR || '","e"]' WHEN kind = 'tool' THEN '["c' || duration_ms::VARCHAR || '"]' END AS ctx FROM deduped)
SELECT trace_id, coalesce(max(kind) FILTER (parent_span_id IS NULL AND k = 1), max(kind) FILTER (f = 1)) AS trace_name,
  coalesce(max(CASE kind WHEN 'chain' THEN '{{"question":"q' || duration_ms::VARCHAR || '"}}' WHEN 'tool' THEN '{{"context":"c' || duration_ms::VARCHAR || '"}}' END)
    FILTER (CASE WHEN root THEN parent_span_id IS NULL AND k = 1 ELSE f = 1 END), '{{}}') AS inputs,
  coalesce(max('a' || duration_ms::VARCHAR) FILTER (kind = 'llm'), max(CASE WHEN kind = 'chain' THEN 'r' || duration_ms::VARCHAR END) FILTER (CASE WHEN root THEN parent_span_id IS NULL AND k = 1 ELSE f = 1 END)) AS output,
  arg_min(ctx, span_id) FILTER (ctx IS NOT NULL) AS context, max(model) FILTER (kind = 'llm') AS model
FROM (SELECT *, bool_or(parent_span_id IS NULL) OVER (PARTITION BY project_id, trace_id) AS root FROM one) GROUP BY project_id, trace_id""")
def trace_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.snapshots(_told_spans(spark, sf_dir)).select("trace_id", "trace_name", "inputs", "output", "context", "model")


def _sampling(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """New items and marks of three projects with different settings; every fourteenth trace is in the queue already."""
    e = fixtures.espans(spark, sf_dir)
    said = F.concat(F.lit('{"text":"'), F.when(F.col("duration_ms") % 7 == 0, "you idiot ").otherwise("fine "), "span_id", F.lit('"}'))
    spans = e.withColumns({"parent_span_id": F.lit(None).cast("string"), "name": F.col("kind"), "input": F.lit("{}"), "output": F.when(F.col("kind") == "llm", said), "model": F.lit("m"), "prompt_version_id": F.lit(None).cast("string")})
    per_trace = e.groupBy("project_id", "trace_id").agg(F.min("started_at").alias("started_at"), F.when(F.count_if(F.col("status") == "error") > 0, "error").otherwise("ok").alias("status"))
    rows = [("p0", True, 0.5, 0.2, False, False, True, datetime(2024, 1, 5)), ("p1", True, 0.1, 0.5, False, True, False, None), ("p2", False, 1.0, 1.0, False, True, True, None)]
    kinds = "project_id string, enabled boolean, sample_rate double, control_sample_rate double, check_pii boolean, check_grounding boolean, check_toxicity boolean, last_scanned_at timestamp_ntz"
    queue = per_trace.where(F.col("trace_id") < "12").select("project_id", "trace_id")
    return review.sample_projects(per_trace, spans, queue, spark.createDataFrame(rows, kinds), NOW)


_SAMPLED = f"""{O.ESPANS.replace("AS started_at,", "AS started_at, event_type,")}, per AS (SELECT project_id, trace_id, min(started_at) AS started_at, bool_or(status = 'error') AS err FROM espans GROUP BY 1, 2),
batch AS (SELECT * FROM per WHERE project_id IN ('p0', 'p1') AND started_at <= TIMESTAMP '2024-01-31' AND started_at > CASE project_id WHEN 'p0' THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2024-01-30' END
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY started_at, trace_id) <= 500)"""


@query(f"""WITH {_SAMPLED}, said AS (SELECT project_id, trace_id, arg_max(duration_ms, (started_at, span_id)) FILTER (event_type = 'purchase') AS d FROM espans GROUP BY 1, 2),
j AS (SELECT b.*, project_id = 'p0' AND coalesce(d % 7 = 0, false) AS toxic FROM batch b JOIN said USING (project_id, trace_id)
  WHERE err OR {O.BUCKET.format("trace_id")} < CASE project_id WHEN 'p0' THEN 0.5 ELSE 0.1 END)
SELECT project_id, trace_id, CASE WHEN toxic THEN 'flagged' ELSE 'control' END AS sampled_as, CASE WHEN toxic THEN 0.5 ELSE 0 END::DOUBLE AS severity FROM j
WHERE trace_id >= '12' AND (toxic OR {O.BUCKET.format("'control:' || trace_id")} < CASE project_id WHEN 'p0' THEN 0.2 ELSE 0.5 END)""")
def sample_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampling(spark, sf_dir)[0].select("project_id", "trace_id", "sampled_as", "severity")


@query(f"WITH {_SAMPLED} SELECT p AS project_id, coalesce((SELECT max(started_at) FROM batch WHERE project_id = p), TIMESTAMP '2024-01-31') AS last_scanned_at FROM (VALUES ('p0'), ('p1')) v(p)")
def sample_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampling(spark, sf_dir)[1]


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = fixtures.review_items(spark, sf_dir).withColumn("corrected_output", F.lit(None).cast("string"))
    n = F.col("doc_id")
    verdict = F.when(n % 4 == 0, "good").when(n % 4 == 1, "bad").when(n % 4 == 2, "unsure")
    at = lambda t: F.lit(t).cast("timestamp_ntz").alias("labelled_at")
    labels = items.where(n % 3 == 0).select(F.when(n % 30 == 0, "unknown").otherwise(F.col("trace_id")).alias("trace_id"), verdict.alias("verdict"), F.when(n % 4 == 1, "better").alias("corrected_output"), at("2024-01-02"))
    older = items.where((n % 6 == 0) & (n % 30 != 0) & F.col("promoted_at").isNull()).select("trace_id", F.lit("bad").alias("verdict"), F.lit("older").alias("corrected_output"), at("2024-01-01"))
    return review.label(items, labels.unionByName(older))


_LABELS = f"""{O.ITEMS}, l AS (SELECT *, doc_id % 3 = 0 AND doc_id % 30 <> 0 AND doc_id % 4 <> 2 AND (promoted_at IS NULL OR doc_id % 4 = 3) AS hit, doc_id % 4 AS q,
  doc_id % 12 = 6 AND doc_id % 30 <> 0 AND promoted_at IS NULL AS older FROM items)"""


@query(f"""WITH {_LABELS} SELECT doc_id, CASE WHEN older OR hit AND q < 2 THEN 'labeled' WHEN hit THEN 'skipped' ELSE status END AS status,
  CASE WHEN hit AND q = 0 THEN 'good' WHEN older OR hit AND q = 1 THEN 'bad' ELSE verdict END AS verdict, CASE WHEN older THEN 'older' WHEN hit AND q = 1 THEN 'better' END AS corrected_output FROM l""")
def review_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[0].select("doc_id", "status", "verdict", "corrected_output")


@query(f"""WITH {_LABELS}, r AS (SELECT CASE WHEN doc_id % 30 = 0 THEN 'not found' WHEN promoted_at IS NOT NULL AND q < 3 THEN 'already promoted' WHEN q = 2 THEN 'unknown verdict' END AS reason FROM l WHERE doc_id % 3 = 0)
SELECT reason, count(*) AS labels FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def review_label_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir)[1].groupBy("reason").agg(F.count("*").alias("labels"))


_CARD = "regexp_replace({}, '[^0-9]', '', 'g')"
_SEVERITY = {k: s for k, (_, s) in guardrails.PII.items()}
_REDACT = "CASE WHEN length(trim(x)) <= 4 THEN repeat('*', length(trim(x))) ELSE substr(trim(x), 1, 2) || repeat('*', length(trim(x)) - 4) || right(trim(x), 2) END"


def _pii_sql() -> str:
    found = []
    for kind, (pattern, _) in guardrails.PII.items():
        hits = f"regexp_extract_all(text, '{pattern}')"
        if kind == "credit_card":  # every second digit from the right doubled, nine taken off beyond nine
            digits = _CARD.format("x")
            ds = f"list_transform(range(0, length({digits})), lambda i: CAST(substr({digits}, CAST(length({digits}) - i AS INT), 1) AS INT))"
            total = f"list_sum(list_transform({ds}, lambda d, i: CASE WHEN i % 2 = 1 THEN d ELSE CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END END))"
            hits = f"list_filter({hits}, lambda x: length({digits}) BETWEEN 13 AND 19 AND {total} % 10 = 0)"
        found.append(f"{hits} AS {kind}")
    listed = " || ".join(f"CASE WHEN len({k}) > 0 THEN ['{k}:' || array_to_string(list_transform({k}[:5], lambda x: {_REDACT}), ',')] ELSE [] END" for k in guardrails.PII)
    worst = "greatest(" + ", ".join(f"CASE WHEN len({k}) > 0 THEN {s} ELSE 0 END" for k, s in _SEVERITY.items()) + ")"
    return f"WITH f AS (SELECT doc_id, {', '.join(found)} FROM documents) SELECT doc_id, {worst}::DOUBLE AS severity, array_to_string({listed}, ';') AS matches FROM f WHERE {worst} > 0"


@query(_pii_sql())
def guardrail_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = docs.select("doc_id", guardrails.pii_finding(F.col("text")).alias("f")).where("f is not null")
    return found.select("doc_id", "f.severity", F.array_join(F.transform("f.matches", lambda m: F.concat(m["kind"], F.lit(":"), F.array_join(m["values"], ","))), ";").alias("matches"))


_NUMBERS = r"regexp_extract_all({}, '\b\d[\d,]*(?:\.\d+)?%?\b')"
_COMMON = "('" + "', '".join(guardrails.COMMON_NUMBERS) + "')"


@query(f"""WITH {O.RESULTS}, m AS (SELECT dataset_item_id, list_filter(list_transform({_NUMBERS.format("output")}, lambda x: replace(rtrim(x, '%'), ',', '')),
  lambda x: x <> '' AND x NOT IN {_COMMON} AND NOT contains(replace(question, ',', ''), x)) AS missing FROM results)
SELECT dataset_item_id, len(missing)::INT AS unsupported, CASE WHEN len(missing) > 0 THEN round(least(0.8, 0.3 + 0.15 * len(missing)), 6) END::DOUBLE AS severity FROM m""")
def guardrail_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers checked against their questions as the only context."""
    r = fixtures.eval_results(spark, sf_dir).withColumn("context", F.array("question"))
    missing = guardrails.unsupported_numbers(F.col("output"), F.col("context"))
    return r.select("dataset_item_id", F.size(missing).alias("unsupported"), guardrails.grounding_severity(F.col("output"), F.col("context")).alias("severity"))


@query(f"""WITH {O.TOXIC}, p AS ({_pii_sql().replace("WITH f AS", "WITH f AS").replace("SELECT doc_id, greatest", "SELECT doc_id, greatest")}),
a AS (SELECT d.doc_id, p.severity AS ps, CASE WHEN len(d.terms) > 0 THEN least(1.0, 0.5 + 0.25 * (len(d.terms) - 1)) END::DOUBLE AS ts FROM toxic d LEFT JOIN p USING (doc_id))
SELECT doc_id, CASE WHEN ts IS NULL THEN 'pii' WHEN ps IS NULL THEN 'toxicity' WHEN ts > ps THEN 'toxicity,pii' ELSE 'pii,toxicity' END AS checks, greatest(coalesce(ps, 0), coalesce(ts, 0)) AS severity
FROM a WHERE ps IS NOT NULL OR ts IS NOT NULL""")
def guardrail_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("f", guardrails.findings(F.col("text"), F.lit(None).cast("array<string>")))
    return docs.where(F.size("f") > 0).select("doc_id", F.array_join(F.transform("f", lambda x: x["check"]), ",").alias("checks"), guardrails.worst(F.col("f")).alias("severity"))


# ---- datasets -------------------------------------------------------------------------------------------------------


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one customer segment and nation each: CSV, JSON lines or a JSON array, some of them broken."""
    c = _table(spark, sf_dir, "customer")
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    n = F.col("c_nationkey") % 3
    flat = F.concat(F.lit('{"question":"'), name, F.lit('","expected_output":"'), key, F.lit('"}'))
    nested = F.concat(F.lit('{"inputs":{"q":'), key, F.lit('},"expected_context":["'), name, F.lit('"],"metadata":{"n":1}}'))
    row = F.concat(name, F.lit(","), key, F.lit(",\"[\"\""), name, F.lit("\"\"]\""))
    line = F.when(n == 0, row).when(n == 1, flat).otherwise(nested)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("l")))), lambda x: x["l"])
    d = c.groupBy("c_mktsegment", "c_nationkey").agg(lines.alias("lines"))  # files are small
    n = F.col("c_nationkey") % 3
    text = F.when(n == 0, F.concat(F.lit("question,Answer,expected_sources\n"), F.array_join("lines", "\n"))).when(n == 1, F.array_join("lines", "\n\n")).otherwise(F.concat(F.lit(" ["), F.array_join("lines", ","), F.lit("]")))
    text = F.when(F.col("c_nationkey") == 4, F.concat(text, F.lit("\n{"))).when(F.col("c_nationkey") == 5, "[1]").otherwise(text)
    file = F.concat("c_mktsegment", F.lit("-"), F.col("c_nationkey").cast("string"), F.when(n == 0, ".CSV").otherwise(".json"))
    content = F.when(F.col("c_nationkey") == 7, F.unhex(F.lit("ff"))).otherwise(text.cast("binary"))
    return d.select(file.alias("name"), content.alias("content"))


@query("""SELECT c_mktsegment || '-' || c_nationkey::VARCHAR || CASE WHEN c_nationkey % 3 = 0 THEN '.CSV' ELSE '.json' END AS name,
  (row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1)::INT AS item_index,
  CASE c_nationkey % 3 WHEN 2 THEN '{"q":' || c_custkey::VARCHAR || '}' ELSE '{"question":"' || c_name || '"}' END AS inputs, CASE WHEN c_nationkey % 3 < 2 THEN c_custkey::VARCHAR END AS expected_output,
  CASE WHEN c_nationkey % 3 <> 1 THEN '["' || c_name || '"]' END AS expected_context, CASE WHEN c_nationkey % 3 = 2 THEN '{"n":1}' ELSE '{}' END AS metadata
FROM customer WHERE c_nationkey NOT IN (4, 5, 7)""")
def dataset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.uploads(_uploads(spark, sf_dir))[0]


@query("""SELECT CASE c_nationkey WHEN 4 THEN 'not readable as JSON' WHEN 5 THEN 'an entry is no JSON object' ELSE 'the bytes are no UTF-8' END AS reason, count(DISTINCT c_mktsegment) AS files
FROM customer WHERE c_nationkey IN (4, 5, 7) GROUP BY 1""")
def dataset_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.uploads(_uploads(spark, sf_dir))[1].groupBy("reason").agg(F.count("*").alias("files"))


@query("""SELECT c_mktsegment AS dataset_slug, count(*)::INT AS item_count, sha256('[' || string_agg('{"expected_context":null,"expected_output":"' || c_custkey::VARCHAR || '","inputs":{"a":1.0,"q":"' || c_name || '"},"metadata":{}}', ',' ORDER BY c_custkey) || ']') AS content_hash
FROM customer GROUP BY 1""")
def dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    items = c.select(
        F.col("c_mktsegment").alias("dataset_slug"), "c_custkey", F.concat(F.lit('{ "q": "'), "c_name", F.lit('", "a": 1.0}')).alias("inputs"),
        F.col("c_custkey").cast("string").alias("expected_output"), F.lit(None).cast("string").alias("expected_context"), F.lit("{}").alias("metadata"),
    )
    return datasets.dataset_hashes(datasets.numbered(items, ["dataset_slug"], ["c_custkey"]), ["dataset_slug"])


@query("""SELECT r_name AS dataset_slug, max(n_nationkey) AS latest_version, arg_max(length(n_name)::INT, n_nationkey) AS item_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY 1""")
def dataset_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = _table(spark, sf_dir, "region"), _table(spark, sf_dir, "nation")
    versions = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).where("r_name <> 'ASIA'")
    versions = versions.select(F.col("r_name").alias("dataset_slug"), F.col("n_nationkey").alias("version"), F.length("n_name").alias("item_count"))
    return registry.dataset_listing(r.select(F.col("r_name").alias("dataset_slug")), versions)


# ---- templates and runs ---------------------------------------------------------------------------------------------

TEMPLATE = "{% for d in docs %}[{{ loop.index }}] {{ d | upper }}\n{% endfor %}{% if note %}({{ note }}){% else %}-{% endif %}{# end #}"


@query("""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE '[1] ' || upper(role) || chr(10) || '[2] X' || chr(10) || CASE WHEN turn % 2 = 0 THEN '(n' || conv_id::VARCHAR || ')' ELSE '-' END END AS text,
CASE WHEN turn % 4 = 3 THEN '''note'' is undefined' END AS error FROM conversations""")
def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    note = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"n'), F.col("conv_id").cast("string"), F.lit('"'))).otherwise("null")
    tail = F.when(F.col("turn") % 4 == 3, "").otherwise(F.concat(F.lit(',"note":'), note))
    values = F.concat(F.lit('{"docs":["'), "role", F.lit('","x"]'), tail, F.lit("}"))
    return c.select("conv_id", "turn", templates.render(F.lit(TEMPLATE), values).alias("r")).select("conv_id", "turn", "r.*")


@query("SELECT n_name, 'docs,other,zz_' || n_name AS variables FROM nation")
def template_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumn("n_name", F.col("n_name"))
    source = F.concat(F.lit("{% for d in docs %}{{ d.x }}{{ other.name | trim }}{% endfor %}{{ zz_"), "n_name", F.lit(" }}"))
    return n.select("n_name", F.array_join(templates.template_variables(source)["variables"], ",").alias("variables"))


def _run() -> runner.Run:
    scores = [("exact_match", {}), ("regex_match", {"pattern": "^[a-m]", "ignore_case": True}), ("embedding_similarity", {}), ("llm_judge", {}), ("retrieval_recall", {"k": 2}), ("retrieval_mrr", {})]
    return runner.Run(scores, model="m", messages=[("system", "Be brief."), ("user", "{{ question }}")], rubric=[("user", "{{ output }}|{{ context }}")], judge_model="m")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = fixtures.eval_results(spark, sf_dir)
    field = F.when(F.col("dataset_item_id") % 10 == 0, "other").otherwise("question")
    asked = F.when(F.col("dataset_item_id") % 10 == 1, "__FAIL__").otherwise(F.col("question"))
    d = F.col("dataset_item_id") % 10
    got = F.when(d == 2, "null").when(d == 4, "[]").when(d == 5, '["A  B",{"id":7}]').otherwise('[{"text":"none"},{"id":"a b"},{"id":7}]')
    values = F.concat(F.lit("{"), J.quoted(field), F.lit(":"), J.quoted(asked), F.lit(',"retrieved_context":'), got, F.lit("}"))
    wanted = F.when(d == 3, "[]").otherwise('["a b",{"id":7}]')
    return r.select("dataset_item_id", F.col("dataset_item_id").alias("item_index"), values.alias("inputs"), "expected_output", wanted.alias("expected_context"))


_RUN = f"""{O.RESULTS}, g AS (SELECT dataset_item_id AS id, CASE WHEN dataset_item_id % 10 = 1 THEN '__FAIL__' ELSE question END AS asked, expected_output AS expected, dataset_item_id % 10 AS d FROM results),
run AS (SELECT *, CASE WHEN d > 1 THEN regexp_replace(asked, '^\\s+|\\s+$', '', 'g') || ' [fake:' || substr(sha256('Be brief.' || chr(10) || asked), 1, 8) || ']' END AS output,
  CASE d WHEN 0 THEN 'message 1: ''question'' is undefined' WHEN 1 THEN 'the generator was asked to fail' END AS error FROM g)"""


@query(f"""WITH {_RUN} SELECT id AS dataset_item_id, output, error, CASE WHEN d > 1 THEN greatest(1, (length(asked) + 10) // 4)::INT END AS prompt_tokens, greatest(1, length(output) // 4)::INT AS completion_tokens FROM run""".replace("greatest(1, length(output) // 4)::INT AS", "CASE WHEN d > 1 THEN greatest(1, length(output) // 4)::INT END AS"))
def eval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, items = _run(), _items(spark, sf_dir)
    runner.validated(run, items)
    return runner.generated(run, items).select("dataset_item_id", "output", "error", "prompt_tokens", "completion_tokens")


@query(f"""WITH {_RUN} SELECT id AS dataset_item_id, 'exact_match' AS evaluator, CASE WHEN expected IS NOT NULL THEN (trim(output) = trim(expected))::INT::DOUBLE END AS score FROM run WHERE error IS NULL
UNION ALL SELECT id, 'regex_match', regexp_matches(output, '^[a-m]', 'i')::INT::DOUBLE FROM run WHERE error IS NULL
UNION ALL SELECT id, 'llm_judge', (cast('0x' || substr(sha256(output || '|' || CASE WHEN d = 3 THEN '' ELSE '[1] a b' || chr(10) || chr(10) || '[2] {{"id":7}}' END), 1, 2) AS INT) % 5) / 4.0::DOUBLE FROM run WHERE error IS NULL
UNION ALL SELECT id, 'retrieval_recall', CASE d WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 0.0 WHEN 5 THEN 1.0 ELSE 0.5 END FROM run WHERE error IS NULL
UNION ALL SELECT id, 'retrieval_mrr', CASE d WHEN 2 THEN NULL WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 WHEN 5 THEN 1.0 ELSE 0.5 END FROM run WHERE error IS NULL""")
def eval_run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the similarity, which eval_fake_similarity holds against SQL."""
    run = _run()
    found = runner.scored(run, runner.generated(run, _items(spark, sf_dir)))
    return found.where("evaluator <> 'embedding_similarity'").select("dataset_item_id", "evaluator", "score")


@query(f"""WITH {_RUN} SELECT id AS dataset_item_id, CASE d WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'a b,7' WHEN 5 THEN '' ELSE '7' END AS missed, true AS self_judged FROM run WHERE error IS NULL""")
def eval_score_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant documents that the first two retrieved lack, and whether the judge is of the judged model."""
    run = _run()
    found = runner.scored(run, runner.generated(run, _items(spark, sf_dir)))
    of = lambda name: F.max(F.when(F.col("evaluator") == name, F.col("detail")))
    d = found.groupBy("dataset_item_id").agg(of("retrieval_recall").alias("r"), of("llm_judge").alias("j"))
    listed = F.transform(J.elements(J.field(F.col("r"), "missed")), J.text_of)
    return d.select("dataset_item_id", F.coalesce(F.array_join(listed, ","), F.lit("")).alias("missed"), F.coalesce(J.field(F.col("j"), "self_judged") == "true", F.lit(False)).alias("self_judged"))


@query("""WITH w AS (SELECT n_nationkey AS k, unnest(regexp_extract_all(lower(n_name || ' of ' || r_name), '\\w+')) AS word FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT k, cast('0x' || substr(sha256(word), 1, 8) AS BIGINT) % 256 AS i, CASE WHEN cast('0x' || substr(sha256(word), 9, 2) AS INT) % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS x FROM w),
v AS (SELECT k, i, sum(x) AS x FROM h GROUP BY 1, 2), n AS (SELECT k, sqrt(sum(x * x)) AS n FROM v GROUP BY 1)
SELECT a.k AS n_nationkey, round(greatest(0, least(1, coalesce((SELECT sum(u.x * w.x) FROM v u JOIN v w ON w.i = u.i AND w.k = 0 WHERE u.k = a.k), 0) / a.n / (SELECT n FROM n WHERE k = 0))), 6)::DOUBLE AS score FROM n a""")
def eval_fake_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    texts = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.concat("n_name", F.lit(" of "), "r_name").alias("t"))
    first = texts.where("n_nationkey = 0").select(F.col("t").alias("other"))  # one row
    score = evaluators.embedding_similarity(generation.embed(F.col("t")), generation.embed(F.col("other")))["score"]
    return texts.crossJoin(F.broadcast(first)).select("n_nationkey", F.round(score, 6).alias("score"))


SCHEMA = {
    "type": "object", "required": ["id", "text"], "additionalProperties": False,
    "properties": {"id": {"type": "integer", "minimum": 10}, "text": {"type": "string", "maxLength": 400}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}}},
}


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 0 ELSE (conv_id >= 10 AND length(role) < 9 AND turn % 3 <> 1)::INT END::DOUBLE AS score FROM conversations""")
def eval_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    tags = F.when(F.col("turn") % 3 == 1, ',"tags":["a","c"]').when(F.length("role") >= 9, ',"tags":"a"').otherwise(',"tags":["b"]')
    fence = F.lit("```json\n")
    whole = F.concat(fence, F.lit('{"id":'), F.col("conv_id").cast("string"), F.lit(',"text":"x"'), tags, F.lit("}\n```\n"))
    text = F.when(F.col("turn") % 3 == 2, "no JSON").otherwise(whole)
    return c.select("conv_id", "turn", evaluators.json_schema(text, SCHEMA, strip_code_fences=True)["score"].alias("score"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN NULL WHEN turn % 5 = 3 THEN 0 ELSE 0.5 END::DOUBLE AS score,
  CASE WHEN turn % 5 = 3 THEN false END AS passed, CASE WHEN turn % 5 = 4 THEN 'item has no ''retrieved_context'' field' END AS error FROM conversations""")
def eval_retrieval_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    n = F.col("conv_id").cast("string")
    got = F.when(F.col("turn") % 5 == 3, "[]").otherwise(F.concat(F.lit('[{"id":'), n, F.lit(',"text":"t"}," A  b ",{"text":"none"},{"content":"'), "role", F.lit('"}]')))
    inputs = F.when(F.col("turn") % 5 == 4, "{}").otherwise(F.concat(F.lit('{"retrieved_context":'), got, F.lit("}")))
    relevant = F.concat(F.lit('["'), n, F.lit('",{"id":"a B"}]'))
    keys, wanted, error = evaluators.retrieval_keys(inputs, relevant)
    result = F.when(error.isNull(), evaluators.retrieval_precision(keys, wanted)).otherwise(evaluators.unscoreable(error))
    return c.select("conv_id", "turn", result.alias("r")).select("conv_id", "turn", "r.score", "r.passed", "r.error")


@query("""SELECT l_orderkey AS dataset_item_id, l_linenumber AS attempt, CASE WHEN l_linenumber % 2 = 1 THEN 'new' ELSE 'old' END AS output, 'first' AS rendered_messages FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 4)
UNION ALL SELECT l_orderkey, l_linenumber, 'new', 'second' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber IN (5, 7))""")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("dataset_item_id"), F.col("l_linenumber").alias("attempt")).distinct()
    stored = keys.where("attempt < 4").withColumns({"output": F.lit("old"), "rendered_messages": F.lit("first")})
    new = keys.where("attempt % 2 = 1").withColumns({"output": F.lit("new"), "rendered_messages": F.lit("second")})
    return runner.upserted(stored, new, ["dataset_item_id", "attempt"], kept=["rendered_messages"])


@query(f"""WITH {O.SCORES}, p AS (SELECT dataset_item_id FROM results ORDER BY 1 LIMIT 100 OFFSET 50)
SELECT dataset_item_id, count(evaluator) AS scores, string_agg(evaluator, ',' ORDER BY evaluator) AS evaluators FROM p LEFT JOIN (SELECT * FROM scores WHERE run_id = 'A') s USING (dataset_item_id) GROUP BY 1""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = fixtures.eval_results(spark, sf_dir).select("dataset_item_id", F.col("dataset_item_id").alias("item_index"))
    page = runner.run_detail(results, fixtures.eval_scores(spark, sf_dir).where("run_id = 'A'"), limit=100, offset=50)
    names = F.array_join(F.transform("scores", lambda s: s["evaluator"]), ",")
    return page.select("dataset_item_id", F.size("scores").cast("long").alias("scores"), F.nullif(names, F.lit("")).alias("evaluators"))


@query(f"WITH {_RUN} SELECT id AS dataset_item_id, error AS exception_message, 3 AS attempts FROM run WHERE error IS NOT NULL")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = runner.dead_letters(runner.generated(_run(), _items(spark, sf_dir)), "r", 3)
    return failed.select("dataset_item_id", "exception_message", "attempts")


# ---- comparison -----------------------------------------------------------------------------------------------------


def _by_place(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The runs' items numbered by themselves, so that places hold different items."""
    s = fixtures.eval_scores(spark, sf_dir).withColumn("item_index", F.col("dataset_item_id") + F.when(F.col("run_id") == "B", 2).otherwise(0))
    return s.where("run_id = 'A'"), s.where("run_id = 'B'")


_PLACED = f"""{O.SCORES}, placed AS (SELECT *, dataset_item_id + CASE WHEN run_id = 'B' THEN 2 ELSE 0 END AS item_index FROM scores),
q AS (SELECT *, {O.CHANGE} FROM (SELECT coalesce(a.item_index, b.item_index) AS item_index, a.score AS baseline, b.score AS candidate
  FROM (SELECT * FROM placed WHERE run_id = 'A') a FULL OUTER JOIN (SELECT * FROM placed WHERE run_id = 'B') b ON a.item_index = b.item_index AND a.evaluator = b.evaluator)),
f AS (SELECT item_index, bool_or(change = 'regressed') AS r, bool_or(change = 'improved') AS i FROM q GROUP BY 1), w AS (SELECT item_index, bool_or(run_id = 'A') AS a, bool_or(run_id = 'B') AS b FROM placed GROUP BY 1),
verdicts AS (SELECT item_index, CASE WHEN r AND NOT i THEN 'regressed' WHEN i AND NOT r THEN 'improved' WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' ELSE 'unchanged' END AS verdict FROM f JOIN w USING (item_index))"""


@query(f"WITH {_PLACED} SELECT * FROM verdicts")
def compare_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.in_order(comparison.compare_examples(*_by_place(spark, sf_dir), key="item_index"), "item_index").select("item_index", "verdict")


@query(f"WITH {_PLACED} SELECT {', '.join(f'''count(*) FILTER (verdict = '{v}') AS {v}_count''' for v in comparison.CHANGES)}, count(*) AS example_count FROM verdicts")
def compare_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.counts(comparison.compare_examples(*_by_place(spark, sf_dir), key="item_index"))


# ---- registry -------------------------------------------------------------------------------------------------------


def _prompts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = _table(spark, sf_dir, "nation")
    k, message = F.col("n_nationkey"), lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    system, user = message("system", F.lit("a\nb")), message("user", F.col("n_name"))
    one = lambda key, value: F.struct(F.lit(key), value)
    before = n.select(F.col("n_name").alias("prompt_slug"), F.array(system, user).alias("messages"), F.map_from_entries(F.array(one("model", F.lit('"m"')), one("top_p", F.lit("0.5")))).alias("parameters"))
    changed = F.when(k % 3 == 0, F.array(system, user)).when(k % 3 == 1, F.array(message("system", F.lit("a\nc")))).otherwise(F.array(system, user, message("user", F.lit("more"))))
    parameters = F.map_from_entries(F.when(k % 2 == 0, F.array(one("model", F.lit('"m"')), one("top_p", F.lit("0.5")))).otherwise(F.array(one("model", F.lit('"n"')), one("top_k", F.lit("5")))))
    return before, n.select(F.col("n_name").alias("prompt_slug"), changed.alias("messages"), parameters.alias("parameters"))


@query("""SELECT n_name AS prompt_slug, n_nationkey % 6 = 0 AS identical, CASE n_nationkey % 3 WHEN 0 THEN 'unchanged,unchanged' WHEN 1 THEN 'modified,removed' ELSE 'unchanged,unchanged,added' END AS messages,
CASE n_nationkey % 2 WHEN 0 THEN 'model=unchanged,top_p=unchanged' ELSE 'model=modified,top_k=added,top_p=removed' END AS parameters FROM nation""")
def prompt_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = registry.prompt_diff(*_prompts(spark, sf_dir))
    return d.select(
        "prompt_slug", "identical", F.array_join(F.transform("messages", lambda m: m["change"]), ",").alias("messages"),
        F.array_join(F.transform("parameters", lambda p: F.concat(p["key"], F.lit("="), p["change"])), ",").alias("parameters"),
    )


@query("""SELECT n_name AS prompt_slug, 0 AS index, 'modified' AS change, '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1,2 +1,2 @@' || chr(10) || ' a' || chr(10) || '-b' || chr(10) || '+c' AS unified FROM nation WHERE n_nationkey % 3 = 1
UNION ALL SELECT n_name, 1, 'removed', '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -1 +0,0 @@' || chr(10) || '-' || n_name FROM nation WHERE n_nationkey % 3 = 1
UNION ALL SELECT n_name, 2, 'added', '--- before' || chr(10) || '+++ after' || chr(10) || '@@ -0,0 +1 @@' || chr(10) || '+more' FROM nation WHERE n_nationkey % 3 = 2""")
def message_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.message_diff(*_prompts(spark, sf_dir)).where("change <> 'unchanged'").select("prompt_slug", "index", "change", "unified")


@query("""WITH e AS (SELECT p_brand, p_size % 3 AS l, p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size END AS v FROM part)
SELECT p_brand AS prompt_slug, l::INT AS label, v::INT AS version FROM e QUALIFY row_number() OVER (PARTITION BY p_brand, l ORDER BY p_partkey DESC) = 1 AND v IS NOT NULL""")
def label_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    version = F.when(F.col("p_size") % 10 != 0, F.col("p_size"))
    events = p.select(F.col("p_brand").alias("prompt_slug"), (F.col("p_size") % 3).cast("int").alias("label"), version.alias("version"), F.col("p_partkey").alias("seq"))
    return registry.current_labels(events)


@query("""WITH t AS (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 25 GROUP BY 1)
SELECT p_partkey, (coalesce(n, 0) + row_number() OVER (PARTITION BY p.p_brand ORDER BY p_partkey))::INT AS version FROM part p LEFT JOIN t USING (p_brand) WHERE p_size >= 25""")
def next_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("prompt_slug"), F.col("p_partkey").alias("seq"), "p_size")
    base = p.where("p_size < 25").groupBy("prompt_slug").agg(F.count("*").cast("int").alias("version"))
    return registry.next_versions(base, p.where("p_size >= 25")).select(F.col("seq").alias("p_partkey"), F.col("version").cast("int").alias("version"))


@query("SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 20")
def version_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.page(_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_size", tie="p_partkey", offset=20)


@query("""SELECT n.n_name AS project_id, s.slug AS prompt_slug FROM nation n, (VALUES ('judge-faithfulness'), ('judge-relevance'), ('judge-correctness'), ('judge-conciseness')) s(slug)
WHERE NOT (n.n_nationkey % 2 = 0 AND s.slug = 'judge-relevance')""")
def rubric_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").withColumnRenamed("n_name", "project_id")
    there = n.where("n_nationkey % 2 = 0").select("project_id", F.lit("judge-relevance").alias("prompt_slug"), F.lit("judge").alias("kind"))
    return registry.seeded(there, n).select("project_id", "prompt_slug")


@query("SELECT 'lo_live_' || md5(c_custkey::VARCHAR) AS key, 'p' || (c_nationkey % 3)::VARCHAR AS project_id FROM customer WHERE c_custkey % 5 NOT IN (0, 1, 2)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    key, n = F.concat(F.lit("lo_live_"), F.md5(F.col("c_custkey").cast("string"))), F.col("c_custkey") % 5
    at = lambda when, t: F.when(when, F.lit(t).cast("timestamp_ntz"))
    keys = c.select(
        F.substring(key, 1, registry.PREFIX_LENGTH).alias("key_prefix"), F.when(n == 0, F.sha2(key, 256)).otherwise(registry.hashed_key(key, "pepper")).alias("key_hash"),
        F.concat(F.lit("p"), (F.col("c_nationkey") % 3).cast("string")).alias("project_id"), at(n == 1, "2024-01-01").alias("revoked_at"),
        F.coalesce(at(n == 2, "2024-01-31"), at(n == 3, "2024-02-01")).alias("expires_at"),
    )
    return registry.verified_keys(c.select(key.alias("key")), keys, "pepper", NOW)


@query("""SELECT p_partkey, p_brand || '-o1' AS name, CASE WHEN p_size % 4 = 0 THEN 'o3-' || p_size::VARCHAR ELSE 'm' || p_size::VARCHAR END AS model, p_size % 4 = 0 OR p_size = 7 AS refuses, p_size % 3 <> 1 AS priced FROM part""")
def model_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    model = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("o3-"), size)).otherwise(F.concat(F.lit("m"), size))
    url = F.when(F.col("p_size") % 3 == 1, "https://other.example/v1").when(F.col("p_size") % 3 == 2, "https://API.example.com/v1")
    return p.select("p_partkey", F.concat("p_brand", F.lit("-o1")).alias("name"), model.alias("model"), runner.refuses(model, ["m7"]).alias("refuses"), runner.priced(url, "api.example.com").alias("priced"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END::DATE > DATE '1995-06-17' AS stale FROM orders")
def stale_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    ended = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 40 DAYS"))
    runs = o.select("o_orderkey", F.col("o_orderdate").alias("created_at"), ended.alias("finished_at"))
    return runner.stale_prices(runs, date(1995, 6, 17)).select("o_orderkey", "stale")


@query("""SELECT p_partkey, sha256('{"a":[1,2.50],"b":{"x":null,"y":"' || p_brand || '"}}') AS content_hash FROM part""".replace("2.50", "2.5"))
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"b" : {"y": "'), "p_brand", F.lit('", "x": null}, "a": [1, 2.50]}'))
    return p.select("p_partkey", registry.canonical_hash(text).alias("content_hash"))


# ---- alerts, metrics and views --------------------------------------------------------------------------------------


@query(f"""WITH {O.ETRACES}, {O.RULES}, d AS (SELECT *, project_id <> 'p2' AND sample_size >= 3 AND value IS NOT NULL AND CASE WHEN metric = 'trace_count' THEN value < threshold ELSE value > threshold END AS fires FROM vals)
SELECT rule, CASE WHEN fires AND project_id = 'p1' THEN 10 WHEN fires THEN 0 ELSE 9 END::INT AS consecutive_failures, NOT (fires AND project_id = 'p1') AS enabled,
CASE WHEN fires THEN TIMESTAMP '2024-01-31' WHEN project_id = 'p2' THEN TIMESTAMP '2024-01-30 23:55:00' END AS last_fired_at FROM d""")
def alert_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after a round in which the webhook of project p1 fails for the tenth time."""
    from . import catalog

    rules = catalog._rules(spark).withColumns({"consecutive_failures": F.lit(9), "webhook_url": F.concat(F.lit("https://hooks.example/"), "project_id")})
    state = alerts.evaluated(rules, catalog._espan_traces(spark, sf_dir), NOW, "secret", lambda url, payload, headers: 500 if url.endswith("p1") else 200)[1]
    return state.select("rule", "consecutive_failures", "enabled", "last_fired_at")


@query(f"""WITH {O.ESPANS} SELECT time_bucket(INTERVAL 1 HOUR, started_at) AS bucket, count(*) AS span_count, count(*) FILTER (status = 'error') AS error_count FROM espans
WHERE project_id = 'p1' AND started_at >= TIMESTAMP '2024-01-24' AND started_at <= TIMESTAMP '2024-01-31' GROUP BY 1""")
def dashboard_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    since, bucket = metrics.window("7d", NOW)
    spans = metrics.in_range(tenancy.scoped(fixtures.espans(spark, sf_dir), "p1"), since, NOW)
    return metrics.span_timeseries(spans, bucket, money=False).select("bucket", "span_count", "error_count")


@query(f"""WITH RECURSIVE {O.DEDUPED}, tops AS (SELECT d.*, d.parent_span_id IS NULL AS root FROM deduped d LEFT JOIN deduped p ON p.project_id = d.project_id AND p.trace_id = d.trace_id AND p.span_id = d.parent_span_id WHERE p.span_id IS NULL),
walk AS (SELECT project_id, trace_id, span_id, 0 AS depth, CASE WHEN root THEN '0' ELSE '1' END || span_id AS path FROM tops
UNION ALL SELECT c.project_id, c.trace_id, c.span_id, w.depth + 1, w.path || '/' || c.span_id FROM deduped c JOIN walk w ON w.project_id = c.project_id AND w.trace_id = c.trace_id AND w.span_id = c.parent_span_id)
SELECT trace_id, span_id, depth, (row_number() OVER (PARTITION BY project_id, trace_id ORDER BY path) - 1)::INT AS place FROM walk""")
def span_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = traces.first_spans(fixtures.spans(spark, sf_dir), ("project_id", "trace_id", "span_id"), ("started_at", "duration_ms"))
    return traces.preorder(spans, traces.span_forest(spans)).select("trace_id", "span_id", "depth", "place")


@query("""SELECT event_id, CASE WHEN value / 1000 > 0.05 THEN 'critical' WHEN value / 1000 > 0.01 THEN 'warning' ELSE 'neutral' END AS tone,
CASE WHEN event_id >= 1000 THEN printf('%.2fs', event_id / 1000.0) ELSE event_id::VARCHAR || 'ms' END AS duration, CASE WHEN event_id % 100 = 0 THEN '$0' WHEN event_id % 100 < 50 THEN printf('$%.4f', (event_id % 100) / 10000.0) ELSE printf('$%.2f', (event_id % 100) * 1.0) END AS cost,
printf('%.1f%%', (event_id % 8) * 12.5) AS share, CASE WHEN event_id >= 1000 THEN printf('%.1fk', event_id / 1000.0) ELSE event_id::VARCHAR END AS compact FROM events""".replace("event_id / 1000.0", "(event_id // 100 * 100) / 1000.0"))
def shown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    round_ = F.when(n >= 1000, F.floor(n / 100) * 100).otherwise(n)
    cost = F.when(n % 100 < 50, (n % 100) / 10000.0).otherwise((n % 100) * 1.0)
    return e.select(
        "event_id", formats.error_tone(F.col("value") / 1000).alias("tone"), formats.shown_duration(round_).alias("duration"), formats.shown_cost(cost).alias("cost"),
        formats.shown_share((n % 8) / 8.0).alias("share"), formats.shown_count(round_).alias("compact"),
    )


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_name LIKE '%7')")
def purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, gone = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer").where("c_name like '%7'")
    return tenancy.without(o, gone.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey")


def _flags(traces_: DataFrame) -> Column:
    return F.when(F.col("trace_id") < "8", F.lit("2024-01-01").cast("timestamp_ntz"))


@query(f"""WITH {O.ROLLUP} SELECT trace_id, span_count, CASE WHEN trace_id < '8' THEN TIMESTAMP '2024-01-01' END AS flagged_at FROM traces""")
def rollup_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-ups of a part of the spans, brought up to date with those of all."""
    spans = traces.first_spans(fixtures.spans(spark, sf_dir), ("project_id", "trace_id", "span_id"), ("started_at", "duration_ms"))
    early = traces.trace_rollup(spans.where("kind in ('chain', 'llm')"))
    early = early.withColumn("flagged_at", _flags(early))
    late = spans.where("kind not in ('chain', 'llm')").select("project_id", "trace_id").distinct()
    touched = traces.trace_rollup(spans.join(late, ["project_id", "trace_id"], "left_semi"))
    unseen = touched.join(early, ["project_id", "trace_id"], "left_anti").select("project_id", "trace_id")
    out = traces.upsert_rollup(early, touched).join(unseen.withColumn("_u", F.lit(True)), ["project_id", "trace_id"], "left")
    return out.select("trace_id", "span_count", F.when(F.col("_u"), _flags(out)).otherwise(F.col("flagged_at")).alias("flagged_at"))


_BY_YEAR = O.ROLLUP.replace("o.o_orderdate AS started_at", "CAST(date_trunc('year', o.o_orderdate) AS TIMESTAMP) AS started_at")


@query(f"""WITH {_BY_YEAR} SELECT trace_id, started_at, span_count, error_count, duration_ms, name, CASE WHEN trace_id < '8' THEN TIMESTAMP '2024-01-01' END AS flagged_at FROM traces""")
def stored_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, begun on New Year's Day each, added to a store in three batches that overlap; some traces flagged beforehand."""
    spans = traces.first_spans(fixtures.spans(spark, sf_dir), ("project_id", "trace_id", "span_id"), ("started_at", "duration_ms"))
    spans = written(spans.withColumn("started_at", F.date_trunc("year", "started_at").cast("timestamp_ntz")), "spans")
    path = f"{scratch_root(spark).rstrip('/')}/tracequarry/store-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    stored = store.SpanStore(spark, path, buckets=8)
    stored.flag(spans.where("trace_id < '8'").select("project_id", "trace_id").distinct(), datetime(2024, 1, 1))
    for n, kinds in enumerate((("chain", "llm"), ("llm", "tool", "retrieval"), ("retrieval", "rerank", "embedding", "other"))):
        stored.add_with_rollups(spans.where(F.col("kind").isin(*kinds)), n)
    return stored.rollups().select("trace_id", "started_at", "span_count", "error_count", "duration_ms", "name", "flagged_at")


@query("""WITH RECURSIVE r AS (SELECT 'p' || (user_id % 3)::VARCHAR AS project_id, event_id, epoch_us(ts) AS t, event_id % 7 AS cost,
  row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT project_id, 0::BIGINT AS n, 0::BIGINT AS event_id, true AS allowed, 0::BIGINT AS remaining, []::STRUCT(t BIGINT, cost BIGINT)[] AS passed FROM (SELECT DISTINCT project_id FROM r)
UNION ALL SELECT q.project_id, q.n, q.event_id, q.used + q.cost <= 20, greatest(0, 20 - q.used - CASE WHEN q.used + q.cost <= 20 THEN q.cost ELSE 0 END)::BIGINT,
  CASE WHEN q.used + q.cost <= 20 THEN list_append(q.kept, {'t': q.t, 'cost': q.cost}) ELSE q.kept END
  FROM (SELECT r.*, list_filter(w.passed, lambda x: x.t > r.t - 3600000000) AS kept, coalesce(list_sum(list_transform(list_filter(w.passed, lambda x: x.t > r.t - 3600000000), lambda x: x.cost)), 0) AS used
    FROM w JOIN r ON r.project_id = w.project_id AND r.n = w.n + 1) q)
SELECT event_id, allowed, remaining FROM w WHERE n > 0""")
def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of each project, of which 20 units pass within an hour."""
    e = _table(spark, sf_dir, "events")
    asked = e.select(F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("project_id"), F.col("event_id").alias("request_id"), F.col("ts").alias("at"), (F.col("event_id") % 7).alias("cost"))
    return admission.admitted(asked, 20, 3600).select(F.col("request_id").alias("event_id"), "allowed", "remaining")


def _metric_sql() -> str:
    """Samples of the eleven series over events, order lines and documents."""
    times = {"http": "value / 1000", "provider": "value / 100", "eval": "value"}
    series = process_metrics.SERIES

    def histogram(name: str, labels: str, value: str, source: str) -> list[str]:
        head = lambda part, le, x: f"SELECT '{name}_{part}' AS sample, {labels} AS labels, {le}::DOUBLE AS le, {x}::DOUBLE AS value FROM {source} GROUP BY ALL"
        rows = [head("bucket", b, f"count(*) FILTER ({value} <= {b})") for b in series[name].bounds]
        return [*rows, head("bucket", "'inf'", f"count({value})"), head("sum", "NULL", f"round(sum({value}), 4)"), head("count", "NULL", f"count({value})")]

    count = lambda name, labels, source, value="count(*)": f"SELECT '{name}' AS sample, {labels} AS labels, NULL::DOUBLE AS le, {value}::DOUBLE AS value FROM {source} GROUP BY ALL"
    parts = [
        count("spans_ingested_total", "'source=native'", "lineitem"), count("spans_rejected_total", "'source=native,reason=' || lower(l_returnflag)", "lineitem"),
        count("ingest_batches_total", "'source=otlp'", "orders"), count("queue_depth", "'queue=' || coalesce(lang, '')", "documents", "max(n_chars)"),
        *histogram("eval_run_duration_seconds", "'status=' || event_type", times["eval"], "events"), count("eval_examples_total", "'outcome=' || event_type", "events"),
        *histogram("provider_request_duration_seconds", "'provider=p' || (user_id % 2)::VARCHAR || ',operation=' || event_type", times["provider"], "events"),
        count("provider_errors_total", "'provider=p' || (user_id % 2)::VARCHAR || ',retryable=' || (event_type = 'error')::VARCHAR", "events"),
        count("http_requests_total", "'method=GET,path=/' || event_type || ',status=' || CASE WHEN event_type = 'error' THEN 500 ELSE 200 END::VARCHAR", "events"),
        *histogram("http_request_duration_seconds", "'method=GET,path=/' || event_type", times["http"], "events"), count("build_info", "'service=worker,environment=test'", "region", "max(1)"),
    ]
    return " UNION ALL ".join(parts)


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, l, o, d = (_table(spark, sf_dir, t) for t in ("events", "lineitem", "orders", "documents"))
    M, provider, kind = process_metrics.measured, F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")), F.col("event_type")  # noqa: N806
    path = F.concat(F.lit("/"), kind)
    parts = [
        M(l, "spans_ingested_total", source=F.lit("native")), M(l, "spans_rejected_total", source=F.lit("native"), reason=F.lower("l_returnflag")), M(o, "ingest_batches_total", source=F.lit("otlp")),
        M(d, "queue_depth", F.col("n_chars"), queue=F.col("lang")), M(e, "eval_run_duration_seconds", F.col("value"), status=kind), M(e, "eval_examples_total", outcome=kind),
        M(e, "provider_request_duration_seconds", F.col("value") / 100, provider=provider, operation=kind), M(e, "provider_errors_total", provider=provider, retryable=kind == "error"),
        M(e, "http_requests_total", method=F.lit("GET"), path=path, status=F.when(kind == "error", 500).otherwise(200)),
        M(e, "http_request_duration_seconds", F.col("value") / 1000, method=F.lit("GET"), path=path), M(_table(spark, sf_dir, "region"), "build_info", service=F.lit("worker"), environment=F.lit("test")),
    ]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query(_metric_sql())
def metric_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _samples(spark, sf_dir)
    return d.withColumn("value", F.when(F.col("sample").endswith("_sum"), F.round("value", 4)).otherwise(F.col("value")))


@query(f"""WITH s AS ({_metric_sql()}), b AS (SELECT labels, le, value, max(value) OVER (PARTITION BY labels) * 0.95 AS r, lag(le, 1, 0) OVER w AS lo, lag(value, 1, 0) OVER w AS below
  FROM s WHERE sample = 'http_request_duration_seconds_bucket' WINDOW w AS (PARTITION BY labels ORDER BY le))
SELECT labels, round(arg_min(CASE WHEN le = 'inf' THEN lo ELSE lo + (le - lo) * coalesce((r - below) / nullif(value - below, 0), 0) END, le), 6)::DOUBLE AS value FROM b WHERE value >= r GROUP BY 1""")
def metric_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = process_metrics.quantiles(_samples(spark, sf_dir), "http_request_duration_seconds", 0.95)
    return found.select("labels", F.round("value", 6).alias("value"))


_SLUGS = """known AS (SELECT 'p' || (p_partkey % 3)::VARCHAR AS project_id, 's' || p_partkey::VARCHAR AS slug, p_name AS name, p_type AS description FROM part WHERE p_partkey % 4 <> 1)"""


def _prompts_of_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(F.concat(F.lit("p"), (key % 3).cast("string")).alias("project_id"), F.concat(F.lit("s"), key.cast("string")).alias("slug"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), "p_partkey")


@query(f"""WITH {_SLUGS}, l AS (SELECT 's' || l_partkey::VARCHAR AS slug, 'p' || (l_partkey % 3)::VARCHAR AS project_id, l_orderkey * 100 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'n' || l_suppkey::VARCHAR END AS name,
  CASE WHEN l_linenumber % 3 = 0 THEN 'd' || l_quantity::INT::VARCHAR END AS description FROM lineitem),
n AS (SELECT project_id, slug, max(struct_pack(seq := seq, v := name)) FILTER (name IS NOT NULL) AS n, max(struct_pack(seq := seq, v := description)) FILTER (description IS NOT NULL) AS d FROM l GROUP BY 1, 2)
SELECT k.project_id, k.slug, coalesce(n.v, name) AS name, coalesce(d.v, description) AS description FROM known k LEFT JOIN n USING (project_id, slug)""")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _prompts_of_projects(spark, sf_dir).where("p_partkey % 4 <> 1").drop("p_partkey")
    l = _table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    changes = l.select(
        F.concat(F.lit("p"), (F.col("l_partkey") % 3).cast("string")).alias("project_id"), F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("slug"), (F.col("l_orderkey") * 100 + n).alias("seq"),
        F.when(n % 2 == 0, F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))).alias("name"), F.when(n % 3 == 0, F.concat(F.lit("d"), F.col("l_quantity").cast("int").cast("string"))).alias("description"),
    )
    return registry.updated(known, changes)[0]


@query(f"""WITH {_SLUGS}, n AS (SELECT 'p' || (p_partkey % 3)::VARCHAR AS project_id, CASE WHEN p_partkey % 7 = 0 THEN 'Bad Slug' WHEN p_partkey % 5 = 0 THEN 'same' ELSE 's' || p_partkey::VARCHAR END AS slug, p_partkey AS seq FROM part)
SELECT seq, CASE WHEN slug = 'Bad Slug' THEN 'slug' WHEN row_number() OVER (PARTITION BY project_id, slug ORDER BY seq) > 1 OR EXISTS (SELECT 1 FROM known k WHERE k.project_id = n.project_id AND k.slug = n.slug) THEN 'taken' ELSE 'created' END AS outcome FROM n""")
def slugs_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _prompts_of_projects(spark, sf_dir)
    key = F.col("p_partkey")
    new = every.select("project_id", F.when(key % 7 == 0, "Bad Slug").when(key % 5 == 0, "same").otherwise(F.col("slug")).alias("slug"), key.alias("seq"))
    good, refused = registry.created(every.where(key % 4 != 1), new)
    return good.select("seq", F.lit("created").alias("outcome")).unionByName(refused.select("seq", F.get("reasons", F.lit(0)).alias("outcome")))


@query("""SELECT event_id % 50 AS request, count(*) AS spans, count(*) FILTER (event_id % 9 <> 0) AS accepted FROM events GROUP BY 1 HAVING count(*) BETWEEN 1 AND 500""")
def native_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the events of one remainder each, read as a client sends them; a ninth of the spans has no name. Requests
    over the bound are refused whole."""
    e = _table(spark, sf_dir, "events")
    n = F.col("event_id")
    id_ = F.md5(n.cast("string"))
    span = F.struct(id_.alias("trace_id"), F.substring(id_, 1, 16).alias("span_id"), F.when(n % 9 != 0, F.col("event_type")).alias("name"), F.col("ts").cast("timestamp").alias("started_at"), F.to_json(F.struct((n % 50).alias("request"))).alias("metadata"))
    body = F.to_json(F.struct(F.collect_list(span).alias("spans")))
    lines, refused = native.batches(e.groupBy(n % 50).agg(body.alias("body")))
    good, bad = native.parsed(lines)
    request = F.get_json_object("metadata", "$.request").cast("long").alias("request")
    both = good.select(request, F.lit(1).alias("ok")).unionByName(bad.select(request, F.lit(0).alias("ok")))
    return both.groupBy("request").agg(F.count("*").alias("spans"), F.sum("ok").alias("accepted"))
