"""SQL of the registered queries over the same tables, for DuckDB."""

from __future__ import annotations

from tracequarry.operators import guardrails

SPANS = """spans AS (
SELECT 'p' || CAST(o.o_custkey % 3 AS VARCHAR) AS project_id, md5('t' || CAST(l.l_orderkey AS VARCHAR)) AS trace_id,
  substr(md5('s' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR)),1,16) AS span_id,
  CASE WHEN l.l_linenumber = 1 THEN NULL ELSE substr(md5('s' || CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(CAST(floor(l.l_linenumber/2) AS BIGINT) AS VARCHAR)),1,16) END AS parent_span_id,
  CASE l.l_linenumber WHEN 1 THEN 'chain' WHEN 2 THEN 'retrieval' WHEN 3 THEN 'llm' WHEN 4 THEN 'rerank' WHEN 5 THEN 'tool' WHEN 6 THEN 'embedding' ELSE 'other' END AS kind,
  CASE WHEN l.l_returnflag='R' AND l.l_linenumber > 3 THEN 'error' ELSE 'ok' END AS status,
  o.o_orderdate AS started_at, o.o_orderdate + INTERVAL 1 MILLISECOND * (CAST(round(l.l_extendedprice*100) AS BIGINT) % 5000) AS ended_at, CAST(CAST(round(l.l_extendedprice*100) AS BIGINT) % 5000 AS INT) AS duration_ms,
  CASE WHEN l.l_linenumber = 3 THEN 'model-' || CAST(l.l_suppkey % 4 AS VARCHAR) END AS model,
  CASE WHEN l.l_linenumber = 3 THEN CAST(l.l_quantity AS INT) END AS prompt_tokens,
  CASE WHEN l.l_linenumber = 3 THEN CAST(l.l_quantity AS INT) * 2 END AS completion_tokens,
  CASE WHEN l.l_linenumber = 3 THEN CAST(CAST(CAST(round(l.l_extendedprice*100) AS BIGINT) AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(6,6)) AS DECIMAL(12,6)) END AS cost_usd
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
DEDUPED = (
    SPANS
    + """, deduped AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id, span_id
  ORDER BY started_at, duration_ms, parent_span_id NULLS FIRST, kind, status, model NULLS FIRST, prompt_tokens NULLS FIRST, cost_usd NULLS FIRST) AS rn FROM spans) WHERE rn = 1)"""
)
ROLLUP = (
    DEDUPED
    + """, roots AS (SELECT *, row_number() OVER (PARTITION BY project_id, trace_id ORDER BY started_at, span_id) AS rn FROM deduped WHERE parent_span_id IS NULL),
traces AS (SELECT d.project_id, d.trace_id, min(d.started_at) AS started_at, max(d.ended_at) AS ended_at, count(*) AS span_count, count(*) FILTER (d.status = 'error') AS error_count,
  coalesce(sum(d.prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(d.completion_tokens), 0)::BIGINT AS completion_tokens, sum(d.cost_usd) AS cost_usd, any_value(r.span_id) AS root_span_id,
  coalesce(any_value(r.kind), '(root pending)') AS name,
  coalesce(any_value(r.duration_ms)::BIGINT, date_diff('millisecond', min(d.started_at), max(d.ended_at))) AS duration_ms,
  CASE WHEN count(*) FILTER (d.status = 'error') > 0 THEN 'error' ELSE 'ok' END AS status
FROM deduped d LEFT JOIN roots r ON r.rn = 1 AND r.project_id = d.project_id AND r.trace_id = d.trace_id GROUP BY 1, 2)"""
)
ESPANS = """espans AS (
SELECT 'p' || CAST(user_id % 3 AS VARCHAR) AS project_id, md5('t' || CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id,
  substr(md5('s' || CAST(event_id AS VARCHAR)),1,16) AS span_id, ts AS started_at,
  CASE WHEN event_type='error' THEN 'error' ELSE 'ok' END AS status, CAST(round(value*10) AS INT) AS duration_ms FROM events)"""
ETRACES = (
    ESPANS
    + """, etraces AS (SELECT project_id, trace_id, min(started_at) AS started_at, sum(duration_ms)::BIGINT AS duration_ms,
  sum(CAST(CAST(duration_ms AS DECIMAL(12,0)) / 1000 AS DECIMAL(12,6))) AS cost_usd,
  CASE WHEN count(*) FILTER (status = 'error') > 0 THEN 'error' ELSE 'ok' END AS status FROM espans GROUP BY 1, 2)"""
)
RULES = """rules AS (SELECT m.metric || '-' || p.project_id || '-' || CAST(w.window_seconds AS VARCHAR) AS rule, * FROM
  (VALUES ('error_rate', 0.2::DOUBLE), ('p95_latency_ms', 3000), ('p99_latency_ms', 5000), ('total_cost_usd', 50), ('trace_count', 5)) m(metric, threshold),
  (VALUES ('p0'), ('p1'), ('p2')) p(project_id), (VALUES (3600), (604800)) w(window_seconds)),
hits AS (SELECT r.rule, r.metric, r.threshold, r.project_id, t.* EXCLUDE project_id FROM rules r LEFT JOIN etraces t ON t.project_id = r.project_id
  AND t.started_at <= TIMESTAMP '2024-01-31' AND t.started_at >= TIMESTAMP '2024-01-31' - r.window_seconds * INTERVAL 1 SECOND),
vals AS (SELECT rule, metric, threshold, project_id, count(trace_id) AS sample_size, round(CASE metric
  WHEN 'error_rate' THEN CASE WHEN count(trace_id) > 0 THEN count(*) FILTER (status = 'error') / count(trace_id) END
  WHEN 'p95_latency_ms' THEN quantile_cont(duration_ms::DOUBLE, 0.95) WHEN 'p99_latency_ms' THEN quantile_cont(duration_ms::DOUBLE, 0.99)
  WHEN 'total_cost_usd' THEN coalesce(sum(cost_usd)::DOUBLE, 0) ELSE count(trace_id)::DOUBLE END, 6) AS value FROM hits GROUP BY 1, 2, 3, 4)"""
RESULTS = """results AS (SELECT u.conv_id*100+u.turn AS dataset_item_id, u.text AS question, a.text AS output,
  CASE WHEN u.conv_id % 7 = 0 THEN NULL WHEN u.conv_id % 3 = 0 THEN a.text ELSE u.text END AS expected_output
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn+1 AND a.role = 'assistant' WHERE u.role = 'user')"""
SCORES = (
    RESULTS
    + """, scores AS (SELECT r.run_id, i.dataset_item_id, e.evaluator, CASE WHEN (i.dataset_item_id + e.k) % 13 = 0 THEN NULL
  ELSE CAST((i.dataset_item_id*7 + e.k*3 + r.off*(i.dataset_item_id % 4)) % 11 AS DOUBLE)/10 END AS score,
  CASE WHEN e.k < 3 AND (i.dataset_item_id + e.k) % 13 <> 0 THEN (i.dataset_item_id*7 + e.k*3 + r.off*(i.dataset_item_id % 4)) % 11 >= 5 END AS passed
FROM results i, (VALUES ('A', 0), ('B', 1)) r(run_id, off), (VALUES ('exact_match', 1), ('regex_match', 2), ('retrieval_recall', 3)) e(evaluator, k)
WHERE NOT (r.run_id='A' AND i.dataset_item_id % 17 = 0) AND NOT (r.run_id='B' AND i.dataset_item_id % 19 = 0))"""
)
RUNS = (
    SCORES
    + """, runs AS (SELECT run_id, dataset_item_id, run_id = 'A' AND dataset_item_id % 5 = 2 AS failed FROM (SELECT DISTINCT run_id, dataset_item_id FROM scores)
UNION ALL SELECT DISTINCT 'C', dataset_item_id, true FROM scores WHERE run_id = 'B')"""
)
CHANGE = """CASE WHEN baseline IS NULL AND candidate IS NULL THEN 'unchanged' WHEN baseline IS NULL THEN 'added' WHEN candidate IS NULL THEN 'removed'
  WHEN abs(candidate - baseline) <= 1e-9 THEN 'unchanged' WHEN candidate > baseline THEN 'improved' ELSE 'regressed' END AS change"""
COMPARED = (
    SCORES
    + f""", compared AS (SELECT *, round(candidate - baseline, 6) AS delta, {CHANGE} FROM (
  SELECT coalesce(a.dataset_item_id, b.dataset_item_id) AS dataset_item_id, coalesce(a.evaluator, b.evaluator) AS evaluator, a.score AS baseline, b.score AS candidate
  FROM (SELECT * FROM scores WHERE run_id = 'A') a FULL OUTER JOIN (SELECT * FROM scores WHERE run_id = 'B') b ON a.dataset_item_id = b.dataset_item_id AND a.evaluator = b.evaluator))"""
)
TERMS = str(guardrails.TOXIC_TERMS)
TOXIC = f"""toxic AS (SELECT *, list_filter({TERMS}, lambda x: contains(lower(text), x)) AS terms FROM documents)"""
ITEMS = """items AS (SELECT d.doc_id, md5('t' || CAST(d.doc_id AS VARCHAR)) AS trace_id, d.text AS output,
  CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN d.doc_id % 11 = 0 THEN 'skipped' ELSE 'labeled' END AS status,
  CASE WHEN lower(d.text) LIKE '%idiot%' OR lower(d.text) LIKE '%stupid%' OR lower(d.text) LIKE '%worthless%' THEN 'flagged' ELSE 'control' END AS sampled_as,
  CASE WHEN l.doc_id IS NULL OR d.doc_id % 11 = 0 THEN NULL WHEN l.toxic = 1 OR l.quality = 0 THEN 'bad' ELSE 'good' END AS verdict,
  CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 11 <> 0 AND d.doc_id % 13 = 0 THEN TIMESTAMP '2024-01-15' END AS promoted_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
VERSIONS = """versions AS (SELECT p_brand AS prompt_slug, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS version, p_partkey AS version_id, sha256(p_name) AS content_hash FROM part),
tops AS (SELECT prompt_slug, max(version) AS m, count(*) AS n FROM versions GROUP BY 1),
labelled AS (SELECT prompt_slug, 'production' AS label, greatest(1, m - 1) AS version FROM tops UNION ALL SELECT prompt_slug, 'staging', m FROM tops)"""
MEASURES = """count(*) AS span_count, count(*) FILTER (status = 'error') AS error_count, round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate"""
LATENCIES = ", ".join(f"round(quantile_cont(duration_ms::DOUBLE, {p / 100}), 6) AS p{p}_ms" for p in (50, 95, 99))
MONEY = "coalesce(sum(cost_usd), 0)::DOUBLE AS cost_usd, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens"
BUCKET = "cast('0x' || substr(sha256({}), 1, 16) AS UBIGINT)::DOUBLE / pow(2, 64)"


def _breakdown(dimension: str) -> str:
    return f"""WITH {SPANS} SELECT {dimension}, {MEASURES}, round(quantile_cont(duration_ms::DOUBLE, 0.95), 6) AS p95_ms, coalesce(sum(cost_usd), 0)::DOUBLE AS cost_usd
FROM spans WHERE {dimension} IS NOT NULL GROUP BY 1 ORDER BY span_count DESC, 1 LIMIT 20"""


ORACLE_SQL: dict[str, str] = {
    "span_summary": f"WITH {SPANS} SELECT project_id, {MEASURES}, {LATENCIES}, count(DISTINCT trace_id) AS trace_count, {MONEY} FROM spans GROUP BY 1",
    "span_summary_filtered": f"""WITH {SPANS} SELECT project_id, {MEASURES}, {LATENCIES}, count(DISTINCT trace_id) AS trace_count, {MONEY} FROM spans
WHERE started_at BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31' AND kind = 'llm' AND model = 'model-1' GROUP BY 1""",
    "span_timeseries_1d": f"WITH {SPANS} SELECT time_bucket(INTERVAL 1 DAY, started_at) AS bucket, {MEASURES}, {LATENCIES}, {MONEY} FROM spans GROUP BY 1",
    "span_timeseries_15m": f"WITH {ESPANS} SELECT project_id, time_bucket(INTERVAL 15 MINUTE, started_at) AS bucket, {MEASURES}, {LATENCIES} FROM espans GROUP BY 1, 2",
    "breakdown_model": _breakdown("model"),
    "breakdown_kind": _breakdown("kind"),
    "span_dedupe": f"WITH {DEDUPED} SELECT project_id, trace_id, span_id, started_at, duration_ms, status FROM deduped",
    "ingest_report": f"""WITH {SPANS}, fresh AS (SELECT started_at, span_id, project_id, trace_id FROM (SELECT *, row_number() OVER (PARTITION BY started_at, span_id ORDER BY duration_ms) AS rn FROM spans) WHERE rn = 1)
SELECT s.project_id, s.received, f.accepted, s.received - f.accepted AS duplicates, f.traces_touched FROM (SELECT project_id, count(*) AS received FROM spans GROUP BY 1) s
JOIN (SELECT project_id, count(*) AS accepted, count(DISTINCT trace_id) AS traces_touched FROM fresh GROUP BY 1) f USING (project_id)""",
    "trace_rollup": f"WITH {ROLLUP} SELECT * REPLACE (cost_usd::DOUBLE AS cost_usd) FROM traces",
    "trace_timeseries": f"""WITH {ROLLUP} SELECT time_bucket(INTERVAL 1 DAY, started_at) AS bucket, count(*) AS trace_count, count(*) FILTER (status = 'error') AS error_count,
round(count(*) FILTER (status = 'error') / count(*), 6) AS error_rate, round(quantile_cont(duration_ms::DOUBLE, 0.95), 6) AS p95_ms, coalesce(sum(cost_usd), 0)::DOUBLE AS cost_usd FROM traces GROUP BY 1""",
    "trace_list": f"WITH {ROLLUP} SELECT trace_id, started_at, span_count, status FROM traces WHERE status = 'error' ORDER BY started_at DESC, trace_id LIMIT 200",
    "total_cost": f"WITH {SPANS} SELECT sum(cost_usd)::DOUBLE AS total_cost_usd FROM spans WHERE started_at >= TIMESTAMP '1994-06-01'",
    "trace_cost": f"WITH {SPANS} SELECT trace_id, sum(cost_usd)::DOUBLE AS cost_usd FROM spans GROUP BY 1",
    "alert_metric_values": f"WITH {ETRACES}, {RULES} SELECT rule, sample_size, value FROM vals",
    "alert_fire_decision": f"""WITH {ETRACES}, {RULES} SELECT rule, CASE WHEN project_id = 'p2' THEN 'cooldown' WHEN sample_size < 3 OR value IS NULL THEN 'too_few'
WHEN CASE WHEN metric = 'trace_count' THEN value < threshold ELSE value > threshold END THEN 'fire' ELSE 'ok' END AS decision FROM vals""",
    "sample_decision": f"WITH {ROLLUP} SELECT trace_id, status = 'error' OR {BUCKET.format('trace_id')} < 0.1 AS in_sample, {BUCKET.format("'control:' || trace_id")} < 0.05 AS in_control FROM traces",
    "sample_batch": f"WITH {ETRACES} SELECT trace_id, started_at FROM etraces WHERE started_at > TIMESTAMP '2024-01-10' AND started_at <= TIMESTAMP '2024-01-31' ORDER BY started_at, trace_id LIMIT 500",
    "guardrail_email": r"SELECT doc_id, len(regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b'))::INT AS emails FROM documents WHERE regexp_matches(text, '\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b')",
    "guardrail_toxicity": f"WITH {TOXIC} SELECT doc_id, array_to_string(terms, ',') AS terms, least(1.0, 0.5 + 0.25 * (len(terms) - 1))::DOUBLE AS severity FROM toxic WHERE len(terms) > 0",
    "review_queue": f"WITH {TOXIC}, {ITEMS} SELECT i.doc_id, CASE WHEN len(t.terms) > 0 THEN least(1.0, 0.5 + 0.25 * (len(t.terms) - 1)) ELSE 0 END::DOUBLE AS severity, i.sampled_as FROM items i JOIN toxic t USING (doc_id) WHERE i.status = 'pending'",
    "review_stats": f"""WITH {ITEMS}, s AS (SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'labeled') AS labeled, count(*) FILTER (status = 'skipped') AS skipped,
count(promoted_at) AS promoted,
count(*) FILTER (sampled_as = 'control' AND status = 'labeled') AS control_reviewed, count(*) FILTER (sampled_as = 'control' AND verdict = 'bad') AS control_missed FROM items)
SELECT *, round(CASE WHEN control_reviewed > 0 THEN control_missed / control_reviewed END, 6) AS estimated_miss_rate FROM s""",
    "review_promote": f"""WITH {ITEMS}, v AS (SELECT 0 AS part, doc_id AS place, trace_id, output AS expected, '{{}}' AS metadata FROM items WHERE status = 'skipped'
UNION ALL SELECT 1, NULL, trace_id, CASE WHEN verdict = 'bad' THEN 'corrected: ' || output ELSE output END, '{{"source":"review_queue","trace_id":"' || trace_id || '","verdict":"' || verdict || '"}}' FROM items
WHERE status = 'labeled' AND promoted_at IS NULL AND output IS NOT NULL) SELECT part, row_number() OVER (ORDER BY part, place NULLS FIRST, trace_id) - 1 AS item_index, trace_id, md5(expected) AS expected_md5, metadata FROM v""",
    "eval_exact_match": f"""WITH {RESULTS} SELECT dataset_item_id, CASE WHEN expected_output IS NOT NULL THEN (trim(output) = trim(expected_output))::INT::DOUBLE END AS score,
CASE WHEN expected_output IS NOT NULL THEN trim(output) = trim(expected_output) END AS passed, CASE WHEN expected_output IS NULL THEN 'no expected output' END AS error FROM results""",
    "eval_regex_match": f"WITH {RESULTS} SELECT dataset_item_id, regexp_matches(output, '^[A-M]', 'i')::INT::DOUBLE AS score, regexp_matches(output, '^[A-M]', 'i') AS passed FROM results",
    "eval_retrieval": """WITH got AS (SELECT vec_id, label, unnest(range(1, 6)) AS rank FROM embeddings),
h AS (SELECT g.*, e.label = g.label AS hit FROM got g LEFT JOIN embeddings e ON e.vec_id = (g.vec_id + g.rank * 7) % (SELECT max(vec_id) + 1 FROM embeddings)),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT vec_id, round(count(*) FILTER (hit) / 5, 6) AS precision, round(count(*) FILTER (hit) / any_value(n.n), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank) FILTER (hit), 0), 6)::DOUBLE AS mrr
FROM h JOIN n USING (label) GROUP BY 1""",
    "eval_similarity": "SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6)::DOUBLE AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "eval_aggregates": f"WITH {SCORES} SELECT run_id, evaluator, count(score) AS scored, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max, round(CASE WHEN count(passed) > 0 THEN count(*) FILTER (passed) / count(passed) END, 6) AS pass_rate, count(*) - count(score) AS unscoreable FROM scores GROUP BY 1, 2",
    "run_status": f"""WITH {RUNS}, s AS (SELECT run_id, count(*) FILTER (NOT failed) AS completed, count(*) FILTER (failed) AS failed FROM runs GROUP BY 1)
SELECT *, CASE WHEN failed = 0 THEN 'succeeded' WHEN completed > 0 THEN 'partial' ELSE 'failed' END AS status FROM s""",
    "compare_scores": f"WITH {COMPARED} SELECT * FROM compared",
    "compare_examples": f"""WITH {COMPARED}, f AS (SELECT dataset_item_id, bool_or(change = 'regressed') AS r, bool_or(change = 'improved') AS i FROM compared GROUP BY 1),
p AS (SELECT dataset_item_id, bool_or(run_id = 'A') AS a, bool_or(run_id = 'B') AS b FROM scores GROUP BY 1)
SELECT dataset_item_id, CASE WHEN r AND NOT i THEN 'regressed' WHEN i AND NOT r THEN 'improved' WHEN NOT a THEN 'added' WHEN NOT b THEN 'removed' ELSE 'unchanged' END AS verdict FROM f JOIN p USING (dataset_item_id)""",
    "compare_aggregates": f"""WITH {SCORES}, m AS (SELECT evaluator, round(avg(score) FILTER (run_id = 'A'), 6) AS baseline, round(avg(score) FILTER (run_id = 'B'), 6) AS candidate FROM scores GROUP BY 1)
SELECT *, round(candidate - baseline, 6) AS delta, {CHANGE} FROM m""",
    "resume_pending": f"""WITH {RUNS} SELECT dataset_item_id FROM results r WHERE NOT EXISTS (SELECT 1 FROM runs s WHERE s.dataset_item_id = r.dataset_item_id AND s.run_id = 'A' AND NOT s.failed)""",
    "latest_version": f"WITH {VERSIONS} SELECT prompt_slug, version, version_id, content_hash FROM versions QUALIFY row_number() OVER (PARTITION BY prompt_slug ORDER BY version DESC) = 1",
    "resolve_label": f"""WITH {VERSIONS} SELECT l.prompt_slug, l.label AS ref, v.version, v.version_id FROM labelled l JOIN versions v USING (prompt_slug, version)
UNION ALL SELECT prompt_slug, '2', version, version_id FROM versions WHERE version = 2""",
    "prompt_listing": f"""WITH {VERSIONS} SELECT t.prompt_slug, t.m AS latest, t.n AS n_versions, l.labels FROM tops t
LEFT JOIN (SELECT prompt_slug, string_agg(label || '=' || CAST(version AS VARCHAR), ',' ORDER BY label) AS labels FROM labelled GROUP BY 1) l USING (prompt_slug)""",
    "cost_by_model": f"""WITH {SPANS} SELECT s.model, sum(CAST(round(CAST(prompt_tokens * i + duration_ms * o AS DECIMAL(18,2)), 0) AS BIGINT)) / 1000000.0::DOUBLE AS cost_usd, count(*) AS n FROM spans s
LEFT JOIN (VALUES ('model-0', 1.25, 2.50), ('model-1', 2.25, 3.50), ('model-2', 3.25, 4.50)) p(model, i, o) ON p.model = s.model WHERE s.model IS NOT NULL GROUP BY 1""",
    "span_tree": f"""WITH RECURSIVE {DEDUPED}, placed AS (SELECT d.*, CASE WHEN d.parent_span_id IS NULL THEN 'root' WHEN p.span_id IS NULL THEN 'orphan' ELSE 'child' END AS placement
FROM deduped d LEFT JOIN deduped p ON p.project_id = d.project_id AND p.trace_id = d.trace_id AND p.span_id = d.parent_span_id),
walk AS (SELECT project_id, trace_id, span_id, 0 AS depth, placement FROM placed WHERE placement <> 'child'
UNION ALL SELECT c.project_id, c.trace_id, c.span_id, w.depth + 1, c.placement FROM placed c JOIN walk w ON c.placement = 'child' AND w.project_id = c.project_id AND w.trace_id = c.trace_id AND w.span_id = c.parent_span_id)
SELECT trace_id, span_id, depth, placement FROM walk""",
    "span_orphans": f"""WITH {DEDUPED} SELECT trace_id, span_id, parent_span_id FROM deduped d WHERE parent_span_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM deduped p WHERE p.project_id = d.project_id AND p.trace_id = d.trace_id AND p.span_id = d.parent_span_id)""",
    "waterfall": f"""WITH {ESPANS}, b AS (SELECT *, epoch_us(started_at) / 1000 AS b, coalesce(duration_ms, 0)::DOUBLE AS own FROM espans),
t AS (SELECT *, min(b) OVER w AS mn, greatest(max(b + own) OVER w - min(b) OVER w, 1.0) AS total FROM b WINDOW w AS (PARTITION BY project_id, trace_id)),
l AS (SELECT *, least(100.0, greatest(0.0, (b - mn) / total * 100)) AS lft FROM t)
SELECT span_id, round(lft, 6)::DOUBLE AS left_pct, round(least(100.0 - lft, greatest(0.6, own / total * 100)), 6)::DOUBLE AS width_pct FROM l""",
    "rate_limit_usage": f"""WITH {ESPANS} SELECT span_id, count(*) OVER (PARTITION BY project_id ORDER BY epoch_us(started_at) // 1000000 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS window_cost FROM espans""",
}
