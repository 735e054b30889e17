"""The span store reads what a batch needs; control state changes as a whole."""

from __future__ import annotations

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tracequarry.operators import traces
from tracequarry.streaming import control
from tracequarry.streaming.store import SpanStore

KINDS = "project_id string, trace_id string, span_id string, parent_span_id string, kind string, status string, started_at timestamp_ntz, ended_at timestamp_ntz, duration_ms int, prompt_tokens int, completion_tokens int, cost_usd decimal(12,6)"


def row(trace, span, parent, day, second=0, status="ok"):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=second)
    return ("p", trace, span, parent, "llm", status, at, at + dt.timedelta(seconds=1), 1000, 1, 2, None)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-")


def plain(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def files_read(df) -> int:
    """Files that the scans of a plan have read, from their metrics."""
    df.collect()
    plan, total, todo = df._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if name.startswith("Scan") and node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_any_order_of_batches_gives_the_rollups_of_all_spans(spark, folder):
    rows = [row(f"t{i % 7}", f"s{i}", None if i < 7 else f"s{i - 7}", day=(i * 5) % 4, second=i, status="error" if i == 9 else "ok") for i in range(40)]
    store = SpanStore(spark, folder)
    store.flag(spark.createDataFrame([("p", "t3")], "project_id string, trace_id string"), dt.datetime(2024, 2, 2))
    for n, part in enumerate((rows[30:], rows[:20], rows[10:35], rows[10:35])):
        store.add_with_rollups(spark.createDataFrame(part, KINDS), n)
    every = spark.createDataFrame(rows, KINDS)
    columns = [c for c in traces.trace_rollup(every).columns if c != "metadata"]
    assert plain(store.rollups(), *columns) == plain(traces.trace_rollup(every), *columns)
    assert plain(store.rollups().where("flagged_at is not null"), "trace_id", "flagged_at") == [("t3", dt.datetime(2024, 2, 2))]
    assert store.spans().count() == 40 and store.spans([dt.date(2024, 1, 2)]).count() == every.where("to_date(started_at) = '2024-01-02'").count()
    before = plain(store.rollups(), *columns), plain(store.spans(), "span_id", "started_at")
    assert store.compact(most_files=1) > 0 and store.compact(most_files=1) == 0
    assert (plain(store.rollups(), *columns), plain(store.spans(), "span_id", "started_at")) == before
    store.add_with_rollups(spark.createDataFrame(rows[:1], KINDS).where("false"), 9)
    assert (plain(store.rollups(), *columns)) == before[0]


def test_files_read_for_a_batch_do_not_grow_with_the_table(spark, folder):
    store = SpanStore(spark, folder)
    store.add(spark.createDataFrame([row("t0", "a", None, 0), row("t0", "b", "a", 1)], KINDS))
    wanted = spark.createDataFrame([("p", "t0")], "project_id string, trace_id string")
    few = files_read(store.of_traces(wanted))
    store.add(spark.createDataFrame([row(f"x{i}", f"y{i}", None, day=2 + i % 5) for i in range(300)], KINDS))
    stored = spark.read.parquet(folder + "/spans")
    assert len(stored.inputFiles()) > 100
    assert files_read(store.of_traces(wanted)) == few == 2
    assert plain(store.of_traces(wanted), "span_id") == [("a",), ("b",)]
    assert SpanStore(spark, folder + "-none").of_traces(wanted) is None and SpanStore(spark, folder + "-none").rollups() is None


def test_a_batch_stopped_between_its_writes_is_made_good(spark, folder, monkeypatch):
    store, batch = SpanStore(spark, folder), spark.createDataFrame([row("t", "a", None, 0), row("t", "b", "a", 1)], KINDS)
    append = SpanStore._append
    for stop_at in ("days", "rollups"):
        with monkeypatch.context() as m:
            m.setattr(SpanStore, "_append", lambda self, df, table, *by: (_ for _ in ()).throw(OSError("killed")) if table == stop_at else append(self, df, table, *by))
            with pytest.raises(OSError):
                store.add_with_rollups(batch, 1)
    store.add_with_rollups(batch, 1)
    assert plain(store.rollups(), "trace_id", "span_count") == [("t", 2)] and store.spans().count() == 2
    assert plain(spark.read.parquet(folder + "/days"), "trace_id", "day") == [("t", dt.date(2024, 1, 1)), ("t", dt.date(2024, 1, 2))]


def test_stream_into_the_store(spark, folder):
    rows = [row(f"t{i % 5}", f"s{i}", None, i % 3, i) for i in range(30)]
    spark.createDataFrame(rows + rows[:7], KINDS).repartition(3).write.parquet(folder + "/in")
    stream = spark.readStream.schema(spark.read.parquet(folder + "/in").schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    store = SpanStore(spark, folder + "/table")
    assert store.ingest(stream, folder + "/checkpoint").awaitTermination(180)
    assert plain(store.rollups(), "trace_id", "span_count") == [(f"t{i}", 6) for i in range(5)]


def rules_of(spark):
    kinds = "rule string, project_id string, metric string, comparison string, threshold double, window_seconds int, min_sample_size int, cooldown_seconds int, webhook_url string, enabled boolean, last_fired_at timestamp_ntz, consecutive_failures int"
    return spark.createDataFrame([("r", "p", "error_rate", "above", 0.1, 3600, 1, 60, "https://hook.example", True, None, 0)], kinds)


NOW = dt.datetime(2024, 1, 2)


def rollups_of(spark, n=4):
    at = NOW - dt.timedelta(seconds=90)
    return spark.createDataFrame([("p", f"t{i}", at, "error" if i else "ok", 100, None) for i in range(n)], "project_id string, trace_id string, started_at timestamp_ntz, status string, duration_ms long, cost_usd decimal(18,6)")


def test_alert_rounds_keep_their_state(spark, folder):
    state, sent = control.ControlState(spark, folder), []
    state.commit(0, replaced={"rules": rules_of(spark)})
    send = lambda url, payload, headers: sent.append(url) or 200
    control.alert_round(state, rollups_of(spark), NOW, "s", send)
    assert plain(state.read("rules"), "rule", "last_fired_at") == [("r", NOW)] and len(sent) == 1
    control.alert_round(state, rollups_of(spark), NOW + dt.timedelta(seconds=5), "s", send)  # cools down
    assert len(sent) == 1 and state.version() == 3


@pytest.mark.parametrize("step", ["settings", "queue", "publish", "rename"])
def test_a_sampling_round_killed_between_two_writes_leaves_the_old_state(spark, folder, monkeypatch, step):
    state = control.ControlState(spark, folder)
    settings = spark.createDataFrame([("p", True, 1.0, 1.0, False, False, True, None)], "project_id string, enabled boolean, sample_rate double, control_sample_rate double, check_pii boolean, check_grounding boolean, check_toxicity boolean, last_scanned_at timestamp_ntz")
    queue = spark.createDataFrame([], "project_id string, trace_id string, status string, sampled_as string, severity double, output string")
    state.commit(0, replaced={"settings": settings, "queue": queue})
    spans = rollups_of(spark).select("project_id", "trace_id", F.lit("s").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.lit("llm").alias("kind"), "started_at", F.lit("n").alias("name"), F.lit("{}").alias("input"), F.lit('{"text":"fine"}').alias("output"), F.lit("m").alias("model"), F.lit(None).cast("string").alias("prompt_version_id"))

    def killed(*a, **b):
        raise KeyboardInterrupt

    write = control.ControlState._write
    with monkeypatch.context() as m:
        if step in ("settings", "queue"):
            m.setattr(control.ControlState, "_write", lambda self, name, df: killed() if name == step else write(self, name, df))
        elif step == "publish":
            m.setattr(control.ControlState, "_publish", killed)
        else:
            m.setattr(control.json, "dumps", killed)
        with pytest.raises(KeyboardInterrupt):
            control.sampling_round(state, rollups_of(spark), spans, NOW)
    assert state.version() == 1 and state.read("queue").count() == 0 and state.read("settings").first()["last_scanned_at"] is None
    assert control.sampling_round(state, rollups_of(spark), spans, NOW) == 2
    assert state.read("queue").count() == 4 and state.read("settings").first()["last_scanned_at"] == NOW - dt.timedelta(seconds=90)
    assert state.read("queue", 1).count() == 0  # the old version stays readable
    state.clean(keep=1)
    assert state.read("queue").count() == 4
    with pytest.raises(LookupError):
        state.read("queue", 0)


def test_of_two_changes_on_one_version_the_second_is_refused(spark, folder):
    state, one = control.ControlState(spark, folder), spark.range(1)
    state.commit(0, replaced={"a": one})
    with pytest.raises(control.Overtaken):
        state.commit(0, replaced={"a": spark.range(5)})
    assert state.read("a").count() == 1 and state.version() == 1
