"""Scoped reads, slugs, metadata and own checks."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions import formats
from tracequarry.functions.isolation import isolated
from tracequarry.operators import guardrails, registry, tenancy, traces
from tracequarry.sources import spans as native


def test_a_project_sees_its_own_rows_only(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("q", "b", 2)], "project_id string, slug string, v int")
    p = tenancy.Project({"prompts": rows, "plain": rows.drop("project_id")}, "p")
    assert [r["slug"] for r in p.table("prompts").collect()] == ["a"] and p.found("prompts", slug="a")["v"] == 1
    for call in (lambda: p.found("prompts", slug="b"), lambda: p.table("plain"), lambda: p.table("none")):
        with pytest.raises(LookupError):
            call()
    assert p.with_ids("prompts", spark.createDataFrame([("b",)], "slug string"), "slug").collect() == []
    with pytest.raises(ValueError):
        tenancy.Project({"prompts": rows}, "").table("prompts")


def test_slugs_labels_and_metadata(spark):
    good, bad = registry.valid_labels(spark.createDataFrame([("prod",), ("12",), ("-x",), ("A",), (None,)], "label string"))
    assert [r[0] for r in good.collect()] == ["prod"] and bad.count() == 4
    table = spark.createDataFrame([("p", "a", "old", "about", 1)], "project_id string, slug string, name string, description string, version int")
    changes = spark.createDataFrame([("p", "a", 1, "first", None), ("p", "a", 2, None, "new"), ("p", "a", 3, "last", None), ("q", "a", 4, "x", None)], "project_id string, slug string, seq int, name string, description string")
    out, unknown = registry.updated(table, changes)
    assert [tuple(r) for r in out.collect()] == [("p", "a", "last", "new", 1)] and [r["project_id"] for r in unknown.collect()] == ["q"]
    new = spark.createDataFrame([("p", "a", 1), ("p", "b", 2), ("p", "b", 1), ("q", "a", 1), ("p", "No", 1)], "project_id string, slug string, seq int")
    good, refused = registry.created(table, new)
    assert sorted(map(tuple, good.collect())) == [("p", "b", 1), ("q", "a", 1)]
    assert sorted((r["slug"], r["seq"], r["reasons"][0]) for r in refused.collect()) == [("No", 1, "slug"), ("a", 1, "taken"), ("b", 2, "taken")]
    assert registry.judges(spark.createDataFrame([("b", "judge"), ("a", "judge"), ("c", "task")], "prompt_slug string, kind string")).collect()[0][0] == "a"


def test_own_checks_fail_by_row(spark):
    def shouting(text):
        return 0.9 if text.isupper() else 1 / (0 if text == "boom" else 1) - 1 or None

    df = spark.createDataFrame([("HELLO",), ("boom",), ("mail a@b.example",), ("quiet",)], "t string")
    more = {"shouting": isolated(shouting, T.DoubleType())(F.col("t"))}
    out = df.select("t", guardrails.findings(F.col("t"), F.lit(None).cast("array<string>"), more=more).alias("f"), guardrails.check_errors(more).alias("e"))
    got = {r["t"]: ([x["check"] for x in r["f"]], [(x["check"], x["reason"]) for x in r["e"]]) for r in out.collect()}
    assert got["HELLO"] == (["shouting"], []) and got["quiet"] == ([], []) and got["mail a@b.example"][0] == ["pii"]
    assert got["boom"] == ([], [("shouting", "ZeroDivisionError: division by zero")])


def test_new_spans_files_and_ages(spark, tmp_path):
    kinds = "started_at timestamp_ntz, span_id string, duration_ms int"
    at = dt.datetime(2024, 1, 1)
    batch = spark.createDataFrame([(at, "a", 2), (at, "a", 1), (at, "b", 1)], kinds)
    assert [tuple(r) for r in traces.new_spans(batch, spark.createDataFrame([(at, "b", 5)], kinds)).collect()] == [(at, "a", 1)]
    line = '{"trace_id":"' + "A" * 32 + '","span_id":"' + "b" * 16 + '","name":"n","started_at":"2024-01-01T00:00:00Z"}'
    (tmp_path / "x.jsonl").write_text(line + "\n{\n" + line.replace("}", ',"extra":1}') + "\n")
    good, bad = native.read_spans(spark, str(tmp_path))
    assert [(r["trace_id"], r["kind"], r["metadata"]) for r in good.collect()] == [("a" * 32, "other", "{}")] and bad.count() == 2
    ages = [(0, "just now"), (59 * 60, "59m ago"), (3 * 3600, "3h ago"), (49 * 3600, "2d ago")]
    df = spark.createDataFrame([(at, at + dt.timedelta(seconds=s)) for s, _ in ages] + [(None, at)], "a timestamp_ntz, n timestamp_ntz")
    assert [r[0] for r in df.select(formats.shown_age(F.col("a"), F.col("n"))).collect()] == [*[w for _, w in ages], "—"]
