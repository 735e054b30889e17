"""Errors stay with their rows."""

from __future__ import annotations

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions.isolation import Unscoreable, casefolded, isolated, isolated_batches, matched
from tracequarry.operators import evaluators, review, runner


def test_rows_that_raise_give_reasons(spark):
    def f(x):
        if x == 3:
            raise Unscoreable("three")
        return "text" if x == 4 else 10.0 / x

    df = spark.createDataFrame([(0,), (2,), (3,), (4,), (None,)], "x int").select("x", isolated(f, T.DoubleType())("x").alias("r")).select("x", "r.*")
    got = {r["x"]: (r["value"], r["error"]) for r in df.collect()}
    assert got[0] == (None, "ZeroDivisionError: float division by zero") and got[2] == (5.0, None) and got[3] == (None, "three") and got[None] == (None, None)
    assert got[4][0] is None and "text" in got[4][1]


def test_batches_are_halved_down_to_the_rows_at_fault(spark):
    def f(x: pd.Series) -> pd.Series:
        if (x % 100 == 7).any():
            raise ValueError("seven")
        return x * 2

    df = spark.range(1000).coalesce(1).select("id", isolated_batches(f, T.LongType())("id").alias("r")).select("id", "r.*")
    for r in df.collect():
        assert (r["value"], r["error"]) == ((None, "ValueError: seven") if r["id"] % 100 == 7 else (2 * r["id"], None))
    short = spark.range(3).select(isolated_batches(lambda x: x.iloc[:1], T.LongType())("id").alias("r"))
    assert short.where("r.error is null").count() == 3  # a batch of one row has the right length


def test_a_pattern_that_explodes_is_stopped(spark):
    df = spark.createDataFrame([(1, "a" * 40 + "!"), (2, "aaa"), (3, None)], "k int, t string").coalesce(1)
    began = time.monotonic()
    got = {r["k"]: r["r"] for r in df.select("k", evaluators.regex_match(F.col("t"), "^(a|aa)+$").alias("r")).collect()}
    assert time.monotonic() - began < 30
    assert got[1]["score"] is None and "over 1 s" in got[1]["error"] and got[2]["score"] == 1.0 and got[3]["score"] is None and got[3]["error"] is None
    assert got[2]["detail"] == '{"pattern":"^(a|aa)+$","matched":"aaa"}'
    assert df.select(matched(F.col("t"), "A+", full=True, ignore_case=True)["value"]["hit"]).collect()[1][0] is True
    with pytest.raises(ValueError, match="no regular expression"):
        evaluators.build("regex_match", pattern="(")


def test_case_is_folded(spark):
    df = spark.createDataFrame([("STRASSE", "straße"), ("a", "b")], "a string, b string")
    assert [r[0]["score"] for r in df.select(evaluators.exact_match(F.col("a"), F.col("b"), case_sensitive=False)).collect()] == [1.0, 0.0]
    assert df.select(casefolded("b")).first()[0] == "strasse"


def test_own_evaluators_fail_by_row_and_the_run_goes_on(spark):
    def length(output, expected, inputs, context):
        if output.startswith("b"):
            raise RuntimeError("no b")
        return None if output.startswith("c") else len(output) / 10

    evaluators.custom("own_length", length)
    try:
        run = runner.Run([("own_length", {"threshold": 0.3}), ("exact_match", {}), ("llm_judge", {})], model="m", rubric=[("user", "{{ output }}")], judge_model="m")
        results = spark.createDataFrame([(1, "abcd", None), (2, "bcd", None), (3, "c", None), (4, None, "failed")], "dataset_item_id int, output string, error string")
        results = results.selectExpr("*", "'x' as expected_output", "'{}' as inputs", "cast(null as string) as expected_context")
        got = {(r["dataset_item_id"], r["evaluator"]): r for r in runner.scored(run, results).collect()}
    finally:
        evaluators.EVALUATORS.pop("own_length")
    own = {i: (got[i, "own_length"]["score"], got[i, "own_length"]["passed"], got[i, "own_length"]["error"]) for i in (1, 2, 3)}
    assert own == {1: (0.4, True, None), 2: (None, None, "RuntimeError: no b"), 3: (None, None, "no score")}
    assert got[2, "exact_match"]["score"] == 0.0 and got[2, "exact_match"]["detail"] == '{"expected":"x","actual":"bcd"}'
    judged = got[1, "llm_judge"]["detail"]
    assert '"self_judged":true' in judged and '"judge_model":"m"' in judged and '"reasoning":"fake' in judged
    assert len(got) == 9


def test_retrieval_details(spark):
    df = spark.createDataFrame([(["x", "a"], ["a", "b", "c"]), ([], ["a"])], "got array<string>, want array<string>")
    recall, mrr, precision = (f(F.col("got"), F.col("want")) for f in (evaluators.retrieval_recall, evaluators.retrieval_mrr, evaluators.retrieval_precision))
    one, none = df.select(recall.alias("r"), mrr.alias("m"), precision.alias("p")).collect()
    assert one["r"]["detail"] == '{"retrieved_count":2,"relevant_count":3,"hits":1,"missed":["b","c"]}'
    assert one["m"]["score"] == 0.5 and '"first_relevant_rank":2' in one["m"]["detail"] and '"first_relevant_rank":null' in none["m"]["detail"]
    assert none["p"]["detail"] == '{"error":"nothing was retrieved"}' and none["p"]["passed"] is False


def test_run_status_counts_items_not_scores(spark):
    rows = [("a", 1, None), ("a", 2, None), ("b", 1, None), ("b", 2, "x"), ("c", 1, "x")]
    got = {r["run_id"]: (r["completed"], r["failed"], r["status"]) for r in evaluators.run_status(spark.createDataFrame(rows, "run_id string, dataset_item_id int, error string")).collect()}
    assert got == {"a": (2, 0, "succeeded"), "b": (1, 1, "partial"), "c": (0, 1, "failed")}


def test_the_last_label_of_a_project_counts(spark):
    kinds = "project_id string, trace_id string, status string, verdict string, corrected_output string, label_reason string, labelled_by string, promoted_at timestamp"
    items = spark.createDataFrame([("p", "t", "pending", None, None, None, None, None), ("q", "t", "pending", None, None, None, None, None), ("q", "u", "pending", "good", None, "old", None, None)], kinds)
    rows = [("p", "t", "good", "first", "ann", 1), ("p", "t", "bad", "second", "bo", 3), ("p", "t", "weird", "refused", "cy", 4), ("q", "u", None, None, "di", 1)]
    labels = spark.createDataFrame(rows, "project_id string, trace_id string, verdict string, label_reason string, labelled_by string, labelled_at int")
    out, refused = review.label(items, labels)
    got = {(r["project_id"], r["trace_id"]): (r["status"], r["verdict"], r["label_reason"], r["labelled_by"]) for r in out.collect()}
    assert got == {("p", "t"): ("labeled", "bad", "second", "bo"), ("q", "t"): ("pending", None, None, None), ("q", "u"): ("skipped", "good", "old", None)}
    assert out.count() == 3 and [r["reason"] for r in refused.collect()] == ["unknown verdict"]
