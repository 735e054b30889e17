"""Tool calls: links, order, violations and canonical form."""

import json
import math
import random

import pytest

from tracequarry.llm.chat_tools import link_tool_calls

SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", False)}, "note": {"text": ("string", True), "tags": ("array", False), "more": ("object", False), "on": ("boolean", False)}}
CALL = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string"
RESULT = "conv_id long, call_id string, turn long, content string"


def linked(spark, calls, results):
    out = link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), SCHEMAS)
    return {(r["conv_id"], r["call_id"], r["kind"]): r for r in out.collect()}


def test_links_and_order(spark):
    calls = [(1, f"c{i}", i, "add", json.dumps({"b": 1.5, "a": i}), f"c{i - 1}" if i else None) for i in range(21)]
    calls += [(2, "x", 1, "add", '{"a": 1}', "y"), (2, "y", 2, "add", '{"a": 1}', "x"), (2, "z", 3, "add", '{"a": 1}', "y"), (2, "w", 3, "add", '{"a": 1}', "absent")]
    out = linked(spark, calls, [(1, "c3", 9, "ok"), (1, "none", 1, "lost"), (2, "x", 5, "late")])
    assert [out[1, f"c{i}", "call"]["depth"] for i in range(21)] == list(range(21))
    assert out[1, "c3", "call"]["status"] == out[1, "c3", "result"]["status"] == "linked" and out[1, "c3", "result"]["depth"] == 3
    assert out[1, "c4", "call"]["status"] == "unanswered" and out[1, "none", "result"]["status"] == "orphan"
    assert all(out[2, k, "call"]["status"] == "cyclic" and out[2, k, "call"]["depth"] is None for k in "xyz") and out[2, "w", "call"]["depth"] == 0
    assert json.loads(out[1, "c3", "call"]["json"]) == {"arguments": '{"a":3,"b":1.5}', "id": "c3", "kind": "call", "name": "add"}


def test_violations(spark):
    cases = {
        '{"a": 1}': [], '{"a": "1"}': ["a is not integer"], "{}": ["missing a"], '{"a": 1, "c": 2, "B": 3}': ["unknown field B", "unknown field c"],
        "[1]": ["not an object"], "nonsense": ["not an object"], '{"a": 1, "b": true}': ["b is not number"],
    }
    calls = [(1, f"k{i}", i, "add", text, None) for i, text in enumerate(cases)] + [(1, "u", 1, "other", "{}", None), (1, "n", 1, None, None, None), (1, "t", 1, "note", '{"text":"x","tags":[1],"more":{},"on":false}', None)]
    out = linked(spark, calls, [])
    for i, want in enumerate(cases.values()):
        assert sorted(out[1, f"k{i}", "call"]["violations"]) == sorted(want)
    assert out[1, "u", "call"]["violations"] == ["unknown tool other"] and out[1, "n", "call"]["violations"] == ["unknown tool null"] and out[1, "t", "call"]["violations"] == []


def test_nulls_and_repeats(spark):
    calls = [(None, "a", 1, "add", "{}", None), (1, None, 1, "add", "{}", None), (1, None, 1, "add", "{}", None), (1, "r", 2, "add", '{"a":2}', None), (1, "r", 1, "add", '{"a":1}', None)]
    calls, results = spark.createDataFrame(calls, CALL), spark.createDataFrame([(1, None, 1, None), (None, "a", 2, "x"), (1, "r", 3, "b"), (1, "r", 3, "a")], RESULT)
    out = link_tool_calls(calls, results, SCHEMAS).collect()
    assert sum(r["kind"] == "call" for r in out) == 4 and sum(r["kind"] == "result" for r in out) == 3
    assert [(r["turn"], r["status"]) for r in out if r["call_id"] == "r" and r["kind"] == "call"] == [(1, "linked")]
    assert [json.loads(r["json"])["content"] for r in out if r["call_id"] == "r" and r["kind"] == "result"] == ["a"]
    assert link_tool_calls(calls.where("false"), results.where("false"), SCHEMAS).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_every_event_comes_after_what_it_depends_on(spark, seed):
    """Random forests, results at any turn, one conversation with most rows; positions against a sort of the whole in Python."""
    rng, calls, results = random.Random(seed), [], []
    for conv, n in ((1, 400), (2, 30), (3, 1)):
        for i in range(n):
            parent = f"c{rng.randrange(i)}" if i and rng.random() < 0.8 else None
            calls.append((conv, f"c{i}", rng.randrange(50), "add", '{"a": 1}', parent))
            if rng.random() < 0.7:
                results.append((conv, f"c{i}", rng.randrange(50), "ok"))
    calls += [(2, "x", 1, "add", "{}", "y"), (2, "y", 1, "add", "{}", "x")]
    rng.shuffle(calls)
    out = linked(spark, calls, results)
    for conv in (1, 2, 3):
        rows = [r for r in out.values() if r["conv_id"] == conv]
        want = sorted(rows, key=lambda r: (math.inf if r["depth"] is None else r["depth"], r["kind"], r["turn"], r["call_id"]))
        assert [r["position"] for r in want] == list(range(len(rows)))
    for conv, call, _, _, _, parent in calls:
        at = out[conv, call, "call"]["position"]
        assert (conv, call, "result") not in out or out[conv, call, "result"]["position"] > at
        if call not in "xy" and parent is not None:
            assert out[conv, parent, "call"]["position"] < at and ((conv, parent, "result") not in out or out[conv, parent, "result"]["position"] < at)
    cyclic = [r["position"] for r in out.values() if r["status"] == "cyclic"]
    assert min(cyclic) == sum(r["conv_id"] == 2 for r in out.values()) - len(cyclic)


def test_long_texts_and_clashing_columns(spark):
    long = "x" * 300_000
    calls = spark.createDataFrame([(1, "a", 1, "note", json.dumps({"text": long}), None, 7, 7, "s", 7)], CALL + ", depth int, position int, status string, _one int")
    results = spark.createDataFrame([(1, "a", 2, long, 7, "j")], RESULT + ", depth int, json string")
    out = link_tool_calls(calls, results, SCHEMAS)
    assert out.columns == ["conv_id", "call_id", "kind", "depth", "turn", "status", "violations", "json", "position"]
    rows = {r["kind"]: r for r in out.collect()}
    assert json.loads(json.loads(rows["call"]["json"])["arguments"])["text"] == json.loads(rows["result"]["json"])["content"] == long
    assert [(rows[k]["depth"], rows[k]["position"], rows[k]["status"]) for k in ("call", "result")] == [(0, 0, "linked"), (0, 1, "linked")]


def test_places_of_nameless_rows(spark):
    calls = [(1, None, 1, "add", "{}", None)] * 2 + [(None, "a", 1, "add", "{}", None), (None, "a", 1, "add", '{"a":1}', None), (1, "k", None, "add", "{}", None)]
    out = link_tool_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame([], RESULT), SCHEMAS).collect()
    assert sorted(r["position"] for r in out if r["conv_id"] == 1) == [0, 1, 2] and sorted(r["position"] for r in out if r["conv_id"] is None) == [0, 1]
    assert [r["position"] for r in out if r["call_id"] == "k"] == [0]
