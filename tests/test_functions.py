"""Templates, schemas, payload decompression, webhooks and run validation, case by case."""

import gzip
import hashlib
import hmac
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracequarry.functions import json_schema, templates
from tracequarry.operators import alerts, comparison, evaluators, metrics, registry, review, runner, tenancy
from tracequarry.sources import otlp


def test_templates():
    assert templates.rendered("{{ a.b[1] }}-{{ c | join | upper }}", {"a": {"b": [1, "x"]}, "c": ["p", "q"], "extra": 1}) == "x-PQ"
    assert templates.rendered("{% if not a %}no{% elif b %}b{% else %}else{% endif %}", {"a": 1, "b": 0}) == "else"
    assert templates.rendered("don't <b>\n", {}) == "don't <b>\n"
    assert templates.variables(["{% for d in docs %}{{ d.t }}{{ loop.index }}{{ q }}{% endfor %}", "{{ a }}"]) == ["a", "docs", "q"]
    for bad in ("{{ a", "{% for x %}{% endfor %}", "{% if a %}", "{% endfor %}", "{{ a | nothing }}", "{{ __import__('os') }}"):
        with pytest.raises(templates.TemplateError):
            templates.parsed(bad)
    for missing in ("{{ a }}", "{{ b.c }}", "{{ b[3] }}"):
        with pytest.raises(templates.TemplateError):
            templates.rendered(missing, {"b": {}})
    with pytest.raises(templates.TemplateError):
        templates.rendered("{% for x in a %}" + "y" * 1000 + "{% endfor %}", {"a": list(range(1001))})


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"type": ["integer", "null"]}, [1, 1.0, None], [True, "1", 1.5]),
        ({"enum": [1, "a", [1]]}, [1, "a", [1]], [2, True]),
        ({"properties": {"a": {"minLength": 2}}, "required": ["a"]}, [{"a": "xx", "b": 1}, 5], [{}, {"a": "x"}]),
        ({"patternProperties": {"^s_": {"type": "string"}}, "additionalProperties": {"type": "integer"}}, [{"s_a": "x", "n": 1}], [{"s_a": 1}, {"n": "x"}]),
        ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}, "uniqueItems": True}, [["a", 1, 2], []], [[1], ["a", "b"], ["a", 1, 1]]),
        ({"oneOf": [{"minimum": 3}, {"maximum": 5}]}, [1, 9], [4]),
        ({"anyOf": [{"type": "string"}, {"multipleOf": 0.1}], "not": {"const": 0.3}}, ["x", 0.2], [0.3, 0.25]),
        ({"if": {"type": "string"}, "then": {"pattern": "^a"}, "else": {"type": "integer"}}, ["ab", 3], ["b", 1.5]),
        ({"$defs": {"n": {"exclusiveMinimum": 0}}, "properties": {"x": {"$ref": "#/$defs/n"}}}, [{"x": 1}], [{"x": 0}]),
        ({"contains": {"const": 1}}, [[0, 1]], [[0]]),
    ],
)
def test_schemas(schema, good, bad):
    json_schema.check_schema(schema)
    assert all(json_schema.fits(v, schema, schema) for v in good)
    assert not any(json_schema.fits(v, schema, schema) for v in bad)


def test_schema_of_unknown_kind_is_refused():
    for bad in ({"type": "text"}, {"dependentRequired": {}}, {"properties": {"a": 5}}, []):
        with pytest.raises(ValueError):
            json_schema.check_schema(bad)


def test_decompression_is_bounded(spark):
    body = b"x" * 5000
    rows = [(1, gzip.compress(body)), (2, gzip.compress(body)[:-9]), (3, gzip.compress(body)[:2] + b"junkjunkjunk"), (4, body), (5, gzip.compress(b"x" * 10_001)), (6, b"\xff"), (7, None)]
    got = {r["k"]: (r["body"], r["reason"]) for r in otlp.decompress(spark.createDataFrame(rows, "k int, content binary"), limit=10_000).collect()}
    assert got[1] == got[4] == (body.decode(), None)
    assert [got[k][1] for k in (2, 3, 5, 6, 7)] == ["truncated gzip", "malformed gzip", "too large", "not UTF-8", "empty"]


def test_webhooks(spark):
    sent = []

    def send(url, payload, headers):
        sent.append((url, payload, headers))
        if url == "down":
            raise OSError
        return 204 if url == "good" else 302

    kinds = "rule string, project_id string, metric string, comparison string, threshold double, window_seconds int, value double, sample_size long, webhook_url string"
    rules = spark.createDataFrame([(u, "p", "error_rate", "above", 0.1, 60, 0.5, 9, u) for u in ("good", "moved", "down")], kinds)
    out = {r["rule"]: r["ok"] for r in alerts.deliver(rules, "secret", datetime(2024, 1, 1), send).collect()}
    assert out == {"good": True, "moved": False, "down": False} and len(sent) == 3
    for _, payload, headers in sent:
        assert headers["x-signature"] == hmac.new(b"secret", payload, hashlib.sha256).hexdigest() and b": " not in payload
        assert json.loads(payload)["rule"]["window_seconds"] == 60


def test_refusals(spark):
    run = runner.Run([("exact_match", {})], model="o3-mini", provider="fake", parameters={"temperature": 0.1})
    one = spark.range(1)
    assert runner.validated(run, one) == "o3-mini" and runner.refused_parameters("o3-mini", {"top_p": 1, "x": 2}) == ["top_p"] and runner.refused_parameters("m", {"top_p": 1}) == []
    wrong = [runner.Run([]), runner.Run([("none", {})], "m"), runner.Run([("exact_match", {"x": 1})], "m"), runner.Run([("exact_match", {})]), runner.Run([("llm_judge", {})], "m"), runner.Run([("exact_match", {})], "m", provider="none")]
    for bad in wrong:
        with pytest.raises(ValueError):
            runner.validated(bad, one)
    with pytest.raises(ValueError):
        runner.validated(runner.Run([("exact_match", {})], "m"), spark.range(0))
    for call in (lambda: metrics.window("2h", datetime(2024, 1, 1)), lambda: tenancy.scoped(one, ""), lambda: registry.page(one, "id", tie="id", limit=0), lambda: evaluators.build("regex_match", pattern="(")):
        with pytest.raises(Exception, match="."):
            call()
    with pytest.raises(LookupError):
        tenancy.found(one, "row", id=7)
    assert tenancy.found(one, "row", id=0)["id"] == 0
    with pytest.raises(ValueError):
        comparison.warnings({"dataset_version_id": 1}, {"dataset_version_id": 2})
    assert len(comparison.warnings({"dataset_version_id": 1, "model": "a"}, {"dataset_version_id": 2, "model": "b"}, "positional")) == 2


def test_promotion_refuses(spark):
    kinds = "trace_id string, status string, verdict string, output string, corrected_output string, promoted_at timestamp_ntz"
    items = spark.createDataFrame([("a", "labeled", "good", "x", None, None), ("b", "pending", None, "x", None, None), ("c", "labeled", "bad", "x", None, None), ("d", "labeled", "good", "x", None, datetime(2024, 1, 1))], kinds)
    none = spark.createDataFrame([], "trace_id string, item_index long, expected_output string, metadata string")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "trace_id string")
    assert [(r["item_index"], r["expected_output"]) for r in review.promote(items, pick("a"), none).collect()] == [(0, "x")]
    for ids in (["b"], ["c"], ["d"], ["a", "b"]):
        with pytest.raises(ValueError):
            review.promote(items, pick(*ids), none)
    with pytest.raises(LookupError):
        review.promote(items, pick("zz"), none)
    with pytest.raises(ValueError):
        review.promote(items, pick("a").where("false"), none)


def test_vectors_of_unlike_lengths_are_a_gap_of_their_row(spark):
    df = spark.createDataFrame([(1, [1.0], [1.0, 2.0]), (2, [1.0, 0.0], [1.0, 0.0])], "k int, a array<double>, b array<double>")
    got = {r["k"]: r for r in df.select("k", evaluators.embedding_similarity(F.col("a"), F.col("b")).alias("r")).select("k", "r.*").collect()}
    assert got[1]["score"] is None and got[1]["error"] == "the vectors differ in length" and got[2]["score"] == 1.0
