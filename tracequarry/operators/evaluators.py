"""Scores of outputs as columns: struct(score, passed, error, detail); a null score with an error is unscoreable.

detail is a JSON object that explains the score; {} where there is nothing to say. No evaluator raises: what cannot be scored
gives a null score and a reason for its row."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from functools import partial
from typing import Any

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions import json_text as J
from tracequarry.functions.isolation import casefolded, isolated, matched
from tracequarry.functions.json_schema import check_schema, schema_result, without_fences

EVALUATORS: dict[str, Callable[..., Column]] = {}
LISTED = 10


def evaluator(name: str):
    """Registers a builder of evaluator columns; names are unique."""

    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in EVALUATORS:
            raise ValueError(f"evaluator {name!r} exists")
        EVALUATORS[name] = f
        return f

    return add


def _detail(**fields: Column) -> Column:
    """A JSON object of fields that are not null; values are JSON texts."""
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in fields.items()]
    return J.object_of(F.array_compact(F.array(*pairs)))


def _result(score: Column, passed: Column, error: Column | None = None, detail: Column | None = None) -> Column:
    error = F.lit(None).cast("string") if error is None else error
    detail = F.when(error.isNull(), detail) if detail is not None else F.lit("{}")
    return F.struct(score.cast("double").alias("score"), passed.cast("boolean").alias("passed"), error.alias("error"), F.coalesce(detail, F.lit("{}")).alias("detail"))


def unscoreable(error: Column) -> Column:
    return _result(F.lit(None), F.lit(None), error)


def custom(name: str, f: Callable[..., float | None]) -> None:
    """Registers an evaluator in Python: f(output, expected, inputs, context), texts or None, gives a score from 0 to 1 or
    None for a gap; what it raises is the reason of that row alone."""

    def build_column(output: Column, expected: Column, inputs: Column, context: Column, threshold: float = 0.5) -> Column:
        r = isolated(f, T.DoubleType(), nulls=True)(output, expected, inputs, context)
        error = F.coalesce(r["error"], F.when(r["value"].isNull(), F.lit("no score")))
        return _result(r["value"], r["value"] >= threshold, error)

    evaluator(name)(build_column)


@evaluator("exact_match")
def exact_match(output: Column, expected: Column, strip: bool = True, case_sensitive: bool = True) -> Column:
    form = lambda c: F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")) if strip else c
    cased = (lambda c: c) if case_sensitive else casefolded
    hit = cased(form(output)) == cased(form(expected))
    detail = F.when(~hit, _detail(expected=J.quoted(expected), actual=J.quoted(output)))
    return _result(F.when(expected.isNotNull(), F.when(hit, 1.0).otherwise(0.0)), F.when(expected.isNotNull(), hit), F.when(expected.isNull(), F.lit("no expected output")), detail)


@evaluator("regex_match")
def regex_match(output: Column, pattern: str, full: bool = False, ignore_case: bool = False) -> Column:
    if len(pattern) > 1000:
        raise ValueError("pattern is over 1000 characters")
    found = matched(output, pattern, full, ignore_case)
    hit = found["value"]["hit"]
    detail = _detail(pattern=F.lit(json.dumps(pattern, ensure_ascii=False)), matched=J.quoted(found["value"]["matched"]))
    return _result(F.when(hit, 1.0).when(~hit, 0.0), hit, found["error"], detail)


def document_key(document: Column, id_field: str = "id", normalise: bool = True) -> Column:
    """What a document, a JSON text, is matched by: an object's id, else its text or content; a string itself."""
    filled = lambda name: F.nullif(J.field(document, name), F.lit('""'))
    raw = F.when(J.is_object(document), F.coalesce(J.field(document, id_field), filled("text"), filled("content"), F.lit('""'))).otherwise(document)
    key = J.text_of(raw)
    return F.lower(F.trim(F.regexp_replace(key, r"\s+", " "))) if normalise else key  # lower: Python cannot be called within a list


def retrieval_keys(inputs: Column, expected_context: Column, field: str = "retrieved_context", id_field: str = "id", normalise: bool = True) -> tuple[Column, Column, Column]:
    """Keys of the retrieved and the relevant documents from JSON texts, and why there are none."""
    raw = J.field(inputs, field)
    keys = lambda c: F.transform(J.elements(c), lambda d: document_key(d, id_field, normalise))
    error = (
        F.when(raw.isNull(), f"item has no '{field}' field").when(~J.is_list(raw), f"'{field}' must be a list of documents")
        .when(expected_context.isNull(), "item has no expected_context")
    )
    return keys(raw), keys(expected_context), error


def _found(top: Column, relevant: Column, hits: Column, **more: Column) -> Column:
    count = lambda c: F.size(c).cast("string")
    listed = F.transform(missed(top, relevant), lambda x: F.coalesce(J.quoted(x), F.lit("null")))
    return _detail(retrieved_count=count(top), relevant_count=count(relevant), hits=hits.cast("string"), missed=F.concat(F.lit("["), F.array_join(listed, ","), F.lit("]")), **more)


def _hits(retrieved: Column, relevant: Column) -> Column:
    return F.size(F.filter(retrieved, lambda x: F.array_contains(relevant, x)))


def _none() -> Column:
    return F.lit(None).cast("boolean")


@evaluator("retrieval_precision")
def retrieval_precision(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """The share of retrieved documents that are relevant; without retrieved ones 0 and failed, else without a verdict."""
    top = F.slice(retrieved, 1, k) if k else retrieved
    score = F.coalesce(F.try_divide(_hits(top, relevant), F.size(top)), F.lit(0.0))
    detail = F.when(F.size(top) == 0, F.lit('{"error":"nothing was retrieved"}')).otherwise(_found(top, relevant, _hits(top, relevant)))
    return _result(score, F.when(F.size(top) == 0, False).otherwise(_none()), detail=detail)


@evaluator("retrieval_recall")
def retrieval_recall(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """The share of relevant documents that were retrieved, without a verdict."""
    top = F.slice(retrieved, 1, k) if k else retrieved
    found = F.size(F.filter(relevant, lambda x: F.array_contains(top, x)))
    return _result(F.try_divide(found, F.size(relevant)), _none(), F.when(F.size(relevant) == 0, F.lit("no relevant items")), _found(top, relevant, found))


@evaluator("retrieval_mrr")
def retrieval_mrr(retrieved: Column, relevant: Column, k: int | None = None) -> Column:
    """One over the rank of the first relevant document; without one 0 and failed, else without a verdict."""
    top = F.slice(retrieved, 1, k) if k else retrieved
    rank = F.array_position(F.transform(top, lambda x: F.array_contains(relevant, x)), True)
    detail = _found(top, relevant, F.when(rank > 0, 1).otherwise(0), first_relevant_rank=F.when(rank > 0, rank.cast("string")).otherwise("null"))
    return _result(F.when(rank > 0, 1.0 / rank).otherwise(0.0), F.when(rank > 0, _none()).otherwise(False), detail=detail)


def missed(retrieved: Column, relevant: Column) -> Column:
    """The relevant documents that were not retrieved, LISTED at most."""
    return F.slice(F.filter(relevant, lambda x: ~F.array_contains(retrieved, x)), 1, LISTED)


def retrieval_scores(retrieved: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """query_id, precision, recall, mrr of retrieved (query_id, group, rank from 1, key) where a query's relevant documents
    are all documents (key, group) of its group: counted and joined, so a group may be of any size."""
    sizes = documents.groupBy("group").agg(F.count("*").alias("n_relevant"))
    got = retrieved.where(F.col("rank") <= k).join(documents.select("key", F.col("group").alias("_g")), "key", "left")
    hit = F.col("_g") == F.col("group")
    out = got.groupBy("query_id", "group").agg(F.count_if(hit).alias("hits"), F.count("*").alias("n"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    out = out.join(sizes, "group", "left")
    return out.select("query_id", (F.col("hits") / F.col("n")).alias("precision"), F.try_divide("hits", "n_relevant").alias("recall"), F.coalesce(F.try_divide(F.lit(1), "first"), F.lit(0.0)).alias("mrr"))


@evaluator("json_schema")
def json_schema(output: Column, schema: dict[str, Any], strip_code_fences: bool = False) -> Column:
    """1 for JSON that fits the schema, else 0; what is no JSON is a failure, not a gap."""
    found = schema_result(without_fences(output) if strip_code_fences else output, schema)
    return _result(F.when(found["valid"], 1.0).otherwise(0.0), found["valid"])


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; null for vectors of unlike length."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0)))


@evaluator("embedding_similarity")
def embedding_similarity(output: Column, expected: Column, threshold: float = 0.85) -> Column:
    raw = cosine(output, expected)
    score = F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    error = F.when(expected.isNull(), "no expected vector").when(raw.isNull(), "the vectors differ in length")
    return _result(score, score >= threshold, error, _detail(cosine=F.round(raw, 6).cast("string"), threshold=F.lit(str(threshold))))


@evaluator("llm_judge")
def judge_score(reply: Column, threshold: float = 0.75, judge_model: str | None = None, target_model: str | None = None, rubric: str | None = None) -> Column:
    """From a judge's JSON reply {"score": 1..5, "reasoning"}: clamped and put on 0..1; a reply without it is unscoreable.

    A judge of the same model as the one it judges is marked, as models favour what they wrote."""
    raw = F.try_variant_get(F.try_parse_json(reply), "$.score", "double").cast("int")
    clamped = F.greatest(F.lit(1), F.least(F.lit(5), raw))
    score = F.when(raw.isNotNull(), (clamped - 1) / 4.0)
    known = lambda v: F.lit(None if v is None else json.dumps(v, ensure_ascii=False)).cast("string")
    own = judge_model is not None and judge_model == target_model
    detail = _detail(
        raw_score=clamped.cast("string"), scale=F.lit('"1-5"'), reasoning=J.field(reply, "reasoning"), judge_model=known(judge_model), rubric=known(rubric),
        self_judged=known(True if own else None), self_judged_note=known("the judge and the judged model are one; such scores are too high" if own else None),
    )
    return _result(score, score >= threshold, F.when(raw.isNull(), F.lit("reply has no score")), detail)


def passages(context: Column) -> Column:
    """A context, a JSON text, as a rubric shows it: lists numbered from 1, strings as they are, null empty."""
    listed = F.transform(J.elements(context), lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.when(J.is_string(x), J.text_of(x)).otherwise(x)))
    return F.when(context.isNull() | (context == "null"), "").when(J.is_string(context), J.text_of(context)).when(J.is_list(context), F.array_join(listed, "\n\n")).otherwise(context)


def judge_variables(inputs: Column, output: Column, expected_output: Column, expected_context: Column, context_field: str = "context") -> Column:
    """The variables of a rubric as a JSON object: the item's fields, then output, expected_output, inputs and context."""
    own = ["output", "expected_output", "inputs", "context"]
    context = F.coalesce(J.field(inputs, context_field), expected_context)
    fields = F.filter(F.map_entries(F.transform_values(F.from_json(inputs, "map<string,variant>"), lambda k, v: F.to_json(v))), lambda e: ~e["key"].isin(own))
    values = [output, F.coalesce(expected_output, F.lit("")), inputs, passages(context)]
    more = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(J.quoted(v), F.lit('""')).alias("value")) for k, v in zip(own, values, strict=True)])
    return J.object_of(F.concat(fields, more))


def build(name: str, **config: Any) -> Callable[..., Column]:
    """The evaluator with its settings; ValueError for names or settings that do not exist."""
    if name not in EVALUATORS:
        raise ValueError(f"unknown evaluator {name!r}; one of {', '.join(sorted(EVALUATORS))}")
    known = inspect.signature(EVALUATORS[name]).parameters
    if wrong := set(config) - set(known):
        raise ValueError(f"{name} has no setting {', '.join(sorted(wrong))}")
    if "schema" in config:
        check_schema(config["schema"])
    if "pattern" in config:
        try:
            regex.compile(config["pattern"])
        except regex.error as e:
            raise ValueError(f"no regular expression: {e}") from e
    return partial(EVALUATORS[name], **config)


def build_all(specs: list[tuple[str, dict[str, Any]]]) -> dict[str, Callable[..., Column]]:
    """At least one evaluator, each name once."""
    names = [n for n, _ in specs]
    if not names or len(set(names)) < len(names):
        raise ValueError("evaluators must be given, each once")
    return {n: build(n, **c) for n, c in specs}


def unpivot_scores(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide evaluator columns as rows (keys, evaluator, score, passed, error, detail)."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("evaluator"), *[F.col(n)[c].alias(c) for c in ("score", "passed", "error", "detail")]) for n in names]))
    return df.select(*keys, rows.alias("r")).select(*keys, "r.*")


def aggregates(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per evaluator: scored rows, mean, least, greatest, the share passed of those with a verdict, unscoreable rows."""
    return scores.groupBy(*by).agg(
        F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.round(F.try_divide(F.count_if("passed"), F.count("passed")), 6).alias("pass_rate"), (F.count("*") - F.count("score")).alias("unscoreable"),
    )


def run_status(results: DataFrame) -> DataFrame:
    """run_id, completed, failed, status of results (run_id, dataset_item_id, error), one for each item: succeeded without
    failures, partial with some, failed if no item has an output. A null score is a gap and fails nothing."""
    out = results.groupBy("run_id").agg(F.count_if(F.col("error").isNull()).alias("completed"), F.count("error").alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "succeeded").when(F.col("completed") > 0, "partial").otherwise("failed"))


def pending_items(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items without a result that succeeded."""
    return items.join(results.where("error is null").select("dataset_item_id").distinct(), "dataset_item_id", "left_anti")
