"""Evaluation runs: validation, rendering and generation of each item, scores, upserts, terminal state, failed items.

A run is one DataFrame over the items; partitions take the place of workers. An item that fails is a row with an error,
and a retry takes up what has no result yet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.functions import generation
from tracequarry.functions import json_text as J
from tracequarry.functions.templates import render

from . import evaluators as E

#: Providers by name: a column of messages to a struct (text, error, input_tokens, output_tokens).
PROVIDERS: dict[str, Callable[[Column], Column]] = {"fake": generation.generate}
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"fake": generation.embed}
#: Parameters of sampling, and names of models that begin so refuse them.
SAMPLING = ("temperature", "top_k", "top_p")
REFUSING_PREFIXES = ("o1", "o3", "o4")
CLIP = 20_000


@dataclass(frozen=True)
class Run:
    """What a run is of. messages: (role, template) of the prompt version, or None where items bring their own prompt."""

    evaluators: list[tuple[str, dict[str, Any]]]
    model: str | None = None
    provider: str = "fake"
    embedder: str = "fake"
    messages: list[tuple[str, str]] | None = None
    parameters: dict[str, Any] = field(default_factory=dict)
    rubric: list[tuple[str, str]] | None = None
    refusing: frozenset[str] = frozenset()
    judge_model: str | None = None


def refused_parameters(model: str, parameters: dict[str, Any], refusing: frozenset[str] = frozenset()) -> list[str]:
    """Sampling parameters that the model does not accept. refusing: names beyond those with REFUSING_PREFIXES."""
    return sorted(set(SAMPLING) & set(parameters)) if model in refusing or model.startswith(REFUSING_PREFIXES) else []


def refuses(model: Column, refusing: list[str] | None = None) -> Column:
    out = model.rlike("^(?:" + "|".join(REFUSING_PREFIXES) + ")")
    return out | model.isin(refusing) if refusing else out


def priced(base_url: Column, host: str) -> Column:
    """Whether list prices hold: without another endpoint, or at the canonical host."""
    return base_url.isNull() | F.coalesce(F.lower(F.try_parse_url(base_url, F.lit("HOST"))) == host, F.lit(False))


def stale_prices(runs: DataFrame, checked: date) -> DataFrame:
    """runs with stale: finished, or created, after the day of the price list."""
    return runs.withColumn("stale", F.to_date(F.coalesce("finished_at", "created_at")) > F.lit(checked))


def validated(run: Run, items: DataFrame) -> str:
    """The model of a run that may start; ValueError before anything is generated."""
    for what, name, known in (("provider", run.provider, PROVIDERS), ("embedder", run.embedder, EMBEDDERS)):
        if name not in known:
            raise ValueError(f"unknown {what} {name!r}; one of {', '.join(sorted(known))}")
    built = E.build_all(run.evaluators)
    if "llm_judge" in built and not run.rubric:
        raise ValueError("llm_judge needs a rubric")
    if items.isEmpty():
        raise ValueError("dataset version contains no items")
    model = run.model or run.parameters.get("model")
    if not model:
        raise ValueError("no model: set one on the run or in the prompt version")
    if run.provider != "fake" and (bad := refused_parameters(model, run.parameters, run.refusing)):
        raise ValueError(f"model {model!r} does not accept {', '.join(bad)}")
    return model


def _messages(templates: list[tuple[str, str]], variables: Column) -> tuple[Column, Column]:
    """Rendered messages, and the first error."""
    parts = [(role, render(F.lit(source), variables)) for role, source in templates]
    listed = F.array(*[F.struct(F.lit(role).alias("role"), p["text"].alias("content")) for role, p in parts])
    errors = F.array_compact(F.array(*[F.when(p["error"].isNotNull(), F.concat(F.lit(f"message {i}: "), p["error"])) for i, (_, p) in enumerate(parts)]))
    return listed, F.get(errors, F.lit(0))


def generated(run: Run, items: DataFrame) -> DataFrame:
    """Results of items (dataset_item_id, item_index, inputs): rendered_messages, output, error, prompt_tokens, completion_tokens."""
    if run.messages is not None:
        messages, error = _messages(run.messages, F.col("inputs"))
    else:
        first = F.coalesce(*[F.nullif(J.field(F.col("inputs"), k), F.lit('""')) for k in ("prompt", "input")])
        own = F.when(J.is_string(first), J.text_of(first))
        messages = F.array(F.struct(F.lit("user").alias("role"), own.alias("content")))
        error = F.when(own.isNull(), F.lit("each item needs a string 'prompt' or 'input' field"))
    d = items.withColumns({"rendered_messages": messages, "_e": error})
    d = d.withColumn("_g", F.when(F.col("_e").isNull(), PROVIDERS[run.provider](F.col("rendered_messages"))))
    return d.select(
        *items.columns, F.when(F.col("_e").isNull(), F.col("rendered_messages")).alias("rendered_messages"), F.col("_g.text").alias("output"),
        F.coalesce("_e", F.col("_g.error")).alias("error"), F.col("_g.input_tokens").alias("prompt_tokens"), F.col("_g.output_tokens").alias("completion_tokens"),
    )


def _score(run: Run, name: str, f: Callable[..., Column]) -> Column:
    output, expected, inputs, context = (F.col(c) for c in ("output", "expected_output", "inputs", "expected_context"))
    if name == "exact_match":
        return f(output, expected)
    if name in ("regex_match", "json_schema"):
        return f(output)
    if name == "embedding_similarity":
        embed = EMBEDDERS[run.embedder]
        return f(embed(output), embed(expected))
    if name == "llm_judge":
        messages, error = _messages(run.rubric or [], E.judge_variables(inputs, output, expected, context))
        return F.when(error.isNotNull(), E.unscoreable(error)).otherwise(f(generation.generate_judgement(messages)))
    if name not in ("retrieval_precision", "retrieval_recall", "retrieval_mrr"):
        return f(output, expected, inputs, context)
    retrieved, relevant, error = E.retrieval_keys(inputs, context)
    return F.when(error.isNotNull(), E.unscoreable(error)).otherwise(f(retrieved, relevant))


def scored(run: Run, results: DataFrame) -> DataFrame:
    """Scores (dataset_item_id, evaluator, score, passed, error, detail) of the results without an error. A judge's detail
    names the models; what an evaluator cannot score, or raises, is the error of that score alone."""
    about = {"judge_model": run.judge_model or run.model, "target_model": run.model}
    built = E.build_all([(n, about | c if n == "llm_judge" else c) for n, c in run.evaluators])
    good = results.where(F.col("error").isNull())
    wide = good.select("dataset_item_id", *[_score(run, n, f).alias(n) for n, f in built.items()])
    return E.unpivot_scores(wide, ["dataset_item_id"], list(built))


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], kept: list[str] | None = None) -> DataFrame:
    """stored with new rows in place of those with the same key; columns in `kept` stay as first written."""
    mark = lambda df, name: df.withColumn(name, F.lit(True))
    both = mark(stored, "_old").alias("s").join(mark(new, "_new").alias("n"), keys, "full_outer")
    kept = kept or []
    pick = lambda c: F.when(F.col("_new") & (F.lit(c not in kept) | F.col("_old").isNull()), F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)
    return both.select(*[F.col(c) if c in keys else pick(c) for c in stored.columns])


def dead_letters(results: DataFrame, run_id: str, attempts: int) -> DataFrame:
    """Items that failed for good, with the error clipped to CLIP characters."""
    return results.where(F.col("error").isNotNull()).select(
        F.lit(run_id).alias("eval_run_id"), "dataset_item_id", F.left("error", F.lit(CLIP)).alias("exception_message"), F.lit(attempts).alias("attempts")
    )


def run_detail(results: DataFrame, scores: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """A page of results by item_index, each with its scores by evaluator; only the page's scores are read."""
    page = results.orderBy("item_index").offset(offset).limit(limit)
    own = scores.join(F.broadcast(page.select("dataset_item_id")), "dataset_item_id", "left_semi")  # at most `limit` ids
    listed = own.groupBy("dataset_item_id").agg(F.array_sort(F.collect_list(F.struct("evaluator", "score", "passed"))).alias("scores"))
    none = F.array().cast("array<struct<evaluator:string,score:double,passed:boolean>>")
    return page.join(listed, "dataset_item_id", "left").withColumn("scores", F.coalesce("scores", none))
