"""Versioned prompts and datasets: versions, labels, listings, diffs, rubrics, keys; costs by price list; rate usage."""

from __future__ import annotations

import difflib
from dataclasses import dataclass
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequarry.functions.formats import canonical_json

from .tenancy import rejected

#: Slugs and labels, and how much of a key is kept in the clear.
SLUG, LABEL, PREFIX_LENGTH = r"^[a-z0-9][a-z0-9_-]{0,63}$", r"^[a-z0-9][a-z0-9_-]{0,31}$", 16


def latest_version(versions: DataFrame, key: str = "prompt_slug") -> DataFrame:
    return versions.groupBy(key).agg(F.max("version").alias("version"), F.max_by("version_id", "version").alias("version_id"), F.max_by("content_hash", "version").alias("content_hash"))


def resolve(versions: DataFrame, labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (prompt_slug, ref) to versions; a ref of digits is a version number, others are labels."""
    number = F.when(F.col("ref").rlike("^[0-9]+$"), F.col("ref").try_cast("int"))
    w = wanted.withColumn("_n", number).join(labels.withColumnRenamed("label", "ref").withColumnRenamed("version", "_v"), ["prompt_slug", "ref"], "left")
    w = w.select("prompt_slug", "ref", F.coalesce("_n", F.when(~F.col("ref").rlike("^[0-9]+$"), F.col("_v"))).alias("version"))
    return w.join(versions, ["prompt_slug", "version"])


def current_labels(events: DataFrame) -> DataFrame:
    """Label assignments (prompt_slug, label, version, seq): the last one counts; a null version removes the label."""
    last = events.groupBy("prompt_slug", "label").agg(F.max(F.struct("seq", "version")).alias("r"))
    return last.where("r.version is not null").select("prompt_slug", "label", "r.version")


def valid_slugs(rows: DataFrame, column: str = "slug") -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed slug, and the others."""
    return rejected(rows, {column: F.col(column).rlike(SLUG)})


def valid_labels(rows: DataFrame, column: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows with a well-formed label that is no number, which would be read as a version; and the others."""
    return rejected(rows, {column: F.col(column).rlike(LABEL) & ~F.col(column).rlike("^[0-9]+$")})


def updated(table: DataFrame, changes: DataFrame, about: tuple[str, ...] = ("name", "description")) -> tuple[DataFrame, DataFrame]:
    """table (project_id, slug, ...) with the descriptive columns of changes (project_id, slug, seq and some of `about`), and
    changes of what is not there. A null leaves a column as it is; of several changes of one column the last by seq counts.
    Contents are not changed in this way: they make a new version."""
    keys, given = ["project_id", "slug"], [c for c in about if c in changes.columns and c in table.columns]
    known = changes.join(table.select(*keys).distinct(), keys, "left_semi")
    last = known.groupBy(*keys).agg(*[F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(f"_{c}") for c in given])
    out = table.join(last, keys, "left").withColumns({c: F.coalesce(F.col(f"_{c}")[c], F.col(c)) for c in given})
    return out.select(*table.columns), changes.join(table.select(*keys).distinct(), keys, "left_anti")


def created(table: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of new (project_id, slug, ...) that may join the table, and the others with reasons: a slug that is malformed, or
    taken in its project by the table or by an earlier row (by seq)."""
    well, bad = valid_slugs(new)
    first = F.row_number().over(Window.partitionBy("project_id", "slug").orderBy("seq")) == 1
    taken = table.select("project_id", "slug").distinct().withColumn("_taken", F.lit(True))
    judged = well.withColumn("_first", first).join(taken, ["project_id", "slug"], "left")
    free = F.col("_first") & F.col("_taken").isNull()
    refused = judged.where(~free).select(*new.columns, F.array(F.lit("taken")).alias("reasons"))
    return judged.where(free).select(*new.columns), bad.select(*new.columns, "reasons").unionByName(refused)


def prompt_listing(versions: DataFrame, labels: DataFrame) -> DataFrame:
    """Latest version, number of versions and labels ('label=version', in order) of each prompt."""
    listed = labels.groupBy("prompt_slug").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "label", "version"))), ",").alias("labels"))  # a handful each
    counts = versions.groupBy("prompt_slug").agg(F.max("version").alias("latest"), F.count("*").alias("n_versions"))
    return counts.join(listed, "prompt_slug", "left")


def dataset_listing(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """datasets (dataset_slug, ...) in order of slug, with the latest version and its item_count; nulls without one."""
    top = versions.groupBy("dataset_slug").agg(F.max("version").alias("latest_version"), F.max_by("item_count", "version").alias("item_count"))
    return datasets.join(top, "dataset_slug", "left").orderBy("dataset_slug")


def page(rows: DataFrame, *newest: str, tie: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, newest or highest first: versions by number, runs, keys and failed items by creation."""
    if not 1 <= limit <= 200:
        raise ValueError("a page has 1 to 200 rows")
    return rows.orderBy(*[F.desc(c) for c in newest], tie).offset(offset).limit(limit)


def next_versions(base: DataFrame, new: DataFrame, key: str = "prompt_slug") -> DataFrame:
    """new rows (key, seq, ...) numbered on from the key's latest version."""
    top = base.groupBy(key).agg(F.max("version").alias("_top"))
    number = F.row_number().over(Window.partitionBy(key).orderBy("seq"))
    return new.join(top, key, "left").withColumn("version", F.coalesce("_top", F.lit(0)) + number).drop("_top")


def parameter_diff(a: Column, b: Column) -> Column:
    """Changes between two parameter maps (JSON texts by key) in order of key, unchanged ones included."""
    keys = F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))

    def one(k: Column) -> Column:
        x, y = F.element_at(a, k), F.element_at(b, k)
        ina, inb = F.map_contains_key(a, k), F.map_contains_key(b, k)
        change = F.when(ina & ~inb, "removed").when(inb & ~ina, "added").when(x.eqNullSafe(y), "unchanged").otherwise("modified")
        return F.struct(k.alias("key"), change.alias("change"), x.alias("value_from"), y.alias("value_to"))

    return F.transform(keys, one)


@F.pandas_udf(T.StringType())
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """Line diff of two texts; null counts as empty."""
    diff = lambda a, b: difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), fromfile="before", tofile="after", lineterm="")
    return pd.Series(["\n".join(diff(a, b)) for a, b in zip(before, after, strict=True)])


def message_diff(before: DataFrame, after: DataFrame, key: str = "prompt_slug") -> DataFrame:
    """Messages (key, messages: array of role and content) of two versions by place: change, both sides, and a line diff."""
    side = lambda df, s: df.select(key, F.posexplode("messages").alias("index", "m")).select(key, "index", F.col("m.role").alias(f"role_{s}"), F.col("m.content").alias(f"content_{s}"), F.lit(True).alias(f"_{s}"))
    d = side(before, "from").join(side(after, "to"), [key, "index"], "full_outer")
    same = F.col("role_from").eqNullSafe(F.col("role_to")) & F.col("content_from").eqNullSafe(F.col("content_to"))
    change = F.when(F.col("_from").isNull(), "added").when(F.col("_to").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    d = d.withColumn("change", change)
    lines = unified_diff("content_from", "content_to")
    return d.select(key, "index", "change", "role_from", "role_to", "content_from", "content_to", F.when(F.col("change") == "unchanged", "").otherwise(lines).alias("unified"))


def prompt_diff(before: DataFrame, after: DataFrame, key: str = "prompt_slug") -> DataFrame:
    """identical, messages and parameters of each prompt that has both versions (key, messages, parameters)."""
    listed = F.array_sort(F.collect_list(F.struct("index", "change", "role_from", "role_to", "content_from", "content_to", "unified")))  # a prompt's messages
    messages = message_diff(before, after, key).groupBy(key).agg(listed.alias("messages"))
    both = before.select(key, F.col("parameters").alias("_a")).join(after.select(key, F.col("parameters").alias("_b")), key)
    both = both.select(key, parameter_diff(F.col("_a"), F.col("_b")).alias("parameters")).join(messages, key, "left")
    same = lambda c: F.forall(c, lambda x: x["change"] == "unchanged")
    return both.select(key, (F.coalesce(same("messages"), F.lit(True)) & same("parameters")).alias("identical"), "messages", "parameters")


@dataclass(frozen=True)
class Rubric:
    slug: str
    name: str
    system: str
    user: str


_JUDGING = "You grade answers strictly and consistently. Judge what is written, not its tone, length or layout. Between two grades take the lower."
_SCALE = " Grade from 1 (worst) to 5 (best) and reply in JSON with score and reasoning."
#: The rubrics that every project can start from; their slugs are fixed values, the texts our own.
RUBRICS = [
    Rubric("judge-faithfulness", "Faithfulness", _JUDGING, "Is every claim of the answer supported by the context?" + _SCALE + "\n\nContext:\n{{ context }}\n\nAnswer:\n{{ output }}"),
    Rubric("judge-relevance", "Relevance", _JUDGING, "Does the answer address what was asked?" + _SCALE + "\n\nInputs:\n{{ inputs }}\n\nAnswer:\n{{ output }}"),
    Rubric("judge-correctness", "Correctness", _JUDGING, "Does the answer agree with the expected one?" + _SCALE + "\n\nExpected:\n{{ expected_output }}\n\nAnswer:\n{{ output }}"),
    Rubric("judge-conciseness", "Conciseness", _JUDGING, "Does the answer say what is needed and no more?" + _SCALE + "\n\nInputs:\n{{ inputs }}\n\nAnswer:\n{{ output }}"),
]


def seeded(prompts: DataFrame, projects: DataFrame) -> DataFrame:
    """New rows (project_id, prompt_slug, name, kind, messages, version, label) of the rubrics that projects lack; a rubric
    that exists is left as it is. prompts: project_id, prompt_slug, kind."""
    rows = [(r.slug, r.name, "judge", [("system", r.system), ("user", r.user)], 1, "production") for r in RUBRICS]
    kinds = "prompt_slug string, name string, kind string, messages array<struct<role:string,content:string>>, version int, label string"
    every = projects.select("project_id").distinct().withColumn("_r", F.explode(F.array(*[F.lit(r.slug) for r in RUBRICS]))).withColumnRenamed("_r", "prompt_slug")
    lacking = every.join(prompts.where("kind = 'judge'").select("project_id", "prompt_slug"), ["project_id", "prompt_slug"], "left_anti")
    return lacking.join(F.broadcast(projects.sparkSession.createDataFrame(rows, kinds)), "prompt_slug")  # a row for each rubric


def judges(prompts: DataFrame) -> DataFrame:
    return prompts.where("kind = 'judge'").orderBy("prompt_slug")


def hashed_key(key: Column, pepper: str) -> Column:
    return F.sha2(F.concat(key, F.lit(pepper)), 256)


def verified_keys(presented: DataFrame, keys: DataFrame, pepper: str, now: datetime) -> DataFrame:
    """presented (key) that are known, not revoked and not expired, with project_id; keys: key_prefix, key_hash, project_id,
    revoked_at, expires_at."""
    p = presented.withColumns({"key_prefix": F.substring("key", 1, PREFIX_LENGTH), "_hash": hashed_key(F.col("key"), pepper)})
    alive = F.col("revoked_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))
    return p.join(keys, "key_prefix").where((F.col("_hash") == F.col("key_hash")) & alive).select("key", "project_id")


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage (model, prompt_tokens, completion_tokens) with cost_usd by prices (model, input_rate, output_rate per million tokens).

    Rates are decimals; a model without a price has a null cost, not 0."""
    amount = F.col("prompt_tokens") * F.col("input_rate") + F.coalesce("completion_tokens", F.lit(0)) * F.col("output_rate")
    return usage.join(prices, "model", "left").withColumn("cost_usd", (amount / F.lit(1_000_000)).cast("decimal(18,6)"))


def canonical_hash(value: Column) -> Column:
    """SHA-256 of a JSON text with its keys in order and no spaces, numbers as they are written."""
    return F.sha2(canonical_json(value), 256)


def rate_usage(requests: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests (project_id, started_at, cost) with the cost of the window of `seconds` that ends with each.

    Costs are summed by second first. Seconds are cut into blocks of one window's length; each block also gets the seconds of
    the block before, so that a window never leaves its block and a project spreads over all tasks."""
    at = F.unix_seconds(F.col("started_at").cast("timestamp"))
    per_second = requests.groupBy("project_id", at.alias("_at")).agg(F.sum("cost").alias("_cost"))
    block = F.floor(F.col("_at") / seconds)
    dealt = per_second.select("*", F.explode(F.array(block, block + 1)).alias("_block"))
    window = Window.partitionBy("project_id", "_block").orderBy("_at").rangeBetween(-seconds, 0)
    sums = dealt.withColumn("window_cost", F.sum("_cost").over(window)).where(F.col("_block") == block).select(F.col("project_id").alias("_p"), "_at", "window_cost")
    return requests.join(sums, requests["project_id"].eqNullSafe(F.col("_p")) & (at == F.col("_at"))).drop("_p", "_at")
