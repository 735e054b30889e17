"""Tool calls and their results, linked, ordered, validated and written as canonical JSON, in DataFrame functions only.

Calls and results are joined on (conv_id, call_id). A call may name a parent, a call whose result it builds on; the depth
of a call is the length of its chain of parents, found by pointer doubling: each round joins every call with the call
that its pointer names, so that a chain of n calls takes log2(n) joins, and no conversation is ever gathered into one
task. `position` is the place of an event in the topological order of its conversation, from 0: by depth, then calls
before results, then turn and call_id, so that every result comes after its call and every call after its parent's
result. Places are counted in ranges of (conv_id, order), so that a conversation of any size is spread over tasks.

Arguments are checked against the schema of the called tool: SCHEMA = {tool: {field: (type, required)}} with the types
string, integer, number, boolean, object and array; fields without a schema are violations. Arguments are written in
canonical form: keys in order, no spaces.

Defined results: calls without a result are 'unanswered', results without a call 'orphan' (depth 0); calls on a cycle of
parents or below one get depth null, status 'cyclic' and the last positions; a parent that does not exist counts as none; repeated calls or
results with one identifier keep the one of lowest turn, then text; a null conv_id, call_id or turn is a value like any
other for ordering (least, ties by the md5 of the JSON), but a null identifier links with nothing; arguments that are not a JSON object give the violation
'not an object'. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequarry.operators.ordering import sums_before

from .common import forget, written

TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def _one(df: DataFrame, order: list[str]) -> DataFrame:
    """One row of each (conv_id, call_id), the least; rows without an identifier all stay."""
    known = df.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    fields = [c for c in df.columns if c not in ("conv_id", "call_id")]
    least = known.groupBy("conv_id", "call_id").agg(F.min(F.struct(*order, *[c for c in fields if c not in order])).alias("r"))
    return least.select("conv_id", "call_id", *[F.col("r")[c].alias(c) for c in fields]).unionByName(df.where(F.col("conv_id").isNull() | F.col("call_id").isNull()))


def call_depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of calls (conv_id, call_id, parent_id); null on or below a cycle."""
    known = calls.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()).select("conv_id", "call_id", "parent_id")
    there = known.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("found"))
    state = known.join(there, ["conv_id", "parent_id"], "left")
    state = state.select("conv_id", "call_id", F.when(F.col("found"), F.col("parent_id")).alias("at"), F.when(F.col("found"), 1).otherwise(0).cast("long").alias("depth"))
    state = written(state, "depths")
    most, reach = state.count(), 1
    while reach <= most and not (open_ := state.where(F.col("at").isNotNull())).isEmpty():
        ahead = state.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = open_.join(ahead, ["conv_id", "at"]).select("conv_id", "call_id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        before, state = state, written(state.where(F.col("at").isNull()).unionByName(moved), "depths")  # only open rows are joined again
        forget(before)
        reach *= 2
    return state.select("conv_id", "call_id", F.when(F.col("at").isNull(), F.col("depth")).alias("depth"))


def _violations(name: Column, value: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("null"))))
    whole = F.schema_of_variant(value)
    keys = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
    for tool, listed in sorted(schemas.items()):
        checks = []
        for field, (kind, required) in sorted(listed.items()):
            got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
            fits = F.lit(False)
            for start in TYPES[kind]:
                fits = fits | got.startswith(start)
            missing = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            checks.append(F.when(got.isNull(), missing).when(~fits, F.lit(f"{field} is not {kind}")))
        known = F.array(*[F.lit(f) for f in sorted(listed)]) if listed else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(F.lit("unknown field "), k))
        found = F.concat(F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>"), extra)
        bad = F.array(F.lit("not an object"))
        out = F.when(name == tool, F.when(value.isNull() | ~F.coalesce(whole.startswith("OBJECT"), F.lit(False)), bad).otherwise(found)).otherwise(out)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """conv_id, call_id, kind ('call' or 'result'), depth, turn, status, violations, json, position of each call and result.

    calls: conv_id, call_id, parent_id, turn, name, arguments (JSON text); results: conv_id, call_id, turn, content."""
    calls = _one(calls.select("conv_id", "call_id", "turn", "name", "arguments", "parent_id"), ["turn", "name", "arguments"])
    results = _one(results.select("conv_id", "call_id", "turn", "content"), ["turn", "content"])
    answered = results.select("conv_id", "call_id", F.lit(True).alias("answered")).where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    made = calls.join(call_depths(calls).withColumn("walked", F.lit(True)), ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left")
    depth = F.when(F.col("walked"), F.col("depth")).otherwise(F.lit(0).cast("long"))
    made = made.select(*calls.columns, depth.alias("depth"), "answered", F.try_parse_json("arguments").alias("value"))
    status = F.when(F.col("depth").isNull(), "cyclic").when(F.col("answered"), "linked").otherwise("unanswered")
    made = made.select("conv_id", "call_id", F.lit("call").alias("kind"), "depth", "turn", "name", "value", "arguments", status.alias("status"))
    violations = _violations(F.col("name"), F.col("value"), schemas)
    arguments = F.coalesce(F.to_json("value"), F.col("arguments"))
    call_json = F.to_json(F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), F.lit("call").alias("kind"), "name"))
    call_rows = made.select("conv_id", "call_id", "kind", "depth", "turn", "status", violations.alias("violations"), call_json.alias("json"))
    of_call = made.select("conv_id", "call_id", F.col("depth").alias("call_depth"), F.col("status").alias("call_status")).where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    got = results.join(of_call, ["conv_id", "call_id"], "left")
    result_json = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("result").alias("kind")))
    depth = F.when(F.col("call_status").isNull(), F.lit(0).cast("long")).otherwise(F.col("call_depth"))
    none = F.array().cast("array<string>")
    result_rows = got.select("conv_id", "call_id", F.lit("result").alias("kind"), depth.alias("depth"), "turn", F.coalesce("call_status", F.lit("orphan")).alias("status"), none.alias("violations"), result_json.alias("json"))
    return _placed(call_rows.unionByName(result_rows))


def _placed(events: DataFrame) -> DataFrame:
    """events with position, their place in the order of their conversation."""
    events = written(events.withColumn("_row", F.monotonically_increasing_id()), "events")  # texts lie still while keys are ordered
    nameless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    keys = events.select(
        "_row", "conv_id", F.coalesce("depth", F.lit((1 << 63) - 1)).alias("level"), "kind", "turn", "call_id",
        F.when(nameless, F.md5("json")).alias("tie"), F.lit(1).cast("long").alias("one"),  # only rows without an identifier can tie
    )
    places = sums_before(keys, "position", "one", ["conv_id"], ["level", "kind", "turn", "call_id", "tie"])
    return events.join(places.select("_row", "position"), "_row").drop("_row")


def calls_and_results(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, turn, role, text) as calls and results.

    Each user turn is a call of 'reply' with its text, built on the user turn before it; the assistant's turn right after
    it is the result; an assistant's turn with no user turn before is an orphan."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    asked = rows.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("turn"), F.col("text")))
    calls = asked.select("conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), name(F.col("turn") - 2).alias("parent_id"))
    results = rows.where("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


REPLY_SCHEMA = {"reply": {"text": ("string", True), "turn": ("integer", True)}}
