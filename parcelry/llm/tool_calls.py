"""Tool calls linked to their results, ordered, validated and written as canonical JSON.

Calls and results meet in one hash join by conversation and identifier; chats reuse identifiers, so neither alone
will do. A call may name earlier calls whose results it needs (``after``). Its depth, its place in topological order, is
the longest way to a call that needs none. Calls that need one other are most: chains of them are shortened by pointer
doubling, every round each looks twice as far up, so a chain of any length takes the logarithm of it in joins. Calls
that need several are settled in rounds, each joining only those still open with what the last round settled. No
conversation is ever gathered in one task. Arguments are checked against their tool's schema and each linked call
becomes one canonical JSON message: keys sorted, no spaces, no escapes that JSON does not need.

Results by case: a call without a result is ``pending``; a result without a call is a row of its own,
``orphan``, with no depth; of several results of one call the first by turn and content is linked and their
number given; an ``after`` that is null or names no call of the conversation asks for nothing; a call on a cycle, or behind
one, has no depth and is ``cyclic``; calls that share an identifier are separate rows, each with the shared result,
and need what any of them needs; null identifiers link with nothing, and a null conversation is one of its own; arguments
that are not a JSON object, hold a number that is not finite or text that is not Unicode, or a tool without a
schema, are invalid, with the reason in ``errors`` and the arguments as they came; other turns (``messages``) are rows
of their own; empty tables give no rows; texts of any length are written whole; extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.llm.common import stage

Schema = dict[str, Any]
KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_errors(value: Any, schema: Schema, at: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, const, bounds, lengths, properties, required, items."""
    errors = []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        boolean = isinstance(value, bool)
        if not any(isinstance(value, KINDS[k]) and (k == "boolean" or not boolean) for k in kinds):
            return [f"{at}: not of type {'|'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not among its values")
    if "const" in schema and value != schema["const"]:
        errors.append(f"{at}: not its value")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        errors += [f"{at}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        errors += [f"{at}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        errors += [f"{at}: shorter than {schema[low]}"] if len(value) < schema.get(low, 0) else []
        errors += [f"{at}: longer than {schema[high]}"] if len(value) > schema.get(high, len(value)) else []
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            errors += schema_errors(item, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, item in sorted(value.items()):
            if k in known:
                errors += schema_errors(item, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                errors.append(f"{at}.{k}: unknown")
    return errors


def parsed_arguments(text: str | None) -> Any:
    def refuse(name: str) -> None:
        raise ValueError(name)

    return json.loads(text or "", parse_constant=refuse)


def _key(conv: str = "conv_id", call: str = "call_id") -> Column:
    """Conversation and identifier as one text; null without an identifier."""
    name = F.col(conv).cast("string")
    return F.concat(F.coalesce(F.concat(F.octet_length(name).cast("string"), F.lit(":"), name), F.lit("-")), F.lit("/"), F.col(call))


def anchors(single: DataFrame, others: DataFrame) -> DataFrame:
    """(key, anchor, steps): of the calls in ``single`` (key, up), which need one other, the nearest call above that is in
    ``others`` (key), and how far it is; none for calls on or behind a cycle. ``others`` are their own."""
    rows = single.join(others.select(F.col("key").alias("up"), F.lit(True).alias("there")), "up", "left")
    state = stage(rows.select("key", "up", F.lit(1).cast("long").alias("steps"), F.coalesce("there", F.lit(False)).alias("there")), "call-chains")
    moving, longest, reach = state.where("NOT there").count(), state.count(), 1
    while moving and reach < 2 * longest:
        target = state.select(F.col("key").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_more"), F.col("there").alias("_there"))
        # Only the calls still moving, joined with those they point to.
        moved = state.where("NOT there").join(target, "up").select("key", F.col("_up").alias("up"), (F.col("steps") + F.col("_more")).alias("steps"), F.col("_there").alias("there"))
        state = stage(state.where("there").unionByName(moved), "call-chains")
        moving, reach = state.where("NOT there").count(), reach * 2
    own = others.select("key", F.col("key").alias("anchor"), F.lit(0).cast("long").alias("steps"))
    return stage(state.where("there").select("key", F.col("up").alias("anchor"), "steps").unionByName(own), "call-anchors")


def depths(calls: DataFrame) -> DataFrame:
    """(key, depth) of every different call (key, after: the keys it needs) that is neither on nor behind a cycle."""
    known = stage(calls.select("key").distinct(), "call-keys")
    asked = calls.select("key", F.explode("after").alias("up")).distinct()
    edges = stage(asked.join(known.select(F.col("key").alias("up")), "up", "left_semi").select("key", "up"), "call-needs")
    several = stage(edges.groupBy("key").agg(F.count("*").alias("n"), F.min("up").alias("up")), "call-counts")
    roots = known.join(several, "key", "left_anti")
    joints = several.where("n > 1").select("key")
    held = anchors(several.where("n = 1").select("key", "up"), roots.unionByName(joints))
    settled_ = stage(roots.withColumn("depth", F.lit(0).cast("long")), "call-depths")
    fresh = settled_
    if not joints.isEmpty():
        ways = edges.join(joints, "key", "left_semi").join(held.select(F.col("key").alias("up"), "anchor", "steps"), "up", "left")
        still = stage(ways.select("key", "anchor", (F.col("steps") + 1).alias("steps"), F.lit(None).cast("long").alias("far")), "call-open")
        while not fresh.isEmpty():
            told = still.where("far IS NULL AND anchor IS NOT NULL").join(fresh.select(F.col("key").alias("anchor"), "depth"), "anchor", "left")
            told = told.select("key", "anchor", "steps", (F.col("steps") + F.col("depth")).alias("far"))
            still = stage(still.where("far IS NOT NULL OR anchor IS NULL").unionByName(told), "call-open")
            done = still.groupBy("key").agg(F.max("far").alias("depth"), F.count_if(F.col("far").isNull()).alias("open")).where("open = 0")
            fresh = stage(done.select("key", "depth"), "call-fresh")
            settled_ = stage(settled_.unionByName(fresh), "call-depths")
            still = still.join(fresh.select("key"), "key", "left_anti")
    above = settled_.select(F.col("key").alias("anchor"), F.col("depth").alias("above"))
    return held.join(above, "anchor").select("key", (F.col("above") + F.col("steps")).alias("depth"))


def linked(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema], messages: DataFrame | None = None) -> DataFrame:
    """One row for each call, for each result without one, and for each of ``messages``.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON text), after (a call_id, or an array of them).
    ``results``: conv_id, turn, call_id, content. ``messages``: conv_id, turn, role, content. Returns conv_id, turn,
    call_id, tool, depth, status (linked, pending, cyclic, orphan, message), n_results, valid, errors, message. In the order
    of (depth, turn, call_id) every call follows what it needs.
    """
    after = F.col("after") if dict(calls.dtypes)["after"].startswith("array") else F.array("after")
    rows = calls.select("conv_id", "turn", "call_id", "tool", "arguments", after.alias("after"), _key().alias("key"))
    rows = stage(rows.withColumn("after", F.transform("after", lambda x: F.concat(F.substring_index("key", "/", 1), F.lit("/"), x))), "calls")
    named, nameless = rows.where("key IS NOT NULL"), rows.where("key IS NULL")
    given = stage(results.select("conv_id", "turn", "call_id", "content", _key().alias("key")), "call-results")
    first = given.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    placed = depths(named.select("key", "after"))
    found = named.join(first, "key", "left").join(placed, "key", "left")
    none = nameless.withColumns({"first": F.lit(None).cast(first.schema["first"].dataType), "n_results": F.lit(None).cast("long"), "depth": F.lit(0).cast("long")})
    status = F.when(F.col("depth").isNull(), "cyclic").when(F.col("first").isNull(), "pending").otherwise("linked")
    done = found.unionByName(none).select(
        "conv_id", "turn", "call_id", "tool", "arguments", "depth", status.alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), F.col("first.content").alias("content"), F.lit("tool").alias("role"),
    )
    empty = lambda kind: F.lit(None).cast(kind)
    lost = given.where("key IS NOT NULL").join(named.select("key").distinct(), "key", "left_anti").unionByName(given.where("key IS NULL").select("key", "conv_id", "turn", "call_id", "content"))
    done = done.unionByName(lost.select(
        "conv_id", "turn", "call_id", empty("string").alias("tool"), empty("string").alias("arguments"), empty("long").alias("depth"),
        F.lit("orphan").alias("status"), F.lit(1).cast("long").alias("n_results"), "content", F.lit("tool").alias("role"),
    ))
    if messages is not None:
        done = done.unionByName(messages.select(
            "conv_id", "turn", empty("string").alias("call_id"), empty("string").alias("tool"), empty("string").alias("arguments"), empty("long").alias("depth"),
            F.lit("message").alias("status"), F.lit(0).cast("long").alias("n_results"), "content", "role",
        ))
    return written(done, schemas)


def written(rows: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """Validates arguments and serialises each row's message."""
    kept = ["conv_id", "turn", "call_id", "tool", "depth", "status", "n_results"]

    def message(row: dict[str, Any]) -> tuple[bool | None, str, str]:
        result = {"content": row["content"], "role": "tool", "tool_call_id": row["call_id"]}
        if row["status"] == "orphan":
            return None, "", canonical([result])
        if row["status"] == "message":
            return None, "", canonical([{"content": row["content"], "role": row["role"]}])
        reason = "$: not a JSON object"
        try:
            arguments = parsed_arguments(row["arguments"])
            if not isinstance(arguments, dict):
                raise ValueError
            reason = "$: holds a number that is not finite or text that is not Unicode"
            canonical(arguments).encode()
            errors = schema_errors(arguments, schemas[row["tool"]]) if row["tool"] in schemas else [f"no schema for {row['tool']}"]
        except (ValueError, RecursionError):
            arguments, errors = row["arguments"], [reason]
        call = {"role": "assistant", "tool_calls": [{"function": {"arguments": arguments, "name": row["tool"]}, "id": row["call_id"], "type": "function"}]}
        return not errors, "; ".join(errors), canonical([call, result] if row["status"] == "linked" or row["n_results"] else [call])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = zip(*map(message, batch.to_pylist()), strict=True)
                arrays = [pa.array(c, k) for c, k in zip(made, (pa.bool_(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, "valid", "errors", "message"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in kept) + ", valid boolean, errors string, message string"
    return rows.mapInArrow(run, schema)


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and other messages from plain turns: a user's turn calls the assistant, whose next turn is the
    result; a call needs the one two turns before it. Identifiers are counted within a conversation, as chats do."""
    name = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    calls = conversations.where("role = 'user'").select(
        "conv_id", turn.alias("turn"), name(turn).alias("call_id"), F.lit("answer").alias("tool"),
        F.to_json(F.struct(F.col("text").alias("question"), turn.alias("turn")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array(F.when(turn >= 2, name(turn - 2))).alias("after"),
    )
    results = conversations.where("role = 'assistant'").select("conv_id", turn.alias("turn"), name(turn - 1).alias("call_id"), F.col("text").alias("content"))
    others = conversations.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", turn.alias("turn"), "role", F.col("text").alias("content"))
    return calls, results, others


#: The schema of the calls that ``turns_as_calls`` makes.
ANSWER_SCHEMA: Schema = {
    "type": "object",
    "properties": {"question": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "required": ["question", "turn"],
    "additionalProperties": False,
}
