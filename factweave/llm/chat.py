"""Chat formatting with linked tool calls.

A message of role ``assistant`` whose text is a JSON object with ``tool_calls`` makes calls, each with id,
name, arguments and, if it needs other calls first, ``depends_on``. A message of role ``tool`` whose text
is a JSON object with ``tool_call_id`` is a result. Results meet their calls by a hash join on conversation
and id; calls are levelled by their dependencies; arguments are checked against the schema of their name;
every message becomes canonical JSON (keys in order, no blanks, characters as they are).

The order of a conversation is (anchor_turn, level, call_index, turn): a result comes right after the
message that made its call, after the results its call depends on. It is given as columns, so that no
task has to hold or sort a whole conversation.

Defined results: of calls that share an id in a conversation the first (turn, then place) counts, the others
are status ``repeated_call``; of results for one call the first turn is ``linked``, later ones are
``repeated``; a result without a call is ``orphan`` and stays at its turn; a message with a call without
a result is ``unanswered``; one with arguments that fail is ``invalid``, with the reasons in ``errors``;
calls in a circle, or that depend on an unknown id, get level -1 and status ``unordered``; text that isn't
such an object is an ordinary message; a null text stays null in the JSON; a null role is null; a null
conversation is one of its own; equal rows give equal rows; an empty table gives an empty result; extra
columns are ignored, whatever their names. Texts are handled whole, one row at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from contextlib import suppress
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups, small_batches, written

#: Argument schemas by tool name; a tool that isn't here takes any object.
SCHEMAS: Mapping[str, Mapping[str, Any]] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def whole(text: str) -> str:
    """``text`` with halves of surrogate pairs, which UTF-8 cannot hold, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: Any) -> str:
    return whole(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def loads(text: str) -> Any:
    """A JSON value; ValueError for what isn't one, NaN and Infinity included, or is nested too deeply."""

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        return json.loads(text, parse_constant=refuse)
    except RecursionError as e:
        raise ValueError("too deep") from e


def is_kind(value: Any, kind: str) -> bool:
    """Whether a value is of a JSON schema's type; an unknown type holds for everything."""
    if kind in ("number", "integer"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        return number and (kind == "number" or isinstance(value, int) or value.is_integer())
    return isinstance(value, _KINDS.get(kind, object))


def failures(value: Any, schema: Mapping[str, Any], at: str = "") -> list[str]:
    """What in ``value`` doesn't follow the schema: type (one or a list), enum, required, properties, additionalProperties, items."""
    kinds = schema.get("type")
    if kinds is not None and not any(is_kind(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at or '/'}: not {kinds if isinstance(kinds, str) else ' or '.join(kinds)}"]
    same = lambda x: isinstance(x, bool) == isinstance(value, bool) and x == value
    out = [] if "enum" not in schema or any(map(same, schema["enum"])) else [f"{at or '/'}: not in enum"]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                out += failures(v, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}/{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        out += [e for k, v in enumerate(value) for e in failures(v, schema["items"], f"{at}/{k}")]
    return out


_CALL = pa.struct([("id", pa.string()), ("index", pa.int32()), ("needs", pa.list_(pa.string()))])
_PARSED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("calls", pa.list_(_CALL)), ("errors", pa.list_(pa.string())), ("result_of", pa.string()), ("json", pa.string())])
_PARSED_DDL = "conv_id bigint, turn bigint, role string, calls array<struct<id:string,index:int,needs:array<string>>>, errors array<string>, result_of string, json string"


def parse(role: str | None, text: str, schemas: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """What a message that may hold a call or a result says."""
    plain = {"calls": None, "errors": None, "result_of": None, "json": canonical({"role": role, "content": text})}
    try:
        return plain | spoken_of(role, loads(text), schemas)
    except (ValueError, RecursionError):
        return plain


def spoken_of(role: str | None, said: Any, schemas: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """The result or the calls in a JSON value; nothing if it is no such object."""
    if not isinstance(said, dict):
        return {}
    if role == "tool" and isinstance(said.get("tool_call_id"), str):
        return {"result_of": whole(said["tool_call_id"]), "json": canonical({"role": role, "tool_call_id": said["tool_call_id"], "content": said.get("content")})}
    calls = said.get("tool_calls")
    if role != "assistant" or not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("id"), str) and isinstance(c.get("name"), str) for c in calls):
        return {}
    errors, made, links = [], [], []
    for k, c in enumerate(calls):
        arguments = c.get("arguments", {})
        if isinstance(arguments, str):
            with suppress(ValueError):
                arguments = loads(arguments)
        errors += [whole(f"{c['id']}: {e}") for e in failures(arguments, schemas.get(c["name"], {"type": "object"}))]
        made.append({"id": c["id"], "name": c["name"], "arguments": arguments})
        needs = c.get("depends_on")
        links.append({"id": whole(c["id"]), "index": k, "needs": sorted({whole(n) for n in needs if isinstance(n, str)}) if isinstance(needs, list) else []})
    return {"calls": links, "errors": errors, "json": canonical({"role": role, "content": said.get("content"), "tool_calls": made})}


#: Calls of a conversation that a task levels by itself; longer ones are levelled in rounds over all tasks.
HELD = 20_000
_LEVELS = pa.schema([("conv", pa.string()), ("id", pa.string()), ("level", pa.int32())])


def ordered(needs: Mapping[str, Sequence[str]]) -> dict[str, int]:
    """Levels of the calls of one conversation: 1 without needs, else one more than the highest of them, -1 if that cannot be told."""
    level = {i: 1 for i, n in needs.items() if not n}
    missing = {i: len(n) for i, n in needs.items() if n}
    waiting: dict[str, list[str]] = {}
    for i, n in needs.items():
        for x in n:
            waiting.setdefault(x, []).append(i)
    ready = list(level)
    for x in ready:  # grows while it is walked
        for i in waiting.get(x, ()):
            missing[i] -= 1
            if not missing[i]:
                level[i] = 1 + max(level[y] for y in needs[i])
                ready.append(i)
    return {i: level.get(i, -1) for i in needs}


def levels(calls: DataFrame, held: int = HELD) -> DataFrame:
    """``conv, id, level`` of the calls ``conv, id, needs``: by topological order, one pass over each conversation."""
    sized = written(calls.join(calls.groupBy("conv").agg(F.count("*").alias("n")), "conv"), "calls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv,), rows in groups(batches, ["conv"]):
            found = ordered(dict(zip(rows.column("id").to_pylist(), rows.column("needs").to_pylist(), strict=True)))
            yield pa.RecordBatch.from_pydict({"conv": [conv] * len(found), "id": list(found), "level": list(found.values())}, _LEVELS)

    short = sized.where(F.col("n") <= held).repartition("conv").sortWithinPartitions("conv", "id").mapInArrow(run, "conv string, id string, level int")
    long = sized.where(F.col("n") > held).drop("n")
    return short if long.isEmpty() else short.unionByName(rounds(long))


def rounds(calls: DataFrame) -> DataFrame:
    """``levels`` by as many rounds as the longest chain of dependencies: for conversations that no task should hold."""
    done = written(calls.where(F.size("needs") == 0).select("conv", "id", F.lit(1).alias("level")), "levels")
    left = written(calls.where(F.size("needs") > 0), "levels")
    level = 1
    while not left.isEmpty():
        level += 1
        wanted = left.select("conv", F.col("id").alias("caller"), F.explode("needs").alias("id"))
        met = wanted.join(done.select("conv", "id"), ["conv", "id"]).groupBy("conv", F.col("caller").alias("id")).agg(F.count("*").alias("n"))
        ready = written(left.join(met, ["conv", "id"]).where(F.col("n") == F.size("needs")).select("conv", "id"), "levels")
        if ready.isEmpty():
            break
        done = done.unionByName(ready.withColumn("level", F.lit(level)))
        left = written(left.join(ready, ["conv", "id"], "left_anti"), "levels")
    return done.unionByName(left.select("conv", "id", F.lit(-1).alias("level")))


def format_chats(messages: DataFrame, schemas: Mapping[str, Mapping[str, Any]] = SCHEMAS) -> DataFrame:
    """conv_id, turn, role, anchor_turn, level, call_index, status, errors, json per message."""
    rows = small_batches(messages).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    maybe = F.coalesce(F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^[ \t\r\n]*\{"), F.lit(False))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"conv_id": r["conv_id"], "turn": r["turn"], "role": r["role"]} | parse(r["role"], r["text"], schemas) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(out, _PARSED)

    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    none = lambda kind: F.lit(None).cast(kind)
    ordinary = rows.where(~maybe).select(
        "conv_id", "turn", "role", F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"), F.lit(0).alias("call_index"), F.lit("message").alias("status"), none("array<string>").alias("errors"), plain.alias("json"),
    )
    spoken = written(rows.where(maybe).mapInArrow(said, _PARSED_DDL), "spoken").withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    every = spoken.where(F.size("calls") > 0).select("conv", "turn", F.inline("calls"))
    calls = every.groupBy("conv", "id").agg(F.min(F.struct("turn", "index", "needs")).alias("x")).select("conv", "id", F.col("x.turn").alias("call_turn"), F.col("x.index").alias("call_index"), F.col("x.needs").alias("needs"))
    calls = calls.join(levels(calls.select("conv", "id", "needs")), ["conv", "id"])
    firsts = spoken.where("result_of IS NOT NULL").groupBy("conv", F.col("result_of").alias("id")).agg(F.min("turn").alias("first_turn"))
    linked = written(calls.join(firsts, ["conv", "id"], "left"), "calls")
    at = linked.select(F.col("conv").alias("c"), F.col("id").alias("i"), "call_turn", "call_index", "level", "first_turn")
    results = (
        spoken.where("result_of IS NOT NULL").join(at, (F.col("conv") == F.col("c")) & (F.col("result_of") == F.col("i")), "left")
        .select(
            "conv_id", "turn", "role", F.coalesce("call_turn", "turn").alias("anchor_turn"), F.coalesce("level", F.lit(0)).alias("level"), F.coalesce("call_index", F.lit(0)).alias("call_index"),
            F.when(F.col("i").isNull(), "orphan").when(F.col("turn") > F.col("first_turn"), "repeated").otherwise("linked").alias("status"), none("array<string>").alias("errors"), "json",
        )
    )
    own = every.join(at, (F.col("conv") == F.col("c")) & (F.col("id") == F.col("i"))).groupBy("conv", "turn").agg(
        F.max(F.when(F.col("turn") > F.col("call_turn"), 1).otherwise(0)).alias("again"), F.max(F.when(F.col("first_turn").isNull(), 1).otherwise(0)).alias("open"), F.min("level").alias("low"),
    )
    status: Column = F.when(F.size("errors") > 0, "invalid").when(F.col("again") == 1, "repeated_call").when(F.col("low") < 0, "unordered").when(F.col("open") == 1, "unanswered").otherwise("linked")
    callers = spoken.where(F.size("calls") > 0).join(own, ["conv", "turn"], "left").select(
        "conv_id", "turn", "role", F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"), F.lit(0).alias("call_index"), status.alias("status"), "errors", "json",
    )
    others = spoken.where("calls IS NULL AND result_of IS NULL").select(
        "conv_id", "turn", "role", F.col("turn").alias("anchor_turn"), F.lit(0).alias("level"), F.lit(0).alias("call_index"), F.lit("message").alias("status"), none("array<string>").alias("errors"), "json",
    )
    return ordinary.unionByName(others).unionByName(callers).unionByName(results)
