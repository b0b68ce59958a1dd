"""Tool calls of chats: linked to their results, ordered after what they depend on, checked and serialised."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sextant.llm.common import batches_task, discard, partitions, written

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


#: Levels of a JSON value that are read; deeper ones are no JSON here.
DEPTH = 100


class NotJson(ValueError):
    """A text that is no JSON value which can be written again in canonical form."""


def _refused(name: str):
    raise NotJson(name)


def loads(text: str):
    """A JSON value: no NaN or infinity, no lone surrogates, not deeper than DEPTH; else NotJson."""
    try:
        value = json.loads(text, parse_constant=_refused)
    except (ValueError, RecursionError) as e:
        raise NotJson(str(e)) from None
    level = [value]
    for _ in range(DEPTH):
        level = [y for x in level if isinstance(x, dict | list) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            break
    else:
        raise NotJson("too deep")
    canonical(value)
    return value


def _is(value, kind: str) -> bool:
    """Whether a value is of a schema type; of a type that is unknown, none is."""
    if kind in ("number", "integer"):
        whole = isinstance(value, int) or kind == "number" or (isinstance(value, float) and value.is_integer())
        return isinstance(value, int | float) and not isinstance(value, bool) and whole
    return kind in _TYPES and isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value by a schema (type, enum, bounds, required, properties, additionalProperties, items)."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    found = []
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        found.append(f"{at}: not one of the values")
    if isinstance(value, str):
        found += [f"{at}: {what}" for what, bad in (("too short", len(value) < schema.get("minLength", 0)), ("too long", len(value) > schema.get("maxLength", math.inf))) if bad]
    if isinstance(value, int | float) and not isinstance(value, bool):
        found += [f"{at}: {what}" for what, bad in (("too small", value < schema.get("minimum", -math.inf)), ("too large", value > schema.get("maximum", math.inf))) if bad]
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        found += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    return found


def _number(value: int | float) -> str:
    """A number as RFC 8785 has it: the shortest digits of the double, with an exponent below 1e-6 and from 1e21."""
    try:
        x = float(value)
    except OverflowError:
        x = math.inf
    if not math.isfinite(x):
        raise NotJson("a number without a double")
    if x == 0:
        return "0"
    digits, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent or 0)  # digits before the decimal point
    digits = whole + part
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    if len(digits) <= point <= 21:
        out = digits + "0" * (point - len(digits))
    elif 0 < point <= 21:
        out = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        out = "0." + "0" * -point + digits
    else:
        out = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{point - 1:+d}"
    return "-" * (x < 0) + out


def canonical(value) -> str:
    """JSON as RFC 8785 has it: keys in the order of their UTF-16 units, no spaces, numbers as doubles, characters as they are."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, int | float) and not isinstance(value, bool):
        return _number(value)
    out = json.dumps(value, ensure_ascii=False)
    if not out.isascii() and any("\ud800" <= c <= "\udfff" for c in out):
        raise NotJson("half a surrogate pair")
    return out


def _text(value) -> str | None:
    """A JSON value as text: strings as they are, null as none, others in canonical form."""
    return value if isinstance(value, str | None) else canonical(value)


def _said(text: str | None) -> dict:
    """The object that a message holds as JSON; none for prose and for JSON that cannot be read."""
    try:
        said = loads(text) if text and text.lstrip()[:1] == "{" else None
    except NotJson:
        return {}
    return said if isinstance(said, dict) else {}


def _extracted(batches):
    fields = [("conv_id", pa.int64()), ("turn", pa.int64()), ("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("parent", pa.string()), ("is_result", pa.bool_()), ("content", pa.string())]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            rows = []
            for r in batch.slice(at, 1024).to_pylist():
                said = _said(r["text"])
                base = {"conv_id": r["conv_id"], "turn": r["turn"]}
                calls = said.get("tool_calls")
                for c in calls if isinstance(calls, list) else ():
                    if isinstance(c, dict) and c.get("id") is not None:
                        given = c.get("arguments")
                        rows.append(base | {"call_id": _text(c["id"]), "name": _text(c.get("name")), "arguments": given if isinstance(given, str) else canonical(given), "parent": _text(c.get("parent")), "is_result": False})
                if said.get("tool_call_id") is not None:
                    rows.append(base | {"call_id": _text(said["tool_call_id"]), "is_result": True, "content": _text(said.get("content"))})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that messages (conv_id, turn, text) hold as JSON: {"tool_calls": [...]} and {"tool_call_id": ..., "content": ...}.

    Null and empty texts, prose, and JSON that cannot be read (malformed, half surrogate pairs, numbers without a
    double, more than DEPTH levels) give none, and so do entries that are no objects or have no id. Ids, names, parents and contents that
    are no strings are their canonical JSON; null conv_ids and turns are kept; repeated rows are kept; texts of any
    length are read whole; other columns are left out, and an empty table gives empty ones.
    """
    schema = "conv_id long, turn long, call_id string, name string, arguments string, parent string, is_result boolean, content string"
    found = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("text").cast("string")).mapInArrow(batches_task(_extracted), schema)
    found = written(found, "messages")
    return found.where(~F.col("is_result")).drop("is_result", "content"), found.where("is_result").select("conv_id", "turn", "call_id", "content")


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): how many calls each comes after, by its parents; null if its parents run in a circle.

    Every round doubles how far up a call has looked, so a chain of n calls takes log2(n) rounds.
    """
    known = calls.select("conv_id", F.col("call_id").alias("up"), F.lit(True).alias("there"))
    state = calls.select("conv_id", "call_id", F.col("parent").alias("up")).join(known, ["conv_id", "up"], "left")
    up = F.when(F.col("there"), F.col("up"))  # a parent that isn't a call of this chat is none
    state = written(state.select("conv_id", "call_id", up.alias("up"), up.isNotNull().cast("long").alias("depth")), "depths")
    limit = max(1, state.count()).bit_length() + 1
    for _ in range(limit):
        if not state.where(F.col("up").isNotNull()).limit(1).count():
            break
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        before = state
        state = written(state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "depths")
        discard(before)
    return state.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def _positions(calls: DataFrame, order: list[str]) -> DataFrame:
    """Adds position, from 0 in each conversation by `order`, though a conversation may span many tasks."""
    spark = calls.sparkSession
    ranged = calls.repartitionByRange(partitions(spark), "conv_id", *order).withColumn("__part", F.spark_partition_id())
    ranged = written(ranged, "ordered")
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = F.row_number().over(Window.partitionBy("conv_id", "__part").orderBy(*order)) - 1
    return ranged.withColumn("__row", within).join(starts, ["conv_id", "__part"]).withColumn("position", (F.col("__start") + F.col("__row")).cast("long")).drop("__row", "__start", "__part")


def _checked(batches, schemas: str):
    known = json.loads(schemas)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            out: list = [[], [], []]
            for r in part.to_pylist():
                problems, given = [], None
                try:
                    given = loads(r["arguments"] if r["arguments"] is not None else "null")
                except NotJson:
                    problems = ["$: no JSON"]
                if not problems:
                    problems = violations(given, known[r["name"]]) if r["name"] in known else ["$: unknown tool"]
                record = {"id": r["call_id"], "name": r["name"], "arguments": given, "result": r["content"], "status": r["status"]}
                for o, v in zip(out, (not problems, "; ".join(problems), canonical(record)), strict=True):
                    o.append(v)
            keep = [n for n in part.schema.names if n not in ("arguments", "content")]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *(pa.array(o, t) for o, t in zip(out, (pa.bool_(), pa.string(), pa.string()), strict=True))], names=[*keep, "valid", "problems", "json"])


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """A row per call and per result without one: conv_id, call_id, name, status, depth, position, valid, problems, json.

    calls: conv_id, turn, call_id, name, arguments (JSON), parent (a call_id or null). results: conv_id,
    turn, call_id, content. Of calls or results with one id in a conversation the earliest counts
    (least turn, null turns last, then least content), so repeated rows count once; rows with null conv_id or call_id
    are left out, and other columns are. status: linked, pending (no result) or orphan (no call). position orders a
    conversation's calls after their parents (depth, turn, call_id); calls whose parents run in a
    circle have no depth and come last. Invalid JSON, unknown tools and schema violations are
    reported in problems; json is the canonical form of the call with its result.
    """
    has_ids = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = lambda df, columns: df.where(has_ids).groupBy("conv_id", "call_id").agg(F.min(F.struct(F.col("turn").isNull().alias("none"), "turn", *columns)).alias("x")).select("conv_id", "call_id", "x.*").drop("none")
    mine = written(first(calls, ["name", "arguments", "parent"]), "calls")
    theirs = first(results, ["content"]).select("conv_id", "call_id", F.col("turn").alias("r_turn"), "content", F.lit(True).alias("answered"))
    both = mine.withColumn("called", F.lit(True)).join(theirs.hint("shuffle_hash"), ["conv_id", "call_id"], "full")
    status = F.when(F.col("called").isNull(), "orphan").when(F.col("answered").isNull(), "pending").otherwise("linked")
    both = both.join(_depths(mine), ["conv_id", "call_id"], "left")
    last = F.lit(2**62)
    both = both.select("conv_id", "call_id", "name", "arguments", "content", status.alias("status"), "depth", F.coalesce("turn", "r_turn").alias("turn"), F.coalesce("depth", last).alias("__deep"))
    placed = _positions(both, ["__deep", "turn", "call_id"]).drop("__deep")
    schema = placed.drop("arguments", "content").schema.add("valid", "boolean").add("problems", "string").add("json", "string")
    return placed.mapInArrow(batches_task(_checked, json.dumps(schemas)), schema)


#: What a chat's turns are as calls: a user asks, and the turn after is the answer.
CHAT_TOOLS = {"reply": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def chat_messages(conversations: DataFrame) -> DataFrame:
    """Plain chats as messages with calls and results: each user turn calls `reply`, after the user turn two before it, and the next assistant turn answers.

    Turns that hold JSON objects themselves are messages too, as they are.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    call = F.struct(turn.cast("string").alias("id"), F.lit("reply").alias("name"), F.struct(text.alias("text"), turn.alias("turn")).alias("arguments"), (turn - 2).cast("string").alias("parent"))
    asked = F.to_json(F.struct(F.array(call).alias("tool_calls")))
    answered = F.to_json(F.struct((turn - 1).cast("string").alias("tool_call_id"), text.alias("content")))
    said = F.array(F.when(F.col("role") == "user", asked).when(F.col("role") == "assistant", answered), F.when(F.ltrim(text).startswith("{"), F.col("text")))
    return conversations.select("conv_id", "turn", F.explode(F.array_compact(said)).alias("text"))
