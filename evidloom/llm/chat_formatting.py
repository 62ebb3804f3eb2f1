"""Chat formatting: tool calls and results linked, ordered, checked and written as canonical JSON.

Messages are turns of conversations: text, or JSON of one of two forms. An assistant's
  {"content": ..., "tool_calls": [{"id": ..., "name": ..., "arguments": {...}, "after": [ids]}]}
makes calls, a tool's
  {"tool_call_id": ..., "content": ...}
is a result. Calls and results are joined by conversation and identifier. A call comes after the calls it names in
`after` and after those whose result its arguments refer to as "$id"; its level is the longest chain of such calls before it.
Levels are found by joins, round by round (as many jobs as the longest chain of calls, whatever the number of
conversations), so no conversation is ever gathered in one task: the result is a row for each message, call and result,
and (conv_id, turn, level, position) is its order.

Status of a call: unknown_tool, bad_arguments, cyclic, no_result or linked, the first that holds; of a
result: orphan (no such call before it), repeated (not the first for its call) or linked; of a message: text.

Canonical JSON: keys sorted by code point, no white space, no escapes but those JSON demands, numbers as they parse,
whole numbers of any length included; half a surrogate pair, which UTF-8 can't hold, stays an escape.

Defined results: a null text is empty; a null role is "user"; a turn whose JSON is neither form, too deep or with numbers
beyond what Python parses is text; identifiers with half a surrogate pair are compared in their escaped form; repeated
rows of one conversation and turn each get their rows; of calls with one id in a conversation the
first (turn, position) is linked to; null conversations or turns are kept, their calls linked among themselves, null
turns before all others, negative ones too; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidloom.llm.common import read, stored

#: Tools and the schemas of their arguments: name -> {argument: (JSON type, required)}.
SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "fetch": {"url": ("string", True)},
    "calculate": {"expression": ("string", True)},
    "lookup": {"key": ("string", True), "default": ("any", False)},
}
ITEM = "kind string, position bigint, call_id string, tool string, valid string, after array<string>, json string"


def writable(text: str) -> str:
    """Half surrogate pairs as JSON escapes: what is left is UTF-8."""
    import re

    return text if text.isascii() else re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    import json

    return writable(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False))


def fits(value, kind: str) -> bool:
    """Whether a JSON value is of a JSON type; true and false are no numbers."""
    if kind == "any":
        return True
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "string": isinstance(value, str),
        "integer": number and (isinstance(value, int) or value.is_integer()),
        "number": number,
        "boolean": isinstance(value, bool),
        "object": isinstance(value, dict),
        "array": isinstance(value, list),
        "null": value is None,
    }.get(kind, False)


def checked(name, arguments, schemas: dict) -> str:
    """'ok', 'unknown_tool' or 'bad_arguments'."""
    if not isinstance(name, str) or name not in schemas:
        return "unknown_tool"
    if not isinstance(arguments, dict):
        return "bad_arguments"
    schema = schemas[name]
    known = all(k in schema and fits(v, schema[k][0]) for k, v in arguments.items())
    return "ok" if known and all(k in arguments for k, (_, needed) in schema.items() if needed) else "bad_arguments"


def references(value) -> list[str]:
    """Identifiers named as "$id" anywhere in arguments; no recursion, so depth doesn't matter."""
    out, rest = [], [value]
    while rest:
        v = rest.pop()
        if isinstance(v, str) and len(v) > 1 and v[0] == "$":
            out.append(v[1:])
        elif isinstance(v, dict):
            rest += v.values()
        elif isinstance(v, list):
            rest += v
    return out


def items_of(role: str, text: str, schemas: dict) -> list[tuple]:
    """A turn's items (kind, position, call_id, tool, valid, after, json)."""
    import json

    def plain():
        return [("message", 0, None, None, None, [], canonical({"content": text, "role": role}))]

    if role not in ("assistant", "tool") or not text.lstrip().startswith("{"):
        return plain()
    try:
        got = json.loads(text, parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
        if role == "tool" and isinstance(got.get("tool_call_id"), str):
            return [("result", 0, writable(got["tool_call_id"]), None, None, [], canonical({"content": got.get("content"), "role": role, "tool_call_id": got["tool_call_id"]}))]
        calls = got.get("tool_calls")
        if role == "assistant" and isinstance(calls, list) and calls and all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            out = [("message", 0, None, None, None, [], canonical({"content": got["content"], "role": role}))] if got.get("content") is not None else []
            for i, c in enumerate(calls):
                arguments, name = c.get("arguments"), c.get("name")
                if isinstance(arguments, str):
                    try:
                        arguments = json.loads(arguments)
                    except ValueError:
                        pass
                named = c.get("after") if isinstance(c.get("after"), list) else []
                after = sorted({writable(x) for x in [*named, *references(arguments)] if isinstance(x, str)})
                body = canonical({"role": role, "tool_call": {"arguments": arguments, "id": c["id"], "name": name}})
                out.append(("call", i + 1, writable(c["id"]), writable(name) if isinstance(name, str) else None, checked(name, arguments, schemas), after, body))
            return out
    except (ValueError, RecursionError):
        pass
    return plain()


def items(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, turn and the columns of ITEM, a row for each item."""
    from pyspark.sql.types import StructType

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    fields = [f.name for f in StructType.fromDDL(ITEM)]

    def parse(batches):
        import pyarrow as pa

        kinds = dict(zip(fields, [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()], strict=True))
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                out = [(c, t, *x) for c, t, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True) for x in items_of(role, text, schemas)]
                columns = [pa.array([r[i] for r in out], k) for i, k in enumerate([pa.int64(), pa.int64(), *kinds.values()])]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", *kinds])

    return own.mapInArrow(parse, f"conv_id bigint, turn bigint, {ITEM}")


def levels(calls: DataFrame) -> DataFrame:
    """First calls (c, id, after) -> (c, id, level), level -1 where a call waits for itself or for one that does.

    A round drops the waits for calls that wait for nothing any more; a call's level is the number of rounds that it is
    seen to wait. Rounds end when no wait is left or none goes. Calls that no one has made aren't waited for.
    """
    made = calls.select(F.col("c").alias("mc"), F.col("id").alias("m_id"))
    waits = stored(calls.select("c", "id", F.explode("after").alias("need")).join(made, F.col("c").eqNullSafe(F.col("mc")) & (F.col("need") == F.col("m_id")), "left_semi"), "waits")
    callers = lambda d: d.select("c", "id").distinct()
    seen, n = [], waits.count()
    while n:
        seen.append(callers(waits))
        still = seen[-1].select(F.col("c").alias("wc"), F.col("id").alias("w_id"))
        waits = stored(waits.join(still, F.col("c").eqNullSafe(F.col("wc")) & (F.col("need") == F.col("w_id")), "left_semi"), "waits")
        if (left := waits.count()) == n:
            seen[-1] = seen[-1].withColumn("cyclic", F.lit(True))
            break
        n = left
    rounds = calls.select("c", "id", F.lit(0).alias("k"), F.lit(False).alias("cyclic"))
    for waiting in seen:
        rounds = rounds.unionByName((waiting if "cyclic" in waiting.columns else waiting.withColumn("cyclic", F.lit(False))).withColumn("k", F.lit(1)))
    level = F.when(F.bool_or("cyclic"), F.lit(-1)).otherwise(F.sum("k")).cast("long")
    return rounds.groupBy("c", "id").agg(level.alias("level"))


def formatted(turns: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """conversations -> conv_id, turn, level, position, kind, call_id, status, json."""
    all_items = stored(items(turns, schemas), "chat-items")
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0).cast("long")).alias("turn"), "position")
    calls = all_items.where("kind = 'call'").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("id")).agg(F.min(F.struct(at.alias("at"), "after")).alias("f")).select("c", "id", F.col("f.at").alias("called"), F.col("f.after").alias("after"))
    results = all_items.where("kind = 'result'").groupBy(F.col("conv_id").alias("c2"), F.col("call_id").alias("id2")).agg(F.min(at).alias("answered"), F.max(at).alias("last"))
    placed = levels(stored(calls, "calls")).select(F.col("c").alias("c3"), F.col("id").alias("id3"), "level")
    linked = calls.join(placed, F.col("c").eqNullSafe(F.col("c3")) & (F.col("id") == F.col("id3")))
    linked = linked.join(results, F.col("c").eqNullSafe(F.col("c2")) & (F.col("id") == F.col("id2")), "full")
    linked = linked.select(F.coalesce("c", "c2").alias("lc"), F.coalesce("id", "id2").alias("l_id"), "called", "answered", "last", "level")
    plain = all_items.where("kind = 'message'").select("conv_id", "turn", F.lit(0).cast("long").alias("level"), "position", "kind", "call_id", F.lit("text").alias("status"), "json")
    rest = all_items.where("kind <> 'message'").join(linked, F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("call_id") == F.col("l_id")))
    of_call = (
        F.when(F.col("valid") != "ok", F.col("valid")).when(F.col("level") < 0, "cyclic").when(F.col("last").isNull() | ~(F.col("last") > F.col("called")) | (at != F.col("called")), "no_result").otherwise("linked")
    )
    of_result = F.when(F.col("called").isNull() | ~(F.col("called") < at), "orphan").when(at != F.col("answered"), "repeated").otherwise("linked")
    status = F.when(F.col("kind") == "call", of_call).otherwise(of_result)
    tools = rest.select("conv_id", "turn", F.coalesce("level", F.lit(0).cast("long")).alias("level"), "position", "kind", "call_id", status.alias("status"), "json")
    return plain.unionByName(tools)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatted(read(spark, sf_dir, "conversations"))


QUERIES = {"op8_chat_formatting": op8_chat_formatting}
ORACLES: dict[str, str] = {}
