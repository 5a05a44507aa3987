"""Operator 7: chat formatting with tool calls, in DataFrame operations only.

A message of the assistant that is a JSON object {"tool_call": {"id", "name", "arguments"}} is a call; a message of the role tool that is
{"tool_call_id", "content"} is a result; all others are plain. Calls and results of a conversation are hash-joined by identifier. Arguments are
validated against the tool's schema. Messages are put in topological order: a result never stands before its call, else turns keep their
order. Each is serialised as canonical JSON: keys sorted, no spaces, arguments' keys sorted at every depth.

A conversation is never gathered: the order is a sort key of each row, calls and results meet by conversation and identifier, and plain messages
aren't shuffled at all, so that a conversation of any length spreads over tasks.

Cases: null texts and roles are plain messages with null content and role; JSON that can't be read, or is too long to be read, is plain; a call id that is used again links results to its
first turn and makes these calls invalid; results without a call are kept and invalid; calls without a result are kept, valid and not linked; a call without a turn has no place and is invalid; repeated rows are kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON types by the type names of variants.
TYPES = {"string": "^STRING$", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT.*$", "array": "^ARRAY.*$", "null": "^VOID$"}
#: The tool of as_tool_messages(), in the form of JSON schemas.
RESPOND = {"respond": {"properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}, "required": ["prompt", "turn"]}}


def fits_schema(arguments: Column, schema: dict) -> Column:
    """Whether a variant of arguments is an object that fits: type, minLength and minimum of its properties, required, and no others."""
    keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
    properties = schema.get("properties", {})
    tests = [F.coalesce(F.schema_of_variant(arguments).rlike(TYPES["object"]), F.lit(False))]
    if not schema.get("additionalProperties", False):
        tests.append(F.size(F.array_except(keys, F.array(*[F.lit(k) for k in properties]).cast("array<string>"))) == 0)
    tests += [F.array_contains(keys, k) for k in schema.get("required", [])]
    for name, p in properties.items():
        value, asked = F.try_variant_get(arguments, f"$.{name}", "variant"), []
        if "type" in p:
            asked.append(F.schema_of_variant(value).rlike(TYPES[p["type"]]))
        if "minLength" in p:
            asked.append(F.length(F.try_variant_get(arguments, f"$.{name}", "string")) >= p["minLength"])
        if "minimum" in p:
            asked.append(F.try_variant_get(arguments, f"$.{name}", "double") >= p["minimum"])
        for test in asked:
            tests.append(~F.array_contains(keys, name) | F.coalesce(test, F.lit(False)))
    out = F.lit(True)
    for test in tests:
        out = out & F.coalesce(test, F.lit(False))
    return out


def linked(messages: DataFrame, tools: dict) -> DataFrame:
    """(conv_id, turn, role, kind, call_id, linked, valid, order_turn, order_phase, json) for each row of messages (conv_id, turn, role, text).

    A conversation's order is (order_turn, order_phase, turn).
    """
    may_be = F.col("role").isin("assistant", "tool") & F.startswith(F.ltrim("text"), F.lit("{"))
    read = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.when(may_be, F.try_parse_json("text")).alias("v"))
    got = lambda path, kind="string": F.try_variant_get("v", path, kind)
    call = (F.col("role") == "assistant") & got("$.tool_call.id").isNotNull() & got("$.tool_call.name").isNotNull()
    result = (F.col("role") == "tool") & got("$.tool_call_id").isNotNull()
    read = read.withColumn("kind", F.when(call, "call").when(result, "result").otherwise("message"))
    read = read.withColumn("call_id", F.when(F.col("kind") == "call", got("$.tool_call.id")).when(F.col("kind") == "result", got("$.tool_call_id")))
    tools_only = read.where("kind <> 'message'")
    own_turn = F.when(F.col("kind") == "call", F.col("turn"))
    met = tools_only.groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.min(own_turn).alias("call_turn"), F.count(own_turn).alias("uses"), F.count(F.when(F.col("kind") == "result", 1)).alias("results"))
    joined = tools_only.join(met.hint("shuffle_hash"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")))
    nothing = [F.lit(None).cast("long").alias(c) for c in ("call_turn", "uses", "results")]
    joined = joined.drop("c", "i").unionByName(read.where("kind = 'message'").select("*", *nothing))
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    arguments = got("$.tool_call.arguments", "variant")
    name = got("$.tool_call.name")
    schema_ok = F.lit(False)
    for tool, schema in tools.items():
        schema_ok = F.when(name == tool, fits_schema(arguments, schema)).otherwise(schema_ok)
    valid = F.when(is_call, schema_ok & (F.col("uses") == 1)).when(is_result, F.col("call_turn").isNotNull()).otherwise(True)
    plain = {"ignoreNullFields": "false"}
    as_call = F.to_json(F.struct(F.lit("assistant").alias("role"), F.struct(arguments.alias("arguments"), F.col("call_id").alias("id"), name.alias("name")).alias("tool_call")), plain)
    as_result = F.to_json(F.struct(got("$.content").alias("content"), F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id")), plain)
    as_message = F.to_json(F.struct(F.col("text").alias("content"), "role"), plain)
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "kind",
        "call_id",
        F.when(is_result, F.col("call_turn").isNotNull()).when(is_call, F.col("results") > 0).otherwise(False).alias("linked"),
        valid.alias("valid"),
        F.when(is_result, F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        F.when(is_result, 1).otherwise(0).alias("order_phase"),
        F.when(is_call, as_call).when(is_result, as_result).otherwise(as_message).alias("json"),
    )


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """Conversations without tools as calls and results: a user's turn calls ``respond``, and the assistant's next turn is its result."""
    call_id = F.concat(F.lit("call-"), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit("-"), (F.col("turn") - F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("string"))
    plain = {"ignoreNullFields": "false"}
    call = F.to_json(F.struct(F.struct(call_id.alias("id"), F.lit("respond").alias("name"), F.struct(F.col("turn"), F.col("text").alias("prompt")).alias("arguments")).alias("tool_call")), plain)
    result = F.to_json(F.struct(call_id.alias("tool_call_id"), F.col("text").alias("content")), plain)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(F.col("role") == "user", "assistant").when(F.col("role") == "assistant", "tool").otherwise(F.col("role")).alias("role"),
        F.when(F.col("role") == "user", call).when(F.col("role") == "assistant", result).otherwise(F.col("text")).alias("text"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations."""
    return linked(as_tool_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), RESPOND)


OP7_SQL = """
WITH m AS (
  SELECT conv_id, turn, text,
         CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE WHEN role IN ('user', 'assistant')
              THEN 'call-' || coalesce(CAST(conv_id AS VARCHAR), 'null') || '-' || CAST(turn - CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS VARCHAR) END AS call_id
  FROM conversations),
calls AS (
  SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS call_turn, count(turn) FILTER (kind = 'call') AS uses, count(*) FILTER (kind = 'result') AS results
  FROM m WHERE kind <> 'message' GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, m.kind, m.call_id,
       CASE kind WHEN 'result' THEN call_turn IS NOT NULL WHEN 'call' THEN results > 0 ELSE false END AS linked,
       CASE kind WHEN 'call' THEN coalesce(length(text) >= 1 AND turn >= 0, false) AND uses = 1 WHEN 'result' THEN call_turn IS NOT NULL ELSE true END AS valid,
       CASE kind WHEN 'result' THEN greatest(turn, call_turn) ELSE turn END AS order_turn,
       CASE kind WHEN 'result' THEN 1 ELSE 0 END AS order_phase,
       CAST(CASE kind
         WHEN 'call' THEN json_object('role', 'assistant', 'tool_call', json_object('arguments', json_object('prompt', text, 'turn', turn), 'id', m.call_id, 'name', 'respond'))
         WHEN 'result' THEN json_object('content', text, 'role', 'tool', 'tool_call_id', m.call_id)
         ELSE json_object('content', text, 'role', m.role) END AS VARCHAR) AS json
FROM m LEFT JOIN calls ON m.conv_id IS NOT DISTINCT FROM calls.conv_id AND m.call_id = calls.call_id
"""
