"""Chat formatting with linked tool calls, in DataFrame operations only.

An assistant message may carry calls, ``{"tool_calls": [{"id", "name", "arguments"}, ...]}``, and a tool message a result,
``{"tool_call_id", "content"}``. Results are hash-joined to calls by conversation and identifier; of calls that repeat an
identifier the first counts, so the join never multiplies rows and a hot key can be split. A message's place in a
topological order needs no walk: a result comes at the later of its own turn and its call's, after all calls of that
turn. Arguments are checked against the schema of their tool, and every message is written as canonical JSON: keys
sorted, no blanks, arguments re-serialised from their parsed form.

Edge cases: null roles and texts are written as JSON null. Text that is no JSON object of these shapes is content. A
result without a call, or a call without a result, is kept and marked. Invalid JSON arguments are kept as a string and
are invalid. Tools without a schema are not checked (null). Equal rows each keep their line. Conversations of any length
are never gathered. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Argument types a schema may name, as the kinds that a parsed value reports.
KINDS = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY<.*", "object": "OBJECT<.*"}
_CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>"
_RESULT = "struct<tool_call_id:string,content:string>"
#: A schema: argument name to (type, required).
Schema = dict[str, tuple[str, bool]]


def json_string(c: Column) -> Column:
    """A JSON string literal, or ``null``."""
    text = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def valid_arguments(name: Column, parsed: Column, schemas: dict[str, Schema]) -> Column:
    """Whether parsed arguments have all required names, no others, and the right types; null for unknown tools."""
    verdict = F.lit(None).cast("boolean")
    for tool, schema in sorted(schemas.items()):
        kind = F.schema_of_variant(parsed)
        ok = kind.startswith("OBJECT<")
        known = F.lit(0)
        for arg, (what, required) in sorted(schema.items()):
            value = F.try_variant_get(parsed, f"$.{arg}", "variant")
            there = value.isNotNull()
            fits = F.schema_of_variant(value).rlike(f"^({KINDS[what]})$")
            ok = ok & F.when(there, F.coalesce(fits, F.lit(False))).otherwise(F.lit(not required))
            known = known + there.cast("int")
        size = F.size(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")))
        verdict = F.when(name == tool, parsed.isNotNull() & F.coalesce(ok & (size == known), F.lit(False))).otherwise(verdict)
    return verdict


def format_messages(messages: DataFrame, schemas: dict[str, Schema] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, order_turn, order_rank, n_calls, n_valid, linked, message) of every row.

    ``order_turn, order_rank, turn`` sort a conversation topologically. ``n_calls`` and ``n_valid`` count a message's calls
    and those with valid arguments; ``linked`` tells for a result whether its call exists, and is null for others.
    """
    schemas = schemas or {}
    shape = F.col("text").rlike(r"^\s*\{")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("calls", F.when((F.col("role") == "assistant") & shape, F.from_json("text", _CALLS)["tool_calls"]))
    rows = rows.withColumn("result", F.when((F.col("role") == "tool") & shape, F.from_json("text", _RESULT)))
    named = rows.where("calls is not null").select("conv_id", "turn", F.explode("calls").alias("c")).where("c.id is not null")
    first = named.groupBy("conv_id", F.col("c.id").alias("call_id")).agg(F.min("turn").alias("call_turn"))
    rows = rows.withColumn("call_id", F.col("result.tool_call_id"))
    linked = _link(rows, first)

    def one(c: Column) -> Column:
        parsed = F.try_parse_json(c["arguments"])
        arguments = F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(json_string(c["arguments"]))
        line = F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), json_string(c["id"]), F.lit(',"name":'), json_string(c["name"]), F.lit("}"))
        return F.struct(line.alias("line"), valid_arguments(c["name"], parsed, schemas).alias("valid"))

    done = linked.withColumn("calls", F.transform("calls", one))
    content = F.when(F.col("calls").isNotNull(), F.lit(None).cast("string")).when(F.col("call_id").isNotNull(), F.col("result.content")).otherwise(F.col("text"))
    tail = F.when(F.col("call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), json_string(F.col("call_id")))).when(F.col("calls").isNotNull(), F.concat(F.lit(',"tool_calls":['), F.array_join(F.transform("calls", lambda c: c["line"]), ","), F.lit("]"))).otherwise("")
    message = F.concat(F.lit('{"content":'), json_string(content), F.lit(',"role":'), json_string(F.col("role")), tail, F.lit("}"))
    return done.select(
        "conv_id", "turn", "role", F.greatest("turn", "call_turn").alias("order_turn"), F.col("call_turn").isNotNull().cast("int").alias("order_rank"),
        F.when(F.col("calls").isNull(), 0).otherwise(F.size("calls")).alias("n_calls"),
        F.when(F.col("calls").isNull(), 0).otherwise(F.size(F.filter("calls", lambda c: c["valid"]))).alias("n_valid"),
        F.when(F.col("call_id").isNotNull(), F.col("call_turn").isNotNull()).alias("linked"), message.alias("message"),
    )


def _link(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Results joined to their calls by a shuffled hash join on the calls; messages that are no results pass by."""
    results = rows.where("call_id is not null").join(first.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    return rows.where("call_id is null").withColumn("call_turn", F.lit(None).cast(dict(first.dtypes)["call_turn"])).unionByName(results)


#: The same rows for messages without tool calls, in DuckDB.
ORACLE = """
SELECT conv_id, turn, role, turn AS order_turn, CAST(0 AS INTEGER) AS order_rank, CAST(0 AS INTEGER) AS n_calls, CAST(0 AS INTEGER) AS n_valid,
       CAST(NULL AS BOOLEAN) AS linked, '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":' || CAST(to_json(role) AS VARCHAR) || '}' AS message
FROM conversations
"""
