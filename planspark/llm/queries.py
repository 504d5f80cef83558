"""The queries ``opN_<name>`` and their SQL: thin contracts over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, html_text, language_id, packing, quality, simhash, toxicity, url_filter, webp
from .common import fold_column

#: Arguments of the tools that conversations may call.
TOOLS: dict[str, chat.Schema] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "convert": {"value": ("number", True), "exact": ("boolean", False), "units": ("array", False)},
}
# Tool calls derived from a turn, read alike by both engines: the tool, its arguments, and the place and call of the result.
CALL_NAME = "case when conv_id % 3 = 0 then 'search' when conv_id % 3 = 1 then 'convert' else 'other' end"
CALL_ARGUMENTS = """case when turn % 4 = 3 then '"{not json"' when conv_id % 3 = 0 and conv_id % 2 = 0 then concat('{"query": "q', cast(turn as string), '", "limit": 5}') when conv_id % 3 = 0 then '{"limit": 5}'
when conv_id % 2 = 0 then concat('{"value": ', cast(conv_id as string), '.5, "units": ["m"]}') else concat('{"value": ', cast(conv_id as string), ', "more": null}') end"""
RESULT_STEP = "case when conv_id % 5 = 0 then -4 else 4 end"
RESULT_CALL = "case when conv_id % 7 = 0 then 'missing' else concat('c', cast(turn as string)) end"
_SORTED = """case when turn % 4 = 3 then '"{not json"' when conv_id % 3 = 0 and conv_id % 2 = 0 then concat('{"limit":5,"query":"q', cast(turn as string), '"}') when conv_id % 3 = 0 then '{"limit":5}'
when conv_id % 2 = 0 then concat('{"units":["m"],"value":', cast(conv_id as string), '.5}') else concat('{"more":null,"value":', cast(conv_id as string), '}') end"""
_VALID = "case when turn % 4 = 3 or conv_id % 3 = 2 then 0 when conv_id % 2 = 0 then 1 else 0 end"
CALLS_ORACLE = f"""
WITH a AS (SELECT * FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn * 10 AS turn, 'assistant' AS role, turn * 10 AS order_turn, CAST(0 AS INTEGER) AS order_rank, CAST(1 AS INTEGER) AS n_calls, CAST({_VALID} AS INTEGER) AS n_valid, CAST(NULL AS BOOLEAN) AS linked,
       concat('{{"content":null,"role":"assistant","tool_calls":[{{"arguments":', {_SORTED}, ',"id":"c', cast(turn as string), '","name":"', {CALL_NAME}, '"}}]}}') AS message FROM a
UNION ALL
SELECT conv_id, turn * 10 + {RESULT_STEP}, 'tool', CASE WHEN conv_id % 7 = 0 THEN turn * 10 + {RESULT_STEP} ELSE greatest(turn * 10, turn * 10 + {RESULT_STEP}) END, CAST(CASE WHEN conv_id % 7 = 0 THEN 0 ELSE 1 END AS INTEGER), CAST(0 AS INTEGER), CAST(0 AS INTEGER), conv_id % 7 <> 0,
       concat('{{"content":"n', cast(length(text) as string), '","role":"tool","tool_call_id":"', {RESULT_CALL}, '"}}') FROM a
""".replace("as string)", "as varchar)")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold_column("doc_id", 4) == 2
    model = language_id.fit(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted", "cross_entropy")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every document in a sequence of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=2, max_tokens=4096)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the line field's verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned from labels of those whose crc32(doc_id) mod 5 is not 0."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_column("doc_id", 5) == 0
    model = toxicity.fit(docs.where(~held_out), labels.where(~held_out))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of every conversation as canonical JSON, with its place in the topological order."""
    return chat.format_messages(table(spark, sf_dir, "conversations"), TOOLS)


def chat_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over conversations whose replies become calls of a tool, each with a result: linked, ordered, validated.

    The table has no tool calls of its own, so they are derived from its turns: the reply of a turn is called ``c<turn>``,
    its result comes a step later, or a step before it, or names a call that there is none of.
    """
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    calls = rows.selectExpr("conv_id", "turn * 10 as turn", "'assistant' as role", f"concat('{{\"tool_calls\": [{{\"id\": \"c', turn, '\", \"name\": \"', {CALL_NAME}, '\", \"arguments\": ', {CALL_ARGUMENTS}, '}}]}}') as text")
    results = rows.selectExpr("conv_id", f"turn * 10 + {RESULT_STEP} as turn", "'tool' as role", f"concat('{{\"content\": \"n', length(text), '\", \"tool_call_id\": \"', {RESULT_CALL}, '\"}}') as text")
    return chat.format_messages(calls.unionByName(results), TOOLS)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    rules = [url_filter.Rule.of(v, r) for v, r in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))]
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs, path = table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")
    return bpe.digests(docs, path, bpe.build_lexicon(docs, path))


def op9_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as lossless WebP and read back."""
    return webp.digests(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {"op1_language_id": op1_language_id, "op2_packing": op2_packing, "op3_quality_rules": op3_quality_rules, "op4_toxicity": op4_toxicity, "op5_simhash": op5_simhash, "op6_chat": op6_chat, "op7_url_filter": op7_url_filter, "op8_bpe": op8_bpe, "op9_webp": op9_webp, "op10_html_text": op10_html_text, "chat_tool_calls": chat_tool_calls}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.ORACLE, "chat_tool_calls": CALLS_ORACLE}
