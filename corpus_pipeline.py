"""Corpus pipeline: toxicity, quality rules, near duplicates, packing.

Each stage takes the documents its predecessor kept and returns documents; the last returns packed pieces. Between two
stages the documents are written as Parquet in the shared folder and read again.

Edge cases: an empty table gives an empty result. A null or empty text is clean, fails the quality rules and so goes;
without it in a stage's input nothing depends on it. Labels may be missing: then no document is toxic and every line is
content. Repeated rows are judged alike, and one of them stays after the near-duplicate stage; rows without an id pass it.
Very long texts are read whole. Further columns are kept by all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planspark.llm import packing, quality, simhash, toxicity
from planspark.llm.common import fold_column, materialize
from planspark.llm.queries import table, tokenizer_file

#: Near-duplicate stage: words of a shingle.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; learned from labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold_column("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough content lines."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return simhash.keep_first(docs, SHINGLE)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=2, max_tokens=4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("packing", pack),
]

#: None of the stages can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
