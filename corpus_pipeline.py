"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.

Null and empty texts break the length rule and go at the first stage. Rows are known by all their columns, never by doc_id alone: unlike texts under one
doc_id, or under none, are documents of their own. Repeated rows are copies (one stays after the third stage, unless doc_id is null: those are never
near-duplicates). Texts are read whole, however long. Extra columns of any name are carried along to the mix, as they came. Ties are settled by
doc_id and digest, so reruns agree. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import line_dedup, minhash_dedup, mixing, packing, quality
from pagemill.operators.durable import removed_at_exit, shared_folder

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no rule. A null text has no words and goes; rows of other languages than those of the stop words aren't judged by these."""
    return quality.keep(docs, lang="lang")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur in three texts go; n_chars follows, and documents without a word left go. Pairs are mostly near copies: the next stage judges them whole. A null doc_id counts as the last."""
    return line_dedup.keep_rest(docs, pairs=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id, then digest. Rows without doc_id stay."""
    return minhash_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most. Null sources are one source, last in order."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences. Repeated rows are packed as documents of their own."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near-duplicates", near_duplicates),
    ("mix", mix),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = removed_at_exit(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
