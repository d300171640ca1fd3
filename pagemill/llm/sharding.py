"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in a fixed order (doc_id, checksum, size; nulls first); the permutation
sends number r to position p in [0, N), and shard = p mod shards, slot = p div shards. Any row's
place can so be computed from its number alone, reruns agree, and shard sizes differ by at most one
row (the law `rows`). Equal texts are spread like any other rows, so a hot group can't fill a shard.

Nulls: a null text has size 16 and the checksum of the empty string; a null doc_id sorts first.
Repeated rows are rows of their own; rows that agree in all three are interchangeable. An empty table gives no rows. Texts are
read whole, however long, and never leave their partition: only (doc_id, size, checksum) is shuffled. Other columns, of any name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import global_row_number, table

ROUNDS = ((40503, 12345), (30011, 6789), (48271, 2221), (25173, 13849), (16807, 777), (28411, 134456))


def feistel(r, n: int, seed: int = 0):
    """Positions of row numbers r under a permutation of [0, n): generalised Feistel over side x side.

    side = ceil(sqrt(n)); positions beyond n walk on along their cycle until they are inside.
    """
    side = max(1, math.isqrt(max(n - 1, 0)) + 1)
    x = np.asarray(r, dtype=np.int64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] // side, x[todo] % side
        for k, (a, b) in enumerate(ROUNDS):
            f = ((right * a + b + seed * (k + 1)) % 1000003) * 7919 // 13
            left, right = right, (left + f + right // 7) % side
        x[todo] = left * side + right
        todo = todo[x[todo] >= n]
    return x


def shard_rows(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (null: law `rows`)."""
    t = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(id_col),
        (F.octet_length(t) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"),
    )
    numbered, n = global_row_number(narrow, [id_col, "text_crc32", "size"], "_row", "shard")

    @F.pandas_udf("long")
    def place(r: pd.Series) -> pd.Series:
        return pd.Series(feistel(r.to_numpy(), n, seed))

    return numbered.withColumn("_p", place("_row")).select(
        id_col,
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4(spark, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), 40)
