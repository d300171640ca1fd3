"""Helpers that the training-data operators share: word rule, row numbers and digests, connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import shared_folder as shared_dir
from ..operators.durable import written
from ..sources.pages import spread

__all__ = ["WORD", "components", "global_row_number", "keyed", "local_roots", "packed", "row_digest", "shared_dir", "table", "unpacked", "words", "written"]

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def words(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def global_row_number(df: DataFrame, keys: list[str], out: str, name: str) -> tuple[DataFrame, int]:
    """Adds a gapless row number from 0 in the order of keys (nulls first), and gives the row count.

    One range shuffle and a sort per partition; only the row count of each partition reaches the
    driver (bounded by spark.sql.shuffle.partitions). The sorted rows are written once, so that the
    numbers can't change between the count and the use.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    ranked = (
        df.withColumn("_each", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_each")  # rows that agree in all keys are interchangeable, and split all the same
        .sortWithinPartitions(*order)
        .drop("_each")
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranked = written(ranked, name)
    counts = sorted((r[0], r[1]) for r in ranked.groupBy("_pid").count().collect())
    offsets, total = [], 0
    for pid, c in counts:
        offsets.append((pid, total))
        total += c
    small = spark.createDataFrame(offsets, "_pid int, _base long")
    numbered = ranked.join(F.broadcast(small), "_pid").withColumn(out, F.col("_base") + F.col("_at"))
    return numbered.drop("_pid", "_at", "_base"), total


def components(edges: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long): rows (id, component = smallest id).

    Alternating large-star and small-star rounds (Kiveris et al., 2014) until nothing changes: each
    is a min per node with map-side combine and a join, so that no neighbourhood is ever collected;
    the number of rounds grows with the logarithm of the number of nodes. Every round is written to the shared folder.
    Edges with a = b keep an isolated node.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, f"{name}-edges")
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u or v = u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(low, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, f"{name}-star")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not converge")
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return ids.union(roots).groupBy("id").agg(F.min("component").alias("component"))


def packed(docs: DataFrame) -> DataFrame:
    """docs with its whole row in the one column _row besides, so that no incoming name can clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def row_digest(docs: DataFrame) -> dict[str, Column]:
    """A 128-bit digest of the whole row (_d1, _d2): rows that agree in it are the same row repeated."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    cells = [plain(f) for f in docs.schema]
    # a hash passes over nulls, so where they stand is hashed too
    blank = F.concat_ws("", *[F.when(F.col(f"`{c}`").isNull(), F.lit("1")).otherwise(F.lit("0")) for c in docs.columns])
    return {"_d1": F.xxhash64(blank, *cells), "_d2": F.xxhash64(F.lit("second"), blank, *cells)}


def keyed(docs: DataFrame) -> DataFrame:
    """packed(docs) with the row digest _d1, _d2."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row, *[c.alias(k) for k, c in row_digest(docs).items()])


def unpacked(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed."""
    return df.select(*[(changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in docs.columns])


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under edges (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
