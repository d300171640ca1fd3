"""Best-fit decreasing packing with a segment tree over remaining capacities.

Documents become token ids with an end id; longer ones are cut into full pieces. Pieces are packed
longest first into the tightest open bin that holds them. Pieces of one length are interchangeable,
and so are bins of one remaining capacity: the packer therefore works on the histogram of lengths (at
most `size` rows, whatever the corpus), moving whole runs of bins between capacities; a segment tree
finds the tightest open capacity in log(size) steps. Its result, runs of (length, ranks, bins), equals
that of placing documents one by one, and its size depends on `size` only.

Each piece finds its place from its length and its rank among pieces of that length. Ranks come from
a count per (partition, length); ids are never shuffled. The tokenised pieces are written once to the shared
folder, so a lost executor can't change ranks.

Nulls: a null text is empty and has the end id alone; a null doc_id is a value. Repeated rows are packed as documents of their own; ties of length
go by partition and order in it. Texts are tokenised whole, however long. Columns but doc_id and the text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SIZE, END = 4096, 1


class Capacities:
    """Segment tree: how many bins are open at each remaining capacity."""

    def __init__(self, size: int):
        self.leaf = 1
        while self.leaf <= size:
            self.leaf *= 2
        self.tree = [0] * (2 * self.leaf)

    def add(self, cap: int, n: int) -> None:
        i = cap + self.leaf
        while i:
            self.tree[i] += n
            i //= 2

    def tightest(self, least: int) -> int:
        """The smallest capacity >= least with an open bin, or -1."""
        i = least + self.leaf
        if self.tree[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.tree[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return -1
        while i < self.leaf:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.leaf


def best_fit(lengths: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, first bin, pieces a bin, offset in the bin), and the number of bins."""
    tree, open_, runs, bins = Capacities(size), {}, [], 0
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            cap = tree.tightest(length)
            if cap < 0:
                each = size // length
                first, n, cap = bins, -(-left // each), size
                bins += n
            else:
                each = cap // length
                first, n = open_[cap].pop()
                tree.add(cap, -n)
            full = min(n, left // each)
            used = full
            if full:
                runs.append((length, rank, first, each, size - cap))
                rank += full * each
                left -= full * each
                _open(open_, tree, cap - each * length, first, full)
            elif left:
                runs.append((length, rank, first, left, size - cap))
                _open(open_, tree, cap - left * length, first, 1)
                rank, left, used = rank + left, 0, 1
            if used < n:
                _open(open_, tree, cap, first + used, n - used)
    return runs, bins


def _open(open_: dict, tree: Capacities, cap: int, first: int, n: int) -> None:
    if cap > 0 and n > 0:
        open_.setdefault(cap, []).append((first, n))
        tree.add(cap, n)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _pid int, _rank long"


def _cutter(path: str, size: int, end: int):
    def run(batches):
        from .tokens import word_ids

        many, last = word_ids(path).many, np.asarray([end], "<u4").tobytes()
        pid, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for doc, raw in zip(batch.column(0).to_pylist(), many(batch.column(1).to_pylist())):
                raw += last
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc, k, at // 4, n, zlib.crc32(part), seen[n])):
                        c.append(v)
                    seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols[:5], types)]
            arrays += [pa.array([pid] * len(cols[0]), pa.int32()), pa.array(cols[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long"), F.col(text)).mapInArrow(_cutter(path, size, end), PIECES)
    pieces = written(pieces, "pieces")
    counts = pieces.groupBy("_pid", "length").agg(F.count("*").alias("n"))
    lengths = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    runs, _ = best_fit(lengths, size)
    runs.sort()
    table = np.asarray(runs, dtype=np.int64).reshape(-1, 5)
    key = (table[:, 0] << 44) + table[:, 1]
    shared = spark.sparkContext.broadcast((key, table))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, runs_ = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(keys, (n << 44) + r, side="right") - 1
        _, first, start, each, offset = runs_[at].T
        k = r - first
        return pd.DataFrame({"sequence_id": start + k // each, "offset": offset + k % each * n})

    before = Window.partitionBy("length").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = pieces.join(base, ["_pid", "length"]).withColumn("_p", place("length", F.col("_base") + F.col("_rank")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
