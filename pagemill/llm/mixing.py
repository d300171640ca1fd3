"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact size in words); each source's target words are filled by whole
documents: the largest number of complete copies of the source, then the rest of the budget by a
bounded-knapsack dynamic program over the size counts (reachable sums), then seeded documents are selected by the
count the program chose for each size.

The program sees only the histogram of a source: as many rows as distinct sizes, not documents. The choice
inside a size is a cut in the order of seeded row hashes: the part of the hash range that holds it is found from counts, and only
rows of that part are ranked. So a document's copies are read from its own row and the cut of its (source, size); no text is shuffled.

A row is known by its 128-bit digest. Rows that agree in it are one row repeated: counted before they are shuffled, and
interchangeable. Nulls: a null text has size 0 and takes 0; null sources form one source, last in order; a null doc_id is
a value. Texts are read whole, however long. Ties of the hash go by digest. Incoming columns of any name stay apart in one
struct. A source whose sizes are all 0 has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keyed, row_digest, table, unpacked, written

WEIGHTS = (5, 2, 1)
#: Words that the program fits at first, and at most.
FINISH, MOST = 1 << 17, 1 << 22
SALT_BITS = 12
#: Tables of at most so many rows (one a source and size, 60 bytes) are broadcast; beyond, both sides are shuffled.
FEW = 300_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[tuple]:
    """(source, size) to (source, size, target): shares by weight, capped at most x size, excess reshared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = [weights[i % len(weights)] for i in range(len(order))]
    cap = [most * s for _, s in order]
    left, open_, got = share * sum(s for _, s in order), set(range(len(order))), [0.0] * len(order)
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap[i]]
        if not over:
            for i in open_:
                got[i] = left * w[i] / total
            break
        for i in over:
            got[i] = cap[i]
            open_.discard(i)
        left -= sum(cap[i] for i in over)
    return [(s, n, got[i]) for i, (s, n) in enumerate(order)]


def fit(counts: dict[int, int], budget: int, finish: int = FINISH, most: int = MOST) -> dict[int, int]:
    """How many documents of each size to take, at most counts[size], for the largest sum <= budget.

    Proportional quotas leave about `finish` words, or so much that several documents of the longest size fit; the bounded-knapsack program
    fits what is left, and may take back from the quotas. Where it can't reach the budget (the last multiple of the
    sizes' common divisor), it starts anew with eight times as many words. So the sum is the largest there is up to a budget of
    `most` words, and beyond unless no choice within `most` words of the quotas reaches the budget.
    """
    counts = {s: c for s, c in sorted(counts.items()) if s > 0 and c > 0}
    if budget >= sum(s * c for s, c in counts.items()):
        return dict(counts)
    if budget <= 0:
        return {}
    goal = budget - budget % gcd(*counts)
    best, keep = {}, finish
    while True:
        keep = min(budget, max(keep, 4 * max(counts)))
        got = _fit_near(counts, budget, keep, budget - goal)
        best = max(best, got, key=lambda x: sum(s * n for s, n in x.items()))
        if sum(s * n for s, n in best.items()) == goal or keep >= min(budget, most):
            return best
        keep *= 8


def _fit_near(counts: dict[int, int], budget: int, keep: int, off: int) -> dict[int, int]:
    """fit() by quotas that leave about `keep` words, and a program over at most 2 keep; a sum `off` below the budget ends it."""
    total = sum(s * c for s, c in counts.items())
    f = (budget - keep) / total
    take = {s: int(c * f) for s, c in counts.items()}
    rest = budget - sum(s * n for s, n in take.items())
    # whole documents, longest first, until the rest is what the program handles
    for s in sorted(counts, reverse=True):
        if rest > keep:
            n = min(counts[s] - take[s], (rest - keep) // s)
            take[s] += n
            rest -= n * s
    # what the program may take back: of each size up to half of the room that is left, the shortest first
    room = keep
    for s in sorted(counts):
        back = min(take[s], (room + 1) // 2 // s)
        take[s] -= back
        rest += back * s
        room -= back * s
    reach, step = np.zeros(rest + 1, bool), np.full(rest + 1, -1, np.int32)
    reach[0] = True
    pieces: list[tuple[int, int]] = []
    for s in counts:
        left, piece = min(counts[s] - take[s], rest // s), 1
        while left > 0 and not reach[rest - off]:
            n = min(piece, left)
            new = np.flatnonzero(reach[: rest + 1 - s * n] & ~reach[s * n :]) + s * n
            step[new] = len(pieces)
            reach[new] = True
            pieces.append((s, n))
            left -= n
            piece *= 2
    # a sum was first reached by one piece from a sum that earlier pieces reach, so no piece comes twice
    at = int(np.flatnonzero(reach)[-1])
    while at:
        s, n = pieces[step[at]]
        take[s] += n
        at -= s * n
    return {s: n for s, n in take.items() if n}


def plan(counts: dict[int, int], budget: int) -> list[tuple[int, int, int]]:
    """(size, times every document is taken, how many of them are taken once more) for one source."""
    total = sum(s * c for s, c in counts.items())
    whole, rest = divmod(budget, total) if total else (0, 0)
    more = fit(counts, rest)
    return [(s, int(whole), int(more.get(s, 0))) for s in counts if s > 0]


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def _measures(row: DataFrame, source: Column, text: Column, seed: int) -> DataFrame:
    """Adds _k (source), size and _h (seeded place in the order of rows, from _d1, _d2)."""
    size = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
    return row.withColumns({"_k": _key(source), "size": size, "_h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_d1", "_d2"), 1)})


def _cuts(narrow: DataFrame, weights, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    """Per source: source_size, target. Per (source, size): _whole times every row; once more all rows before the cut
    (_ch, _c1, _c2), and of the _same rows at the cut _left."""
    spark = narrow.sparkSession
    salt = F.shiftright("_h", 63 - SALT_BITS).alias("_salt")
    parts = written(narrow.groupBy("_k", "source", "size", salt).agg(F.count("*").alias("n")), "mix-counts")
    per = parts.groupBy("_k", "source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).collect()
    # one row a source reaches the driver, as the target weights are given by source
    goals = targets([(r["source"], int(r["size"])) for r in per], weights, share, most)
    goal = spark.createDataFrame(goals, "source string, source_size long, target double")
    goal = goal.select(_key(F.col("source")).alias("_k"), "source_size", "target")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(s): int(n) for s, n in zip(pdf["size"], pdf["n"])}
        got = plan(counts, round(float(pdf["target"].iloc[0])))
        return pd.DataFrame(got, columns=["size", "_whole", "_more"]).assign(_k=key[0])

    hist = parts.groupBy("_k", "size").agg(F.sum("n").alias("n")).join(goal, "_k")
    quota = written(hist.groupBy("_k").applyInPandas(one, "_k string, size long, _whole long, _more long"), "mix-quota")
    before = Window.partitionBy("_k", "size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.join(quota.filter("_more > 0").drop("_whole"), ["_k", "size"])
    starts = starts.withColumn("_base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = starts.filter("_base < _more and _more <= _base + n").select("_k", "size", "_salt", (F.col("_more") - F.col("_base")).alias("_want"))
    ranked = narrow.select("_k", "size", "_h", "_d1", "_d2", salt).join(_sided(starts), ["_k", "size", "_salt"])
    ranked = ranked.groupBy("_k", "size", "_want", "_h", "_d1", "_d2").agg(F.count("*").alias("_same"))
    upto = Window.partitionBy("_k", "size").orderBy("_h", "_d1", "_d2").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("_left", F.col("_want") - F.sum("_same").over(upto) + F.col("_same")).filter("_left > 0 and _left <= _same")
    cut = ranked.select("_k", "size", F.col("_h").alias("_ch"), F.col("_d1").alias("_c1"), F.col("_d2").alias("_c2"), "_same", "_left")
    return goal, written(quota.select("_k", "size", "_whole").join(cut, ["_k", "size"], "left"), "mix-cuts")


def _sided(small: DataFrame) -> DataFrame:
    small = written(small, "mix-side")
    return F.broadcast(small) if small.count() <= FEW else small


def _taken(rows: DataFrame, cuts: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """rows with their copies; and once for each row repeated, of whose repeats only some are taken once more, its columns with _whole, _same, _left (None: there are none)."""
    out = rows.join(F.broadcast(cuts) if cuts.count() <= FEW else cuts, ["_k", "size"], "left")
    here = F.struct("_h", "_d1", "_d2")
    cut = F.struct("_ch", "_c1", "_c2")
    out = out.withColumn("copies", F.coalesce(F.col("_whole") + F.when(here <= cut, 1).otherwise(0), F.lit(0)).cast("long"))
    if cuts.filter("_left < _same").isEmpty():
        return out, None
    split = F.coalesce((F.col("_left") < F.col("_same")) & (here == cut), F.lit(False))
    some = out.filter(split).groupBy("_k", "size", "_d1", "_d2").agg(*[F.first(c).alias(c) for c in same], *[F.first(c).alias(c) for c in ("_whole", "_same", "_left")])
    return out.filter(~split), some


def _repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times, with its number _i from 1."""
    blocks = df.withColumn("_times", times).filter("_times > 0").withColumn("_block", F.explode(F.expr("sequence(0L, (_times - 1) div 4096)")))
    return blocks.withColumn("_i", F.explode(F.expr("sequence(_block * 4096 + 1, least(_times, (_block + 1) * 4096))"))).drop("_block", "_times")


def choose(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """One narrow row per document: doc_id, source, size, source_size, target, copies (0 to most)."""
    digest = [c.alias(k) for k, c in row_digest(docs).items()]
    rows = docs.select("doc_id", "source", F.col(text).alias("_t"), *digest)
    narrow = written(_measures(rows, F.col("source"), F.col("_t"), seed).drop("_t"), "mix")
    goal, cuts = _cuts(narrow, weights, share, most)
    out, some = _taken(narrow, cuts, ["doc_id", "source"])
    names = ["doc_id", "source", "size", "_k", "copies"]
    out = out.select(*names)
    if some is not None:
        some = _repeat(some, F.col("_same")).withColumn("copies", F.col("_whole") + F.when(F.col("_i") <= F.col("_left"), 1).otherwise(0))
        out = out.unionByName(some.select(*names))
    out = out.join(goal, "_k", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, text: str = "text") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    row = F.col("_row")
    rows = _measures(keyed(docs), row.getField("source"), row.getField(text), seed)
    _, cuts = _cuts(written(rows.withColumn("source", row.getField("source")).drop("_row"), "mix"), weights, share, most)
    out, some = _taken(rows, cuts, ["_row"])
    out = _repeat(out, F.col("copies")).select("_row")
    if some is not None:
        out = out.unionByName(_repeat(some, F.col("_whole") * F.col("_same") + F.col("_left")).select("_row"))
    return unpacked(out, docs)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return choose(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
