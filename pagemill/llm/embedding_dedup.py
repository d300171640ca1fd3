"""Embedding near-duplicates by a subspace pigeonhole join.

Vectors of one label whose cosine reaches t are unit vectors within squared distance 2 - 2t. They are
rotated (an orthogonal matrix, so distances stay) and split into blocks of few dimensions; if the whole
squared distance keeps within the budget, at least one block keeps within its proportional share. Each
block is range-joined on a grid over its first dimensions, and the union of candidates is verified with the
cosine in double precision: no pair is lost, none below t is linked.

Grid cells are twice the block's radius wide. A vector is at home in one cell and visits the later cells that
its ball touches, so a close pair meets in exactly one cell of a block; a pair counts only in the first
block whose share it keeps, so that link counts need no set of pairs. Pairs never leave a task: it
emits, for each vector with links, the number of links and the root of its local component. Identical
vectors are one class before any of this. The grid takes as many dimensions as bring cells of the largest
label to about TILE vectors; cells with more are cut into tiles of pairs of parts, so no task holds more than
two parts.

Vectors that are null, zero, or hold null or non-finite components, and rows with a null label or
vec_id, link with nothing: n_links 0, component_id = vec_id, kept (false where vec_id is null). Vectors of
different lengths are never compared; they may have any length. Repeated rows are vectors of their own: copies link with each other.
Ties of a component go to the smallest vec_id. An empty table gives no rows; extra columns of any name are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, local_roots, table, written

TILE, BLOCK, CELLS = 4096, 8, 6
SLACK = 1e-7
#: Hot cells up to this number (a few MB) are broadcast; beyond, both sides are shuffled.
FEW = 200_000


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(d).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def blocks(d: int, width: int = BLOCK) -> list[tuple[int, int]]:
    m = max(1, round(d / width))
    cuts = [d * i // m for i in range(m + 1)]
    return list(zip(cuts, cuts[1:]))


def rotated(x: np.ndarray) -> np.ndarray:
    """Rotated unit vectors, rounded so that every task sees the same block distances."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    return np.round(u @ rotation(x.shape[1]), 9)


def cells(r: np.ndarray, budget: float, dims: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block, row, cell key) of homes and then of visits: a list of (rows, keys, is home) per block."""
    d, out = r.shape[1], []
    for b, (lo, hi) in enumerate(blocks(d)):
        g, radius = min(dims, hi - lo), math.sqrt(budget * (hi - lo) / d) + SLACK
        x = r[:, lo : lo + g] / (2 * radius)
        home = np.floor(x).astype(np.int64)
        inside = x - home
        side = np.where(inside < 0.5, -1, 1)
        gap = np.minimum(inside, 1 - inside)
        rows, keys, homes = [np.arange(len(r))], [_key(b, home)], [np.ones(len(r), bool)]
        for subset in range(1, 1 << g):
            s = [j for j in range(g) if subset >> j & 1]
            hit = ((gap[:, s] ** 2).sum(1) <= 0.25) & (side[:, s[0]] > 0)
            if hit.any():
                to = home[hit].copy()
                to[:, s] += side[hit][:, s]
                rows.append(np.flatnonzero(hit))
                keys.append(_key(b, to))
                homes.append(np.zeros(int(hit.sum()), bool))
        out.append((np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)))
    return out


def _key(block: int, cell: np.ndarray) -> np.ndarray:
    """A 64-bit hash of block and cell, so that cells of any number and size stay apart."""
    key = np.full(len(cell), block + 1, np.uint64)
    for j in range(cell.shape[1]):
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cell[:, j].astype(np.uint64)
        key = (key ^ (key >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (key ^ (key >> np.uint64(31))).view(np.int64)


def pairs(x: np.ndarray, r: np.ndarray, block: int, left: np.ndarray, right: np.ndarray | None, home: np.ndarray, t: float):
    """Index pairs with cosine >= t whose first block within its share is `block`.

    left, right: the rows of two parts, or of one with right None; pairs of two visitors belong elsewhere.
    """
    d, budget = x.shape[1], 2 - 2 * t
    cut = blocks(d)
    lo, hi = cut[block]
    share = [budget * (b - a) / d + SLACK for a, b in cut]
    other = left if right is None else right
    y = r[other, lo:hi]
    y2, norm = (y * y).sum(1), np.sqrt((x * x).sum(1))
    for k in range(0, len(left), 1024):
        part = left[k : k + 1024]
        z = r[part, lo:hi]
        near = (z * z).sum(1)[:, None] + y2[None, :] - 2 * (z @ y.T) <= share[block] + SLACK
        i, j = np.nonzero(near)
        if right is None:
            keep = j > i + k
            i, j = i[keep], j[keep]
        i, j = part[i], other[j]
        keep = home[i] | home[j]
        i, j = i[keep], j[keep]
        for c in range(0, len(i), 16384):
            a, b = i[c : c + 16384], j[c : c + 16384]
            diff = (r[a] - r[b]) ** 2
            first = diff[:, lo:hi].sum(1) <= share[block]
            for e in range(block):
                first &= diff[:, cut[e][0] : cut[e][1]].sum(1) > share[e]
            a, b = a[first], b[first]
            ok = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= t
            yield a[ok], b[ok]


def near_duplicates(vectors: DataFrame, t: float = 0.98, tile: int = TILE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists(e, lambda v: v != 0)
    )
    ids = vectors.select(
        F.col("vec_id").cast("long"),
        F.coalesce(fine, F.lit(False)).alias("_fine"),
        F.xxhash64("label", "embedding").alias("_k1"),
        F.xxhash64(F.lit("second"), "embedding", "label").alias("_k2"),
        "label",
        "embedding",
    )
    # a 128-bit key stands for (label, embedding); identical vectors are one class
    classes = ids.filter("_fine").groupBy("_k1", "_k2").agg(
        F.min("vec_id").alias("cid"), F.count("*").alias("n"), F.first("label").cast("string").alias("label"), F.first("embedding").alias("x")
    )
    classes = written(classes, "vectors")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    dims = max(1, min(BLOCK, math.ceil(math.log(max(1, most / tile)) / math.log(CELLS))))
    budget = 2 - 2 * t

    def spread(batches):
        for batch in batches:
            cid, n, label = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            x = batch.column(3)
            sizes = np.diff(x.offsets.to_numpy())
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                own = batch.take(pa.array(at))
                v = own.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                for b, (rows, keys, homes) in enumerate(cells(rotated(v), budget, dims)):
                    take = pa.array(rows)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pc.binary_join_element_wise(own.column(2).take(take), pa.scalar(str(d)), "/"),
                            pa.array(np.full(len(rows), b), pa.int32()),
                            pa.array(keys),
                            pa.array(homes),
                            own.column(0).take(take),
                            own.column(1).take(take),
                            own.column(3).take(take),
                        ],
                        names=["part", "block", "cell", "home", "cid", "n", "x"],
                    )

    placed = classes.select("cid", "n", "label", F.col("x").cast("array<double>").alias("x")).mapInArrow(
        spread, "part string, block int, cell long, home boolean, cid long, n long, x array<double>"
    )
    placed = placed.withColumn("x", F.col("x").cast(vectors.schema["embedding"].dataType))
    big = placed.groupBy("part", "block", "cell").count().filter(F.col("count") > tile)
    big = written(big.withColumn("parts", F.ceil(F.col("count") / (tile // 2)).cast("int")).drop("count"), "cells")
    hot = big.count()
    on = ["part", "block", "cell"]
    if hot <= FEW:
        big = F.broadcast(big)
    tiled = placed.join(big, on, "left") if hot else placed.withColumn("parts", F.lit(None).cast("int"))
    tiled = tiled.withColumn("parts", F.coalesce("parts", F.lit(1)))
    tiled = tiled.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    tiled = tiled.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")}).drop("with", "parts")

    def join(key: tuple, table: pa.Table) -> pa.Table:
        block, lo, hi = key[1].as_py(), key[3].as_py(), key[4].as_py()
        cid, n = table["cid"].to_numpy(), table["n"].to_numpy()
        home, own = table["home"].to_numpy(), table["own"].to_numpy()
        vec = table["x"].combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cid), -1)
        order = np.argsort(cid, kind="stable")
        cid, n, home, own, x = cid[order], n[order], home[order].astype(bool), own[order], x[order]
        left = np.flatnonzero(own == lo)
        found = list(pairs(x, rotated(x), block, left, None if lo == hi else np.flatnonzero(own == hi), home, t))
        i = np.concatenate([a for a, _ in found]) if found else np.zeros(0, np.int64)
        j = np.concatenate([b for _, b in found]) if found else np.zeros(0, np.int64)
        links = np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
        hit = np.flatnonzero(links)
        root = local_roots(len(cid), i, j)
        return pa.table({"cid": cid[hit], "links": links[hit].astype(np.int64), "root": cid[root[hit]]})

    found = tiled.groupBy("part", "block", "cell", "lo", "hi").applyInArrow(join, "cid long, links long, root long")
    found = written(found, "links")
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vectors")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("_k1", "_k2", "cid", "n").join(links, "cid", "left").join(roots.withColumnRenamed("id", "cid"), "cid", "left")
    known = known.select(
        "_k1",
        "_k2",
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "cid").alias("component_id"),
        F.lit(True).alias("_fine"),
    )
    out = ids.select("vec_id", "_fine", "_k1", "_k2").join(known, ["_k1", "_k2", "_fine"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)
