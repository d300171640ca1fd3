"""MinHash near-duplicates: ProbMinHash sketches of weighted shingles, banding, exact verification.

Shingles are pairs of adjoining lower-cased words (letters and digits), weighted by how often they occur;
similarity is the probability Jaccard index J_P. In a sketch every shingle is a Poisson process whose
rate is its weight: arrivals fall into random slots, each slot keeps its earliest shingle, and a
process ends as soon as its next arrival is later than every slot's earliest (early termination). Two
sketches agree in a slot with probability J_P.

Texts with equal weighted shingles are one class. Every link rests on an exact J_P >= t, in four steps:
each class is verified against the smallest of the bands it shares, that which it meets most often (a star); verified links are
connected; inside such a component every pair is verified; last, where a band holds classes of more than one
component, its pairs across components are, each in the first band that it shares. No unverified hit ever connects, so chance
hits don't grow into groups. Pairs stay inside tasks: groups of over TILE classes are cut into tiles of pairs of parts,
and a task emits a row per class, its links and its root. A lone pair at J_P shares none of the BANDS
bands of ROWS slots with chance (1 - J_P^ROWS)^BANDS (1.6 % at 0.5, 0.35 % at 0.55, 0.01 % at 0.6), and is lost then.

A row is known by its 128-bit digest, never by doc_id alone: unlike texts under one doc_id are documents of their own.
Null and empty texts link with nothing, as do null doc_ids (component_id null, kept); texts without letters
and digits link with their exact copies alone. Repeated rows are copies with one verdict; keep_one leaves one of them.
Ties go to the smallest doc_id, then digest. Texts are read whole, however long. Incoming columns of any name stay apart
in one struct. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, keyed, local_roots, row_digest, table, unpacked, written

BANDS, ROWS = 64, 4
THRESHOLD, TILE = 0.5, 512
CHUNK = 250_000
#: Sides of at most so many rows (48 bytes each: 24 MB) are broadcast; beyond, both sides are shuffled.
FEW = 500_000
LOW = np.uint64((1 << 48) - 1)
GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bounds leave so much room for rounding, and a J_P that is t but for rounding counts as t.
SLACK, ROUNDING = 1e-9, 1e-12


def shingles(text: Column) -> Column:
    """64-bit hashes of word pairs in order (of the word itself where there is only one)."""
    w = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")
    one = lambda a: F.when(F.size(a) == 1, F.transform(a, lambda x: F.xxhash64(x))).otherwise(
        F.transform(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(a, i + 1)))
    )
    return F.transform(F.array(w), one)[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weigh(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: (text index, 48-bit shingle, weight), in order."""
    doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    key = np.sort((doc << np.uint64(48)) | (values.astype(np.uint64, copy=False) & LOW))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    weight = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(48)).astype(np.int64), key & LOW, weight.astype(np.float64)


def sketch(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, slots: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash of n texts at once: an (n, slots) array of 32-bit shingle marks (0 for texts without any)."""
    best = np.full(n * slots, np.inf)
    mark = np.zeros(n * slots, np.uint32)
    time = np.zeros(len(doc))
    own = _mix(shingle + GOLD)
    step = 0
    while len(doc):
        step += 1
        bits = _mix(own + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
        time = time - np.log(((bits >> np.uint64(12)).astype(np.float64) + 0.5) / 2.0**52) / weight
        slot = (_mix(bits) % np.uint64(slots)).astype(np.int64)
        at = doc * slots + slot
        np.minimum.at(best, at, time)
        won = best[at] == time
        mark[at[won]] = (own[won] >> np.uint64(32)).astype(np.uint32)
        last = best.reshape(n, slots).max(1)
        go = time < last[doc]
        doc, own, time, weight = doc[go], own[go], time[go], weight[go]
    return mark.reshape(n, slots)


def band_keys(marks: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands) 64-bit keys: the band's number and its marks."""
    m = marks.reshape(len(marks), bands, rows).astype(np.uint64)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64) * GOLD), m.shape[:2])
    for r in range(rows):
        key = _mix(key * np.uint64(5) + m[:, :, r] + GOLD)
    return key.view(np.int64)


def _texts(sizes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts with some CHUNK shingles, or of one text with more."""
    i = 0
    while i < len(sizes):
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1
        j = min(len(sizes), max(i + 1, j), i + 2000)
        yield i, j
        i = j


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, kind))


def sketches(docs: DataFrame, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, _d1, _d2 (digest of the row), _k1, _k2 (digest of the weighted shingles, or of a wordless text), bands (null without words), _fine."""
    names = ["doc_id", "_d1", "_d2", "_k1", "_k2", "bands", "_fine"]

    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(offsets)
            for i, j in _texts(sizes, offsets):
                doc, shingle, weight = weigh(values[offsets[i] : offsets[j]], sizes[i:j])
                found = band_keys(sketch(doc, shingle, weight, j - i, bands * rows), bands, rows)
                w = weight.astype(np.uint64)
                keys = []
                for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
                    total = np.zeros(j - i, np.uint64)
                    np.add.at(total, doc, _mix(shingle ^ np.uint64(salt)) * (w * np.uint64(2) + np.uint64(1)))
                    keys.append(pa.array(total.view(np.int64)))
                some = pa.array(sizes[i:j] > 0)
                texts = [c.slice(i, j - i) for c in batch.columns[4:6]]
                keys = [pc.if_else(some, k, t) for k, t in zip(keys, texts)]
                found = pc.if_else(some, _lists(found.ravel(), np.full(j - i, bands), pa.int64()), None)
                arrays = [*(c.slice(i, j - i) for c in batch.columns[:3]), *keys, found, batch.column(6).slice(i, j - i)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    t = F.col(text)
    fine = F.coalesce(t != "", F.lit(False)) & F.col("doc_id").isNotNull()
    digest = [c.alias(k) for k, c in row_digest(docs).items()]
    narrow = docs.select(F.col("doc_id").cast("long"), *digest, shingles(t).alias("s"), F.xxhash64(t), F.xxhash64(F.lit("second"), t), fine.alias("_fine"))
    return narrow.mapInArrow(run, "doc_id long, _d1 long, _d2 long, _k1 long, _k2 long, bands array<long>, _fine boolean")


def weighted_sets(docs: DataFrame, want: DataFrame, text: str, bands: int, rows: int) -> DataFrame:
    """cid, n, ids (distinct shingles in order), w (how often each occurs), bands of the rows whose digest is wanted."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(offsets)
            for i, j in _texts(sizes, offsets):
                doc, shingle, weight = weigh(values[offsets[i] : offsets[j]], sizes[i:j])
                count = np.bincount(doc, minlength=j - i)
                arrays = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)]
                arrays += [_lists(shingle.view(np.int64), count, pa.int64()), _lists(weight.astype(np.int32), count, pa.int32())]
                found = band_keys(sketch(doc, shingle, weight, j - i, bands * rows), bands, rows)
                arrays.append(_lists(found.ravel(), np.full(j - i, bands), pa.int64()))
                new = [c not in seen and not seen.add(c) for c in arrays[0].to_pylist()]  # a repeated row comes once
                yield pa.RecordBatch.from_arrays(arrays, names=["cid", "n", "ids", "w", "bands"]).filter(pa.array(new, pa.bool_()))

    chosen = docs.select(F.col(text).alias("_t"), *[c.alias(k) for k, c in row_digest(docs).items()]).join(want, ["_d1", "_d2"])
    return chosen.select("cid", "n", shingles(F.col("_t")).alias("s")).mapInArrow(run, "cid long, n long, ids array<long>, w array<int>, bands array<long>")


class Sets:
    """The weighted sets of a table's rows, flat."""

    def __init__(self, table: pa.Table):
        ids = table["ids"].combine_chunks()
        self.size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.ids = ids.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.w = table["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.total = np.bincount(np.repeat(np.arange(len(self.size)), self.size), self.w, len(self.size))

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and for each the number of its row among rows."""
        size = self.size[rows]
        which = np.repeat(np.arange(len(rows)), size)
        return np.arange(len(which)) + (self.start[rows] - np.cumsum(size) + size)[which], which

    def overlap(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Sums of min(x/X, y/Y), for pairs sorted by i: one dense row of i against all its partners at a time."""
        rows = np.unique(np.concatenate([i, j]))
        at, which = self.entries(rows)
        kinds, code = np.unique(self.ids[at], return_inverse=True)
        share = self.w[at] / self.total[rows][which]
        start = np.concatenate([[0], np.cumsum(self.size[rows])])
        dense, out = np.zeros(len(kinds)), np.zeros(len(i))
        place = np.zeros(len(self.size), np.int64)
        place[rows] = np.arange(len(rows))
        for lo, hi in _runs(i):
            own = slice(start[place[i[lo]]], start[place[i[lo]] + 1])
            dense[code[own]] = share[own]
            # partners in one piece where they adjoin (they do inside a tile), else all rows
            first, last = place[j[lo:hi]].min(), place[j[lo:hi]].max() + 1
            piece = slice(start[first], start[last])
            low = np.minimum(share[piece], dense[code[piece]])
            sums = np.add.reduceat(low, start[first:last] - start[first])
            out[lo:hi] = sums[place[j[lo:hi]] - first]
            dense[code[own]] = 0
        return out

    def linked(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """For pairs of rows, sorted by i, whether J_P >= t.

        With S = sum of min(x/X, y/Y): S / (2 - S) <= J_P <= S. Pairs that these bounds leave open are computed in full.
        """
        out = np.zeros(len(i), bool)
        todo = np.arange(len(i))
        if len(i) >= 16 * len(_runs(i)):
            s = self.overlap(i, j)
            out = s / (2 - s) >= t + SLACK
            todo = np.flatnonzero(~out & (s >= t - SLACK))
        cost = np.cumsum(self.size[i[todo]] + self.size[j[todo]])
        at = 0
        while at < len(todo):
            upto = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + 4 * CHUNK, side="right"))
            upto = min(max(upto, at + 1), at + 60_000)
            some = todo[at:upto]
            out[some] = self._exact(i[some], j[some], t)
            at = upto
        return out

    def _exact(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        left, p = self.entries(i)
        right, q = self.entries(j)
        a = (p.astype(np.uint64) << np.uint64(48)) | self.ids[left]
        b = (q.astype(np.uint64) << np.uint64(48)) | self.ids[right]
        found = np.minimum(np.searchsorted(b, a), len(b) - 1)
        hit = b[found] == a
        p, x, y = p[hit], self.w[left[hit]], self.w[right[found[hit]]]
        s = np.bincount(p, np.minimum(x / self.total[i[p]], y / self.total[j[p]]), len(i))
        out = s / (2 - s) >= t + SLACK
        is_open = ~out & (s >= t - SLACK)
        some = is_open[p]
        p, x, y = p[some], x[some], y[some]
        if len(p):
            only_x, only_y = self.total[i] - np.bincount(p, x, len(i)), self.total[j] - np.bincount(p, y, len(i))
            out |= is_open & (_probability_jaccard(p, x, y, only_x, only_y) >= t - ROUNDING)
        return out


def _runs(i: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(i)) + 1
    return list(zip([0, *cut.tolist()], [*cut.tolist(), len(i)])) if len(i) else []


def _probability_jaccard(p: np.ndarray, x: np.ndarray, y: np.ndarray, only_x: np.ndarray, only_y: np.ndarray) -> np.ndarray:
    """J_P of pairs, from the weights x, y of their common shingles (pair p) and what each has alone.

    J_P is the sum over common i of 1 / sum_j max(x_j/x_i, y_j/y_i): for shingles with a ratio y_j/x_j up to i's x_j/x_i counts, beyond it y_j/y_i.
    """
    ratio = y / x
    order = np.lexsort((ratio, p))
    p, x, y, ratio = p[order], x[order], y[order], ratio[order]
    sx, sy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    n = len(only_x)
    edge = np.searchsorted(p, np.arange(n + 1))
    last = np.ones(len(p), bool)
    last[:-1] = (p[1:] != p[:-1]) | (ratio[1:] != ratio[:-1])
    ends = np.flatnonzero(last) + 1
    upto = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    below = (sx[upto] - sx[edge[p]] + only_x[p]) / x
    above = (sy[edge[p + 1]] - sy[upto] + only_y[p]) / y
    return np.bincount(p, 1 / (below + above), n)


def whole_groups(batches, keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (rows of a group adjoin) with the number of each row's group."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        first = _first_of_group(held, keys)
        cut = int(np.flatnonzero(first)[-1])
        if cut:
            yield held.slice(0, cut).combine_chunks(), np.cumsum(first[:cut]) - 1
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), np.cumsum(_first_of_group(held, keys)) - 1


def _first_of_group(rows: pa.Table, keys: list[str]) -> np.ndarray:
    first = np.zeros(rows.num_rows, bool)
    first[:1] = True
    for k in keys:
        x = rows[k].to_numpy()
        first[1:] |= x[1:] != x[:-1]
    return first


def _star_links(t: float):
    """low, cid of members of a star that link with its pivot. In: low, part, cid, n, ids, w, in order; the pivot is the smallest."""

    def run(batches):
        for rows, group in whole_groups(batches, ["low", "part"]):
            pivot = np.searchsorted(group, group)
            cid, low = rows["cid"].to_numpy(), rows["low"].to_numpy()
            j = np.flatnonzero(cid != low)
            hit = j[Sets(rows).linked(pivot[j], j, t)]
            yield pa.RecordBatch.from_arrays([pa.array(cid[hit]), pa.array(low[hit])], names=["a", "b"])

    return run


def _group_links(t: float, keys: list[str], across: bool):
    """cid, links, root of the pairs inside each group (or between two parts of one).

    across: only pairs of different components, and each only in the first band that it shares.
    """

    def run(batches):
        for rows, group in whole_groups(batches, [*keys, "lo", "hi"]):
            cid, n = rows["cid"].to_numpy(), rows["n"].to_numpy()
            own, lo, hi = rows["own"].to_numpy(), rows["lo"].to_numpy(), rows["hi"].to_numpy()
            again = np.zeros(len(cid), bool)
            again[1:] = (cid[1:] == cid[:-1]) & (group[1:] == group[:-1])  # a repeated row in another split
            sets = Sets(rows)
            if across:
                comp, band = rows["comp"].to_numpy(), rows["band"].to_numpy()
                bands = rows["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(cid), -1)
            ii, jj = [], []

            def judge() -> None:
                i, j = (np.concatenate(x) for x in parts)
                if across:
                    new = np.flatnonzero(comp[i] != comp[j])
                    i, j = i[new], j[new]
                    new = [np.flatnonzero((bands[i[k : k + 4096]] == bands[j[k : k + 4096]]).argmax(1) == band[i[k : k + 4096]]) + k for k in range(0, len(i), 4096)]
                    new = np.concatenate(new) if new else np.zeros(0, np.int64)
                    i, j = i[new], j[new]
                hit = sets.linked(i, j, t)
                ii.append(i[hit])
                jj.append(j[hit])
                for x in parts:
                    x.clear()

            parts: tuple[list, list] = ([], [])
            small = 0
            for first, end in _runs(group):
                at = first + np.flatnonzero(~again[first:end])
                left, right = at[own[at] == lo[first]], at[own[at] == hi[first]]
                if lo[first] == hi[first]:
                    a, b = np.triu_indices(len(left), 1)
                    a, b = left[a], left[b]
                else:
                    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
                # large groups go alone, small ones together
                if len(a) > 2000 and small:
                    judge()
                    small = 0
                parts[0].append(a)
                parts[1].append(b)
                small += len(a)
                if small > 2000:
                    judge()
                    small = 0
            if small:
                judge()
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (ii, jj))
            links = np.bincount(i, n[j], len(cid)) + np.bincount(j, n[i], len(cid))
            hit = np.flatnonzero(links)
            root = local_roots(len(cid), i, j)
            arrays = [pa.array(cid[hit]), pa.array(links[hit].astype(np.int64)), pa.array(cid[root[hit]])]
            yield pa.RecordBatch.from_arrays(arrays, names=["cid", "links", "root"])

    return run


def _tiled(members: DataFrame, group: str, tile: int) -> DataFrame:
    """members (group, cid, ...) with the tiles own, lo, hi that each goes to: one where the group is small."""
    sizes = members.groupBy(group).agg(F.ceil(F.count("*") / (tile // 2)).cast("int").alias("parts")).filter("parts > 2")
    out = members.join(sizes, group, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    out = out.withColumn("own", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
    out = out.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return out.withColumns({"lo": F.least("own", "with"), "hi": F.greatest("own", "with")}).drop("with", "parts")


def _in_groups(sets: DataFrame, who: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The sets of who (cid, keys), each group in one partition, in order of cid."""
    return sets.join(_sided(who, name), "cid").repartition(*keys).sortWithinPartitions(*keys, "cid")


def _sided(df: DataFrame, name: str) -> DataFrame:
    small = written(df, name)
    return F.broadcast(small) if small.count() <= FEW else small


def verdicts(docs: DataFrame, t: float = THRESHOLD, tile: int = TILE, text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """near_duplicates, and the row digest _d1, _d2."""
    drawn = written(sketches(docs, text, bands, rows), "sketches")
    head = F.min(F.struct("doc_id", "_d1", "_d2")).alias("head")
    classes = drawn.filter("_fine").groupBy("_k1", "_k2").agg(head, F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # bands that two classes share, and who shares them
    banded = classes.select("cid", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key")
    members = written(banded.join(shared, "key"), "members")
    keys = members.groupBy("key").agg(
        F.min("cid").alias("low"), F.first("band").alias("band"), F.count("*").alias("m"), F.sum(F.shiftright(F.xxhash64("cid"), 20)).alias("set")
    )
    keys = written(keys, "keys")
    want = members.select("cid").distinct().join(classes.select("cid", "n", "head._d1", "head._d2"), "cid")
    want = _sided(want, "wanted")
    sets = written(weighted_sets(docs, want, text, bands, rows), "sets")
    # each class against the smallest of its bands that it meets most often: a first guess at who belongs together
    hits = members.join(keys.select("key", "low"), "key").filter("cid > low").groupBy("cid", "low").agg(F.count("*").alias("hits"))
    stars = hits.filter("hits > 1").groupBy("cid").agg(F.max_by("low", F.struct("hits", -F.col("low"))).alias("low"))
    stars = written(stars, "stars")
    parts = stars.groupBy("low").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    pivots = parts.select(F.col("low").alias("cid"), "low", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    arms = stars.join(parts, "low").select("cid", "low", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"))
    star = _in_groups(sets, pivots.unionByName(arms), ["low", "part"], "arms")
    edges = written(star.select("low", "part", "cid", "n", "ids", "w").mapInArrow(_star_links(t), "a long, b long").distinct(), "edges")
    groups = written(components(edges, "stars").select(F.col("id").alias("cid"), F.col("component").alias("comp")), "groups")
    # every pair inside a component; where that is one link, it is known
    lone = groups.groupBy("comp").agg(F.count("*").alias("size")).filter("size = 2").select("comp")
    inside = _in_groups(sets, _tiled(groups.join(lone, "comp", "left_anti"), "comp", tile), ["comp", "lo", "hi"], "tiles")
    inside = inside.select("comp", "lo", "hi", "own", "cid", "n", "ids", "w").mapInArrow(_group_links(t, ["comp"], False), "cid long, links long, root long")
    pairs = edges.join(lone, F.col("b") == F.col("comp"))
    pairs = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*")
    pairs = pairs.join(want.select(F.col("cid").alias("b"), "n"), "b").select(F.col("a").alias("cid"), F.col("n").alias("links"))
    # pairs across components, in bands that hold several; of bands with the same classes the first stands for all
    placed = members.join(groups, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2").select("key")
    mixed = keys.join(mixed, "key").groupBy("m", "set", "low").agg(F.min(F.struct("band", "key")).alias("one")).select("one.key")
    across = _in_groups(sets, _tiled(placed.join(mixed, "key"), "key", tile), ["key", "lo", "hi"], "mixed")
    across = across.select("key", "lo", "hi", "own", "cid", "n", "comp", "band", "bands", "ids", "w")
    across = written(across.mapInArrow(_group_links(t, ["key"], True), "cid long, links long, root long"), "across")
    roots = components(edges.union(across.select("cid", "root")), "documents").withColumnRenamed("id", "cid")
    links = inside.unionByName(across).drop("root").unionByName(pairs).groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("_k1", "_k2", "cid", "n", "head").join(links, "cid", "left").join(roots, "cid", "left")
    known = written(known.withColumn("component", F.coalesce("component", "cid")), "known")
    heads = known.filter("links > 0").groupBy("component").agg(F.min("head").alias("first"))
    known = known.join(heads, "component", "left").select(
        "_k1",
        "_k2",
        F.lit(True).alias("_fine"),
        F.col("head.doc_id").alias("class_id"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("first", "head").alias("first"),
    )
    out = drawn.select("doc_id", "_d1", "_d2", "_k1", "_k2", "_fine").join(known, ["_k1", "_k2", "_fine"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
        F.coalesce(F.struct("doc_id", "_d1", "_d2") == F.col("first"), F.lit(True)).alias("kept"),
        "_d1",
        "_d2",
    )


def near_duplicates(docs: DataFrame, t: float = THRESHOLD, tile: int = TILE, text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, component_id, kept (one of each component)."""
    return verdicts(docs, t, tile, text, **how).drop("_d1", "_d2")


def op3(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def keep_one(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with one row of each component; rows without doc_id stay."""
    marks = verdicts(docs, text=text, **how).filter("doc_id is not null").groupBy("_d1", "_d2")
    marks = marks.agg(F.min("kept").alias("kept"), (F.count("*") > 1).alias("again"), F.min("n_links").alias("links"))
    # rows of null or empty texts link with nothing, so they stay however often they are repeated
    marks = written(marks.filter("not kept or (again and links > 0)").select("_d1", "_d2", "kept"), "gone")
    few = marks.count() <= FEW
    joined = keyed(docs).join(F.broadcast(marks) if few else marks, ["_d1", "_d2"], "left")
    once = joined.filter("kept is null").select("_row")
    repeated = joined.filter("kept").groupBy("_d1", "_d2").agg(F.first("_row").alias("_row")).select("_row")
    return unpacked(once.unionByName(repeated), docs)
