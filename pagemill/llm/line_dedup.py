"""Line dedup by a log-template tree.

A line of MIN_TOKENS words or more goes down a tree of fixed depth: its token count, then its LEAD leading
tokens, with tokens that hold a digit read as variable. In the leaf it joins the template that it
agrees with in most positions (SIMILAR of them at least), whose differing positions become variable, or
founds one. A template found in MIN_TEXTS different texts or more recurs: its lines are dropped from every
text but the first that has it (smallest doc_id), so each passage stays once in the corpus. Two texts are enough
for a template of LONG words or more, and for equal lines of any count: there lines don't agree by chance.
With pairs=False two texts never are.

A leaf can only hold a recurring template if different texts reach it, so a first pass over hashes
alone finds those leaves; only their distinct lines are shuffled, counted with digits masked (lines that differ in such
tokens alone are one), and clustered, the commonest first. A leaf is streamed by one task that keeps templates, not lines, and finds those
that a line can join by an index of tokens and positions. Texts are counted once however many copies there are, and take the same
decision: drops are joined by the text's 128-bit digest, never by row.

Words are split by one rule (space and \\t to \\r) and digits are 0 to 9, in the tree and in the templates.
Null and empty texts have no lines and stay as they are; a null doc_id counts as the last; repeated
rows are copies; ties of templates go to the earlier. Texts are read whole, however long and with however many lines. Incoming columns of
any name stay apart in one struct. An empty table gives no rows. Blank and short lines always stay, and so does the order.
"""

from __future__ import annotations

from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, packed, table, unpacked, words, written

LEAD, SIMILAR, MIN_TEXTS, MIN_TOKENS, LONG = 3, 0.6, 3, 4, 10
VARIABLE = "<*>"
#: Sides of at most so many keys (8 bytes, in a hash table 24) are broadcast: 12 and 24 MB; beyond, both sides are shuffled.
FEW_LEAVES, FEW_DROPS = 500_000, 1_000_000


class Leaf:
    """Templates of one leaf, with an index of what stands where in them."""

    def __init__(self, similar: float = SIMILAR):
        self.similar, self.templates, self.founders = similar, [], []
        self.index: dict[tuple[int, str], set[int]] = {}

    def add(self, masked: list[str], founder: int) -> int:
        """The founder of the template that the line (its digit-bearing tokens masked) joins: the one it agrees with most, the first of equals."""
        need = ceil(self.similar * len(masked) - 1e-9)
        # of any len - need + 1 positions a template within reach agrees in one: those with the fewest templates tell
        places = sorted((self.index.get(x, ()) for x in enumerate(masked)), key=len)
        near = set().union(*places[: len(masked) - need + 1])
        best, most = -1, need - 1
        for k in sorted(near):
            n = sum(map(str.__eq__, self.templates[k], masked))
            if n > most:
                best, most = k, n
        if best < 0:
            self.templates.append(list(masked))
            self.founders.append(founder)
            for x in enumerate(masked):
                self.index.setdefault(x, set()).add(len(self.templates) - 1)
            return founder
        template = self.templates[best]
        for at, (a, b) in enumerate(zip(template, masked)):
            if a != b and a != VARIABLE:
                self.index[at, a].discard(best)
                self.index.setdefault((at, VARIABLE), set()).add(best)
                template[at] = VARIABLE
        return self.founders[best]


def _masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(VARIABLE)).otherwise(t))


def _digests(text: Column) -> dict[str, Column]:
    return {"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit("second"), text)}


def _cluster(similar: float):
    def run(batches):
        at, leaf = None, None
        for batch in batches:
            keys, hashes, lines = (batch.column(i).to_pylist() for i in range(3))
            out = []
            for key, h, line in zip(keys, hashes, lines):
                if at != key:
                    at, leaf = key, Leaf(similar)
                out.append(leaf.add(line.split(" "), h))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.int64())], names=["leaf", "masked_hash", "template"])

    return run


def recurring_lines(docs: DataFrame, text: str = "text", min_texts: int = MIN_TEXTS, similar: float = SIMILAR, pairs: bool = True) -> DataFrame:
    """_k1, _k2 (digest of a text) and drop: hashes of the lines that go from it."""
    t, least = F.col(text), min(2, min_texts) if pairs else min_texts
    source = docs.filter(t.isNotNull()).select(F.col("doc_id").cast("long"), *[c.alias(k) for k, c in _digests(t).items()], F.split(t, "\n").alias("lines"))
    lines = source.select("doc_id", "_k1", "_k2", F.explode(F.array_distinct("lines")).alias("line"))
    # an explode keeps the tokens from being split once for each use
    lines = lines.select("*", F.explode(F.array(words(F.col("line")))).alias("tokens")).filter(F.size("tokens") >= MIN_TOKENS)
    leaf = F.xxhash64(F.size("tokens"), _masked(F.slice("tokens", 1, LEAD))).alias("leaf")
    lines = lines.select("doc_id", "_k1", "_k2", "line", "tokens", leaf)
    leaves = lines.groupBy("leaf").agg(F.min("_k1").alias("a"), F.max("_k1").alias("b")).filter("a <> b").select("leaf")
    leaves = written(leaves, "leaves")
    few = leaves.count() <= FEW_LEAVES
    lines = lines.join(F.broadcast(leaves) if few else leaves, "leaf", "left_semi")
    masked = F.array_join(_masked(F.col("tokens")), " ").alias("masked")
    lines = lines.select("leaf", F.xxhash64("line").alias("line_hash"), "_k1", "_k2", "doc_id", F.size("tokens").alias("size"), masked)
    seen = lines.groupBy("leaf", "line_hash", "_k1", "_k2").agg(F.min("doc_id").alias("doc"), F.first("size").alias("size"), F.first("masked").alias("masked"))
    seen = written(seen.withColumn("masked_hash", F.xxhash64("masked")), "lines")
    distinct = seen.groupBy("leaf", "masked_hash").agg(F.count("*").alias("n"), F.first("masked").alias("masked"))
    enough = seen.groupBy("leaf").agg(F.count("*").alias("texts")).filter(F.col("texts") >= least).select("leaf")
    run = distinct.join(enough, "leaf").repartition("leaf").sortWithinPartitions("leaf", F.col("n").desc(), "masked_hash")
    named = run.select("leaf", "masked_hash", "masked").mapInArrow(_cluster(similar), "leaf long, masked_hash long, template long")
    found = seen.drop("masked").join(named, ["leaf", "masked_hash"])
    found = written(found, "found")
    place = F.struct(F.coalesce("doc", F.lit((1 << 63) - 1)).alias("doc"), "_k1", "_k2")
    per_text = found.groupBy("leaf", "template", "_k1", "_k2").agg(F.min("doc").alias("doc"), F.first("size").alias("size"))
    recur = per_text.groupBy("leaf", "template").agg(F.count("*").alias("texts"), F.min(place).alias("first"), F.first("size").alias("size"))
    recur = recur.filter(F.col("texts") >= F.when(F.col("size") >= LONG, least).otherwise(min_texts)).drop("size")
    later = "not (_k1 = first._k1 and _k2 = first._k2)"
    gone = found.join(recur, ["leaf", "template"]).filter(later).select("_k1", "_k2", "line_hash")
    if least < min_texts:
        same = found.filter(F.col("size") < LONG).groupBy("leaf", "line_hash").agg(F.count("*").alias("texts"), F.min(place).alias("first"))
        same = found.join(same.filter(F.col("texts") >= least), ["leaf", "line_hash"]).filter(later)
        gone = gone.unionByName(same.select("_k1", "_k2", "line_hash"))
    return gone.groupBy("_k1", "_k2").agg(F.collect_set("line_hash").alias("drop"))


def line_dedup(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with recurring lines gone from the text, and n_lines, n_dropped."""
    drops = written(recurring_lines(docs, text, **how), "drops")
    size = drops.agg(F.count("*"), F.sum(F.size("drop"))).first()
    few = (size[0] or 0) * 3 + (size[1] or 0) <= FEW_DROPS
    text_ = F.col("_row").getField(text)
    joined = packed(docs).withColumns(_digests(text_)).join(F.broadcast(drops) if few else drops, ["_k1", "_k2"], "left")
    joined = joined.withColumn("_lines", F.split(text_, "\n"))
    left = F.filter("_lines", lambda x: ~F.array_contains(F.col("drop"), F.xxhash64(x)))
    joined = joined.withColumn("_left", F.when(F.col("drop").isNotNull(), left))
    n = F.when(text_.isNull(), F.lit(0)).otherwise(F.size("_lines"))
    dropped = F.when(F.col("drop").isNull(), F.lit(0)).otherwise(F.size("_lines") - F.size("_left"))
    new = F.when(F.col("drop").isNull(), text_).otherwise(F.array_join("_left", "\n"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[(new if c == text else F.col("_row").getField(c)).alias(c) for c in own],
        n.cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )


def keep_rest(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with its columns and without recurring lines; n_chars follows, and texts that lose their last word go."""
    out = line_dedup(packed(docs).withColumns({"doc_id": F.col("_row.doc_id"), "text": F.col("_row").getField(text)}), **how)
    n = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("_row").getField("n_chars"))
    left = (F.col("n_dropped") == 0) | F.regexp_like("text", F.lit(WORD))
    return unpacked(out.filter(left), docs, **{text: F.col("text"), "n_chars": n})


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs)
