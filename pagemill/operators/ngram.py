"""Language by character trigrams: a model counted from labelled texts, and its verdicts.

Texts are cut into trigrams where they are read (Arrow batches, numpy), so no row a character is ever made: training shuffles
the counts of distinct grams, a verdict nothing. The model keeps every gram it counted. It is sent to all tasks
while it has at most FEW_GRAMS rows; beyond, the distinct grams of each text are joined with it by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lang import plain_text
from ..functions.text import trimmed
from .durable import checkpointed

#: Rows of a model that is sent to all tasks (some 100 bytes each).
FEW_GRAMS = 500_000
BITS = np.uint64(21)
#: Characters that are cut at once (some 50 bytes of memory each).
MOST_CHARS = 1 << 20


def _plain(text: Column) -> Column:
    return F.lower(trimmed(plain_text(text)))


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Every trigram of each whole text, as the number of its text and a code of its three characters."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    chars = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(chars) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(texts)), sizes)
    code = (chars[:-2] << (BITS + BITS)) | (chars[1:-1] << BITS) | chars[2:]
    whole = text[:-2] == text[2:]
    return text[:-2][whole], code[whole]


def in_pieces(texts: list[str | None], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What trigrams() gives, in parts of a bounded number of characters: whole short texts together, long ones in windows that share two characters."""
    most = MOST_CHARS if most is None else most
    rows, held, size = [], [], 0

    def cut():
        at, code = trigrams(held)
        return np.array(rows, np.int64)[at], code

    for k, t in enumerate(texts):
        for start in range(0, max(len(t or "") - 2, 0), most):
            window = t[start : start + most + 2]
            if held and size + len(window) > most:
                yield cut()
                rows, held, size = [], [], 0
            rows.append(k)
            held.append(window)
            size += len(window)
    if held:
        yield cut()


def _gram(code: int) -> str:
    return chr(code >> 42) + chr(code >> 21 & 0x1FFFFF) + chr(code & 0x1FFFFF)


def _code(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def train(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, gram, gain, unseen: the log probability of a gram in a language, and of one that it hasn't seen (one is added to each)."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names, which = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
            for at, code in in_pieces(batch.column(1).to_pylist()):
                for k in np.unique(which[at]):
                    grams, n = np.unique(code[which[at] == k], return_counts=True)
                    rows = [[str(names[k])] * len(grams), [_gram(int(g)) for g in grams], n]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64())], names=["lang", "gram", "n"])

    known = texts.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string"), _plain(F.col(text)))
    counts = known.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts)
    total = counts.groupBy("lang").agg((F.sum("n") + F.count("*")).alias("total"))  # one row a language
    counts = counts.join(F.broadcast(total), "lang")
    return counts.select("lang", "gram", F.log((F.col("n") + 1) / F.col("total")).alias("gain"), F.log(1 / F.col("total")).alias("unseen"))


def lang_ngram(texts: DataFrame, model: DataFrame, key: str, text: str = "text", few: int = FEW_GRAMS) -> DataFrame:
    """key, lang: the language with the highest score, one row a text; ties go to the first by name. '' for texts without a known gram."""
    unseen = {r["lang"]: r["unseen"] for r in model.groupBy("lang").agg(F.first("unseen").alias("unseen")).orderBy("lang").collect()}  # one row a language
    langs = list(unseen)
    base = np.array([unseen[x] for x in langs])
    plain = texts.select(key, _plain(F.col(text)).alias("_t"))
    if not langs:
        return plain.select(key, F.lit("").alias("lang"))
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}[key]
    rows = model.select("lang", "gram", (F.col("gain") - F.col("unseen")).alias("gain")).limit(few + 1).toArrow()
    if rows.num_rows <= few:
        gram = np.array([_code(g) for g in rows["gram"].to_pylist()], np.uint64)
        codes, at = np.unique(gram, return_inverse=True)
        gains = np.zeros((len(codes), len(langs)))
        gains[at, [langs.index(x) for x in rows["lang"].to_pylist()]] = rows["gain"].to_numpy()
        sent = texts.sparkSession.sparkContext.broadcast((codes, gains))

        def run(batches):
            codes, gains = sent.value
            for batch in batches:
                n = batch.num_rows
                grams, hits, gained = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros((n, len(langs)))
                for at, code in in_pieces(batch.column(1).to_pylist()):
                    found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    hit = codes[found] == code
                    grams += np.bincount(at, minlength=n)
                    at, found = at[hit], found[hit]
                    hits += np.bincount(at, minlength=n)
                    for k in range(len(langs)):
                        gained[:, k] += np.bincount(at, gains[found, k], n)
                best = np.round(grams[:, None] * base + gained, 6).argmax(1)
                some = hits > 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([langs[b] if s else "" for b, s in zip(best, some)], pa.string())], names=[key, "lang"])

        return plain.mapInArrow(run, f"`{key}` {kind}, lang string")

    def cut(batches):
        for batch in batches:
            for at, code in in_pieces(batch.column(1).to_pylist()):
                order = np.lexsort((code, at))
                at, code = at[order], code[order]
                first = np.ones(len(at), bool)
                first[1:] = (at[1:] != at[:-1]) | (code[1:] != code[:-1])
                start = np.flatnonzero(first)
                n = np.diff(np.append(start, len(at)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[start])), pa.array([_gram(int(c)) for c in code[start]], pa.string()), pa.array(n, pa.int64())], names=["_id", "gram", "n"])

    model = checkpointed(model)
    wide = model.groupBy("gram").pivot("lang", langs).agg(F.first(F.col("gain") - F.col("unseen")))
    wide = wide.select("gram", F.array(*[F.coalesce(F.col(f"`{x}`"), F.lit(0.0)) for x in langs]).alias("gains"))
    # a text is known by a number of its own: keys may repeat or be null
    numbered = checkpointed(plain.withColumn("_id", F.monotonically_increasing_id()))
    grams = numbered.select("_id", "_t").mapInArrow(cut, "_id long, gram string, n long").join(wide, "gram", "left")
    sums = [F.sum(F.coalesce(F.get("gains", k), F.lit(0.0)) * F.col("n")).alias(f"s{k}") for k in range(len(langs))]
    score = grams.groupBy("_id").agg(F.sum("n").alias("n"), F.count("gains").alias("hits"), *sums).filter("hits > 0")
    each = [F.struct(F.round(F.col(f"s{k}") + F.col("n") * F.lit(float(base[k])), 6).alias("score"), F.lit(-k).alias("k"), F.lit(x).alias("lang")) for k, x in enumerate(langs)]
    best = score.select("_id", F.array_max(F.array(*each))["lang"].alias("lang"))
    return numbered.select("_id", key).join(best, "_id", "left").select(key, F.coalesce("lang", F.lit("")).alias("lang"))
