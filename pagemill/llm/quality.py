"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Measures are built-in expressions over the whole text; every rule is a row (name, measure, low, high)
and fails a document whose measure lies outside [low, high]. Null and empty texts have no words:
every count is 0, ratios are 0, and they fail the length rule. Rows are independent, so repeated
rows get repeated results and there are no ties; an empty table gives no rows; texts are read whole, however long. Extra
columns are kept as they are (a clash with an output name, __words, __lines or __m replaces the incoming column; keep() loses none).
Where a column of languages is named, the rule on stop words binds those of LANGS and rows without a language alone.

Repeats in 3-word windows are found by sorting (hash, position) pairs inside the row, unless all its hashes are distinct. The 64-bit
hash only finds pairs to compare; the words themselves are compared before a window counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, table, unpacked, words

STOP_WORDS = (
    "the and of to in is it for was on are be with as at by this that from or an a not "
    "le la les de des du et en un une est que qui dans pour par au aux sur pas avec il elle "
    "der die das und ist nicht ein eine zu den von mit sich auf für im dem auch es an als "
    "el los las y que del se por con para su no lo al una como"
).split()

LANGS = ("en", "fr", "de", "es")


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float
    high: float


RULES = (
    Rule("length", "n_words", 50, float("inf")),
    Rule("repeats", "repeat_ratio", 0, 0.5),
    Rule("symbols", "symbol_ratio", 0, 0.1),
    Rule("word_length", "mean_word_chars", 2.5, 12),
    Rule("stop_words", "stop_ratio", 0.02, 1),
    Rule("repeated_lines", "dup_line_ratio", 0, 0.4),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _repeat_words(w: str) -> Column:
    """Words of array column w that lie in a 3-word window found twice or more."""
    n = F.size(w)
    hashes = F.transform(
        F.slice(F.col(w), F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get(F.col(w), i + 1), F.get(F.col(w), i + 2)),
    )

    def same(a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(3):
            equal = equal & (F.get(F.col(w), a["i"] + k) == F.get(F.col(w), b["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def positions(s: Column) -> Column:
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
            lambda a: a["n"],
        )

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.transform(F.transform(F.array(pairs), positions), covered)[0]
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(found)

    # one-element arrays bind the hashes, the sorted pairs and the positions once
    return F.transform(F.array(hashes), count)[0]


def measures(docs: DataFrame, text: str = "text", lang: str | None = None) -> DataFrame:
    """docs with the base counts and the ratios that the rules read; stop_ratio is null for languages without stop words here."""
    spoken = F.lit(True) if lang is None else F.coalesce(F.lower(F.col(lang)).isin(*LANGS), F.lit(True))
    t = F.coalesce(F.col(text), F.lit(""))
    symbols = "#*$%&|<>"
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\n\x0b\x0c\r]"))
    out = docs.withColumns({"__words": words(F.col(text)), "__lines": lines})
    counts = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.array_join("__words", "")).cast("long"),
        # a search first: most texts hold no symbol, and translate looks at each character
        "n_symbols": F.when(t.rlike(f"[{symbols}]"), F.length(t) - F.length(F.translate(t, symbols, ""))).otherwise(F.lit(0)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_repeat_words": F.coalesce(_repeat_words("__words"), F.lit(0)).cast("long"),
        "n_stop_words": F.size(F.filter("__words", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
    }
    # an explode of one row bars a filter on the result from being pushed below, where it would repeat the counts
    one = F.explode(F.array(F.struct(*[v.alias(k) for k, v in counts.items()])))
    out = out.select(*[f"`{c}`" for c in out.columns if c not in counts and c != "__m"], one.alias("__m")).select("*", "__m.*").drop("__m")
    return out.withColumns(
        {
            "repeat_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
            "symbol_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
            "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
            "stop_ratio": F.when(spoken, _ratio(F.col("n_stop_words"), F.col("n_words"))),
            "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        }
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The rule table as one expression: the names of the rules that a row breaks."""
    broken = [F.when((F.col(r.measure) < r.low) | (F.col(r.measure) > r.high), F.lit(r.name)) for r in rules]
    return F.array_compact(F.array(*broken))


def quality(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = None) -> DataFrame:
    """docs with measures, broken (rule names), base_failed and kept."""
    out = measures(docs, text, lang)
    out = out.withColumn("broken", compile_rules(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, lang: str | None = None) -> DataFrame:
    """The rows of docs that break no rule, with its columns."""
    rows = packed(docs).withColumn("text", F.col("_row").getField(text))
    if lang is not None:
        rows = rows.withColumn("lang", F.col("_row").getField(lang))
    return unpacked(quality(rows, "text", rules, lang and "lang").filter("kept"), docs)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs.select("doc_id", "text", "lang"), lang="lang").select(
        "doc_id", *BASE, "base_failed", "kept", F.array_join("broken", ",").alias("broken")
    )
