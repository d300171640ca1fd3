"""Main content by tag-path features of the node table (content extraction by path features).

The bottom-up fold of the page tree is relational: nodes come with pre-order intervals, so every additive
measure of a subtree is a difference of two prefix sums. The one below the node is on the same row; the one at
the interval's end is fetched by an equi-join on (page_id, pre = end). No recursion, no range join.

A page's nodes are written by one task next to each other, but Spark doesn't know: the windows partition by
page_id, one shuffle of narrow rows that the join, the density sum and the arg-max all reuse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_space


def leaf_variance(n: Column, total: Column, squares: Column) -> Column:
    """Population variance of n leaves; half the value for one, 0 for none."""
    n = n.cast("double")
    mean = F.try_divide(total.cast("double"), n)
    return F.when(n == 0, 0.0).when(n == 1, total / 2).otherwise(F.greatest(F.try_divide(squares.cast("double"), n) - mean * mean, F.lit(0.0)))


def node_score(variance: Column, density_sum: Column, text: Column, p: Column) -> Column:
    """ln(sqrt(variance + 1)) * density sum * ln(text + 1) * log10(paragraphs + 1)."""
    return F.log(F.sqrt(variance + 1)) * density_sum * F.log(text + 1.0) * F.log10(p + 1.0)


def node_stats(nodes: DataFrame) -> DataFrame:
    """Element rows with text, link_text, tags, link_tags, p, leaves, density, density_sum, variance and score."""
    element = F.col("tag") != "#text"
    size = F.when(element, 0).otherwise(F.char_length(normalise_space(F.col("text")))).cast("long")
    n = nodes.select(
        "page_id", "pre", "end", "parent", "tag", size.alias("size"), element.alias("element"),
        (F.col("tag") == "a").alias("is_a"), (F.col("tag") == "p").alias("is_p"),
    )
    upto = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    # text under a link: the last link opened so far that hasn't ended
    link_end = F.max(F.when(F.col("is_a"), F.col("end"))).over(upto)
    n = n.withColumn("linked", F.coalesce(link_end >= F.col("pre"), F.lit(False)))
    one = {
        "text": F.col("size"),
        "link_text": F.when(F.col("linked"), F.col("size")).otherwise(F.lit(0)),
        "tags": F.col("element").cast("long"),
        "link_tags": F.col("is_a").cast("long"),
        "p": F.col("is_p").cast("long"),
        "leaves": (~F.col("element")).cast("long"),
        "squares": F.col("size") * F.col("size"),
    }
    sums = n.withColumns({f"c_{k}": F.sum(v).over(upto) for k, v in one.items()}).withColumns({f"o_{k}": v for k, v in one.items()})
    ends = sums.select("page_id", F.col("pre").alias("end"), *[F.col(f"c_{k}").alias(f"e_{k}") for k in one])
    sub = sums.filter("element").join(ends, ["page_id", "end"])
    sub = sub.select("page_id", "pre", "end", "parent", "tag", "is_a", "linked", *[(F.col(f"e_{k}") - F.col(f"c_{k}") + F.col(f"o_{k}")).alias(k) for k in one])
    # inside a link its own text doesn't count as link text: the link assigns it and passes it upwards
    sub = sub.withColumn("link_text", F.when(F.col("linked") & ~F.col("is_a"), F.lit(0)).otherwise(F.col("link_text")))
    text, tags = F.col("text") - F.col("link_text"), F.col("tags") - F.col("link_tags")
    sub = sub.withColumn("density", F.when((text == 0) | (tags == 0), 0.0).otherwise(text / tags))
    below = sub.filter("parent is not null").groupBy("page_id", "parent").agg(F.sum("density").alias("density_sum"))
    below = below.withColumnRenamed("parent", "pre")
    sub = sub.join(below, ["page_id", "pre"], "left").withColumn("density_sum", F.coalesce("density_sum", F.lit(0.0)))
    sub = sub.withColumn("variance", leaf_variance(F.col("leaves"), F.col("text"), F.col("squares")))
    score = node_score(F.col("variance"), F.col("density_sum"), F.col("text") - F.col("link_text"), F.col("p"))
    return sub.withColumn("score", score).drop("is_a", "linked")


def content_node(stats: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, pre, end, tag, score of each page's best element below body, links left out; ties: first in the page."""
    body = nodes.filter("tag = 'body'").groupBy("page_id").agg(F.min(F.struct("pre", "end")).alias("body"))
    inside = stats.join(body, "page_id").filter("pre > body.pre and pre <= body.end and tag <> 'a' and score > 0")
    best = F.max(F.struct("score", (-F.col("pre")).alias("back"), "end", "tag")).alias("best")
    return inside.groupBy("page_id").agg(best).select("page_id", (-F.col("best.back")).alias("pre"), "best.end", "best.tag", "best.score")
