"""Links of pages: extraction, filtering, classification by title, rule and path statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.domain import domain_parse, domain_top
from ..functions.lang import HAN, WORD_LANGS
from ..functions.text import blank, built_once, let, normalise_space, remove_lines, trimmed

CONTENT, LIST, UNKNOWN, NONE = "CONTENT", "LIST", "UNKNOWN", "NONE"
ZH_SHORT = ("5g", "ai", "cba", "ipo", "it", "nba")
ZH_SIGNS = "[！（），：；？“”。]"
LICENCE = "(?:信息服务|出版服务|出版|视听节目|视听|新闻|新网|演出|制作|经营)许可证"


def page_links(links: Column, base: Column) -> Column:
    """array<struct(href, url, title)> of a page's links, each target once, made inside the row.

    Of links with one href the longest title counts (in bytes; of equals the first), then of hrefs that resolve alike the longest, then the smallest.
    """
    first = lambda a, same: let(F.array_sort(a), lambda x: F.filter(x, lambda e, i: (i == 0) | ~same(e, F.get(x, i - 1))))
    read = F.transform(links, lambda l: F.struct(trimmed(remove_lines(l["href"])).alias("href"), l["pos"].alias("pos"), normalise_space(l["title"]).alias("title")))
    read = F.filter(read, lambda e: (e["href"] != "") & (e["title"] != ""))
    read = F.transform(read, lambda e: F.struct(e["href"].alias("href"), (-F.octet_length(e["title"])).alias("n"), e["pos"].alias("pos"), e["title"].alias("title")))
    once = first(read, lambda a, b: a["href"] == b["href"])

    def resolved(e: Column) -> Column:
        bad = e["href"].rlike(urls.ILLEGAL)
        url = F.when(bad, e["href"]).otherwise(urls.url_resolve(e["href"], base))
        return F.struct(url.alias("url"), bad.alias("bad"), e["n"].alias("n"), e["title"].alias("title"), e["href"].alias("href"))

    return first(F.transform(once, resolved), lambda a, b: (a["url"] == b["url"]) & (a["bad"] == b["bad"]))


@built_once
def _found() -> Column:
    return F.when(F.col("base").isNotNull(), page_links(F.col("links"), F.col("base")))


@built_once
def _reason(strict: bool) -> Column:
    return urls.url_reason(F.col("href"), F.col("url"), F.col("base"), F.lit(strict), F.col("_top"), F.col("_base_top"))


@built_once
def _kind() -> Column:
    return link_by_title(F.col("url"), F.col("title"), F.col("lang"))


def web_links(features: DataFrame, strict: bool = True, carry: tuple[str, ...] = (), outer: bool = False) -> DataFrame:
    """page_id, base, url, title, reason (null for accepted links), and the page's columns in carry. No shuffle.

    A null base gives no links. outer: a page without links has one row, with a null url.
    """
    pages = features.select("page_id", F.col("url").alias("base"), *carry, "links")
    if strict:
        pages = domain_parse(pages.withColumn("_base_host", urls.hostname(F.col("base"))), "_base_host", "_b").withColumn("_base_top", domain_top(F.col("_b")))
    else:
        pages = pages.withColumn("_base_top", F.lit(""))
    found = _found()
    out = pages.select("page_id", "base", *carry, "_base_top", (F.explode_outer if outer else F.explode)(found).alias("l"))
    out = out.select("page_id", "base", *carry, "_base_top", "l.url", "l.title", "l.href")
    if strict:
        out = domain_parse(out.withColumn("_host", urls.hostname(F.col("url"))), "_host", "_d").withColumn("_top", domain_top(F.col("_d")))
    else:
        out = out.withColumn("_top", F.lit(""))
    return out.select("page_id", "base", "url", "title", _reason(strict).alias("reason"), *carry)


def link_by_title(url: Column, title: Column, lang: Column) -> Column:
    """Class of a link by its address and title alone."""
    t, l = blank(title), blank(lang)  # noqa: E741
    han = F.regexp_count(t, F.lit(HAN))
    tight = F.replace(t, F.lit(" "), F.lit(""))
    bare = F.regexp_replace(t, "\\p{P}", "")
    words = F.size(F.filter(F.split(bare, " "), lambda x: F.trim(x) != ""))
    zh = (
        F.when(han == 0, F.when(F.lower(t).isin(*ZH_SHORT), LIST).otherwise(NONE))
        .when(han <= 5, LIST)
        .when(F.char_length(tight) >= 8, CONTENT)
        .when(tight.rlike(ZH_SIGNS), CONTENT)
        .otherwise(UNKNOWN)
    )
    spaced = F.when(~bare.rlike("[a-zA-Z]"), NONE).when(words >= 5, CONTENT).otherwise(LIST)
    return (
        F.when(F.char_length(blank(url)) > 255, NONE)
        .when(urls.no_path(urls.path(url)), NONE)
        .when(l == "zh", zh)
        .when(l.isin(*WORD_LANGS), spaced)
        .when(F.char_length(bare) >= 8, CONTENT)
        .otherwise(LIST)
    )


def link_by_regex(links: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds by_rule: does a rule for the link's host, or else for its registrable domain, match the URL?

    rules: host, regex; a dictionary that sites keep by hand, broadcast when Spark finds it small.
    """
    side = rules.groupBy("host").agg(F.collect_list("regex").alias("regexes"))
    work = domain_parse(links.withColumn("_host", urls.hostname(F.col("url"))), "_host", "_d")
    work = work.withColumn("_top", domain_top(F.col("_d")))
    work = work.join(side.select(F.col("host").alias("_host"), F.col("regexes").alias("_own")), "_host", "left")
    work = work.join(side.select(F.col("host").alias("_top"), F.col("regexes").alias("_general")), "_top", "left")
    hit = F.exists(F.coalesce("_own", "_general"), lambda r: F.call_function("rlike", F.col("url"), r))
    return work.withColumn("by_rule", F.coalesce(hit, F.lit(False))).select(*links.columns, "by_rule")


def link_clean(kind: Column, title: Column, lang: Column) -> Column:
    return F.when((blank(lang) == "zh") & (kind == CONTENT) & blank(title).rlike(LICENCE), NONE).otherwise(kind)


def link_path_stats(links: DataFrame, kind: str = "kind") -> DataFrame:
    """page_id, content, dated, top_paths of the CONTENT links of each page."""
    seg = urls.path_first_seg(trimmed(urls.path(F.col("url"))))
    c = links.filter(F.col(kind) == CONTENT).select("page_id", seg.alias("seg"), urls.url_publish_date(urls.path(F.col("url"))).alias("d"))
    by_seg = c.groupBy("page_id", "seg").agg(F.count("*").alias("n"), F.count_if("d").alias("d"))
    pairs = F.collect_list(F.when(F.col("seg").isNotNull() & (F.col("n") > 1), F.struct("seg", "n")))
    out = by_seg.groupBy("page_id").agg(F.sum("n").alias("content"), F.sum("d").alias("dated"), pairs.alias("_p"))
    often = F.filter("_p", lambda x: (x["n"] / F.col("content") > 0.4) & (F.col("content") >= 8))
    return out.select("page_id", "content", "dated", F.array_sort(F.transform(often, lambda x: x["seg"])).alias("top_paths"))


def link_path_process(links: DataFrame, kind: str = "kind") -> DataFrame:
    """Reclassifies links of a page by what the paths of its CONTENT links look like (counted before any change)."""
    work = links
    for step in _path_steps(kind):
        work = work.withColumns(step)
    return work.select(*links.columns)


@built_once
def _path_steps(kind: str) -> list[dict[str, Column]]:
    page = Window.partitionBy("page_id")
    where = trimmed(urls.path(F.col("url")))
    own = F.count_if("_is").over(Window.partitionBy("page_id", "_seg"))
    publish = F.coalesce(F.try_divide("_dates", "_content") > 0.7, F.lit(False))
    long = F.char_length(blank(F.col("title"))) >= 2
    k = F.col(kind)
    a = F.when((k == LIST) & F.col("_dated") & long, CONTENT).when(k == UNKNOWN, F.when(F.col("_dated") & long, CONTENT).otherwise(LIST)).otherwise(k)
    b = F.when((k == UNKNOWN) & F.col("_seg").isNotNull(), F.when(F.col("_top") & long, CONTENT).otherwise(LIST)).otherwise(k)
    bare = (F.col("_where") == "") | (F.col("_where") == "/") | F.col("_seg").isNull()
    c = (F.col(kind) == CONTENT) & (F.col("_content") > 0) & (publish | F.col("_tops")) & bare
    return [
        {"_where": where},
        {"_seg": urls.path_first_seg(F.col("_where")), "_dated": urls.url_publish_date(F.col("_where")), "_is": F.col(kind) == CONTENT},
        {
            "_own": F.when(F.col("_seg").isNotNull(), own).otherwise(0),
            "_content": F.count_if("_is").over(page),
            "_dates": F.count_if(F.col("_is") & F.col("_dated")).over(page),
        },
        {"_top": (F.col("_own") > 1) & (F.col("_own") / F.col("_content") > 0.4) & (F.col("_content") >= 8)},
        {"_tops": F.coalesce(F.bool_or("_top").over(page), F.lit(False))},
        {kind: F.when(publish, a).when(F.col("_tops"), b).otherwise(k)},
        {kind: F.when(c, UNKNOWN).otherwise(F.col(kind))},
    ]


def link_types(links: DataFrame, rules: DataFrame | None = None, accepted: Column | None = None) -> DataFrame:
    """links (page_id, url, title, lang) with kind. With rules, they decide instead of titles and paths.

    accepted: links for which it is false have no kind and don't count in the statistics of their page.
    """
    fine = F.lit(True) if accepted is None else accepted
    if rules is None:
        out = links.withColumn("kind", F.when(fine, _kind()))
        out = link_path_process(out)
    else:
        out = link_by_regex(links, rules)
        kind = F.when(F.col("by_rule"), CONTENT).when(urls.no_path(urls.path(F.col("url"))), NONE).otherwise(LIST)
        out = out.withColumn("kind", F.when(fine, kind)).drop("by_rule")
    return out.withColumn("kind", link_clean(F.col("kind"), F.col("title"), F.col("lang")))


def subdomains(links: DataFrame) -> DataFrame:
    """page_id, subdomain: distinct hosts of accepted links that are more than a registrable domain."""
    hosts = links.select("page_id", urls.hostname(F.col("url")).alias("subdomain")).filter("subdomain <> ''").distinct()
    parsed = domain_parse(hosts, "subdomain", "_d")
    return parsed.filter(F.col("subdomain") != domain_top(F.col("_d"))).select("page_id", "subdomain")


def link_counts(typed: DataFrame) -> DataFrame:
    return typed.groupBy("page_id").agg(F.count_if(F.col("kind") == CONTENT).alias("content_count"), F.count_if(F.col("kind") == LIST).alias("list_count"))


def friend_domains(features: DataFrame) -> DataFrame:
    """page_id, domain, title: front pages of other registrable domains that a page links to."""
    links = web_links(features, strict=False).filter("reason is null")
    work = links.withColumns({"_host": urls.hostname(F.col("url")), "_base": urls.hostname(F.col("base")), "_p": urls.path(F.col("url"))})
    work = work.filter((F.col("_p").isin("", "/", "/index.html", "/index.htm", "/index.shtml")) & (F.col("_host") != ""))
    work = domain_parse(domain_parse(work, "_host", "_d"), "_base", "_b")
    work = work.withColumn("domain", domain_top(F.col("_d"))).filter((F.col("domain") != "") & (F.col("domain") != domain_top(F.col("_b"))))
    return work.groupBy("page_id", "domain").agg(F.min_by("title", F.struct(-F.octet_length("title"), "title")).alias("title"))
