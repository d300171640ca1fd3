"""News records: the cascades that find title and publish time of a page, and the record itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, urls
from ..functions.domain import domain_parse, domain_top
from ..functions.lang import WORD_LANGS
from ..functions.text import blank, built_once, let, similarity, trimmed
from ..functions.titles import content_title_clean, web_title
from .durable import checkpointed
from .page import page_features

REFRESH = "(?i)http-equiv\\s*=\\s*[\"']?\\s*refresh"
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
QUOTED = "(?i)\"title\"[\\t ]{0,4}:[\\t ]{0,4}\"(.*)\""


def title_threshold(lang: Column) -> Column:
    return F.when(blank(lang).isin(*WORD_LANGS), 0.5).otherwise(0.3)


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def title_by_origin(headings: Column, origin: Column, least: Column) -> Column:
    """The last heading similar to the text of the link that led here."""
    good = F.filter(_strings(headings), lambda h: similarity(h, origin) > least)
    return F.when(blank(origin) == "", "").otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), F.lit("")))


def title_by_meta(metas: Column, title: Column, least: Column) -> Column:
    """og:title, then twitter:title; the shorter of it and the page's title. title: cleaned."""
    value = lambda test: F.get(F.transform(F.filter(F.coalesce(metas, F.array().cast(times.META)), test), lambda m: trimmed(m["content"])), 0)
    found = F.array_compact(
        F.array(
            value(lambda m: F.lower(blank(m["property"])) == "og:title"),
            value(lambda m: F.lower(blank(m["property"])) == "twitter:title"),
            value(lambda m: F.lower(blank(m["name"])) == "twitter:title"),
        )
    )
    found = F.filter(found, lambda t: t != "")
    similar = F.get(F.filter(found, lambda t: similarity(t, title) > least), 0)
    shorter = F.when(F.char_length(similar) < F.char_length(title), similar).otherwise(title)
    return F.coalesce(F.when(blank(title) == "", F.get(found, 0)).when(similar.isNotNull(), shorter), F.lit(""))


def title_by_script(scripts: Column, title: Column, least: Column) -> Column:
    """The last quoted "title" in a script that is similar to the page's. Scripts may hold character references, which stand for signs: it is compared without them too."""
    near = lambda q: F.greatest(similarity(q, title), similarity(F.regexp_replace(q, REFERENCE, ""), title)) > least
    quoted = F.transform(_strings(scripts), lambda s: trimmed(F.regexp_extract(F.regexp_replace(s, "[\\r\\n]+", " "), QUOTED, 1)))
    return F.coalesce(F.try_element_at(F.filter(quoted, lambda q: (q != "") & near(q)), F.lit(-1)), F.lit(""))


def title_by_heading(headings: Column, title: Column, least: Column) -> Column:
    """The heading most similar to the page's title; the first of equals."""
    scored = F.transform(_strings(headings), lambda h, i: F.struct(similarity(h, title).alias("s"), (-i).alias("i"), h.alias("h")))
    best = F.array_max(F.filter(scored, lambda x: x["s"] > least))
    return F.when(blank(title) == "", "").otherwise(F.coalesce(best["h"], F.lit("")))


def title_by_selector(titled: Column, title: Column, least: Column) -> Column:
    """The first element named like a title whose text is similar to the page's title."""
    return F.coalesce(F.get(F.filter(_strings(titled), lambda x: similarity(x, title) > least), 0), F.lit(""))


def news_title(origin: Column, title: Column, lang: Column) -> Column:
    """struct(title, title_pos): the first of the cascade that finds one. Reads the features of the row."""
    least = title_threshold(lang)
    clean = content_title_clean(web_title(title), lang)

    def cascade(t: Column) -> Column:
        tries = (
            (title_by_origin(F.col("headings"), origin, least), "headline"),
            (title_by_meta(F.col("metas"), t, least), "meta"),
            (title_by_script(F.col("scripts"), t, least), "script"),
            (F.when(F.col("content").isNotNull(), title_by_heading(F.col("headings"), t, least)).otherwise(""), "headline"),
            (title_by_selector(F.col("titled"), t, least), "selector"),
            (t, "title"),
        )
        found = [F.when(c != "", F.struct(c.alias("title"), F.lit(pos).alias("title_pos"))) for c, pos in tries]
        return F.coalesce(*found, F.struct(F.lit("").alias("title"), F.lit("").alias("title_pos")))

    return let(clean, cascade)


def news_time(url: Column, lang: Column, title: Column, title_pos: Column, as_of: Column | None = None) -> Column:
    """struct(time, time_pos, english): the first of the cascade that finds one. Reads the features of the row."""
    metas, text = F.col("metas"), F.col("news_text")
    tag, by_lang = times.time_by_tag(F.col("datetime"), lang), times.time_by_lang(text, lang, title, title_pos, as_of)
    no = F.lit(False)
    tries = (
        (times.time_by_meta(metas, lang), "meta", no),
        (times.time_by_meta_en(metas, lang), "meta", F.lit(True)),
        (tag["time"], "tag", tag["english"]),
        (times.time_by_script(F.col("scripts")), "script", no),
        (times.time_by_body(text, lang, title, title_pos, as_of), "body", no),
        (by_lang["time"], "lang", by_lang["english"]),
        (times.time_by_url(url), "url", no),
    )
    pair = lambda c, pos, en: F.struct(c.alias("time"), F.lit(pos).alias("time_pos"), en.alias("english"))
    return F.coalesce(*[F.when(c != "", pair(c, pos, en)) for c, pos, en in tries], pair(F.lit(""), "", no))


@built_once
def _record(origin: str | None, charset: bool) -> list[dict[str, Column]]:
    """The steps from a page's features to its language, title and time."""
    from .sites import page_lang

    return [
        {"_l": page_lang("para_text", charset)},
        {"lang": F.col("_l.lang"), "_t": news_title(F.col(origin) if origin else F.lit(""), F.col("title"), F.col("_l.lang"))},
        {"_d": news_time(F.col("url"), F.col("lang"), F.col("_t.title"), F.col("_t.title_pos"), F.col("_as_of"))},
        {"time": times.format_time(F.col("_d.time"), F.col("_d.english"))},
        {"time_local": times.parse_time(F.col("time"))},
    ]


def extract_news(pages: DataFrame, origin: str | None = None, as_of: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One news record per page: title, time, content and language, with where each was found.

    pages: page_id, url, html, a column of anchor texts if `origin` names one, charset if it isn't UTF-8, and those in carry. One pass, no shuffle.
    """
    f = page_features(
        pages, "title", "html_lang", "xml_lang", "content_language", "meta_lang", "metas", "scripts", "para_text", "headings", "titled", "datetime",
        "news_text", "content", "content_tag", "content_pre", "content_html",
    )
    f = f.withColumn("_as_of", F.current_timestamp() if as_of is None else as_of)
    for step in _record(origin, "charset" in pages.columns):
        f = f.withColumns(step)
    return f.select(
        "page_id",
        "url",
        *carry,
        "_t.title",
        "_t.title_pos",
        "time_local",
        "time",
        "_d.time_pos",
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce("content_html", F.lit("")).alias("content_node"),
        "lang",
    )


#: The addresses of at most so many pages that refresh (some 200 bytes each) are broadcast.
FEW_JUMPS = 100_000


def followed(pages: DataFrame, site: DataFrame | None = None) -> DataFrame:
    """pages with asked (their own url), and url, html and error of the page one refresh further on, where it leads to the same registrable domain.

    site: url, html of pages that can be fetched (all pages, if not given). A target that isn't among them gives ErrorRequest.
    Refreshes to other domains, IP addresses and hosts without a domain are not followed. Only pages that may hold a refresh are parsed for it.
    """
    from .sites import meta_refresh

    site = (pages if site is None else site).filter("url is not null and html is not null").select("url", "html")
    start = pages.withColumn("asked", F.col("url"))
    maybe = page_features(start.filter(F.col("html").rlike(REFRESH)), "refresh").withColumn("_to", meta_refresh(F.col("refresh")))
    maybe = maybe.filter("_to <> ''").select("page_id", "asked", "_to", urls.hostname(F.col("asked")).alias("_h"), urls.hostname(F.col("_to")).alias("_t"))
    maybe = domain_parse(domain_parse(maybe, "_h", "_hd"), "_t", "_td")
    same = (domain_top(F.col("_td")) != "") & (domain_top(F.col("_td")) == domain_top(F.col("_hd"))) & ~F.col("_t").rlike(urls.IPV4)
    hops = checkpointed(maybe.filter(same).select("page_id", "asked", "_to").distinct())
    few = hops.count() <= FEW_JUMPS
    wanted = hops.select(F.col("_to").alias("url")).distinct()
    # of pages that share an address, one answers
    found = site.join(F.broadcast(wanted) if few else wanted, "url", "left_semi").groupBy("url").agg(F.min("html").alias("_html"))
    own = [c for c in pages.columns if c not in ("url", "html")]
    side = F.broadcast(hops) if few else hops
    stay = start.join(side, ["page_id", "asked"], "left_anti")
    stay = stay.select(*own, "asked", "url", "html", F.when(F.col("html").isNull(), "ErrorRequest").otherwise("").alias("error"))
    move = start.drop("url", "html").join(side, ["page_id", "asked"]).withColumnRenamed("_to", "url").join(found, "url", "left")
    move = move.select(*own, "asked", "url", F.col("_html").alias("html"), F.when(F.col("_html").isNull(), "ErrorRequest").otherwise("").alias("error"))
    return stay.unionByName(move)


def get_news(pages: DataFrame, site: DataFrame | None = None, origin: str | None = None, as_of: Column | None = None) -> DataFrame:
    """News records of pages after at most one refresh within the registrable domain: asked, url (of the page read), the record, error."""
    return extract_news(followed(pages, site), origin, as_of, ("asked", "error"))
