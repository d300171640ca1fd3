"""Site profiles and link data: one row per page out of the scalar and link operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.domain import domain_parse, domain_top, meta_from_host
from ..functions.lang import lang_html, lang_page
from ..functions.registration import icp_doc, province_name
from ..functions.text import blank, built_once, limited, remove_lines, trimmed
from ..functions.titles import web_title, web_title_clean
from .links import CONTENT, LIST, link_types, web_links
from .page import page_features

LANGS = ("title", "html_lang", "xml_lang", "content_language", "meta_lang", "list_text")


def with_lang(features: DataFrame, text: str = "list_text") -> DataFrame:
    """Adds lang and lang_pos. A page without a column charset is read as UTF-8."""
    out = features.withColumn("_l", page_lang(text, "charset" in features.columns))
    return out.withColumns({"lang": F.col("_l.lang"), "lang_pos": F.col("_l.lang_pos")}).drop("_l")


@built_once
def page_lang(text: str, charset: bool) -> Column:
    """struct(lang, lang_pos) of a page's features; text: the column whose text is judged."""
    attribute = lang_html(F.col("html_lang"), F.col("xml_lang"), F.col("content_language"), F.col("meta_lang"))
    return lang_page(F.col("charset") if charset else F.lit("UTF-8"), web_title(F.col("title")), F.col(text), attribute)


def meta_refresh(refresh):
    """Target of a refresh meta's content."""
    return trimmed(F.regexp_extract(blank(refresh), "(?i)url=(.+)", 1))


def get_link_data(pages: DataFrame, strict: bool = True, rules: DataFrame | None = None) -> DataFrame:
    """page_id, url, title, kind (class of an accepted link) or reason (why it was turned down)."""
    f = with_lang(page_features(pages, *LANGS, "links"))
    links = web_links(f, strict, ("lang",))
    return link_types(links, rules, F.col("reason").isNull()).select("page_id", "url", "title", "kind", "reason")


def domain_errors(domain, asked, host, top, port, refresh, refresh_host, refresh_top, refresh_port, failed, unparsed) -> Column:
    """Error code of a probe, or ''.

    domain: what was probed; asked: the host that was asked for it; host, top, port: of the address that answered;
    refresh and its three: of a refresh's target ('' where there is none, or no host in it).
    """
    away = lambda t: (t != "") & (t != domain)
    odd = lambda h, p: h.rlike(urls.IPV4) | (p != "")
    moved, jumps = (asked != host) & away(top), (refresh != "") & away(refresh_top)
    return (
        F.when(failed, "ErrorDomainDetect")
        .when(moved & odd(host, port), "ErrorRedirectHost")
        .when(moved, F.concat(F.lit("ErrorRedirect:"), top))
        .when(unparsed, "ErrorDocParse")
        .when(jumps & odd(refresh_host, refresh_port), "ErrorMetaJumpHost")
        .when(jumps, F.concat(F.lit("ErrorMetaJump:"), refresh_top))
        .when(refresh != "", "ErrorMetaJump")
        .otherwise("")
    )


#: The columns of a profile, and what an error leaves of each.
PROFILE = {
    "lang": "", "lang_pos": "", "country": "", "province": "", "category": "", "icp": "", "title": "", "title_clean": "", "description": "",
}


@built_once
def _profile(top: bool) -> tuple[dict[str, Column], Column]:
    first = {"_i": icp_doc(F.col("body_text")), "_m": meta_from_host(F.col("asked"), F.col("lang"), F.col("_a")), "_title": web_title(F.col("title"))}
    known = F.col("_i.icp") != ""
    domain = domain_top(F.col("_a")) if top else F.col("asked")
    error = domain_errors(
        domain, F.col("asked"), F.col("_host"), domain_top(F.col("_d")), urls.port(F.col("url")),
        F.col("_refresh"), F.col("_refresh_host"), domain_top(F.col("_r")), urls.port(F.col("_refresh")), F.col("failed"), F.col("unparsed"),
    )
    return first, F.struct(
        domain.alias("domain"),
        F.col("_host").alias("home_host"),
        domain_top(F.col("_d")).alias("top"),
        F.regexp_extract("url", "^[a-z]+", 0).alias("scheme"),
        "lang",
        "lang_pos",
        F.when(known, "中国").otherwise(F.col("_m.country")).alias("country"),
        F.when(known, province_name(F.col("_i.province_short"))).otherwise(F.col("_m.province")).alias("province"),
        F.col("_m.category").alias("category"),
        F.col("_i.icp").alias("icp"),
        F.col("_title").alias("title"),
        web_title_clean(F.col("_title"), F.col("lang")).alias("title_clean"),
        limited(trimmed(remove_lines(F.col("description"))), 384).alias("description"),
        error.alias("error"),
    )


def detect_domain(pages: DataFrame, top: bool = True) -> DataFrame:
    """One profile per page, as of a site's front page: by registrable domain, or by host (top=False, the form for sub-domains).

    pages: page_id, url (of the answer), html (null: it couldn't be read as a page), and if known asked (the host that
    was asked for) and failed (no answer). With an error only domain, home_host, scheme and error are known. Pages are parsed once;
    links carry the small profile of their page, so one exchange by page_id counts them.
    """
    if "failed" not in pages.columns:
        pages = pages.withColumn("failed", F.lit(False))
    if "asked" not in pages.columns:
        pages = pages.withColumn("asked", urls.hostname(F.col("url")))
    pages = pages.select("page_id", "url", "html", "asked", F.coalesce("failed", F.lit(False)).alias("failed"), F.col("html").isNull().alias("unparsed"))
    f = with_lang(page_features(pages, *LANGS, "description", "refresh", "links", "body_text"))
    f = f.withColumns({"_host": urls.hostname(F.col("url")), "_refresh": meta_refresh(F.col("refresh"))})
    f = f.withColumn("_refresh_host", urls.hostname(F.col("_refresh")))
    f = domain_parse(domain_parse(domain_parse(f, "_host", "_d"), "asked", "_a"), "_refresh_host", "_r")
    first, profile = _profile(top)
    f = f.withColumns(first).select("page_id", "url", "lang", "links", profile.alias("p"))
    links = web_links(f, carry=("lang", "p"), outer=True)
    typed = link_types(links, accepted=F.col("url").isNotNull() & F.col("reason").isNull())
    host = urls.hostname(F.col("url"))
    sub = F.when(F.col("url").isNotNull() & F.col("reason").isNull() & (host != "") & (host != F.col("p.top")), host)
    count = lambda kind: F.count_if(F.col("kind") == kind)
    out = typed.groupBy("page_id").agg(F.first("p").alias("p"), count(CONTENT).alias("content_count"), count(LIST).alias("list_count"), F.array_sort(F.collect_set(sub)).alias("subdomains"))
    fine = F.col("p.error") == ""
    return out.select(
        "page_id",
        "p.domain",
        "p.home_host",
        "p.scheme",
        *[F.when(fine, F.col(f"p.{c}")).otherwise(v).alias(c) for c, v in PROFILE.items()],
        *[F.when(fine, F.col(c)).otherwise(0).alias(c) for c in ("content_count", "list_count")],
        F.when(fine, F.col("subdomains")).otherwise(F.array().cast("array<string>")).alias("subdomains"),
        "p.error",
    )


def detect_subdomain(pages: DataFrame) -> DataFrame:
    return detect_domain(pages, top=False)
