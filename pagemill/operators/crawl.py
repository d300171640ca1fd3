"""Level-order crawl over a table of pages: frontier and seen-set are relations.

Each level is one join of the frontier with the link table and one anti-join with what has been seen;
levels are written to the checkpoint folder, so the plan doesn't grow and a lost executor costs nothing but its tasks.
The driver holds a count per level, never URLs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.domain import domain_parse, domain_top
from ..functions.urls import hostname, index_url
from .durable import checkpointed
from .links import CONTENT, LIST, link_types, web_links
from .news import extract_news, followed
from .page import page_features
from .sites import LANGS, with_lang


@dataclass(frozen=True)
class CrawlOptions:
    """depth counts levels; with_subdomains adds the sub-domains that the roots link to as roots; retry and timeout_ms go to requests()."""

    depth: int = 3
    retry: int = 2
    timeout_ms: int = 20_000
    with_subdomains: bool = False

    def clone(self, **changes) -> CrawlOptions:
        return replace(self, **changes)

    def requests(self) -> dict[str, int]:
        """Options of sources.pages.http_get for the pages of a crawl."""
        return {"retry": self.retry, "timeout_ms": self.timeout_ms}


def page_edges(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """src, dst, kind, title: the accepted links of pages, classified."""
    f = with_lang(page_features(pages, *LANGS, "links"))
    links = link_types(web_links(f, carry=("lang",)), rules, F.col("reason").isNull())
    return links.filter("reason is null").select(F.col("base").alias("src"), F.col("url").alias("dst"), "kind", "title")


def with_subdomain_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """roots (url), and the front page of each sub-domain that a root links to, by the root's scheme."""
    seen = edges.join(roots, edges["src"] == roots["url"]).select("src", "dst")
    seen = domain_parse(seen.withColumn("_h", hostname(F.col("dst"))), "_h", "_d").filter((F.col("_h") != "") & (F.col("_h") != domain_top(F.col("_d"))))
    front = seen.select(F.concat(index_url(F.col("src"))["scheme_url"], F.col("_h")).alias("url"))
    return roots.select("url").union(front).distinct()


def crawl_bfs(links: DataFrame, roots: DataFrame, options: CrawlOptions = CrawlOptions()) -> DataFrame:
    """url, depth of every list page that is visited. links: src, dst, kind; roots: url.

    Roots are no member of the seen-set, so one that is linked to is visited once more, as a list page. A level is written once; what has been seen
    is the union of the levels.
    """
    if options.with_subdomains:
        roots = with_subdomain_roots(links, roots)
    follow = links.filter(F.col("kind") == LIST).select("src", "dst").filter("dst is not null")
    levels = [checkpointed(roots.select("url", F.lit(0).alias("depth")).distinct())]
    for depth in range(1, options.depth):
        new = levels[-1].join(follow, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct()
        if len(levels) > 1:
            new = new.join(reduce(DataFrame.union, levels[1:]).select("url"), "url", "left_anti")
        levels.append(checkpointed(new.select("url", F.lit(depth).alias("depth"))))
        if levels[-1].isEmpty():
            break
    return reduce(DataFrame.union, levels)


def crawl_content(links: DataFrame, visited: DataFrame) -> DataFrame:
    """url, depth, title, list_url of the content pages that visited pages link to, each once and never one visited as a list page.

    title and list_url are those of the link found first: by depth, then by the address of its page, then by title.
    """
    titled = links if "title" in links.columns else links.withColumn("title", F.lit(""))
    found = titled.filter(F.col("kind") == CONTENT).join(visited, F.col("src") == F.col("url"))
    found = found.groupBy("dst").agg(F.min(F.struct("depth", "src", "title")).alias("f"))
    found = found.select(F.col("dst").alias("url"), "f.depth", "f.title", F.col("f.src").alias("list_url"))
    return found.join(visited.filter("depth > 0").select("url"), "url", "left_anti")


def crawl_lists(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """url, depth, error: a record of every visited list page; ErrorRequest where there is no such page."""
    there = pages.filter("html is not null").select("url").distinct().withColumn("_there", F.lit(True))
    return visited.join(there, "url", "left").select("url", "depth", F.when(F.col("_there"), "").otherwise("ErrorRequest").alias("error"))


def crawl_news(pages: DataFrame, roots: DataFrame, options: CrawlOptions = CrawlOptions(), rules: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """News records of the content pages that a crawl from roots (url) over the links of pages finds: list_url, depth, asked, url, the record, error.

    pages (page_id, url, html) are what can be fetched. A content page that isn't there has a row with ErrorRequest.
    """
    edges = checkpointed(page_edges(pages, rules))
    content = crawl_content(edges, checkpointed(crawl_bfs(edges, roots, options)))
    there = pages.filter("url is not null").groupBy("url").agg(F.min("html").alias("html"))
    found = content.join(there, "url", "left").withColumn("page_id", F.monotonically_increasing_id())
    found = checkpointed(found.withColumnRenamed("title", "origin"))
    return extract_news(followed(found, pages), "origin", as_of, ("asked", "depth", "list_url", "error")).drop("page_id")
