"""Trees, content scores, links, news, crawls and streams on small pages."""

import collections
import contextlib
import http.server
import math
import os
import random
import re
import threading
import time

import pytest
from pyspark.sql import functions as F

from pagemill.operators import cepf, crawl, dom, links, news, ngram, page, sites
from pagemill.plans import all_queries
from pagemill.sources.pages import RequestOptions, decoded_pages, http_do, http_get
from pagemill.streaming import pages as streaming

FOLDER = "/root/testdata/sf0.001"


def shape(node):
    return node.text if node.text is not None else (node.tag, *map(shape, node.children))


def body_of(html):
    return next(n for n in dom.parse(html).walk() if n.tag == "body")


@pytest.mark.parametrize(
    "html, tree",
    [
        ("<p>a<p>b", ("body", ("p", "a"), ("p", "b"))),
        ("<ul><li>a<li>b</ul>c", ("body", ("ul", ("li", "a"), ("li", "b")), "c")),
        ("<p><b>a<p>c", ("body", ("p", ("b", "a")), ("p", ("b", "c")))),
        ("a<br>b<img>c", ("body", "a", ("br",), "b", ("img",), "c")),
        ("<script>x<p></script>y", ("body", "y")),
        ("<div>a</p>b</div>", ("body", ("div", "a", ("p",), "b"))),
        ("<table><tr><td>1<td>2<tr><td>3</table>", ("body", ("table", ("tr", ("td", "1"), ("td", "2")), ("tr", ("td", "3"))))),
        ("<a href=x>1<a href=y>2</a>", ("body", ("a", "1"), ("a", "2"))),
        ("x &lt; y &amp z", ("body", "x < y & z")),
        ("", ("body",)),
        ("<p>cut <b", ("body", ("p", "cut <b"))),
    ],
)
def test_tree(html, tree):
    found = shape(body_of(html))
    assert found == tree


def test_intervals():
    nodes = dom.number(dom.parse("<div><p>a</p><p>b<i>c</i></p></div>"))
    for n in nodes:
        inside = [m for m in n.walk()]
        assert [m.pre for m in inside] == list(range(n.pre, n.end + 1))


def fold(n):
    """The content measures by plain recursion: text, link text, tags, link tags, p, leaf lengths, density, sum of densities."""
    if n.text is not None:
        size = len(page.tidy(n.text))
        return size, 0, 0, 0, 0, [size], 0.0, 0.0
    kids = [fold(c) for c in n.children]
    text, linked, tags, link_tags, p = (sum(k[i] for k in kids) for i in range(5))
    leaves = [x for k in kids for x in k[5]]
    tags += 1
    if n.tag == "a":
        linked, link_tags = text, link_tags + 1
    if n.tag == "p":
        p += 1
    density = (text - linked) / (tags - link_tags) if text - linked and tags - link_tags else 0.0
    return text, linked, tags, link_tags, p, leaves, density, sum(k[6] for k in kids)


def score(f):
    text, linked, _, _, p, leaves, _, total = f
    mean = sum(leaves) / len(leaves) if leaves else 0
    variance = 0 if not leaves else leaves[0] / 2 if len(leaves) == 1 else sum((x - mean) ** 2 for x in leaves) / len(leaves)
    return math.log(math.sqrt(variance + 1)) * total * math.log(text - linked + 1) * math.log10(p + 1)


def random_page(rnd, depth=0):
    out = []
    for _ in range(rnd.randint(1, 4)):
        r = rnd.random()
        if r < 0.4 or depth > 4:
            out.append("word " * rnd.randint(0, 9))
        elif r < 0.55:
            out.append(f"<a href=/x>{'link ' * rnd.randint(0, 3)}</a>")
        else:
            tag = rnd.choice(["div", "p", "span", "section", "b"])
            out.append(f"<{tag}>{random_page(rnd, depth + 1)}" + (f"</{tag}>" if rnd.random() < 0.8 else ""))
    return "".join(out)


def test_features_do_only_what_is_asked_for(monkeypatch):
    def number(root):
        raise AssertionError("numbered")

    monkeypatch.setattr(dom, "number", number)
    monkeypatch.setattr(page, "number", number)
    got = page.features_of("<title>t</title><script>x</script><p>a<p>b<a href=u>c</a>", {"body_text", "links"})
    assert got["body_text"] == "abc" and got["links"] == [{"pos": 0, "href": "u", "title": "c"}] and "para_text" not in got


def test_prefix_sums_equal_recursion(spark):
    rnd = random.Random(1)
    pages = [(k, random_page(rnd)) for k in range(60)] + [(99, ""), (100, None)]
    nodes = dom.html_nodes(spark.createDataFrame(pages, "page_id long, html string"))
    stats = cepf.node_stats(nodes)
    got = {(r["page_id"], r["pre"]): r for r in stats.collect()}
    seen = 0
    for k, html in pages:
        if html is None:
            continue
        root = dom.parse(html)
        for n in root.walk():
            if n.text is not None:
                continue
            seen += 1
            r, f = got[(k, n.pre)], fold(n)
            assert (r["text"], r["link_text"], r["tags"], r["link_tags"], r["p"]) == f[:5], (k, n.tag)
            assert r["density_sum"] == pytest.approx(f[7]) and r["score"] == pytest.approx(score(f), abs=1e-9)
    assert seen == len(got)
    best = {r["page_id"]: r["pre"] for r in cepf.content_node(stats, nodes).collect()}
    for k, html in pages:
        if html is not None:
            node = page.best_node(next(n for n in dom.parse(html).walk() if n.tag == "body"))
            assert best.get(k) == (node.pre if node is not None else None), k


PAGE = """<html lang="en"><head><title>Storm hits the northern coast | Daily News</title>
<meta property="article:published_time" content="2024-05-06 07:08:09"><script>var a = {"pubDate" : "2020-01-01 00:00:00"};</script></head>
<body><nav><a href="/">Home</a><a href="/world">World</a></nav><div id="main"><h1>Storm hits the northern coast</h1>
<p>A strong storm hit the northern coast on Monday, and people in several towns had to leave their houses for the night.</p>
<p>The wind fell towards the morning, and roads opened again before noon, said the police in a short note.</p></div><p>Contact</p></body></html>"""


def test_extract_news(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/2024/05/06/x.html", PAGE), (2, "https://a.example.com/y", None), (3, None, "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in news.extract_news(pages, as_of=F.lit("2026-01-01").cast("timestamp")).collect()}
    r = got[1]
    assert (r["title"], r["title_pos"], r["time"], r["time_pos"], r["time_local"], r["lang"]) == ("Storm hits the northern coast", "headline", "2024-05-06 07:08:09", "meta", "2024-05-06 07:08:09", "en")
    assert r["content"].split("\n")[-1].startswith("The wind fell") and "Contact" not in r["content"]
    assert (got[2]["title"], got[2]["content"], got[3]["time"]) == ("", "", "")


FOOTED = '<html lang="{}"><title>Stin anor</title><p>Stin anor inreea.<div>Die chlich ist als ungüach zu eniegeß enere und der</div><footer>Répaaux la éaux pas è les des enouch on éréle</footer>'


def test_a_foreign_footer_leaves_the_language_that_the_page_says(spark):
    rows = [(1, "https://a.example.com/1", FOOTED.format("en")), (2, "https://a.example.com/2", FOOTED.format("")), (3, "https://a.example.com/3", FOOTED.format("es"))]
    got = {r["page_id"]: r["lang"] for r in news.extract_news(spark.createDataFrame(rows, streaming.PAGES)).collect()}
    assert got[1] == "en" and got[2] in ("fr", "de") and got[3] == "es"


def test_title_cascade_order(spark):
    html = '<title>Big storm on the coast</title><meta property="og:title" content="Big storm on coast"><body><h1>Storm: big, on the coast</h1><p>x</p></body>'
    pages = spark.createDataFrame([(1, "u", html, "storm big on the coast"), (2, "u", html, "")], "page_id long, url string, html string, anchor string")
    got = {r["page_id"]: (r["title"], r["title_pos"]) for r in news.extract_news(pages, origin="anchor").collect()}
    assert got == {1: ("Storm: big, on the coast", "headline"), 2: ("Big storm on coast", "meta")}


def test_script_titles_with_character_references(spark):
    given = "array('\"title\": \"Que&amp;&amp;&amp; do\"', 'x = \"title\": \"Other words\"')"
    title = spark.range(1).select(news.title_by_script(F.expr(given), F.lit("Que&&& do"), F.lit(0.5)).alias("t")).first()["t"]
    assert title == "Que&amp;&amp;&amp; do"


def test_web_links_keep_the_longest_title(spark):
    html = '<body><a href="/a">one</a><a href="/a">longer one</a><a href="">x</a><a href="/b"></a><a href="/c.pdf">file</a><a href="http://other.org/">other site</a></body>'
    f = page.page_features(spark.createDataFrame([(1, "http://www.example.com/x", html), (2, None, html)], "page_id long, url string, html string"), "links")
    got = {(r["page_id"], r["url"]): (r["title"], r["reason"]) for r in links.web_links(f).collect()}
    assert got == {
        (1, "http://www.example.com/a"): ("longer one", None),
        (1, "http://www.example.com/c.pdf"): ("file", "invalid url with suffix"),
        (1, "http://other.org/"): ("other site", "invalid url with strict domain"),
    }
    friends = [tuple(r) for r in links.friend_domains(f).collect()]
    assert friends == [(1, "other.org", "other site")]


def test_rules_replace_titles(spark):
    rows = [(1, "http://a.example.com/1", "t", "en"), (1, "http://a.example.com/x", "t", "en"), (1, "http://b.example.com/1", "t", "en"), (1, "http://b.example.com/", "t", "en")]
    rules = spark.createDataFrame([("a.example.com", "/x$"), ("example.com", "/1$")], "host string, regex string")
    got = {r["url"]: r["kind"] for r in links.link_types(spark.createDataFrame(rows, "page_id long, url string, title string, lang string"), rules).collect()}
    assert got == {"http://a.example.com/1": "LIST", "http://a.example.com/x": "CONTENT", "http://b.example.com/1": "CONTENT", "http://b.example.com/": "NONE"}


def test_crawl(spark):
    edges = [("r", "a", "LIST"), ("r", "b", "LIST"), ("a", "r", "LIST"), ("a", "c", "LIST"), ("b", "c", "LIST"), ("c", "d", "LIST"), ("a", "n1", "CONTENT"), ("c", "n1", "CONTENT"), ("b", "a", "CONTENT")]
    df = spark.createDataFrame(edges, "src string, dst string, kind string")
    roots = spark.createDataFrame([("r",)], "url string")
    visited = crawl.crawl_bfs(df, roots, crawl.CrawlOptions(depth=3))
    assert sorted(map(tuple, visited.collect())) == [("a", 1), ("b", 1), ("c", 2), ("r", 0), ("r", 2)]
    assert [tuple(r) for r in crawl.crawl_content(df, visited).collect()] == [("n1", 1, "", "a")]
    there = spark.createDataFrame([("r", "x"), ("a", "x"), ("b", None)], "url string, html string")
    assert sorted(tuple(r) for r in crawl.crawl_lists(visited, there).collect() if r["error"]) == [("b", 1, "ErrorRequest"), ("c", 2, "ErrorRequest")]
    assert crawl.CrawlOptions().clone(depth=9).depth == 9


def test_stream(spark, tmp_path):
    rows = [(k, f"u{k % 3}", f"<title>t{k}</title>") for k in range(6)]
    spark.createDataFrame(rows, streaming.PAGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = collections.Counter()

    def sink(df, k):
        for r in df.collect():
            got[r["url"]] += 1

    streaming.run(streaming.seen_once(streaming.stream_pages(spark, f"{tmp_path}/in")), sink, f"{tmp_path}/c").awaitTermination()
    assert got == {"u0": 1, "u1": 1, "u2": 1}


def test_stream_titles_has_pages_that_share_a_url(spark, tmp_path):
    rows = [(k, f"u{k % 3}", f"<title>t{k}</title>") for k in range(6)]
    spark.createDataFrame(rows, streaming.PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in all_queries()["stream_titles"](spark, str(tmp_path)).collect())
    assert got == [(k, f"u{k % 3}", f"t{k}") for k in range(6)]


def test_site_profile(spark):
    html = '<html lang="fr"><head><title>Accueil - Site</title><meta name=description content="d"></head><body><a href="/un">x</a>京ICP备 123号</body></html>'
    r = sites.detect_domain(spark.createDataFrame([(1, "https://www.example.fr/", html)], "page_id long, url string, html string")).first()
    assert (r["domain"], r["lang"], r["country"], r["province"], r["icp"], r["title_clean"], r["description"], r["list_count"], r["subdomains"]) == ("example.fr", "fr", "中国", "北京", "京ICP备123", "Accueil", "d", 1, ["www.example.fr"])


def jump(to):
    return f'<meta http-equiv=refresh content="0;url={to}"><title>Old page here</title>'


def test_get_news_follows_inside_the_domain_alone(spark):
    rows = [
        (1, "https://a.example.com/1", jump("https://b.example.com/2")),
        (2, "https://a.example.com/3", jump("https://evil.other.org/")),
        (3, "https://a.example.com/4", jump("/home")),
        (4, "https://a.example.com/5", jump("https://gone.example.com/")),
        (5, "https://b.example.com/2", "<title>New page there</title>" + jump("https://a.example.com/1").split("<title>")[0]),
        (6, "https://b.example.com/2", "<title>New page there</title>"),
        (7, "https://evil.other.org/", "<title>Evil page</title>"),
        (8, None, None),
    ]
    got = [(r["page_id"], r["asked"], r["url"], r["title"], r["error"]) for r in news.get_news(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == [
        (1, "https://a.example.com/1", "https://b.example.com/2", "New page there", ""),
        (2, "https://a.example.com/3", "https://a.example.com/3", "Old page here", ""),
        (3, "https://a.example.com/4", "https://a.example.com/4", "Old page here", ""),
        (4, "https://a.example.com/5", "https://gone.example.com/", "", "ErrorRequest"),
        (5, "https://b.example.com/2", "https://a.example.com/1", "Old page here", ""),
        (6, "https://b.example.com/2", "https://b.example.com/2", "New page there", ""),
        (7, "https://evil.other.org/", "https://evil.other.org/", "Evil page", ""),
        (8, None, None, "", "ErrorRequest"),
    ]


def test_get_news_of_a_page_with_a_foreign_footer(spark):
    rows = [(1, "https://a.example.com/1", jump("https://b.example.com/2")), (2, "https://b.example.com/2", FOOTED.format("en"))]
    got = {r["page_id"]: (r["url"], r["lang"]) for r in news.get_news(spark.createDataFrame(rows, streaming.PAGES)).collect()}
    assert got == {1: ("https://b.example.com/2", "en"), 2: ("https://b.example.com/2", "en")}


def test_domain_errors(spark):
    rows = [
        (1, "https://www.example.com/", jump("https://b.example.com/"), "example.com", False),
        (2, "https://www.example.com/", jump("https://x.other.org/"), "www.example.com", False),
        (3, "https://www.example.com/", jump("http://10.0.0.1/"), "www.example.com", False),
        (4, "https://www.other.org/", "<p>x", "www.example.com", False),
        (5, "https://www.other.org:81/", "<p>x", "www.example.com", False),
        (6, "https://www.example.com/", None, "www.example.com", False),
        (7, "https://www.example.com/", None, "www.example.com", True),
        (8, "https://www.example.com/", "<p>x", "sub.example.com", False),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, asked string, failed boolean")
    codes = lambda d: {r["page_id"]: r["error"] for r in d.collect()}
    assert codes(sites.detect_domain(df)) == {
        1: "ErrorMetaJump", 2: "ErrorMetaJump:other.org", 3: "ErrorMetaJumpHost", 4: "ErrorRedirect:other.org", 5: "ErrorRedirectHost", 6: "ErrorDocParse", 7: "ErrorDomainDetect", 8: "",
    }
    assert codes(sites.detect_subdomain(df))[8] == "ErrorRedirect:example.com"


def test_trigram_model_by_either_way(spark):
    rows = [(1, "the cat and the dog and the bird", "en"), (2, "der hund und die katze und der vogel", "de"), (3, "le chien et le chat et les oiseaux", "fr"), (4, "xx", "fr"), (5, None, None), (None, "the end and the start", None), (6, "日本語の文", None)]
    df = spark.createDataFrame(rows, "k long, text string, lang string")
    model = ngram.train(df)
    ways = [sorted((r["k"] or 0, r["lang"]) for r in ngram.lang_ngram(df, model, "k", few=few).collect()) for few in (10**6, 0)]
    assert ways[0] == ways[1] == [(0, "en"), (1, "en"), (2, "de"), (3, "fr"), (4, ""), (5, ""), (6, "")]
    assert ngram.lang_ngram(df, model.limit(0), "k").filter("lang <> ''").count() == 0


def test_trigrams_of_a_batch_are_cut_in_bounded_pieces():
    texts = [None, "", "ab", "abcabcabc" * 7, "x", "日本語の文章" * 30, "the end", "abc"]
    whole = collections.Counter(zip(*(x.tolist() for x in ngram.trigrams(texts))))
    for most in (1, 2, 5, 50, 10**6):
        parts = list(ngram.in_pieces(texts, most))
        assert sum((collections.Counter(zip(at.tolist(), code.tolist())) for at, code in parts), collections.Counter()) == whole
        assert max(len(code) for _, code in parts) <= most


def test_bodies_become_pages(spark):
    rows = [
        (1, "新闻".encode("gbk"), "text/html; charset=gb2312"), (2, "é".encode("latin-1"), "text/html; charset=iso-8859-1"), (3, "plain".encode(), "text/plain"), (4, b"\xff\xfe\xfd", "text/html; charset=utf-8"),
        (5, b"x", "image/png"), (6, b"y" * 101, "text/html"), (7, None, "text/html"), (8, "日本".encode("iso2022_jp"), "text/html; charset=ISO-2022-JP"),
    ]
    df = spark.createDataFrame(rows, "k long, body binary, content_type string")
    got = {r["k"]: (r["html"], r["charset"], r["error"]) for r in decoded_pages(df, RequestOptions(max_bytes=100)).collect()}
    assert got[1] == ("新闻", "GBK", None) and got[2] == ("é", "ISO-8859-1", None) and got[3] == ("plain", "UTF-8", None)
    assert got[4][2] == "ErrorCharset" and got[5][2] == "content type" and got[6][2] == "content length" and got[7] == (None, "", None)


@pytest.fixture
def site():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hop = re.match(r"/hop(\d+)", self.path)
            if self.path == "/slow":
                time.sleep(3)
            self.send_response(302 if hop and hop[1] != "0" else 404 if self.path == "/gone" else 200)
            if hop and hop[1] != "0":
                self.send_header("Location", f"/hop{int(hop[1]) - 1}")
            self.send_header("Content-Type", "image/png" if self.path == "/image" else "text/html; charset=gbk")
            self.end_headers()
            with contextlib.suppress(BrokenPipeError):
                self.wfile.write(b"x" * 5000 if self.path == "/large" else "<title>新闻</title>".encode("gbk"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_against_a_local_server(spark, site):
    paths = ["/page", "/hop3", "/hop4", "/image", "/large", "/gone", "/slow"]
    got = {r["request_url"].removeprefix(site): r for r in http_do(spark, *[site + x for x in paths], max_bytes=1000, timeout_ms=1000).collect()}
    assert (got["/page"]["html"], got["/page"]["charset"], got["/page"]["error"]) == ("<title>新闻</title>", "GBK", None)
    assert got["/hop3"]["status"] == 200 and got["/hop3"]["url"] == f"{site}/hop0" and got["/hop4"]["html"] is None
    assert got["/image"]["error"] == "content type" and got["/large"]["error"] == "content length"
    assert got["/gone"]["status"] == 404 and got["/gone"]["error"] and "timed out" in got["/slow"]["error"]


def test_links_stay_in_their_row(spark):
    pages = spark.createDataFrame([(1, "http://www.example.com/", "<a href=/x>y</a>")], "page_id long, url string, html string")
    f = sites.with_lang(page.page_features(pages, *sites.LANGS, "links"))
    found = links.web_links(f, carry=("lang",))
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(found) == 0
    assert exchanges(sites.detect_domain(pages)) == 1


def test_http_errors_are_rows(spark):
    with pytest.raises(ValueError):
        http_get(spark)
    r = http_get(spark, "http://127.0.0.1:9/", timeout_ms=500).first()
    assert not r["success"] and r["error"] and r["body"] is None


def test_plans_prune_and_stay_in_place(spark):
    if not os.path.exists(FOLDER):
        pytest.skip("no test tables")
    p = spark.read.parquet(f"{FOLDER}/pages.parquet")
    plan = news.extract_news(p)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plan = page.page_features(p.select("page_id", "html"), "title")._jdf.queryExecution().executedPlan().toString()
    assert "url" not in plan.split("ReadSchema")[-1]
