"""Queries of the scalar operators: character sets, addresses, titles, hosts, languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import charset, domain, lang, registration, text, titles, urls
from ..operators import links as link_ops
from ..sources.pages import TEXT_TYPES, content_type_filter, scan_pages, size_limit
from .catalog import pick, query, sql_pick, sql_text, table

HEADERS = [
    "text/html; charset=gb2312", "text/html;charset=UTF8", "text/html", "text/html; charset=ISO-8859-1", "application/json; charset=Shift_JIS",
    "text/html; charset= big5-hkscs", "text/html; charset=windows-1251", "text/xml; CHARSET=utf_8", "image/png", "",
]
METAS = [
    '<meta http-equiv="Content-Type" content="text/html; charset=gbk">', '<meta charset="utf-8">', "", "<meta charset=euc-kr>",
    '<meta http-equiv=content-type content="text/html; charset=big5"><meta charset="gb18030">', "<META CHARSET='koi8-r'>",
    '<meta charset="shift_jis"><meta http-equiv="content-type" content="text/html; charset=euc-jp">',
]
NAMES = ["utf8", " UTF_8 ", "gb2312", "GBK", "big5-hkscs", "shift-jis", "iso-8859-1", "", "euc-jp", "Utf-8"]
LINKS = [
    "./d/7.html", "/e/8.html", "../d/9.html", "//www.example.net/c/1.html", "//m.example.net/e/10.pdf?k=2", "?q=1", "#top", "javascript:;",
    "http://www.example.com/a.JPG", "https://10.0.0.1/x", "http://a.example.org:8080/x", "a{b}", "news/today", "/a/../b/./c/", "HTTPS://X.example.com/Y",
    "", "/x/..", "mailto:me@example.com", "/2024/05/17/story.html", "../../../up.html", "/a b",
]
PATHS = ["/a/b/", "/a", "", "/", "/news/2024/05/17/x.html", "/2031-1/y.html", "/a.b-c_d/e", "rel/x", "//a//b", "/202/x", "/ /x", "/20230518.html"]
TITLES = [
    "首页_新华网 - 新闻", "新闻｜要闻_首页", "About the Project on Nuclear Issues | Center", "Home - News - World", "A: b: c", "plain title", "—|专题 | 首页",
    "=x>>y>>>z", "日本語_新華網", "", "首页 - 国内", "a|b - c", "， ，头条",
]
LANG_OF = ["zh", "en", "fr", "", "ja"]
ICPS = [
    "京公网安备-11010-22号", "沪ICP备12345678 苏B2-20190001", "粤ICP备87654321-2号", "津公网安备12010202000001号", "x 粤ICP备87654321号 y",
    "浙ICP备11223344浙公网安备33010602000001号", "粤 ICP备\n12345 号", "icp 123", "浙B2-20080101", "台ICP备1", "沪icp证030247号", "",
]
HOSTS = [
    "mfa.gov.sg", "m.example.com", "bbc.co.uk", "nasa.gov", "dealer.auto.sohu.com", "co.uk", "matichon.co.th", "www.gov.cn", "archives.gov.mo", "", "a.b.example.org",
    "example.net", "localhost", "x.hk", "news.tw", "www.yahoo.co.jp", "spiegel.de", "www.lemonde.fr", "elpais.es", "gov.uk", "WWW.Example.COM.", "a..com", "foo.ck", "a.foo.ck", "www.ck",
]
#: The rules that decide HOSTS: suffix, has a wildcard below, is an exception, icann (for the SQL; Spark has the whole list).
SUFFIXES = "cn,com,com.cn,gov.cn,co.jp,co.th,co.uk,de,es,fr,gov,gov.mo,gov.sg,gov.uk,hk,jp,mo,net,org,sg,th,tw,uk".split(",")
CODES = ["zh-CN", "en", "EN", "utf-8", "zh-Hans-CN", " fr ", "de-AT", "x", "", "ja"]
SAMPLES = {
    "中文": "新华社北京电 中国经济发展新闻报道今天全国各地人民群众积极参加各项活动取得了重大成果为进一步推动社会主义现代化建设作出贡献的同志们受到了表彰和奖励大会在人民大会堂隆重举行",
    "日语": "日本語の文章はひらがなとカタカナと漢字で書かれています東京都知事選挙の結果について報道各社は速報を出しましたこの記事では詳しい内容を説明していきますのでご覧ください",
    "韩语": "대한민국 서울에서 오늘 열린 기자회견에서 정부는 새로운 경제 정책을 발표하였다 이번 정책은 중소기업을 지원하고 일자리를 늘리기 위한 것이라고 밝혔다 전문가들은 환영하였다",
    "俄语": "Президент России сегодня выступил с речью перед журналистами и рассказал о новых планах развития экономики страны на ближайшие годы и ответил на вопросы граждан",
    "阿拉伯语": "أعلنت الحكومة اليوم عن خطة جديدة لتطوير الاقتصاد الوطني ودعم الشركات الصغيرة والمتوسطة في جميع أنحاء البلاد خلال السنوات القادمة وقال الوزير ذلك",
    "英语": "The government announced today a new plan to develop the national economy and to support small companies all over the country in the coming years",
    "one letter of another script": "0123456789 " * 8 + "ж",
    "short": "中文",
}

NORMAL = (
    "CASE WHEN {u} IN ('UTF8','UTF_8') THEN 'UTF-8' WHEN {u} LIKE 'GB%' THEN 'GBK' WHEN {u} LIKE 'BIG5%' THEN 'Big5' "
    "WHEN {u} LIKE 'SHIFT%' THEN 'SHIFT_JIS' ELSE {u} END"
)


def normal(c: str) -> str:
    return NORMAL.format(u=f"upper(trim({c}))")


def header(c: str) -> str:
    return normal(f"regexp_extract({c}, {sql_text(charset.NAMED)}, 1)")


def in_page(c: str) -> str:
    old = f"regexp_extract(regexp_extract({c}, {sql_text(charset.META4)}, 1), {sql_text(charset.NAMED)}, 1)"
    new = f"regexp_extract({c}, {sql_text(charset.META5)}, 1)"
    first = f"CASE WHEN {old} = '' THEN {new} WHEN {new} = '' THEN {old} WHEN instr({c}, {old}) <= instr({c}, {new}) THEN {old} ELSE {new} END"
    return normal(f"({first})")


def space(c: str) -> str:
    return f"trim(regexp_replace({c}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def edge(c: str) -> str:
    return f"regexp_replace({c}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def part(c: str, k: int) -> str:
    return f"regexp_extract({c}, {sql_text(urls.PARTS)}, {k})"


def dots(p: str) -> str:
    """Dot segments of an absolute path."""
    step = "CASE WHEN b[1] = '.' THEN a WHEN b[1] = '..' THEN CASE WHEN len(a) > 1 THEN a[1:len(a)-1] ELSE a END ELSE list_concat(a, b) END"
    lists = f"list_concat([CAST([] AS VARCHAR[])], list_transform(string_split({p}, '/'), lambda x: [x]))"
    return f"array_to_string(list_reduce({lists}, lambda a, b: {step}), '/') || CASE WHEN regexp_matches({p}, '(^|/)\\.\\.?$') THEN '/' ELSE '' END"


def resolve(link: str, base: str) -> str:
    origin = f"{part(base, 1)} || '://' || {part(base, 2)}"
    lead, tail = f"regexp_extract({link}, '^[^?#]*')", f"regexp_extract({link}, '[?#].*$')"
    where, query_ = part(base, 3), part(base, 4)
    merged = f"(CASE WHEN {where} = '' THEN '/' ELSE regexp_replace({where}, '[^/]*$', '') END || {lead})"
    return (
        f"CASE WHEN lower({link}) LIKE 'http%' OR regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link} "
        f"WHEN {link} LIKE '//%' THEN {part(base, 1)} || ':' || {link} "
        f"WHEN {link} = '' THEN {origin} || {where} || {query_} WHEN {link} LIKE '#%' THEN {origin} || {where} || {query_} || {link} "
        f"WHEN {link} LIKE '?%' THEN {origin} || {where} || {link} WHEN {link} LIKE '/%' THEN {origin} || {dots(lead)} || {tail} "
        f"ELSE {origin} || {dots(merged)} || {tail} END"
    )


def sql_path(u: str) -> str:
    return f"CASE WHEN {part(u, 1)} <> '' AND {part(u, 2)} = '' AND {part(u, 3)} NOT LIKE '/%' THEN '' ELSE {part(u, 3)} END"


def sql_host(u: str) -> str:
    return f"regexp_replace(regexp_replace({part(u, 2)}, '^.*@', ''), ':[0-9]*$', '')"


def sql_dir(p: str) -> str:
    cut = f"regexp_replace(regexp_replace({p}, '[^/]*$', ''), '/{{2,}}', '/', 'g')"
    return f"CASE WHEN {cut} = '' THEN '.' ELSE regexp_replace({cut}, '(.)/$', '\\1') END"


# sources


@query("scan_pages", "SELECT page_id, url, strlen(html) AS n_bytes FROM pages")
def _(spark, d):
    return scan_pages(spark, d).select("page_id", "url", F.octet_length("html").cast("long").alias("n_bytes"))


@query("content_type_filter", f"SELECT page_id, ct FROM (SELECT page_id, {sql_pick('page_id', HEADERS)} AS ct FROM pages) WHERE lower(trim(string_split(ct, ';')[1])) IN ({', '.join(map(sql_text, TEXT_TYPES))})")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", pick("page_id", HEADERS).alias("ct")).filter(content_type_filter(F.col("ct")))


@query("size_limit", "SELECT page_id, strlen(html) AS n_bytes FROM pages WHERE strlen(html) <= 8000")
def _(spark, d):
    return table(spark, d, "pages").filter(size_limit(F.col("html"), 8000)).select("page_id", F.octet_length("html").cast("long").alias("n_bytes"))


# character sets


@query("charset_normalize", f"SELECT page_id, {normal(sql_pick('page_id', NAMES))} AS charset FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", charset.charset_normalize(pick("page_id", NAMES)).alias("charset"))


@query("charset_header", f"SELECT page_id, {header(sql_pick('page_id', HEADERS))} AS charset FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", charset.charset_header(pick("page_id", HEADERS)).alias("charset"))


@query("charset_html", f"SELECT page_id, {in_page('h')} AS charset FROM (SELECT page_id, {sql_pick('page_id', METAS)} || regexp_replace(html, '<meta charset=.utf-8.>', '') AS h FROM pages)")
def _(spark, d):
    h = F.concat(pick("page_id", METAS), F.regexp_replace("html", "<meta charset=.utf-8.>", ""))
    return table(spark, d, "pages").select("page_id", charset.charset_html(h).alias("charset"))


@query(
    "charset_header_html",
    f"""WITH x AS (SELECT page_id, {header(sql_pick('page_id', HEADERS))} AS a, {in_page('h')} AS b FROM
    (SELECT page_id, {sql_pick('page_id', METAS)} || regexp_replace(html, '<meta charset=.utf-8.>', '') AS h FROM pages)),
    y AS (SELECT *, CASE WHEN a = '' AND b = '' THEN '' WHEN a = '' THEN 'html' WHEN b = '' OR a = b THEN 'header'
      WHEN a LIKE 'ISO%' OR a LIKE 'WINDOWS%' THEN 'html' ELSE 'header' END AS charset_pos FROM x)
    SELECT page_id, CASE charset_pos WHEN 'header' THEN a WHEN 'html' THEN b ELSE '' END AS charset, charset_pos FROM y""",
)
def _(spark, d):
    h = F.concat(pick("page_id", METAS), F.regexp_replace("html", "<meta charset=.utf-8.>", ""))
    return table(spark, d, "pages").select("page_id", charset.charset_header_html(pick("page_id", HEADERS), h).alias("c")).select("page_id", "c.*")


#: Bodies as hex with the charset that header, page or bytes give.
BODIES = [
    ("E4BDA0E5A5BD", "", "UTF-8", "valid"), ("C4E3BAC3CAC0BDE7", "text/html; charset=gb2312", "GBK", "header"), ("C4E3BAC3CAC0BDE7", "", "GB18030", "guess"),
    ("82B182F182C982BF82CD", "", "SHIFT_JIS", "guess"), ("F0D2C9D7C5D420CDC9D2", "", "KOI8-R", "guess"), ("616263", "text/html", "UTF-8", "valid"),
    ("3C6D65746120636861727365743D6575632D6B723EBEC8B3E7", "", "EUC-KR", "html"), ("A4B3A4F3A4CBA4C1A4CF", "", "EUC-JP", "guess"), ("CFF0E8E2E5F220ECE8F0", "", "WINDOWS-1251", "guess"),
]


@query("charset_detect", f"SELECT page_id, {sql_pick('page_id', [b[2] for b in BODIES])} AS charset, {sql_pick('page_id', [b[3] for b in BODIES])} AS charset_pos FROM pages")
def _(spark, d):
    body, said = F.unhex(pick("page_id", [b[0] for b in BODIES])), pick("page_id", [b[1] for b in BODIES])
    return table(spark, d, "pages").select("page_id", charset.charset_detect(body, said).alias("c")).select("page_id", "c.*")


GUESSES = [(h, "" if p == "valid" else c) for h, t, c, p in BODIES if p == "guess" or h == "616263"]


@query("charset_guess", f"SELECT page_id, {sql_pick('page_id', [g[1] for g in GUESSES])} AS charset FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", charset.charset_guess(F.unhex(pick("page_id", [g[0] for g in GUESSES]))).alias("charset"))


DECODED = [("E4BDA0", "UTF-8", "你"), ("C4E3BAC3", "GBK", "你好"), ("A741A66E", "Big5", "你好"), ("82B182F1", "SHIFT_JIS", "こん"), ("E9", "ISO-8859-1", "é"), ("F0D2C9", "KOI8-R", "При"), ("BEC8B3E7", "EUC-KR", "안녕")]


@query("decode_body", f"SELECT page_id, {sql_pick('page_id', [x[2] for x in DECODED])} AS text FROM pages")
def _(spark, d):
    body, name = F.unhex(pick("page_id", [x[0] for x in DECODED])), pick("page_id", [x[1] for x in DECODED])
    return table(spark, d, "pages").select("page_id", charset.decode_body(body, name).alias("text"))


# addresses


@query("url_resolve", f"SELECT page_id, {resolve('l', 'url')} AS resolved FROM (SELECT page_id, url, {sql_pick('page_id', LINKS)} AS l FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_resolve(pick("page_id", LINKS), F.col("url")).alias("resolved"))


SUFFIX_SQL = ", ".join(f"'{s}'" for s in urls.SUFFIXES)
FILTERED = f"""WITH x AS (SELECT page_id, url, {sql_pick('page_id', LINKS)} AS l FROM pages),
    y AS (SELECT *, CASE WHEN regexp_matches(l, '[{{}}\\[\\]@$<>"]') THEN l ELSE {resolve('l', 'url')} END AS u FROM x),
    z AS (SELECT *, {sql_path('u')} AS p, regexp_replace({part('u', 2)}, '^.*@', '') AS hp FROM y)
    SELECT page_id, u AS resolved, CASE WHEN regexp_matches(l, '[{{}}\\[\\]@$<>"]') THEN 'invalid url with illegal characters'
      WHEN regexp_matches(u, '[\\x00-\\x20\\x7F]') THEN 'invalid url with parse error'
      WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'invalid url with not absolute url'
      WHEN regexp_extract(hp, ':([0-9]*)$', 1) <> '' THEN 'invalid url with not 80 port'
      WHEN regexp_matches(hp, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}') THEN 'invalid url with ip hostname'
      WHEN lower(regexp_extract(p, '\\.([^./]*)$', 1)) IN ({SUFFIX_SQL}) THEN 'invalid url with suffix'
      WHEN regexp_extract(hp, '([^.]+\\.[^.]+)$', 1) <> regexp_extract({part('url', 2)}, '([^.]+\\.[^.]+)$', 1) THEN 'invalid url with strict domain' END AS reason FROM z"""


@query("url_filter", FILTERED)
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", "url", pick("page_id", LINKS).alias("l"))
    x = x.withColumns({"h": urls.hostname(urls.url_resolve(F.col("l"), F.col("url"))), "b": urls.hostname(F.col("url"))})
    x = domain.domain_parse(domain.domain_parse(x, "h", "hd"), "b", "bd")
    f = urls.url_filter(F.col("l"), F.col("url"), F.lit(True), domain.domain_top(F.col("hd")), domain.domain_top(F.col("bd")))
    return x.select("page_id", f.alias("f")).select("page_id", F.col("f.url").alias("resolved"), "f.reason")


@query("path_dir", f"SELECT page_id, {sql_dir('p')} AS dir FROM (SELECT page_id, {sql_pick('page_id', PATHS)} AS p FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.path_dir(pick("page_id", PATHS)).alias("dir"))


@query("path_dir_clean", f"SELECT page_id, translate({sql_pick('page_id', PATHS)}, '.-_', '') AS dir FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.path_dir_clean(pick("page_id", PATHS)).alias("dir"))


@query("path_first_seg", f"SELECT page_id, list_filter(string_split({sql_dir('p')}, '/'), lambda x: trim(x) <> '')[1] AS seg FROM (SELECT page_id, {sql_pick('page_id', PATHS)} AS p FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.path_first_seg(pick("page_id", PATHS)).alias("seg"))


@query("url_publish_date", f"SELECT page_id, regexp_matches(translate({sql_dir('p')}, '.-_', ''), '20[23][0-9]/?(1[0-2]|0?[1-9])/?([12][0-9]|3[01]|0?[1-9])?') AS dated FROM (SELECT page_id, {sql_pick('page_id', PATHS)} AS p FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.url_publish_date(pick("page_id", PATHS)).alias("dated"))


INDEXES = ["sohu.com", "https://news.example.com/a/b", "http://example.org", "www.example.net", ""]


@query("index_url", f"SELECT page_id, CASE WHEN x LIKE '%//%' THEN regexp_extract(x, '^([^/]*//)', 1) ELSE 'https://' END AS scheme_url, CASE WHEN x LIKE '%//%' THEN regexp_extract(x, '^([^/]*//[^/]*)', 1) ELSE 'https://www.' || x END AS index_url FROM (SELECT page_id, {sql_pick('page_id', INDEXES)} AS x FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.index_url(pick("page_id", INDEXES)).alias("i")).select("page_id", "i.*")


# titles


def cut_last(c: str, m: str) -> str:
    return edge(f"left({c}, length({c}) - strpos(reverse({c}), {sql_text(m[::-1])}) - {len(m) - 1})")


def cascade(c: str, marks, cut) -> str:
    return "CASE " + " ".join(f"WHEN strpos({c}, {sql_text(m)}) > 0 THEN {cut(c, m)}" for m in marks) + f" ELSE {c} END"


def until(c: str, m: str) -> str:
    return edge(f"string_split({c}, {sql_text(m)})[1]")


LEAD_RE = "^" + "".join({"|": "(\\|)?"}.get(m, f"({m})?") for m in titles.SITE_ZH)
OTHER_SQL = cascade("t", titles.OTHER, cut_last)


@query(
    "web_title_clean",
    f"""WITH x AS (SELECT page_id, {sql_pick('page_id', TITLES)} AS t, {sql_pick('(page_id // 13)', LANG_OF)} AS l FROM pages),
    a AS (SELECT *, regexp_replace(t, {sql_text(LEAD_RE)}, '') AS z0 FROM x),
    b AS (SELECT *, CASE WHEN z0 LIKE '首页%' THEN regexp_replace(z0, '首页[ |\\-_－—｜]*', '', 'g') ELSE z0 END AS z1 FROM a),
    c AS (SELECT *, {cascade('z1', titles.SITE_ZH, until)} AS z2 FROM b),
    e AS (SELECT *, CASE WHEN z2 <> '首页' AND z2 LIKE '%首页' THEN left(z2, length(z2) - 2) ELSE z2 END AS z3 FROM c)
    SELECT page_id, CASE WHEN l = 'zh' THEN regexp_replace(z3, '[^\\pL\\pN]', '', 'g') ELSE {OTHER_SQL} END AS title FROM e""",
)
def _(spark, d):
    t, l = pick("page_id", TITLES), F.get(F.array(*[F.lit(v) for v in LANG_OF]), ((F.col("page_id") / 13).cast("int") % len(LANG_OF)))  # noqa: E741
    return table(spark, d, "pages").select("page_id", titles.web_title_clean(t, l).alias("title"))


@query(
    "content_title_clean",
    f"""WITH x AS (SELECT page_id, {sql_pick('page_id', TITLES)} AS t, {sql_pick('(page_id // 13)', LANG_OF)} AS l FROM pages)
    SELECT page_id, CASE WHEN l = 'zh' THEN {cascade('t', titles.CONTENT_ZH, until)} ELSE {OTHER_SQL} END AS title FROM x""",
)
def _(spark, d):
    t, l = pick("page_id", TITLES), F.get(F.array(*[F.lit(v) for v in LANG_OF]), ((F.col("page_id") / 13).cast("int") % len(LANG_OF)))  # noqa: E741
    return table(spark, d, "pages").select("page_id", titles.content_title_clean(t, l).alias("title"))


@query(
    "similarity",
    """WITH x AS (SELECT p_partkey, regexp_replace(p_name, '[^\\pL\\pN]', '', 'g') AS a, regexp_replace(p_type, '[^\\pL\\pN]', '', 'g') AS b FROM part)
    SELECT p_partkey, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 0.0 ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 6) AS sim FROM x""",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(text.similarity(F.col("p_name"), F.col("p_type")), 6).alias("sim"))


# hosts

LOOKUP = f"""rules AS (SELECT unnest([{', '.join(map(sql_text, SUFFIXES))}]) AS s),
    h AS (SELECT page_id, lower(regexp_replace(trim(host), '\\.$', '')) AS h, host FROM (SELECT page_id, {sql_pick('page_id', HOSTS)} AS host FROM pages)),
    l AS (SELECT *, string_split(h, '.') AS a FROM h),
    n AS (SELECT *, CASE WHEN h = 'www.ck' THEN 1 WHEN h LIKE '%.ck' THEN 2 ELSE greatest(1,
      coalesce((SELECT max(len(string_split(s, '.'))) FROM rules WHERE h = s OR h LIKE '%.' || s), 1)) END AS k,
      h LIKE '%.ck' OR EXISTS (SELECT 1 FROM rules WHERE h = s OR h LIKE '%.' || s) AS icann FROM l),
    f AS (SELECT *, h <> '' AND len(a) > k AND NOT list_contains(a, '') AS ok FROM n),
    d AS (SELECT page_id, host, h, CASE WHEN ok THEN array_to_string(a[1:len(a)-k-1], '.') END AS subdomain, CASE WHEN ok THEN a[len(a)-k] END AS domain,
      CASE WHEN ok THEN array_to_string(a[len(a)-k+1:len(a)], '.') END AS tld, CASE WHEN ok THEN icann END AS icann FROM f)"""


def parsed_hosts(spark, d):
    x = table(spark, d, "pages").select("page_id", pick("page_id", HOSTS).alias("host"))
    return domain.domain_parse(x, "host", "d")


@query("domain_parse", f"WITH {LOOKUP} SELECT page_id, host, subdomain, domain, tld, icann FROM d")
def _(spark, d):
    return parsed_hosts(spark, d).select("page_id", "host", "d.*")


@query("domain_top", f"WITH {LOOKUP} SELECT page_id, coalesce(domain || '.' || tld, '') AS top FROM d")
def _(spark, d):
    return parsed_hosts(spark, d).select("page_id", domain.domain_top(F.col("d")).alias("top"))


@query("domain_top_url", f"SELECT page_id, regexp_extract({part('url', 2)}, '([^.]+\\.[^.]+)$', 1) AS top FROM pages")
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("h"))
    return domain.domain_parse(x, "h", "d").select("page_id", domain.domain_top(F.col("d")).alias("top"))


@query("domain_parse_url", f"SELECT page_id, regexp_extract(h, '^(.*)\\.[^.]+\\.[^.]+$', 1) AS subdomain, regexp_extract(h, '([^.]+)\\.[^.]+$', 1) AS domain, regexp_extract(h, '([^.]+)$', 1) AS tld, true AS icann FROM (SELECT page_id, {part('url', 2)} AS h FROM pages)")
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", urls.hostname(F.col("url")).alias("h"))
    return domain.domain_parse(x, "h", "d").select("page_id", "d.*")


GOV = ", ".join(f"('gov.{c}', '{n}')" for n, cs in domain.GOVERNMENTS.items() for c in cs.split())
BY = ", ".join(f"('{k}', '{v}')" for k, v in domain.BY_LANG.items())


@query(
    "meta_from_host",
    f"""WITH {LOOKUP}, g(t, c) AS (VALUES {GOV}), b(k, c2) AS (VALUES {BY}), x AS (SELECT d.*, {sql_pick('(page_id // 25)', LANG_OF)} AS l, regexp_extract(h, '\\.([a-z]+)$', 1) AS code FROM d),
    y AS (SELECT x.*, g.c, b.c2, code IN ('hk', 'tw', 'mo') AND l = 'zh' AS zh FROM x LEFT JOIN g ON g.t = tld LEFT JOIN b ON b.k = code || '/' || l)
    SELECT page_id, CASE WHEN domain IS NULL THEN '' WHEN tld = 'gov' THEN '美国' WHEN c IS NOT NULL THEN c WHEN zh THEN '中国' ELSE coalesce(c2, '') END AS country,
      CASE WHEN domain IS NOT NULL AND zh AND tld <> 'gov' THEN CASE code WHEN 'hk' THEN '中国香港' WHEN 'tw' THEN '中国台湾' ELSE '中国澳门' END ELSE '' END AS province,
      CASE WHEN domain IS NOT NULL AND (tld = 'gov' OR c IS NOT NULL) THEN '政务' ELSE '' END AS category FROM y""",
)
def _(spark, d):
    l = F.get(F.array(*[F.lit(v) for v in LANG_OF]), (F.col("page_id") / 25).cast("int") % len(LANG_OF))  # noqa: E741
    x = parsed_hosts(spark, d)
    return x.select("page_id", domain.meta_from_host(F.col("host"), l, F.col("d")).alias("m")).select("page_id", "m.*")


def sql_icp(t: str, g: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({t}, {sql_text(p)}, {g}), '')" for p in (registration.ICP, registration.POLICE, registration.TELECOM)) + ", '')"


@query("icp_from_text", f"SELECT page_id, {sql_icp('t', 0)} AS icp, {sql_icp('t', 1)} AS province_short FROM (SELECT page_id, {sql_pick('page_id', ICPS)} AS t FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", registration.icp_from_text(pick("page_id", ICPS)).alias("i")).select("page_id", "i.*")


PROVINCES = ", ".join(f"('{k}', '{v}')" for k, v in registration.PROVINCES.items())


@query("province_name", f"WITH p(k, v) AS (VALUES {PROVINCES}) SELECT page_id, coalesce(v, '') AS province FROM (SELECT page_id, {sql_pick('page_id', [*registration.PROVINCES, 'x', ''])} AS s FROM pages) LEFT JOIN p ON p.k = s")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", registration.province_name(pick("page_id", [*registration.PROVINCES, "x", ""])).alias("province"))


# languages

BY_NAME = ", ".join(f"('{k}', '{v}')" for k, v in lang.NAMES.items())


@query("lang_name", f"WITH p(k, v) AS (VALUES {BY_NAME}) SELECT page_id, coalesce(v, '') AS name, coalesce(k, '') AS code FROM (SELECT page_id, {sql_pick('page_id', [*lang.NAMES, 'xx'])} AS s FROM pages) LEFT JOIN p ON p.k = s")
def _(spark, d):
    name = lang.lang_name(pick("page_id", [*lang.NAMES, "xx"]))
    return table(spark, d, "pages").select("page_id", name.alias("name"), lang.lang_code(name).alias("code"))


VALID = "regexp_matches(trim({c}), '^([A-Za-z]{{2}}|[A-Za-z]{{2}}-[A-Za-z]+)$')"


@query("lang_html", "SELECT page_id, CASE WHEN " + VALID.format(c="a") + " THEN left(trim(a), 2) WHEN " + VALID.format(c="b") + f" THEN left(trim(b), 2) ELSE '' END AS lang FROM (SELECT page_id, {sql_pick('page_id', CODES)} AS a, {sql_pick('(page_id // 10)', CODES)} AS b FROM pages)")
def _(spark, d):
    b = F.get(F.array(*[F.lit(v) for v in CODES]), (F.col("page_id") / 10).cast("int") % len(CODES))
    none = F.lit(None).cast("string")
    return table(spark, d, "pages").select("page_id", lang.lang_html(pick("page_id", CODES), none, b, none).alias("lang"))


TEXTS = list(SAMPLES.values())
CHUNK_SQL = "trim(left(regexp_replace(replace(replace(regexp_replace({t}, '[\\r\\n]', '', 'g'), chr(9), ''), '  ', ''), '[\\pP\\pS]', '', 'g'), 2048))"


def n_of(p: str, t: str = "t") -> str:
    return f"len(regexp_extract_all({t}, '{p}'))"


LANG_SQL = f"""CASE WHEN length(t) < 64 THEN '' WHEN {n_of('[\\p{Han}]')}::DOUBLE / length(t) >= 0.3 THEN CASE WHEN {n_of('[\\p{Hiragana}|\\p{Katakana}]')}::DOUBLE / {n_of('[\\p{Han}]')} > 0.1 THEN 'ja' ELSE 'zh' END
    WHEN {n_of('[a-zA-Z]')}::DOUBLE / length(t) > 0.618 THEN 'en' WHEN {n_of('[\\p{Arabic}]')}::DOUBLE / length(t) > 0.3 THEN 'ar' WHEN {n_of('[\\p{Cyrillic}]')}::DOUBLE / length(t) > 0.3 THEN 'ru' WHEN {n_of('[\\p{Hangul}]')}::DOUBLE / length(t) > 0.3 THEN 'ko' ELSE '' END"""


@query("lang_text", f"SELECT page_id, lang, CASE WHEN lang = '' THEN '' WHEN lang IN ('ar', 'ru', 'ko') THEN 'lingua' ELSE 'body' END AS lang_pos FROM (SELECT page_id, {LANG_SQL} AS lang FROM (SELECT page_id, {CHUNK_SQL.format(t=sql_pick('page_id', TEXTS))} AS t FROM pages))")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", lang.lang_text(pick("page_id", TEXTS)).alias("l")).select("page_id", "l.*")


TITLED = ["新闻中心", "Breaking news", "中 x", "日本語_新華網", ""]


@query(
    "lang_title",
    f"""WITH x AS (SELECT page_id, {sql_pick('page_id', TITLED)} AS t0, regexp_replace({sql_pick('(page_id // 5)', TEXTS)}, '[^\\pL\\pN]', '', 'g') AS b FROM pages)
    SELECT page_id, CASE WHEN {n_of('[\\p{Han}]', 't0')} < 2 THEN '' WHEN {n_of('[\\p{Hiragana}|\\p{Katakana}]', 'b')}::DOUBLE / length(b) > 0.2 THEN 'ja' WHEN {n_of('[\\p{Hangul}]', 'b')}::DOUBLE / length(b) > 0.2 THEN 'ko' ELSE 'zh' END AS lang FROM x""",
)
def _(spark, d):
    b = F.get(F.array(*[F.lit(v) for v in TEXTS]), (F.col("page_id") / 5).cast("int") % len(TEXTS))
    return table(spark, d, "pages").select("page_id", lang.lang_title(pick("page_id", TITLED), b).alias("lang"))


# links by title

ANCHORS = [
    "nba", "体育", "要闻", "国家主席发表重要讲话内容", "中央经济工作会议，", "国务院办公厅新", "今天 北京 新闻 发布 会", "One two three four five", "Short title", "Новости сегодня в мире и стране",
    "abc", "!!!", "", "经营许可证信息查询系统首页",
]
TARGETS = ["https://a.example.com/news/1.html", "https://a.example.com/", "https://a.example.com/index.html", "https://a.example.com", "https://a.example.com/" + "x" * 250, "https://a.example.com/2024/05/1.html"]
KIND_SQL = f"""CASE WHEN length(u) > 255 THEN 'NONE' WHEN {sql_path('u')} IN ('', '/') OR regexp_matches({sql_path('u')}, '^/index\\.(aspx?|s?html|htm|jsp|php)$') THEN 'NONE'
    WHEN l = 'zh' THEN CASE WHEN {n_of('[\\p{Han}]')} = 0 THEN CASE WHEN lower(t) IN ('5g', 'ai', 'cba', 'ipo', 'it', 'nba') THEN 'LIST' ELSE 'NONE' END WHEN {n_of('[\\p{Han}]')} <= 5 THEN 'LIST'
      WHEN length(replace(t, ' ', '')) >= 8 OR regexp_matches(t, '[，。；：？！（）“”]') THEN 'CONTENT' ELSE 'UNKNOWN' END
    WHEN l IN ('en', 'fr') THEN CASE WHEN NOT regexp_matches(regexp_replace(t, '\\pP', '', 'g'), '[a-zA-Z]') THEN 'NONE' WHEN len(list_filter(string_split(regexp_replace(t, '\\pP', '', 'g'), ' '), lambda x: trim(x) <> '')) >= 5 THEN 'CONTENT' ELSE 'LIST' END
    WHEN length(regexp_replace(t, '\\pP', '', 'g')) >= 8 THEN 'CONTENT' ELSE 'LIST' END"""


@query("link_by_title", f"SELECT page_id, {KIND_SQL} AS kind FROM (SELECT page_id, {sql_pick('page_id', ANCHORS)} AS t, {sql_pick('(page_id // 14)', TARGETS)} AS u, {sql_pick('(page_id // 7)', LANG_OF)} AS l FROM pages)")
def _(spark, d):
    nth = lambda n, vs: F.get(F.array(*[F.lit(v) for v in vs]), (F.col("page_id") / n).cast("int") % len(vs))
    return table(spark, d, "pages").select("page_id", link_ops.link_by_title(nth(14, TARGETS), pick("page_id", ANCHORS), nth(7, LANG_OF)).alias("kind"))


@query("link_clean", f"SELECT page_id, CASE WHEN l = 'zh' AND regexp_matches(t, '(视听|经营|出版服务|新网|制作|视听节目|出版|新闻|信息服务|演出)许可证') THEN 'NONE' ELSE 'CONTENT' END AS kind FROM (SELECT page_id, {sql_pick('page_id', ANCHORS)} AS t, {sql_pick('(page_id // 14)', LANG_OF)} AS l FROM pages)")
def _(spark, d):
    l = F.get(F.array(*[F.lit(v) for v in LANG_OF]), (F.col("page_id") / 14).cast("int") % len(LANG_OF))  # noqa: E741
    return table(spark, d, "pages").select("page_id", link_ops.link_clean(F.lit("CONTENT"), pick("page_id", ANCHORS), l).alias("kind"))
