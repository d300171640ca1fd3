"""Scalar functions on cases whose results follow from their definitions by hand."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import charset, domain, lang, registration, text, times, titles, urls
from pagemill.operators import links


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_a_body_is_searched_once_for_registrations(spark):
    df = spark.createDataFrame([("a 粤 ICP\n备 123 号",), ("x 京公网安备 11\t沪B2-1",), ("",), (None,)], "body string").select(registration.icp_doc(F.col("body")).alias("i")).select("i.*")
    assert [tuple(r) for r in df.collect()] == [("粤ICP备123", "粤"), ("京公网安备11", "京"), ("", ""), ("", "")]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.count("body#") < 8
    given = [("".join(random.Random(k).choices(["粤", "京", "台", "ICP", "icp", "备案", "证", "公网安备", "B2-", "b2-", "12", " "], k=12)),) for k in range(600)]
    each = [F.struct(F.regexp_extract("t", p, 0).alias("icp"), F.regexp_extract("t", p, 1).alias("short")) for p in (registration.ICP, registration.POLICE, registration.TELECOM)]
    want = F.coalesce(F.get(F.filter(F.array(*each), lambda x: x["icp"] != ""), 0), F.struct(F.lit("").alias("icp"), F.lit("").alias("short")))
    got = spark.createDataFrame(given, "t string").select(registration.icp_from_text(F.col("t")).alias("got"), want.alias("want")).collect()
    assert all(tuple(r["got"]) == tuple(r["want"]) for r in got) and sum(r["want"][0] != "" for r in got) > 30


@pytest.mark.parametrize(
    "given, icp, province",
    [
        ("粤ICP备17055554号", "粤ICP备17055554", "粤"),
        ("粤ICP备17055554-34号", "粤ICP备17055554", "粤"),
        ("京公网安备31010402001073号", "京公网安备31010402001073", "京"),
        ("京公网安备-31010-4020010-73号", "", ""),
        ("鲁ICP备05002386鲁公网安备37070502000027号", "鲁ICP备05002386", "鲁"),
        ("粤B2-20090059", "粤B2-20090059", "粤"),
        (None, "", ""),
    ],
)
def test_icp(spark, given, icp, province):
    r = one(spark, registration.icp_from_text(F.lit(given).cast("string")))
    assert (r["icp"], r["province_short"]) == (icp, province)


@pytest.mark.parametrize("short, name", [("粤", "广东"), ("秦", "陕西"), ("蜀", "四川"), ("黔", "贵州"), ("陇", "甘肃"), ("蒙", "内蒙古"), ("黑", "黑龙江"), ("台", "中国台湾"), ("x", "")])
def test_province(spark, short, name):
    assert one(spark, registration.province_name(F.lit(short))) == name


BASE = "http://www.example.com/a/b/"


@pytest.mark.parametrize(
    "link, url, reason",
    [
        ("./d/45.html", "http://www.example.com/a/b/d/45.html", None),
        ("../d/45.html", "http://www.example.com/a/d/45.html", None),
        ("/d/45.html", "http://www.example.com/d/45.html", None),
        ("//www.example.com/d/45.html", "http://www.example.com/d/45.html", None),
        ("//www.example.com/d/45.pdf?k=1", "http://www.example.com/d/45.pdf?k=1", "invalid url with suffix"),
        ("a{b}", "a{b}", "invalid url with illegal characters"),
        ("http://1.2.3.4/x", "http://1.2.3.4/x", "invalid url with ip hostname"),
        ("http://www.example.com:80/x", "http://www.example.com:80/x", "invalid url with not 80 port"),
        ("http://qq.com/x", "http://qq.com/x", "invalid url with strict domain"),
        ("javascript:;", "javascript:;", "invalid url with strict domain"),
    ],
)
def test_url_filter(spark, link, url, reason):
    df = spark.createDataFrame([(link,)], "l string").withColumn("h", urls.hostname(urls.url_resolve(F.col("l"), F.lit(BASE))))
    df = domain.domain_parse(df, "h", "d")
    r = df.select(urls.url_filter(F.col("l"), F.lit(BASE), F.lit(True), domain.domain_top(F.col("d")), F.lit("example.com")).alias("f")).first()["f"]
    assert (r["url"], r["reason"]) == (url, reason)


@pytest.mark.parametrize("path, found", [("/a/b/", "/a/b"), ("/a", "/"), ("", "."), ("/", "/")])
def test_path_dir(spark, path, found):
    assert one(spark, urls.path_dir(F.lit(path))) == found


HOSTS = {
    "bbc.co.uk": ("", "bbc", "co.uk", True),
    "dealer.auto.sohu.com": ("dealer.auto", "sohu", "com", True),
    "www.gov.cn": ("", "www", "gov.cn", True),
    "a.foo.ck": ("", "a", "foo.ck", True),
    "www.ck": ("", "www", "ck", True),
    "x.y.github.io": ("x", "y", "github.io", False),
    "a.unknowntld": ("", "a", "unknowntld", False),
    "co.uk": None,
    "": None,
    "a..com": None,
}


def test_domain_parse(spark):
    df = spark.createDataFrame([(h,) for h in [*HOSTS, None]], "h string")
    got = {r["h"]: tuple(r["d"]) if r["d"] else None for r in domain.domain_parse(df, "h", "d").collect()}
    assert got == {**HOSTS, None: None}


@pytest.mark.parametrize(
    "host, language, found",
    [
        ("nasa.gov", "", ("美国", "", "政务")), ("archives.gov.mo", "", ("中国", "", "政务")), ("mfa.gov.sg", "", ("新加坡", "", "政务")),
        ("matichon.co.th", "", ("", "", "")), ("a.gov.hk", "zh", ("中国", "中国香港", "政务")), ("news.tw", "zh", ("中国", "中国台湾", "")), ("www.lemonde.fr", "fr", ("法国", "", "")), ("co.uk", "en", ("", "", "")),
    ],
)
def test_meta_from_host(spark, host, language, found):
    df = domain.domain_parse(spark.createDataFrame([(host,)], "h string"), "h", "d")
    assert tuple(df.select(domain.meta_from_host(F.col("h"), F.lit(language), F.col("d")).alias("m")).first()["m"]) == found


@pytest.mark.parametrize(
    "title, language, found",
    [
        ("About the Project on Nuclear Issues | Center for x", "en", "About the Project on Nuclear Issues"),
        ("首页_新华网 - 新闻", "zh", "新华网"),
        ("_要闻|首页", "zh", "要闻"),
        ("首页", "zh", ""),
        ("a - b - c", "", "a - b"),
        ("x: y", "de", "x"),
        (None, "zh", ""),
    ],
)
def test_web_title_clean(spark, title, language, found):
    assert one(spark, titles.web_title_clean(F.lit(title).cast("string"), F.lit(language))) == found


@pytest.mark.parametrize("code, found", [("zh", "zh"), ("en", "en"), ("zh-cn", "zh"), ("utf-8", ""), ("EN", "EN"), ("zh-Hans-CN", "")])
def test_lang_html(spark, code, found):
    none = F.lit(None).cast("string")
    assert one(spark, lang.lang_html(F.lit(code), none, none, none)) == found


def test_lang_text_needs_64_characters(spark):
    assert tuple(one(spark, lang.lang_text(F.lit("中文")))) == ("", "")
    assert tuple(one(spark, lang.lang_text(F.lit("中文新闻" * 20)))) == ("zh", "body")
    assert tuple(one(spark, lang.lang_text(F.lit("हिन्दी समाचार पत्र में आज की मुख्य खबरें " * 4)))) == ("hi", "lingua")


def test_latin_text_with_accents(spark):
    french = "Le gouvernement a annoncé aujourd'hui que les nouvelles règles pour les écoles seront appliquées dans toutes les régions du pays à la rentrée"
    assert tuple(one(spark, lang.lang_text(F.lit(french)))) == ("fr", "lingua")
    assert tuple(one(spark, lang.lang_text(F.lit("Die Regierung hat für die nächsten Jahre größere Änderungen angekündigt und möchte die Schulen in allen Ländern stärken")))) == ("de", "lingua")


@pytest.mark.parametrize(
    "name, found", [("utf8", "UTF-8"), ("gb2312", "GBK"), ("big5-hkscs", "Big5"), ("Shift-JIS", "SHIFT_JIS"), ("", ""), (None, "")]
)
def test_charset_names(spark, name, found):
    assert one(spark, charset.charset_normalize(F.lit(name).cast("string"))) == found


def test_charset_earlier_meta_wins(spark):
    page = '<meta charset="gb18030"><meta http-equiv="Content-Type" content="text/html; charset=big5">'
    assert one(spark, charset.charset_html(F.lit(page))) == "GBK"
    assert tuple(one(spark, charset.charset_header_html(F.lit("text/html; charset=iso-8859-1"), F.lit(page)))) == ("GBK", "html")


def test_similarity(spark):
    assert one(spark, text.similarity(F.lit("a-b c"), F.lit("abd"))) == pytest.approx(2 / 3)
    assert one(spark, text.similarity(F.lit("--"), F.lit(None).cast("string"))) == 0


NOW = "2026-01-15 12:00:00"


@pytest.mark.parametrize(
    "body, language, found",
    [
        ("2022-05-26 17:00:57 UTC", "en", "2022-05-26 17:00:57"),
        ("x 22-09-02 11:11:11 y", "en", "22-09-02 11:11:11"),
        ("发布 09-02 08:30 编辑", "zh", "2026-09-02 08:30"),
        ("发布 9月2日 08:30 编辑", "zh", "2026年9月2日 08:30"),
        ("09-02 08:30", "en", ""),
        ("2021-01-01 and 2022-02-02 and 2039-09-09", "en", "2022-02-02"),
    ],
)
def test_time_by_body(spark, body, language, found):
    got = times.time_by_body(F.lit(body), F.lit(language), F.lit(""), F.lit(""), F.lit(NOW).cast("timestamp"))
    assert one(spark, got) == found


def test_addresses_of_hosts_are_no_dates(spark):
    none, now = F.lit(""), F.lit(NOW).cast("timestamp")
    us = lambda t: one(spark, times.time_by_lang(F.lit(t), F.lit("en"), none, none, now)["time"])
    assert us("seen at 14.14.156.110 and 91.12.248.113") == ""
    assert us("seen at 14.14.156.110 on 8/30/2022 11:11:11.") == "8/30/2022 11:11:11"
    short = lambda t, l: one(spark, times.time_by_body(F.lit(t), F.lit(l), none, none, now))  # noqa: E731, E741
    assert short("host 23.1.15.7 is down", "en") == ""
    assert short("host 23.1.15.7 is down, 23.1.16", "en") == "23.1.16"
    assert short("host 10.9.1.2 10:30 起", "zh") == ""


def test_pick_dates_near_the_title(spark):
    body = F.lit("2020-01-01 10:00 " + "far " * 30 + "My title 2021-02-03 11:12:13")
    got = times.pick_dates(body, times.every(body, times.SHORT), F.lit("My title"), F.lit("headline"))
    assert one(spark, got) == "2021-02-03 11:12:13"
    got = times.pick_dates(body, times.every(body, times.SHORT), F.lit("My title"), F.lit("meta"))
    assert one(spark, got) == "2020-01-01 10:00"


@pytest.mark.parametrize(
    "given, found",
    [("2024年5月6日 7时8分", "2024-05-06 07:08:00"), ("6 May 2024", "2024-05-06 00:00:00"), ("May 6 2024 07:08", "2024-05-06 07:08:00"), ("5/6/2024 07:08:09", "2024-05-06 07:08:09"), ("2024-05-06T07:08:09+02:00", "2024-05-06 05:08:09"), ("20240506", "2024-05-06 00:00:00"), ("soon", "")],
)
def test_parse_time(spark, given, found):
    assert one(spark, times.parse_time(F.lit(given))) == found


def test_formats_are_tried_where_they_can_fit_alone(spark):
    given = ["2024-05-06 7:8:9", "2024-5-6", "2024/05/06 07:08", "2024.5.6", "2024年5月6日7:08", "2024-05-06t07:08:09", "20240506", "6 may 2024", "MAY 6 2024 07:08", "6 September 2024", "5/6/2024", "2024-13-01", "6 Mai 2024", ""]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    plain = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in times.FORMATS], F.try_to_timestamp("t"))
    fits = sum((F.col("t").rlike(times.shape(f)).cast("int") for f in times.FORMATS), F.lit(0))
    for r in df.select("t", times.parsed(F.col("t")).alias("got"), plain.alias("want"), fits.alias("fits")).collect():
        assert r["got"] == r["want"] and r["fits"] <= 2, r


@pytest.mark.parametrize(
    "url, title, language, kind",
    [
        ("https://a.com/x", "nba", "zh", "LIST"), ("https://a.com/x", "abc", "zh", "NONE"), ("https://a.com/x", "国务院办公厅新", "zh", "UNKNOWN"), ("https://a.com/x", "中国足球队赢了！", "zh", "CONTENT"),
        ("https://a.com/", "One two three four five", "en", "NONE"), ("https://a.com/x", "One two three four five", "en", "CONTENT"), ("https://a.com/x", "Новости сегодня в мире и стране", "ru", "NONE"),
        ("https://a.com/x", "12345678", "", "CONTENT"), ("https://a.com/x", "1234567", "", "LIST"), ("https://a.com/" + "x" * 250, "One two three four five", "en", "NONE"),
    ],
)
def test_link_by_title(spark, url, title, language, kind):
    assert one(spark, links.link_by_title(F.lit(url), F.lit(title), F.lit(language))) == kind
