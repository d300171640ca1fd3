"""Registrable domains by the public suffix list, and what a host name says about its site."""

from __future__ import annotations

import gzip
from functools import lru_cache
from pathlib import Path
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import blank, built_once, literal_map

LIST = Path(__file__).with_name("data") / "public_suffix.txt.gz"

#: Countries of governmental suffixes gov.<code>, by name of the country.
GOVERNMENTS = {
    "中国": "hk mo tw", "日本": "jp", "韩国": "kr", "朝鲜": "kp", "印度": "in", "印度尼西亚": "id", "泰国": "th", "越南": "vn",
    "新加坡": "sg", "马来西亚": "my", "菲律宾": "ph", "缅甸": "mm", "尼泊尔": "np", "斯里兰卡": "lk", "孟加拉国": "bd", "巴基斯坦": "pk",
    "阿富汗": "af", "伊朗": "ir", "伊拉克": "iq", "以色列": "il", "黎巴嫩": "lb", "沙特阿拉伯": "sa", "土耳其": "tr", "亚美尼亚": "am",
    "埃及": "eg", "摩洛哥": "ma", "阿尔及利亚": "dz", "尼日利亚": "ng", "安哥拉": "ao", "南非": "az",
    "英国": "uk", "爱尔兰": "ie", "法国": "fr", "德国": "de", "荷兰": "nl", "比利时": "be", "西班牙": "es", "葡萄牙": "pt", "意大利": "it",
    "希腊": "gr", "瑞典": "se", "波兰": "pl", "捷克": "cz", "斯洛伐克": "sk", "斯洛文尼亚": "si", "匈牙利": "hu", "克罗地亚": "hr",
    "罗马尼亚": "ro", "保加利亚": "bg", "阿尔巴尼亚": "al", "立陶宛": "lt", "乌克兰": "ua", "俄罗斯": "ru",
    "美国": "us", "加拿大": "ca", "巴西": "br", "智利": "cl", "哥伦比亚": "co", "巴拉圭": "py", "阿鲁巴": "aw", "安圭拉": "ai", "澳大利亚": "au",
}
REGIONS = {"hk": "中国香港", "mo": "中国澳门", "tw": "中国台湾"}
#: Country of a plain suffix, where the page's language agrees.
BY_LANG = {"cn/zh": "中国", "de/de": "德国", "es/es": "西班牙", "fr/fr": "法国", "in/hi": "印度", "jp/ja": "日本", "kr/ko": "韩国", "ru/ru": "俄罗斯", "uk/en": "英国", "us/en": "美国"}


@lru_cache(maxsize=1)
def rules() -> pa.Table:
    """The snapshot by key (the last two labels of a rule, or its only one): entries (suffix, labels, kind, icann).

    kind: 0 a rule, 1 a rule for everything one label longer, 2 an exception to such a rule.
    """
    found: dict[str, list[dict]] = {}
    for line in gzip.decompress(LIST.read_bytes()).decode().split("\n"):
        if not line or line.startswith("#"):
            continue
        icann, rule = line[0] != "-", line.lstrip("-")
        kind = 1 if rule.startswith("*.") else 2 if rule.startswith("!") else 0
        suffix = rule.removeprefix("*.").removeprefix("!")
        labels = suffix.split(".")
        found.setdefault(".".join(labels[-2:]), []).append({"suffix": suffix, "labels": len(labels), "kind": kind, "icann": icann})
    entry = pa.struct([("suffix", pa.string()), ("labels", pa.int32()), ("kind", pa.int32()), ("icann", pa.bool_())])
    return pa.table({"key": pa.array(list(found)), "entries": pa.array(list(found.values()), pa.list_(entry))})


TABLES: WeakKeyDictionary[SparkSession, DataFrame] = WeakKeyDictionary()


def suffix_table(spark: SparkSession) -> DataFrame:
    """The rules as a local table of fixed size (some 10,000 rules), small enough to broadcast; made once a session."""
    if spark not in TABLES:
        TABLES[spark] = spark.createDataFrame(rules())
    return TABLES[spark]


@built_once
def _host_parts(host: str) -> dict[str, Column]:
    h = F.lower(F.regexp_replace(F.trim(blank(F.col(host))), "\\.\\z", ""))
    return {"_h": h, "_labels": F.split(h, "\\."), "_k1": F.substring_index(h, ".", -1), "_k2": F.when(F.contains(h, F.lit(".")), F.substring_index(h, ".", -2))}


def domain_parse(df: DataFrame, host: str, out: str = "domain") -> DataFrame:
    """Adds a struct (subdomain, domain, tld, icann); null for a blank host or one that is a bare suffix.

    Two broadcast lookups a host, by its last label and by its last two; the few rules found there are
    compared with the host in place. No shuffle, no user function.
    """
    table = suffix_table(df.sparkSession)
    work = df.withColumns(_host_parts(host))
    for k in (1, 2):
        side = table.select(F.col("key").alias(f"_key{k}"), F.col("entries").alias(f"_e{k}"))
        work = work.join(F.broadcast(side), F.col(f"_k{k}") == F.col(f"_key{k}"), "left")
    best, found, domain = _parse_steps()
    return work.withColumn("_best", best).withColumns(found).withColumn(out, domain).select(*[c for c in df.columns if c != out], out)


@built_once
def _parse_steps() -> tuple[Column, dict[str, Column], Column]:
    """Of a host _h, its _labels and the rules _e1, _e2: the _best rule, what it says, the parsed domain."""
    none = F.array().cast("array<struct<suffix:string,labels:int,kind:int,icann:boolean>>")
    entries = F.concat(F.coalesce("_e1", none), F.coalesce("_e2", none))
    size = F.size("_labels")
    fits = lambda x: ((F.col("_h") == x["suffix"]) | F.col("_h").endswith(F.concat(F.lit("."), x["suffix"]))) & ((x["kind"] != 1) | (size > x["labels"]))
    rank = lambda x: F.struct((x["kind"] == 2).alias("e"), (x["labels"] + F.when(x["kind"] == 0, 0).when(x["kind"] == 1, 1).otherwise(-1)).alias("n"), x["icann"].alias("icann"))
    best = F.array_max(F.transform(F.filter(entries, fits), rank))
    found = {"_n": F.coalesce("_best.n", F.lit(1)), "_i": F.coalesce("_best.icann", F.lit(False))}
    fine = (F.col("_h") != "") & (size > F.col("_n")) & ~F.array_contains("_labels", "")
    left = F.greatest(size - F.col("_n") - 1, F.lit(0))
    domain = F.when(
        fine,
        F.struct(
            F.array_join(F.slice("_labels", F.lit(1), left), ".").alias("subdomain"),
            F.get("_labels", left).alias("domain"),
            F.array_join(F.slice("_labels", left + 2, F.greatest(F.col("_n"), F.lit(0))), ".").alias("tld"),
            F.col("_i").alias("icann"),
        ),
    )
    return best, found, domain


def domain_top(domain: Column) -> Column:
    """domain.tld of a parsed domain, or ''."""
    return F.when(domain.isNull(), "").otherwise(F.concat(domain["domain"], F.lit("."), domain["tld"]))


def meta_from_host(host: Column, lang: Column, domain: Column) -> Column:
    """struct(country, province, category) of a host; domain as domain_parse gives it."""
    h, l = F.lower(blank(host)), blank(lang)  # noqa: E741
    code = F.regexp_extract(h, "\\.([a-z]+)\\z", 1)
    gov = {f"gov.{c}": name for name, codes in GOVERNMENTS.items() for c in codes.split()}
    country = F.when(domain["tld"] == "gov", "美国").otherwise(F.try_element_at(literal_map(gov), domain["tld"]))
    zh = code.isin(*REGIONS) & (l == "zh")
    region = F.try_element_at(literal_map(REGIONS), code)
    plain = F.when(zh, "中国").otherwise(F.try_element_at(literal_map(BY_LANG), F.concat_ws("/", code, l)))
    known = domain.isNotNull()
    return F.struct(
        F.when(known, F.coalesce(country, plain, F.lit(""))).otherwise("").alias("country"),
        F.when(known & zh & (domain["tld"] != "gov"), region).otherwise("").alias("province"),
        F.when(known & country.isNotNull(), "政务").otherwise("").alias("category"),
    )
