"""URLs: parts, resolution against a base, paths, and the reasons for which a link is turned down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, trimmed

PARTS = "^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(\\?[^#]*)?(#.*)?"
SCHEME = "^[A-Za-z][A-Za-z0-9+.\\-]*:"
SUFFIXES = (
    "7z apk bmp bz2 cgi doc docx exe flv gif gz jpeg jpg mov mp3 mp4 ogv pdf play png ppt pptx rar rm rmvb rss sgf sig txt xls xlsx xml zip"
).split()
ILLEGAL = "[{}\\[\\]@$<>\"]"
IPV4 = "\\d{1,3}(?:\\.\\d{1,3}){3}"
DATED = "20[23]\\d/?(?:1[0-2]|0?[1-9])/?(?:[12]\\d|3[01]|0?[1-9])?"
INDEX = "^/index\\.(?:aspx?|s?html|htm|jsp|php)\\z"
REASONS = {
    "illegal": "invalid url with illegal characters",
    "base": "invalid url with baseUrl parse error",
    "parse": "invalid url with parse error",
    "relative": "invalid url with not absolute url",
    "port": "invalid url with not 80 port",
    "ip": "invalid url with ip hostname",
    "suffix": "invalid url with suffix",
    "strict": "invalid url with strict domain",
}


def part(url: Column, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query with ?, 5 fragment with #."""
    return F.regexp_extract(blank(url), PARTS, k)


def host_port(url: Column) -> Column:
    return F.regexp_replace(part(url, 2), "^.*@", "")


def hostname(url: Column) -> Column:
    return F.regexp_replace(host_port(url), ":[0-9]*\\z", "")


def port(url: Column) -> Column:
    return F.regexp_extract(host_port(url), ":([0-9]*)\\z", 1)


def path(url: Column) -> Column:
    """Path of a URL; empty for an opaque one such as javascript:x."""
    opaque = (part(url, 1) != "") & (part(url, 2) == "") & ~part(url, 3).startswith("/")
    return F.when(opaque, "").otherwise(part(url, 3))


def remove_dots(p: Column) -> Column:
    """RFC 3986 dot segments of an absolute path."""
    segments = F.split(p, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda a, s: F.when(s == ".", a)
        .when(s == "..", F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a))
        .otherwise(F.concat(a, F.array(s))),
    )
    open_end = p.rlike("(?:^|/)\\.\\.?\\z")
    return F.concat(F.array_join(kept, "/"), F.when(open_end & (p != ""), "/").otherwise(""))


def url_resolve(link: Column, base: Column) -> Column:
    """Absolute where it begins with http in any case; else RFC 3986 resolution against base."""
    scheme, authority, where = part(base, 1), part(base, 2), part(base, 3)
    origin = F.concat(scheme, F.lit("://"), authority)
    lead = F.regexp_extract(link, "^[^?#]*", 0)
    tail = F.regexp_extract(link, "[?#].*\\z", 0)
    merged = F.concat(F.when(where == "", "/").otherwise(F.regexp_replace(where, "[^/]*\\z", "")), lead)
    return (
        F.when(F.lower(link).startswith("http"), link)
        .when(link.rlike(SCHEME), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link == "", F.concat(origin, where, part(base, 4)))
        .when(link.startswith("#"), F.concat(origin, where, part(base, 4), link))
        .when(link.startswith("?"), F.concat(origin, where, link))
        .when(link.startswith("/"), F.concat(origin, remove_dots(lead), tail))
        .otherwise(F.concat(origin, remove_dots(merged), tail))
    )


def url_reason(link: Column, url: Column, base: Column, strict: Column, top: Column, base_top: Column) -> Column:
    """Why a link is turned down; null for an accepted one. url: what it resolves to."""
    suffix = F.lower(F.regexp_extract(path(url), "\\.([^./]*)\\z", 1))
    return (
        F.when(link.rlike(ILLEGAL), REASONS["illegal"])
        .when((part(base, 1) == "") & ~F.lower(link).startswith("http"), REASONS["base"])
        .when(url.rlike("[\\x00-\\x20\\x7F]") | url.rlike("%(?![0-9A-Fa-f]{2})"), REASONS["parse"])
        .when(~url.rlike(SCHEME), REASONS["relative"])
        .when(port(url) != "", REASONS["port"])
        .when(hostname(url).rlike(IPV4), REASONS["ip"])
        .when(suffix.isin(*SUFFIXES), REASONS["suffix"])
        .when(strict & (blank(top) != blank(base_top)), REASONS["strict"])
    )


def url_filter(link: Column, base: Column, strict: Column, top: Column, base_top: Column) -> Column:
    """struct(url, reason): reason is null for an accepted link.

    top and base_top: registrable domains of the resolved link's and the base's host (see domain.py).
    """
    given = blank(link)
    url = F.when(given.rlike(ILLEGAL), given).otherwise(url_resolve(given, blank(base)))
    return let(url, lambda u: F.struct(u.alias("url"), url_reason(given, u, base, strict, top, base_top).alias("reason")))


def path_dir(p: Column) -> Column:
    """All but the last element of a path, cleaned; '.' for an empty path."""
    cut = F.regexp_replace(F.regexp_replace(blank(p), "[^/]*\\z", ""), "/{2,}", "/")
    bare = F.regexp_replace(cut, "(.)/\\z", "$1")
    return F.when(bare == "", ".").otherwise(bare)


def path_dir_clean(p: Column) -> Column:
    return F.translate(blank(p), ".-_", "")


def path_first_seg(p: Column) -> Column:
    """First non-blank segment of the directory of a path; null without one."""
    return F.get(F.filter(F.split(path_dir(p), "/"), lambda x: F.trim(x) != ""), 0)


def url_publish_date(p: Column) -> Column:
    """Does the directory of a path hold a date of the 2020s or 2030s?"""
    return path_dir_clean(path_dir(trimmed(p))).rlike(DATED)


def no_path(p: Column) -> Column:
    """Empty, root or index paths."""
    t = trimmed(p)
    return (t == "") | (t == "/") | t.rlike(INDEX)


def index_url(url: Column) -> Column:
    """struct(scheme_url, index): what a site's name or address has as its front page."""
    bits = F.split(blank(url), "/")
    one = F.size(bits) < 3
    scheme = F.when(one, "https://").otherwise(F.concat(F.get(bits, 0), F.lit("//")))
    index = F.when(one, F.concat(F.lit("https://www."), F.get(bits, 0))).otherwise(F.concat(scheme, F.get(bits, 2)))
    return F.struct(scheme.alias("scheme_url"), index.alias("index_url"))
