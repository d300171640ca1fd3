"""Character sets: where a page says which one it uses, names, guesses, decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let

NAMED = "(?i)" + "charset=" + "\\s*([a-z][\\w-]*)"
META4 = "(?is)<meta([^>]*http-equiv=[\"']?content-type[^>]*)>"
META5 = "(?is)<meta[^>]*\\scharset=[\"']?\\s*([a-z][\\w-]*)"
#: Python's codec for each charset that decode_body knows besides UTF-8 (supersets where pages are often mislabelled).
CODECS = {
    "GBK": "gb18030", "GB18030": "gb18030", "BIG5": "cp950", "SHIFT_JIS": "cp932", "EUC-JP": "euc_jp", "ISO-2022-JP": "iso2022_jp", "EUC-KR": "cp949", "ISO-2022-KR": "iso2022_kr",
    "KOI8-R": "koi8_r", "KOI8-U": "koi8_u", "US-ASCII": "ascii", "UTF-16": "utf_16", "UTF-16LE": "utf_16_le", "UTF-16BE": "utf_16_be", "TIS-620": "tis_620",
    **{f"ISO-8859-{k}": f"iso8859_{k}" for k in range(1, 17) if k != 12}, **{f"WINDOWS-{k}": f"cp{k}" for k in (874, *range(1250, 1259))},
}


def charset_normalize(name: Column) -> Column:
    known = lambda c: (
        F.when(c.isin("UTF8", "UTF_8"), "UTF-8")
        .when(c.startswith("GB"), "GBK")
        .when(c.startswith("BIG5"), "Big5")
        .when(c.startswith("SHIFT"), "SHIFT_JIS")
        .otherwise(c)
    )
    return let(F.upper(F.trim(blank(name))), known)


def charset_header(content_type: Column) -> Column:
    return charset_normalize(F.regexp_extract(blank(content_type), NAMED, 1))


def charset_html(html: Column) -> Column:
    """Both meta forms; where they differ, the one whose name stands first in the page."""
    h = blank(html)
    old = F.regexp_extract(F.regexp_extract(h, META4, 1), NAMED, 1)
    new = F.regexp_extract(h, META5, 1)

    def pick(x: Column) -> Column:
        a, b = x["old"], x["new"]
        earlier = F.call_function("instr", h, a) <= F.call_function("instr", h, b)
        return F.when(a == "", b).when((b == "") | earlier, a).otherwise(b)

    return charset_normalize(let(F.struct(old.alias("old"), new.alias("new")), pick))


def charset_header_html(content_type: Column, html: Column) -> Column:
    """struct(charset, charset_pos); a header of ISO or WINDOWS gives way to the page."""

    def decide(x: Column) -> Column:
        a, b = x["a"], x["b"]
        weak = a.startswith("ISO") | a.startswith("WINDOWS")
        header = (a != "") & ((b == "") | (a == b) | ~weak)
        return (
            F.when(header, F.struct(a.alias("charset"), F.lit("header").alias("charset_pos")))
            .when(b != "", F.struct(b.alias("charset"), F.lit("html").alias("charset_pos")))
            .otherwise(F.struct(F.lit("").alias("charset"), F.lit("").alias("charset_pos")))
        )

    return let(F.struct(charset_header(content_type).alias("a"), charset_html(html).alias("b")), decide)


def charset_guess(body: Column) -> Column:
    """The most plausible of a fixed list for bytes that are no UTF-8: the fewest odd characters after decoding.

    Lead and trail bytes tell the double-byte sets apart; the guess isn't passed through charset_normalize.
    """
    hexed = F.hex(body)
    high = F.regexp_count(F.regexp_replace(hexed, "([0-9A-F]{2})", "$1 "), F.lit("[89A-F][0-9A-F] "))
    spaced = F.regexp_replace(hexed, "([0-9A-F]{2})", "$1 ")
    gb = F.regexp_count(spaced, F.lit("(?:B[0-9A-F]|[CD][0-9A-F]) (?:A[1-9A-F]|[B-F][0-9A-F]) ")) * 2
    koi = F.regexp_count(spaced, F.lit("[CD][0-9A-F] "))
    cyr = F.regexp_count(spaced, F.lit("[EF][0-9A-F] "))
    sjis = F.regexp_count(spaced, F.lit("8[123] [4-9A-F][0-9A-F] ")) * 2
    eucjp = F.regexp_count(spaced, F.lit("A[45] (?:A[1-9A-F]|[B-F][0-9A-F]) ")) * 2
    return (
        F.when(high == 0, "")
        .when(sjis * 2 > high, "SHIFT_JIS")
        .when(eucjp * 2 > high, "EUC-JP")
        .when(gb * 10 >= high * 9, "GB18030")
        .when(koi * 2 > high, "KOI8-R")
        .when(cyr * 2 > high, "WINDOWS-1251")
        .otherwise("ISO-8859-1")
    )


def charset_detect(body: Column, content_type: Column) -> Column:
    """struct(charset, charset_pos): valid UTF-8, else header and page, else a guess."""
    said = charset_header_html(content_type, F.decode(body, "ISO-8859-1"))
    pair = lambda c, pos: F.struct(c.alias("charset"), pos.alias("charset_pos"))
    guessed = let(charset_guess(body), lambda g: pair(g, F.when(g != "", "guess").otherwise("")))
    spoken = let(said, lambda x: F.when(x["charset"] != "", x).otherwise(guessed))
    return F.when(F.is_valid_utf8(body), pair(F.lit("UTF-8"), F.lit("valid"))).otherwise(spoken)


def decode_body(body: Column, charset: Column) -> Column:
    """Text of a body. UTF-8 and unknown sets are read as UTF-8 in place (null where that is invalid); only bodies of other sets
    go to Python, in Arrow batches. Bytes that a set doesn't know become U+FFFD."""

    @F.pandas_udf("string")
    def read(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(CODECS[n], "replace") for b, n in zip(bodies, names)], dtype=object)

    name = F.upper(blank(charset))
    other = name.isin(*CODECS)
    return F.when(other, read(F.when(other, body), name)).otherwise(F.try_validate_utf8(body))
