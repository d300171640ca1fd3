"""Page titles: cleaning by separators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, limited, remove_lines, remove_sign, trimmed

SITE_ZH = (*"_|-－｜—＊：,，:·", ">>", "=")
CONTENT_ZH = SITE_ZH[:6]
OTHER = (" - ", " | ", ":")
HOME = "首页"


def web_title(title: Column, length: int = 0) -> Column:
    return limited(trimmed(remove_lines(title)), 128, length)


def _cut(c: Column, mark: str) -> Column:
    last = F.char_length(c) - F.instr(F.reverse(c), mark[::-1]) - (len(mark) - 1)
    return c.substr(F.lit(1), last)


def _until_first(c: Column, mark: str) -> Column:
    return trimmed(F.substring_index(c, mark, 1))


def _cascade(c: Column, marks: tuple[str, ...], cut) -> Column:
    out = c
    for mark in reversed(marks):
        out = F.when(F.instr(c, mark) > 0, cut(c, mark)).otherwise(out)
    return out


def _other(title: Column) -> Column:
    return let(title, lambda t: _cascade(t, OTHER, lambda c, m: trimmed(_cut(c, m))))


def web_title_clean(title: Column, lang: Column) -> Column:
    """Site titles. zh: no leading separators and home word, the part before the first separator found, letters and digits only."""
    t = blank(title)
    lead = "".join(f"(?:{re.escape(m)})?" for m in SITE_ZH)
    z = F.regexp_replace(t, "^" + lead, "")
    z = let(z, lambda x: F.when(x.startswith(HOME), F.regexp_replace(x, HOME + "[ |\\-_－—｜]*", "")).otherwise(x))
    z = let(z, lambda x: _cascade(x, SITE_ZH, _until_first))
    z = let(z, lambda x: F.when((x != HOME) & x.endswith(HOME), x.substr(F.lit(1), F.char_length(x) - len(HOME))).otherwise(x))
    return F.when(blank(lang) == "zh", remove_sign(z)).otherwise(_other(t))


def content_title_clean(title: Column, lang: Column) -> Column:
    """Titles of single pages: the same cuts with fewer marks, nothing else removed."""
    t = blank(title)
    return F.when(blank(lang) == "zh", let(t, lambda x: _cascade(x, CONTENT_ZH, _until_first))).otherwise(_other(t))
