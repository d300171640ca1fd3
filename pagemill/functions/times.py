"""Publish times: date grammars, the choice among several dates, formatting and parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, normalise_space, trimmed
from .urls import path, path_dir, path_dir_clean

Y4, Y2 = "20[1-3]\\d", "(?:20[1-3]\\d|[1-3]\\d)"
MONTH, DAY = "(?:1[0-2]|0?[1-9])", "(?:[12]\\d|3[01]|0?[1-9])"
CLOCK = "(?:2[0-3]|[01]?\\d)[:点时][0-5]?\\d[:分]?(?:[0-5]?\\d秒?)?"
MOMENT = CLOCK + "(?:\\.\\d{3})?(?:[zZ]|[+\\-]\\d{2}:?\\d{2})?"
AFTER = "[日Tt]?[ ]{0,3}"
MONTH_DAY = MONTH + "[-/月.]" + DAY + AFTER
FULL = Y4 + "[-/年.]" + MONTH_DAY + "(?:" + MOMENT + ")?"
SHORT = Y2 + "[-/年.]" + MONTH_DAY + "(?:" + MOMENT + ")?"
NO_YEAR = MONTH_DAY + "(?:" + CLOCK + ")?"
MONTHS = [m.split("-") for m in "jan-uary feb-ruary mar-ch apr-il may- jun-e jul-y aug-ust sep-tember oct-ober nov-ember dec-ember".split()]
NAMES = "(?:" + "|".join([a + b for a, b in MONTHS] + [a + "t?" * (a == "sep") for a, b in MONTHS if b]) + ")"
ORDINAL, LOOSE = "(?:st|nd|rd|th)?", "[, ]{0,4}"
ENGLISH_CLOCK = "(?:" + LOOSE + "(?:2[0-3]|[01]?\\d):[0-5]?\\d(?::[0-5]?\\d)?(?:" + LOOSE + "(?:am|pm))?)?"
ENGLISH_1 = "(?i)" + DAY + ORDINAL + LOOSE + NAMES + LOOSE + Y4 + ENGLISH_CLOCK
ENGLISH_2 = "(?i)" + NAMES + LOOSE + DAY + ORDINAL + LOOSE + Y4 + ENGLISH_CLOCK
US = MONTH + "[-/.]" + DAY + "[-/.]" + Y2 + "[ ]{0,3}(?:(?:2[0-3]|[01]?\\d):[0-5]?\\d:?(?:[0-5]?\\d)?)?"
SCRIPT = "(?i)\"[\\w\\-]*pub.*\"[\\t ]{0,4}:[\\t ]{0,4}\"(" + Y4 + "[-/年.]" + MONTH_DAY + MOMENT + ")\""
EPOCH = "(?i)ct[\\t ]{0,4}=[\\t ]{0,4}\"(1[2-9]\\d{8})\""
IN_URL = "20[23]\\d/?(?:1[0-2]|0[1-9])/?(?:[12]\\d|3[01]|0[1-9])"
#: A network address, whose numbers would read as a short or US date.
IPV4 = "(?<!\\d)(?<!\\d\\.)\\d{1,3}(?:\\.\\d{1,3}){3}(?!\\.?\\d)"
NAMED = "publish|pubdate|pubtime|release|dctermsdate"
FORMATS = (
    "yyyy-M-d H:m:s", "yyyy-M-d H:m", "yyyy-M-d", "yyyy/M/d H:m:s", "yyyy/M/d H:m", "yyyy/M/d", "yyyy.M.d H:m:s", "yyyy.M.d H:m", "yyyy.M.d",
    "yyyy年M月d日 H:m:s", "yyyy年M月d日H:m:s", "yyyy年M月d日 H:m", "yyyy年M月d日H:m", "yyyy年M月d日", "yyyy-M-d'T'H:m:s", "yyyyMMdd",
    "d MMM yyyy H:m:s", "d MMM yyyy H:m", "d MMM yyyy", "MMM d yyyy H:m:s", "MMM d yyyy H:m", "MMM d yyyy",
    "d MMMM yyyy H:m:s", "d MMMM yyyy", "MMMM d yyyy H:m:s", "MMMM d yyyy H:m", "d MMMM yyyy H:m", "MMMM d yyyy", "M/d/yyyy H:m:s", "M/d/yyyy H:m", "M/d/yyyy",
)


def first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(blank(text), pattern, group)


def has_clock(date: Column) -> Column:
    return date.rlike(CLOCK)


def english(date: Column) -> Column:
    return F.replace(normalise_space(date), F.lit(","), F.lit(" "))


def _longest(dates: Column) -> Column:
    """The longest string, the first of equals; '' for none."""
    pick = F.aggregate(dates, F.lit(""), lambda a, d: F.when(F.char_length(d) > F.char_length(a), d).otherwise(a))
    return F.coalesce(pick, F.lit(""))


def _by_meta(metas: Column, lang: Column, patterns: tuple[str, ...], clean) -> Column:
    def date(m: Column) -> Column:
        found = F.coalesce(*[F.nullif(first(m["content"], p), F.lit("")) for p in patterns])
        named = F.translate(blank(m["property"]), "_-.", "").rlike(NAMED) | F.translate(blank(m["name"]), "_-.", "").rlike(NAMED)
        return F.when(named, clean(found))

    dates = F.array_compact(F.transform(F.coalesce(metas, F.array().cast(META)), date))
    timed = lambda d: F.filter(d, has_clock)
    return let(dates, lambda d: F.when(F.size(timed(d)) > 0, _longest(timed(d))).when(blank(lang) != "zh", _longest(d)).otherwise(""))


META = "array<struct<name:string,property:string,content:string>>"


def time_by_meta(metas: Column, lang: Column) -> Column:
    """Longest date with a clock in metas named like a publish time; without a clock only where lang isn't zh."""
    return _by_meta(metas, lang, (FULL,), trimmed)


def time_by_meta_en(metas: Column, lang: Column) -> Column:
    return F.when(blank(lang) == "zh", "").otherwise(_by_meta(metas, lang, (ENGLISH_1, ENGLISH_2), english))


def time_by_tag(datetime: Column, lang: Column) -> Column:
    """struct(time, english) of the first time element."""
    plain = first(datetime, FULL)
    en = F.coalesce(*[F.nullif(first(datetime, p), F.lit("")) for p in (ENGLISH_1, ENGLISH_2)], F.lit(""))
    use = (plain == "") & (blank(lang) != "zh") & (en != "")
    return F.struct(F.when(use, english(en)).otherwise(plain).alias("time"), use.alias("english"))


def time_by_script(scripts: Column) -> Column:
    """The last script that holds a quoted publish time with a clock, or an epoch."""

    def one(s: Column) -> Column:
        line = F.regexp_replace(s, "[\\r\\n]+", " ")
        epoch = F.nullif(first(line, EPOCH, 1), F.lit(""))
        return F.coalesce(
            F.nullif(trimmed(first(line, SCRIPT, 1)), F.lit("")),
            F.date_format(F.timestamp_seconds(epoch.cast("long")), "yyyy-MM-dd HH:mm:ss"),
        )

    found = F.array_compact(F.transform(F.coalesce(scripts, F.array().cast("array<string>")), one))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(""))


def pick_dates(text: Column, dates: Column, title: Column, title_pos: Column, need_clock: bool = False, is_english: bool = False, as_of: Column | None = None) -> Column:
    """The date meant among several, in page order: those with a clock come first.

    Of several with a clock: the first, unless it isn't the longest and the title's place is known; then the one
    nearest to the title. Of those without: English ones likewise, others the last before as_of + 1 day.
    """
    as_of = F.current_timestamp() if as_of is None else as_of

    def tidy(d: Column) -> Column:
        t = trimmed(d)
        t = F.when(t.rlike("[:分]\\d{3}\\z"), t.substr(F.lit(1), F.char_length(t) - 1)).otherwise(t)
        return F.when(t.rlike("[:分]\\d{4}\\z"), t.substr(F.lit(1), F.char_length(t) - 2)).otherwise(t)

    def nearest(ds: Column) -> Column:
        at = F.call_function("instr", blank(text), blank(title))
        near = F.array_min(F.transform(ds, lambda d, i: F.struct(F.abs(F.call_function("instr", blank(text), d) - at).alias("n"), i.alias("i"), d.alias("d"))))
        return near["d"]

    def placed(*where: str) -> Column:
        return (blank(title) != "") & blank(title_pos).isin(*where)

    def choose(timed: Column, plain: Column) -> Column:
        longest_first = F.char_length(F.get(timed, 0)) >= F.array_max(F.transform(timed, lambda d: F.char_length(d)))
        clocked = F.when(longest_first | ~placed("selector", "headline", "content"), F.get(timed, 0)).otherwise(nearest(timed))
        if need_clock:
            rest = F.lit("")
        elif is_english:
            rest = F.when(placed("selector", "headline"), nearest(plain)).otherwise(F.get(plain, 0))
        else:
            limit = F.unix_timestamp(as_of) + 86400
            good = F.filter(plain, lambda d: F.coalesce((F.unix_timestamp(parsed(d)) < limit) & (F.unix_timestamp(parsed(d)) > 0), F.lit(False)))
            rest = F.when(F.size(plain) == 1, F.get(plain, 0)).otherwise(F.coalesce(F.try_element_at(good, F.lit(-1)), F.get(plain, 0)))
        return F.when(F.size(timed) > 0, clocked).when(F.size(plain) > 0, rest).otherwise("")

    tidied = F.transform(dates, lambda d: F.when(has_clock(trimmed(d)), tidy(d)).otherwise(trimmed(d)))
    split = let(tidied, lambda ds: F.struct(F.filter(ds, has_clock).alias("t"), F.filter(ds, lambda d: ~has_clock(d)).alias("p")))
    return F.coalesce(let(split, lambda s: choose(s["t"], s["p"])), F.lit(""))


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(blank(text), F.lit(pattern), F.lit(0))


def numbers_apart(text: Column) -> Column:
    """A text without network addresses, for patterns of dates that have numbers and points alone."""
    return F.regexp_replace(blank(text), IPV4, " ")


def time_by_body(text: Column, lang: Column, title: Column, title_pos: Column, as_of: Column | None = None) -> Column:
    """From all short dates of the body; zh pages without any may show month, day and clock: the year is as_of's."""
    now = F.current_timestamp() if as_of is None else as_of
    plain = numbers_apart(text)
    found = let(every(plain, SHORT), lambda d: F.when(F.size(d) > 0, pick_dates(text, d, title, title_pos, as_of=now)).otherwise(""))
    some = F.size(every(plain, SHORT)) > 0
    bare = pick_dates(text, every(plain, NO_YEAR), title, title_pos, need_clock=True, as_of=now)
    year = F.date_format(now, "yyyy")
    dated = let(
        bare,
        lambda b: F.when(b == "", "").when(b.contains("月"), F.concat(year, F.lit("年"), b)).otherwise(F.concat(year, F.lit("-"), F.translate(b, "/.", "--"))),
    )
    return F.when(some, found).when(blank(lang) == "zh", dated).otherwise("")


def time_by_lang(text: Column, lang: Column, title: Column, title_pos: Column, as_of: Column | None = None) -> Column:
    """struct(time, english): English and US forms for pages that aren't zh (a zh form would have matched before)."""
    en1, en2 = every(text, ENGLISH_1), every(text, ENGLISH_2)
    en = F.transform(F.when(F.size(en1) > 0, en1).otherwise(en2), english)
    us = every(numbers_apart(text), US)
    use = F.size(en) > 0
    time = F.when(use, pick_dates(text, en, title, title_pos, is_english=True, as_of=as_of)).when(F.size(us) > 0, pick_dates(text, us, title, title_pos, as_of=as_of)).otherwise("")
    other = blank(lang) != "zh"
    return F.struct(F.when(other, time).otherwise("").alias("time"), (other & use).alias("english"))


def time_by_url(url: Column) -> Column:
    return F.replace(first(path_dir_clean(path_dir(trimmed(path(url)))), IN_URL), F.lit("/"), F.lit(""))


def format_time(time: Column, is_english: Column) -> Column:
    t = blank(time)
    tight = F.when(t.rlike("[TtZz]"), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t)
    plain = let(tight, lambda x: F.when(x.contains("T") & ~F.lower(x).contains("z") & ~x.rlike("[+\\-]\\d{2}:?\\d{2}\\z"), F.replace(x, F.lit("T"), F.lit(" "))).otherwise(x))
    out = F.when(F.coalesce(is_english, F.lit(False)), t).otherwise(plain)
    return let(out, lambda x: F.when(x.contains(":") & ~x.rlike("[时点]"), F.regexp_replace(x, "分\\z", "")).otherwise(x))


def shape(form: str) -> str:
    """A pattern that every string has which a format of FORMATS reads: numbers of any width, signed years, months by any letters.

    A format that doesn't fit costs an exception, a pattern next to nothing.
    """
    parts = [m.group() for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", form)]
    known = {"yyyy": "[+\\-]?\\d{4,}", "MMMM": "\\D+", "MMM": "\\D+", "MM": "\\d{2}", "dd": "\\d{2}"}
    return "(?i)\\A" + "".join(known.get(p) or ("\\d+" if p in "MdHms" else re.escape(p.strip("'"))) for p in parts) + "\\z"


def parsed(time: Column) -> Column:
    """Timestamp of a time string, by the first format that fits; null if none does. Zone tails are honoured."""
    t = trimmed(time)
    zoned = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, "(\\d)[ ]([+\\-]\\d{2}:?\\d{2}|[zZ])\\z", "$1$2"), "\\.\\d{3}", ""))
    plain = F.regexp_replace(t, "\\.\\d{3}\\z", "")
    plain = F.regexp_replace(F.regexp_replace(plain, "(\\d)(?:st|nd|rd|th)", "$1"), " {2,}", " ")
    plain = F.regexp_replace(F.regexp_replace(plain, "[点时]", ":"), "[分](\\d)", ":$1")
    plain = F.regexp_replace(plain, "[:分秒]+\\z", "")
    return let(plain, lambda p: F.coalesce(*[F.when(p.rlike(shape(f)), F.try_to_timestamp(p, F.lit(f))) for f in FORMATS], zoned))


def parse_time(time: Column) -> Column:
    """Local time as yyyy-MM-dd HH:mm:ss, '' where no format fits."""
    return F.coalesce(F.date_format(parsed(time), "yyyy-MM-dd HH:mm:ss"), F.lit(""))
