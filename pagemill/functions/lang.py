"""Language of a page: by charset, title, html attributes and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, let, literal_map, remove_lines, remove_sign, trimmed

BY_CHARSET = {
    name: code
    for code, names in {"ja": "SHIFT_JIS EUC-JP ISO-2022-JP", "ko": "ISO-2022-KR EUC-KR", "ru": "KOI8-R", "zh": "ISO-2022-CN EUC-CN GBK Big5"}.items()
    for name in names.split()
}
NAMES = {
    pair[:2]: pair[2:] for pair in "ar阿拉伯语 de德语 en英语 es西班牙语 fr法语 hi印地语 it意大利语 ja日语 ko韩语 my缅甸语 pt葡萄牙语 ru俄语 th泰语 vi越南语 zh中文".split()
}
WORD_LANGS = ("ar", "de", "en", "es", "fr", "pt", "ru")
CODE = "^(?:[A-Za-z]{2}|[A-Za-z]{2}-[A-Za-z]+)\\z"
HAN, KANA, HANGUL = "\\p{IsHan}", "[\\p{IsHiragana}|\\p{IsKatakana}]", "\\p{IsHangul}"
CHUNK, LEAST = 2048, 64


def share(text: Column, pattern: str, of: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)).cast("double"), of.cast("double")), F.lit(0.0))


def lang_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(NAMES), blank(code)), F.lit(""))


def lang_code(name: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({v: k for k, v in NAMES.items()}), blank(name)), F.lit(""))


def lang_html(lang: Column, xml_lang: Column, content_language: Column, meta_lang: Column) -> Column:
    """First attribute that is a language code, its first two characters as they are."""
    return F.coalesce(*[F.when(trimmed(c).rlike(CODE), F.substring(trimmed(c), 1, 2)) for c in (lang, xml_lang, content_language, meta_lang)], F.lit(""))


def lang_title(title: Column, body: Column) -> Column:
    """zh, ja or ko where the title has two Han characters or more, else ''."""
    b = trimmed(F.substring(remove_sign(body), 1, CHUNK))
    han = F.regexp_count(remove_sign(title), F.lit(HAN)) >= 2
    kind = let(b, lambda x: F.when(share(x, KANA, F.char_length(x)) > 0.2, "ja").when(share(x, HANGUL, F.char_length(x)) > 0.2, "ko").otherwise("zh"))
    return F.when(han, kind).otherwise("")


def plain_text(text: Column) -> Column:
    """A text without line ends, tabs, double spaces and signs."""
    t = F.replace(F.replace(remove_lines(text), F.lit("\t"), F.lit("")), F.lit("  "), F.lit(""))
    return F.regexp_replace(t, "[\\p{P}\\p{S}]", "")


def text_chunk(text: Column) -> Column:
    """What lang_text looks at: at most CHUNK characters, as its definition has it."""
    return trimmed(F.substring(plain_text(text), 1, CHUNK))


def lang_text(text: Column, latin: Column | None = None) -> Column:
    """struct(lang, lang_pos); `latin`: a model's verdict for Latin text with accents (lang_ngram), else lang_latin's."""

    def judge(t: Column) -> Column:
        n = F.char_length(t)
        han = F.regexp_count(t, F.lit(HAN))
        kana = F.coalesce(F.try_divide(F.regexp_count(t, F.lit(KANA)).cast("double"), han.cast("double")), F.lit(0.0))
        other = F.greatest(*[F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(k).alias("k")) for p, k in OTHER_SCRIPTS])
        lang = (
            F.when(n < LEAST, "")
            .when(share(t, HAN, n) >= 0.3, F.when(kana > 0.1, "ja").otherwise("zh"))
            .when(share(t, "[a-zA-Z]", n) > 0.618, F.when(F.regexp_count(t, F.lit("[\\x{80}-\\x{ff}]")) > 5, latin_).otherwise("en"))
            .when(other["n"] * 10 > n * 3, other["k"])
            .otherwise("")
        )
        model = (share(t, HAN, n) < 0.3) & (
            (share(t, "[a-zA-Z]", n) <= 0.618) | (F.regexp_count(t, F.lit("[\\x{80}-\\x{ff}]")) > 5)
        )
        return F.struct(lang.alias("lang"), F.when(lang == "", "").when(model, "lingua").otherwise("body").alias("lang_pos"))

    latin_ = F.coalesce(latin, lang_latin(text)) if latin is not None else lang_latin(text)
    return let(text_chunk(text), judge)


#: Function words that tell Latin-script languages apart; the first language wins ties.
FUNCTION_WORDS = {
    "en": "the of and to in is that for was with",
    "fr": "le la les des et du une est dans pour qui au aux",
    "de": "der die das und ist nicht ein eine den von zu mit",
    "es": "el los las y que del por una con se su",
    "pt": "o os um uma não do da em para com ao",
}


def lang_latin(text: Column) -> Column:
    """The language whose function words occur most often: a verdict on one row, without a model table."""
    chunk = F.lower(text_chunk(text))
    scored = [
        F.struct(F.regexp_count(chunk, F.lit("(?<!\\p{L})(?:" + "|".join(w.split()) + ")(?!\\p{L})")).alias("n"), F.lit(-k).alias("k"), F.lit(code).alias("lang"))
        for k, (code, w) in enumerate(FUNCTION_WORDS.items())
    ]
    return F.greatest(*scored)["lang"]


OTHER_SCRIPTS = (("\\p{IsArabic}", "ar"), ("\\p{IsCyrillic}", "ru"), ("\\p{IsDevanagari}", "hi"), (HANGUL, "ko"))


def lang_page(charset: Column, title: Column, body: Column, html_lang: Column, latin: Column | None = None) -> Column:
    """struct(lang, lang_pos): charset, then title, then a trusted attribute, then the text of UTF pages.

    Without a model's verdict (`latin`), Latin text with accents on a page that says en is en: function words of a foreign footer or advertisement don't overrule it.
    """
    by_charset = F.try_element_at(literal_map(BY_CHARSET), blank(charset))
    by_title = lang_title(title, body)
    pair = lambda a, b: F.struct(a.alias("lang"), F.lit(b).alias("lang_pos"))
    from_text = lang_text(body, latin)
    if latin is None:
        said = blank(html_lang) == "en"
        from_text = let(lang_text(body, F.when(said, "en")), lambda r: F.when(said & (r["lang"] == "en") & (r["lang_pos"] == "lingua"), pair(F.lit("en"), "html")).otherwise(r))
    return (
        F.when(by_charset.isNotNull(), pair(by_charset, "charset"))
        .when(by_title != "", pair(by_title, "title"))
        .when((html_lang != "") & (html_lang != "en"), pair(html_lang, "html"))
        .when(blank(charset).startswith("UTF"), from_text)
        .otherwise(pair(F.lit(""), ""))
    )
