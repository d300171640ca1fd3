"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import embedding_dedup, html_text, line_dedup, minhash_dedup, mixing, packing, quality, secrets, sharding, token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{k % 977} the of" for k in range(30_000))
ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "the same text again and again " * 3, "en", None, 90),
    (4, "the same text again and again " * 3, "en", None, 90),
    (5, "the same text again and again " * 3, "en", "b", 90),
    (None, "no id here", "en", "b", 10),
    (6, LONG, "en", "a", len(LONG)),
    (7, "é🙂 ﬁ İ \x00 x y", None, "b", 10),
]
OPERATORS = {
    "quality": lambda d: quality.quality(d),
    "sharding": lambda d: sharding.shard_rows(d),
    "mixing": lambda d: mixing.choose(d),
    "mix": lambda d: mixing.mix(d),
    "packing": lambda d: packing.pack(d, BPE),
    "tokens": lambda d: token_counts.token_counts(d, PIECES),
    "lines": lambda d: line_dedup.line_dedup(d),
    "minhash": lambda d: minhash_dedup.near_duplicates(d),
    "keep_one": lambda d: minhash_dedup.keep_one(d),
    "secrets": lambda d: secrets.find_secrets(d),
}
CLASHES = (
    "n_words kept size shard taken piece n_tokens n_lines component_id spans _w _k1 _k2 _rank _h check sig _row _n _i _pid _at _base cid grp part parts leaf _d1 _d2 _left _same _whole _k _t id src mark "
    "masked head first component _fine key band low comp drop gone again links _lines tokens line n row __m __words __lines copies source_size target"
).split()
STAGES = {
    "quality": lambda d: quality.keep(d, lang="lang"),
    "lines": lambda d: line_dedup.keep_rest(d),
    "keep_one": lambda d: minhash_dedup.keep_one(d),
    "mix": lambda d: mixing.mix(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(rows):
    return sorted((r["doc_id"] for r in rows), key=lambda k: (k is not None, k))


def test_odd_rows(docs):
    """What each operator makes of nulls, blanks, ties, repeats and a long text."""
    got = {name: f(docs).collect() for name, f in OPERATORS.items()}
    for name in ("quality", "sharding", "mixing", "tokens", "lines", "minhash", "secrets"):
        assert ids(got[name]) == ids([{"doc_id": r[0]} for r in ROWS]), name
    of = lambda name, k: [r for r in got[name] if r["doc_id"] == k]
    for k in (1, 2, 3):
        q = of("quality", k)[0]
        assert (q["n_words"], q["n_repeat_words"], q["base_failed"], q["kept"]) == (0, 0, True, False)
        assert of("mixing", k)[0]["copies"] == 0 and (k == 3 or of("tokens", k)[0]["n_tokens"] == 0)
        assert of("secrets", k)[0]["spans"] == "" and of("minhash", k)[0]["n_links"] == 0
    assert of("quality", 6)[0]["n_words"] == 90_000
    assert sorted(r["slot"] for r in got["sharding"]) == sorted(k // 40 for k in range(len(ROWS)))
    assert [(r["piece"], r["length"]) for r in of("packing", 1)] == [(0, 1)]
    long = sorted(r["length"] for r in of("packing", 6))
    assert len(long) > 20 and set(long[1:]) == {4096}
    assert {r["text"] for r in of("lines", 6)} == {LONG} and all(r["n_dropped"] == 0 for r in got["lines"])
    assert {(r["doc_id"], r["n_links"], r["component_id"], r["kept"]) for r in got["minhash"] if r["n_links"]} == {(4, 2, 4, True), (5, 2, 4, False)}
    assert ids(got["keep_one"]) == [None, 1, 2, 3, 4, 6, 7]
    taken = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in got["mix"])
    assert taken == sum(r["size"] * r["copies"] for r in got["mixing"]) and all(0 <= r["copies"] <= 2 for r in got["mixing"])


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns(docs, name):
    wide = docs.withColumns({c: F.lit("x") for c in CLASHES})
    assert len(OPERATORS[name](wide).collect()) == len(OPERATORS[name](docs).collect())


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_every_column(docs, name):
    docs = docs.union(docs.sparkSession.createDataFrame([(8, "the " + " of ".join(f"word{k}" for k in range(60)), "en", "a", 1)], SCHEMA))
    wide = docs.withColumns({c: F.lit("x") for c in CLASHES})
    got, plain = STAGES[name](wide).collect(), STAGES[name](docs).collect()
    assert got[0].asDict().keys() == set(wide.columns) and all(r[c] == "x" for r in got for c in CLASHES)
    assert sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in got))) == sorted(map(str, ((r["doc_id"], r["text"], r["source"]) for r in plain)))


def test_other_languages_are_not_judged_by_stop_words(spark):
    text = " ".join(f"sana{k} puhe{k % 31}" for k in range(60))
    df = spark.createDataFrame([(1, text, "fi"), (2, text, "en"), (3, text, None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["kept"] for r in quality.quality(df, lang="lang").collect()} == {1: True, 2: False, 3: False}


def test_pieces_with_an_inner_marker_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter([("<unk>", 0.0), ("a\u2581b", -1.0)])


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    page = "<article><h1>Title</h1><p>" + "Words of the article go here. " * 20 + "</p></article>"
    rows = [(1, "u", None, "x", "y"), (2, None, "", "x", "y"), (None, "u", page, "x", "y"), (3, "u", page * 300, "x", "y"), (3, "u", page, None, None), (4, "u", "<p", "", "")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 6
    assert [r["text"] for r in got if r["page_id"] in (1, 2, 4)] == ["", "", ""]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, n_links string, x string"
    a, b, nan = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0], float("nan")
    rows = [
        (1, a, 1), (2, a, 1), (3, b, 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, nan, 0.0], 1),
        (9, [1.0, None, 0.0], 1), (10, [float("inf"), 0.0, 0.0], 1), (11, [2.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [0.0, 1.0, 0.0], 1), (None, a, 1), (14, [], 1),
    ]
    df = spark.createDataFrame([(*r, "c", "c") for r in rows], schema)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[3] == (3, 1, False) and got[11] == (3, 1, False)
    for k in (4, 5, 6, 7, 8, 9, 10, 12, 13, 14):
        assert got[k] == (0, k, True)
    assert got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).collect() == []
