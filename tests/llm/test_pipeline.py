"""Each stage of the pipeline against a plain version of what it decides."""

import collections
import random

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "er on an re he in ed nd ha en ou ti es or th sh ea ing tion ble".split()


def say(rnd, n):
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(2, 4)))
    return " ".join(rnd.choice(["the", "of"]) if rnd.random() < 0.15 else word() for _ in range(n))


def test_stages(spark):
    rnd = random.Random(11)
    passage = say(rnd, 60)
    rows = []
    for k in range(40):
        text = "\n".join(say(rnd, 40) for _ in range(3))
        if k < 5:
            text += "\n" + passage
        rows.append((k, text, "en", f"s{k % 3}", len(text)))
    rows += [(100, "too short", "en", "s0", 9), (101, "spam spam " * 40, "en", "s1", 400), (102, "# $ % & " * 40 + say(rnd, 60), "en", "s1", 400)]
    words = rows[20][1].split(" ")
    words[7] = "different"
    rows += [(200, rows[10][1], "en", "s2", rows[10][4]), (201, " ".join(words), "en", "s2", len(" ".join(words))), (None, say(rnd, 80), None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}
    lines = stages["line dedup"](spark, kept, "")
    got = {r["doc_id"]: r for r in lines.collect()}
    assert lines.columns == docs.columns and len(got) == kept.count()
    assert [k for k, r in got.items() if passage in r["text"]] == [0]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values() if r["doc_id"] is not None)
    one = stages["near-duplicates"](spark, lines, "")
    assert {r["doc_id"] for r in one.collect()} == set(got) - {200, 201}
    mixed = stages["mix"](spark, one, "")
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 2
    packed = stages["packing"](spark, mixed, "").collect()
    assert collections.Counter(r["doc_id"] for r in packed if r["piece"] == 0) == copies


def test_rows_are_known_by_more_than_doc_id(spark, tmp_path):
    """Unlike texts under one doc_id or none, a repeated row, null and empty texts, an extra column."""
    rnd = random.Random(13)
    schema = SCHEMA + ", _row string"
    a, b, c, d = (say(rnd, 90) for _ in range(4))
    rows = [(1, a, "en", "s", 1, "x"), (1, b, "en", "s", 1, "x"), (None, c, None, None, None, "x"), (None, d, None, None, None, "y"), (2, a, "en", "s", 1, "x"), (1, b, "en", "s", 1, "x"), (3, None, "en", "s", 0, "x"), (4, "", "en", None, 0, "x")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, "")
        assert docs.columns == [f.split()[0] for f in schema.split(", ")], name
    one = sorted(map(str, (tuple(r) for r in docs.collect())))
    assert one == sorted(map(str, [rows[0], rows[1], rows[2], rows[3]]))
    mixed = [collections.Counter(map(str, (tuple(r) for r in corpus_pipeline.STAGES[3][1](spark, x, "").collect()))) for x in (docs, docs.repartition(3))]
    assert mixed[0] == mixed[1] and set(mixed[0]) <= set(one) and max(mixed[0].values()) <= 2


def test_run(spark, tmp_path):
    rnd = random.Random(12)
    rows = [(k, say(rnd, 90), "en", "s", 1) for k in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 12
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
