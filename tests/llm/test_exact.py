"""Every operator against a brute-force version, an exact round trip, or held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import string
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagemill.llm import embedding_dedup, html_text, line_dedup, minhash_dedup, mixing, packing, quality, secrets, sharding, token_counts
from pagemill.llm.common import components
from pagemill.llm.tokens import word_ids

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string"
SYLLABLES = "the er on an re he in ed nd ha en ou ti es or th sh ea ing tion ble st nt wh ly of and is".split()


def say(rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=60):
    rnd, out = random.Random(seed), []
    for k in range(n):
        text = "\n".join(say(rnd, rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6)))
        out.append((k, text, rnd.choice(["a", "b", "c", None])))
    for k in range(10):
        w = out[k][1].split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[rnd.randrange(len(w))] = "changed"
        out.append((n + k, " ".join(w), "b"))
        out.append((n + 10 + k, out[k][1], "c"))
    return out


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_quality(spark):
    rnd = random.Random(3)
    texts = [None, "", "a b c a b c", "x x x x", " \x0b a\x0cb c", "# $ a|b\na|b\n\n  \na|b", *[" ".join(rnd.choice("a b c d") for _ in range(n)) for n in range(60)]]
    got = quality.quality(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = WORD.findall(t)
        tri, hit = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i, x in enumerate(zip(w, w[1:], w[2:])):
            if tri[x] > 1:
                hit |= {i, i + 1, i + 2}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))
        assert tuple(r[c] for c in quality.BASE) == want, t
        assert r["base_failed"] == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


@pytest.mark.parametrize("tile", [4096, 6])
def test_embeddings(spark, tile, monkeypatch):
    if tile == 6:
        monkeypatch.setattr(embedding_dedup, "FEW", 0)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 24))
    x[60:90] = x[:30] + rng.normal(size=(30, 24)) * 0.12
    x[90:110] = x[5] + rng.normal(size=(20, 24)) * 0.1
    x[110:130] = x[7]
    label = rng.integers(0, 2, 150)
    label[90:130] = 1
    x = x.astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], int(label[k])) for k in range(150)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df, 0.98, tile).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert link.sum() > 100
    i, j = np.nonzero(link)
    root = embedding_dedup.local_roots(150, i, j)
    assert got == {k: (int(link[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(150)}


def test_components(spark):
    rnd = random.Random(1)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    i, j = np.array(pairs).T
    root = embedding_dedup.local_roots(1100, i, j)
    assert got == {int(k): int(root[k]) for k in {*i.tolist(), *j.tolist()}}


def brute_jaccard(a, b):
    """J_P of two weighted sets given as dicts."""
    total = 0.0
    both = {s: (a.get(s, 0.0), b.get(s, 0.0)) for s in {*a, *b}}
    for v, w in both.values():
        if v and w:
            total += 1 / sum(max(p / v, q / w) for p, q in both.values())
    return total


def as_sets(bags):
    """minhash_dedup.Sets of dicts."""
    names = {s: i for i, s in enumerate(sorted({s for b in bags for s in b}))}
    lists = [sorted((names[s], w) for s, w in b.items()) for b in bags]
    return minhash_dedup.Sets(pa.table({"ids": pa.array([[s for s, _ in x] for x in lists], pa.list_(pa.int64())), "w": pa.array([[int(w) for _, w in x] for x in lists], pa.list_(pa.int32()))}))


def weighted(rnd, kind=300):
    return {rnd.randrange(kind): float(rnd.choice([1, 1, 1, 2, 5])) for _ in range(rnd.randint(1, 60))}


def test_linked_equals_brute_force():
    rnd = random.Random(2)
    bags = [weighted(rnd) for _ in range(6)]
    for k in range(40):
        b = dict(bags[k % 6])
        for s in rnd.sample(sorted(b), rnd.randint(0, len(b) // 2)):
            del b[s]
        bags.append((b or {1: 1.0}) | {rnd.randrange(300, 400): 1.0 for _ in range(rnd.randint(0, 12))})
    sets = as_sets(bags)
    i, j = np.triu_indices(len(bags), 1)
    for t in (0.3, 0.5, 0.6):
        want = np.array([brute_jaccard(bags[a], bags[b]) >= t - 1e-12 for a, b in zip(i, j)])
        assert 10 < want.sum() < len(want) - 10
        assert (sets.linked(i, j, t) == want).all()  # many partners each: by bounds first
        assert (np.concatenate([sets.linked(i[k : k + 1], j[k : k + 1], t) for k in range(len(i))]) == want).all()
    assert sets.linked(i[:0], j[:0], 0.5).tolist() == []


def test_sketch_estimates_probability_jaccard():
    rnd = random.Random(3)
    a = {s: float(rnd.randint(1, 5)) for s in range(200)}
    b = {s: float(rnd.randint(1, 5)) for s in range(80, 260)}
    flat = sorted((k, s, w) for k, x in enumerate((a, b)) for s, w in x.items())
    doc, shingle, weight = (np.array(x) for x in zip(*flat))
    s = minhash_dedup.sketch(doc, shingle.astype(np.uint64) * np.uint64(0x9E3779B1), weight, 2, 4096)
    assert abs((s[0] == s[1]).mean() - brute_jaccard(a, b)) < 0.04


@pytest.mark.parametrize("tile", [512, 4])
def test_minhash(docs, rows, tile, monkeypatch):
    if tile == 4:
        monkeypatch.setattr(minhash_dedup, "FEW", 0)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, tile=tile).collect()}
    bags = {}
    for k, t, _ in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        c = sorted(collections.Counter(zip(w, w[1:])).items())
        bags[k] = c
    names = {s: i for i, s in enumerate(sorted({s for c in bags.values() for s, _ in c}))}
    sets = {k: {names[s]: float(n) for s, n in c} for k, c in bags.items()}
    link = {(a, b) for a in sets for b in sets if a != b and brute_jaccard(sets[a], sets[b]) >= 0.5 - 1e-12}
    for k in sets:
        assert got[k]["n_links"] == sum((k, b) in link for b in sets), k
    i, j = np.array(sorted(link)).T
    root = embedding_dedup.local_roots(len(rows), i, j)
    assert {k: r["component_id"] for k, r in got.items()} == {k: int(root[k]) for k in got}
    kept = {r["doc_id"] for r in minhash_dedup.keep_one(docs, tile=tile).collect()}
    assert kept == {int(k) for k in root}


def test_wordless_copies(spark):
    rows = [(1, "!!!"), (2, "!!!"), (3, "???"), (4, ""), (5, ""), (6, None), (7, None)]
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}


def test_unlike_rows_of_one_doc_id(spark):
    rnd = random.Random(21)
    a, b, c, d = (say(rnd, 80) for _ in range(4))
    near = a.replace(" ", "  ", 1)
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (1, near, "y"), (1, a, "x"), (1, a, "z"), (None, d, "x"), (None, d, "x"), (3, a, None), (4, None, "x"), (4, None, "x"), (4, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in minhash_dedup.keep_one(df).collect())
    assert got[:4] == [(0, d), (0, d), *sorted([(1, b)] + [x for x in got if x in [(1, a), (1, near)]])]
    assert got[4:] == [(2, c), (4, ""), (4, ""), (4, "")]
    marks = minhash_dedup.near_duplicates(df).collect()
    assert len(marks) == len(rows)
    assert sorted((r["n_links"], r["component_id"]) for r in marks if r["n_links"]) == [(4, 1)] * 5


def test_pairs_across_components(spark):
    """Classes that don't link with the smallest of their band, but with each other."""
    rnd = random.Random(22)
    rows, k = [], 0
    for _ in range(25):
        head = say(rnd, 45)
        for _ in range(2):
            body = say(rnd, 75)
            for _ in range(2):
                w = (head + " " + body).split(" ")
                w[rnd.randrange(len(w))] = "changed"
                rows.append((k, " ".join(w), None))
                k += 1
    df = spark.createDataFrame(rows, SCHEMA)
    for tile in (512, 4):
        got = minhash_dedup.near_duplicates(df, tile=tile, t=0.5).collect()
        bags = [dict(collections.Counter(zip(w, w[1:]))) for _, t, _ in rows for w in [t.split(" ")]]
        link = [[a != b and brute_jaccard(bags[a], bags[b]) >= 0.5 - 1e-12 for b in range(len(rows))] for a in range(len(rows))]
        assert {r["doc_id"]: r["n_links"] for r in got} == {a: sum(x) for a, x in enumerate(link)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 12345])
def test_feistel_is_a_permutation(n):
    p = sharding.feistel(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    some = np.array([0, n - 1])
    assert (sharding.feistel(some, n) == p[some]).all()
    if n >= 1000:
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.1


def test_sharding(docs, rows):
    got = sharding.shard_rows(docs, 7).collect()
    text = {k: t for k, t, _ in rows}
    assert all(r["size"] == 16 + len(text[r["doc_id"]].encode()) and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    key = lambda rows_: sorted((r["doc_id"], r["shard"], r["slot"]) for r in rows_)
    assert key(got) == key(sharding.shard_rows(docs.repartition(5), 7).collect())


def test_fit_is_best():
    rnd = random.Random(4)
    for _ in range(200):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(1, 5))}
        budget = rnd.randint(0, 150)
        got = mixing.fit(counts, budget)
        assert all(0 < n <= counts[s] for s, n in got.items())
        sums = {0}
        for s, c in counts.items():
            sums |= {x + s * k for x in sums for k in range(1, c + 1)}
        assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= budget)
    big = {s: 50 for s in range(3, 900, 7)}
    assert sum(s * n for s, n in mixing.fit(big, 1_000_003, finish=2000).items()) == 1_000_003


@pytest.mark.parametrize(
    "counts,budget,want",
    [
        ({1000: 1000, 1: 999}, 900_000, 900_000),
        ({1000: 100_000, 1: 999}, 90_000_000, 90_000_000),  # above MOST: the ones come back from the quotas
        ({1000: 100_000, 7: 400}, 90_000_001, 90_000_001),
        ({6: 900_000, 10: 900_000}, 9_000_001, 9_000_000),
        ({400: 5000, 401: 5000, 20_000: 30}, 1_999_999, 1_999_999),
    ],
)
def test_fit_above_the_first_finish(counts, budget, want):
    got = mixing.fit(counts, budget)
    assert all(0 < n <= counts[s] for s, n in got.items())
    assert sum(s * n for s, n in got.items()) == want


def test_fit_agrees_for_any_finish():
    rnd = random.Random(8)
    for _ in range(40):
        counts = {rnd.randint(1, 60): rnd.randint(1, 30) for _ in range(rnd.randint(1, 4))}
        budget = rnd.randint(0, 2500)
        sums = {sum(s * n for s, n in mixing.fit(counts, budget, finish=f).items()) for f in (1, 50, 10**6)}
        assert len(sums) == 1


def test_mixing(spark):
    assert mixing.targets([("b", 100), (None, 10), ("a", 1000)]) == [("a", 1000, 1445.0), ("b", 100, 200.0), (None, 10, 20.0)]
    rnd = random.Random(6)
    rows = [(k, say(rnd, rnd.randint(0, 60)), rnd.choice(["a", "b", "b", "c", None])) for k in range(300)] + [(900, "same words here", "d")] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.choose(df).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in mixing.choose(df.repartition(3)).collect())
    by = collections.defaultdict(lambda: [0, 0.0])
    for r in got:
        assert 0 <= r["copies"] <= 2
        by[r["source"]][0] += r["size"] * r["copies"]
        by[r["source"]][1] = r["target"]
    assert all(abs(a - b) <= 3 for a, b in by.values())
    taken = collections.Counter()
    for r in got:
        taken[r["doc_id"]] += r["copies"]
    assert collections.Counter(r["doc_id"] for r in mixing.mix(df).collect()) == +taken


def same_crc(text):
    """Two texts of one CRC32 and one count of words."""
    seen = {}
    for k in itertools.count():
        other = f"{text} other {k:x}"
        crc = zlib.crc32(other.encode())
        if crc in seen:
            return seen[crc], other
        seen[crc] = other


def test_mix_keeps_unlike_rows_apart(spark):
    one, two = same_crc("words of a text")
    assert one != two and zlib.crc32(one.encode()) == zlib.crc32(two.encode())
    schema = "doc_id long, text string, source string, _k string, size string"
    rows = [(None, one, "a", "x", None), (None, two, "a", "x", None), (1, one, "a", "x", None), (1, one, "a", "y", None), (1, one, "a", None, "y")]
    assert collections.Counter(tuple(r) for r in mixing.mix(spark.createDataFrame(rows, schema), share=2.0).collect()) == {r: 2 for r in rows}
    got = mixing.mix(spark.createDataFrame(rows, schema), share=1.0).collect()
    assert collections.Counter(tuple(r) for r in got) == {r: 1 for r in rows}


def test_mix_takes_some_of_repeated_rows(spark):
    rows = [(None, "one two three four", "a")] * 9000 + [(1, "five six seven eight", "a"), (2, "five six", "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    for share in (0.4, 1.3):
        want = round(share * (4 * 9001 + 2))
        chosen = mixing.choose(df, share=share).collect()
        assert len(chosen) == len(rows) and sum(r["size"] * r["copies"] for r in chosen) == want // 2 * 2
        counts = lambda x: collections.Counter(tuple(r) for r in x)
        got = counts(mixing.mix(df, share=share).collect())
        assert got == counts(mixing.mix(df.repartition(3), share=share).collect())
        assert sum(n * len(r[1].split()) for r, n in got.items()) == want // 2 * 2
        assert got[rows[0]] == sum(r["copies"] for r in chosen if r["doc_id"] is None)


def naive_best_fit(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(c, i) for i, c in enumerate(bins) if c >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def test_best_fit_equals_one_by_one():
    rnd = random.Random(7)
    for _ in range(150):
        size = rnd.choice([5, 10, 64, 100])
        lengths = [rnd.randint(1, rnd.choice([size, max(1, size // 4)])) for _ in range(rnd.randint(0, 150))]
        runs, bins = packing.best_fit(collections.Counter(lengths), size)
        want = naive_best_fit(lengths, size)
        assert bins == len(want)
        fill = collections.Counter()
        placed = collections.Counter(lengths)
        for n in placed:
            own = sorted(r for r in runs if r[0] == n)
            for k in range(placed[n]):
                r = [x for x in own if x[1] <= k][-1]
                fill[r[2] + (k - r[1]) // r[3]] += n
        assert sorted(size - v for v in fill.values()) == want


def test_packing(docs, rows):
    got = packing.pack(docs, BPE, size=64).collect()
    ids = word_ids(BPE)
    by, seq = collections.defaultdict(dict), collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]][r["piece"]] = r
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, t, _ in rows:
        want = np.append(np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4"), np.uint32(1)).astype("<u4")
        parts = [by[k][i] for i in range(len(by[k]))]
        assert [p["start"] for p in parts] == list(range(0, len(want), 64))
        for p in parts:
            assert zlib.crc32(want[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]
        assert sum(p["length"] for p in parts) == len(want) and all(p["length"] == 64 for p in parts[:-1])
    for v in seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert len(seq) == len(naive_best_fit([r["length"] for r in got], 64))


ODD = ["", " ", "  a", "a  b ", "日本語 x\n\n\ty", "<0x0A> é <unk> </s>", "a" * 50, "▁▁a ▁", "🙂🙂 ok", "it's we'll DON'T 12½ ²", "Ünï İx ǅ ß ẞ ﬁ Σας", "a<|endoftext|>b", "\x1c\x85 x\xady", "“q” it’s —"]


def test_token_counts_equal_the_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.Unigram(token_counts.vocabulary(PIECES), unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=True)
    c, rnd = token_counts.counter(PIECES), random.Random(8)
    for text in [*ODD, *[say(rnd, 40) for _ in range(50)], *["".join(rnd.choice("aé the▁\n🙂-xq") for _ in range(60)) for _ in range(50)]]:
        assert c.count(text) == len(t.encode(text).ids), text


def test_word_ids_equal_the_tokenizer():
    w = word_ids(BPE)
    for text in ODD:
        assert w.ids(text) == w.encode(text), text


@pytest.mark.parametrize("block, at_once, cache", [(1 << 23, 10_000, 600_000), (50, 3, 20), (1, 1, 0)])
def test_a_batch_equals_the_tokenizer(block, at_once, cache, monkeypatch):
    """Whole batches, small blocks and a full cache; the words of simple texts reach the tokenizer together, not one by one."""
    from pagemill.llm import tokens

    for name, value in (("BLOCK", block), ("AT_ONCE", at_once), ("CACHE", cache)):
        monkeypatch.setattr(tokens, name, value)
    rnd, w = random.Random(14), tokens.WordIds(BPE)
    mixed = ["".join(rnd.choice("aé'st.,!\n\t\xa0 1½ß-<|") for _ in range(60)) for _ in range(60)]
    simple = [*[say(rnd, 40) for _ in range(20)], "x" * 300 + " " + "x" * 300, "'s 't ''s 're 'd12", "\xa0a\xa0\xa0b\r\n", " ", "END. End.\tend"]
    texts = [None, *ODD, *mixed, *simple, None]
    assert w.many(texts) == [w.encode(t or "") for t in texts]
    assert w.many([]) == [] and w.many([None, ""]) == [b"", b""] and len(w.cache) <= cache
    alone, w = [], tokens.WordIds(BPE)
    monkeypatch.setattr(w, "encode", alone.append)
    w.many(simple)
    assert alone == []


@pytest.mark.parametrize("few", [True, False])
def test_lines(spark, few, monkeypatch):
    if not few:
        monkeypatch.setattr(line_dedup, "FEW_LEAVES", 0)
        monkeypatch.setattr(line_dedup, "FEW_DROPS", 0)
    passage = say(random.Random(9), 60)
    rnd, rows = random.Random(10), []
    for k in range(12):
        own = [say(rnd, 12) for _ in range(3)]
        if k % 3 == 0:
            own.insert(1, passage)
        if k % 2 == 0:
            own.append(f"Posted on page {k} by user {k * 7} in the forum")
        rows.append((k, "\n".join(own), "a"))
    rows.append((50, rows[0][1], "a"))
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, text, _ in rows:
        lines = text.split("\n")
        if k not in (0, 50):
            lines = [x for x in lines if x != passage and not x.startswith("Posted")]
        assert got[k]["text"] == "\n".join(lines), k
        assert got[k]["n_dropped"] == len(text.split("\n")) - len(lines)


def test_secrets(spark):
    key = "ghp_" + "aZ3xK9mQ2pL7vB4nR8sT1wY6cD5fG0hJ2kMe"
    texts = [None, "", 'token = "abcdef1"', "PASSWD:abc secret=xyz12345", "AKIA" + "A1" * 8 + " AKIA12", "0" * 24 + " " + "f" * 23, f"login with {key} now", "api_key='k=v/1.2' apikey:12345", "card 4736962573099581 ok"]
    got = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    count = {k: (r["n_assign"], r["n_access"], r["n_hex"]) for k, r in got.items()}
    assert count == {0: (0, 0, 0), 1: (0, 0, 0), 2: (1, 0, 0), 3: (1, 0, 0), 4: (0, 1, 0), 5: (0, 0, 1), 6: (0, 0, 0), 7: (1, 0, 0), 8: (0, 0, 0)}
    assert got[3]["spans"] == "assign:11:26" and got[3]["base_sha256"] == hashlib.sha256(b"assign:11:26").hexdigest()
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[6]["spans"] == f"cnn:11:{11 + len(key)}" and got[8]["spans"] == ""


def brute_spans(text):
    """Pattern findings by hand: no regular expressions."""
    def run(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    word = set(string.ascii_letters + string.digits + "+/_.=-")
    found, at = [], 0
    while at < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if text[at : at + len(n)].translate(LOWER) == n), None)
        end = at
        if name:
            k = at + len(name)
            k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
            k = run(k, " ")
            if text[k : k + 1] in (":", "="):
                k = run(k + 1, " ")
                k += text[k : k + 1] in ('"', "'") and text[k : k + 1] != ""
                end = run(k, word)
                if end > k:
                    if end - k >= 6:
                        found.append((at, 0, end))
                else:
                    end = at
        at = max(end, at + 1)
    for kind, head, chars, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set(string.digits + "abcdef"), 24)):
        at = 0
        while at < len(text):
            end = run(at + len(head), chars) if text.startswith(head, at) else at
            if end > at + len(head):
                if end - at >= least:
                    found.append((at, kind, end))
                at = end
            else:
                at += 1
    return sorted(found)


LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_base_spans_equal_brute_force():
    rnd, hits = random.Random(41), 0
    bits = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "\u017fecret", "to\u212aen", '"', "'", " ", ":", "=", "a1", "Zz.", "==", "/+", "\n", "AKIA", "AKIAAKIA", "0123456789abcdef", "f", "deadbeef", "XY12", "é", "🙂", "-", "_", "\t", "\u0661"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25)))
        got = secrets.base_spans(text)
        assert got == brute_spans(text), text
        hits += len(got)
    assert hits > 400


def test_secret_candidates():
    line = 'sent P@ssw0rd!, then "getElementByName" x1 and 123456789012. Password is hunter2 or correcthorse\nbattery'
    got = [line[s:e] for s, e in secrets.candidates(line, [])]
    assert got == ["P@ssw0rd!", "getElementByName", "123456789012", "hunter2", "correcthorse"]
    assert [("key " + x)[s:e] for x in ("abcdef", "abcde") for s, e in secrets.candidates("key " + x, [])] == ["abcdef"]
    text = "x" * 9 + "1" + "0" * 24 + "-" + "y2" * 8
    assert secrets.candidates(text, [(10, 2, 34)]) == [(35, 51)]
    assert secrets.candidates("", []) == [] and secrets.candidates("no more than words", []) == []


def test_secret_network_equals_plain_loops():
    net = secrets.network()
    w, f = net.w, secrets.FILTERS
    text = "use key = 'Ab3$kk92!x' now; id 4f1c0a9d8e7b6a5f4e3d"
    found = secrets.candidates(text, [])
    assert len(found) == 2
    for s, e in found:
        row = secrets.codes(text, s, e)
        act, own = [], []
        for c in range(2, len(row) - 2):
            act.append([max(0.0, w["bias"][k] + sum(w["table"][j][row[c + j - 2]][k] for j in range(5))) for k in range(f)])
            own.append(row[c] >= 100)
        pooled = []
        for side in (True, False):
            part = [a for a, o in zip(act, own) if o == side]
            pooled += [max(a[k] for a in part) for k in range(f)] + [sum(a[k] for a in part) / len(part) for k in range(f)]
        hidden = [max(0.0, w["b1"][h] + sum(pooled[k] * w["w1"][k][h] for k in range(4 * f))) for h in range(secrets.HIDDEN)]
        z = float(w["b2"] + sum(h * v for h, v in zip(hidden, w["w2"])))
        assert abs(net.probabilities([row])[0] - 1 / (1 + np.exp(-z / float(w["temperature"])))) < 1e-9


def test_secret_network_on_held_out_findings():
    rows, y = secrets.labelled(3000, seed=123)
    found = secrets.network().probabilities(rows) >= secrets.network().threshold
    assert found[y == 1].mean() >= 0.95 and found[y == 0].mean() <= 0.02


def test_secret_threshold_keeps_recall():
    net = secrets.train(*secrets.labelled(2500, seed=9), epochs=5)
    rows, y = secrets.labelled(1500, seed=10)
    assert 0 < net.threshold <= 0.5 and (net.probabilities(rows) >= net.threshold)[y == 1].mean() >= 0.93
    assert 0.02 < float(secrets.network().w["temperature"]) < 50


def test_secrets_in_context_only():
    """The same shapes with and without a word that makes them credentials."""
    rnd, net = random.Random(17), secrets.network()
    uuid = lambda: "-".join("".join(rnd.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))
    hexa = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(22))
    for make in (uuid, hexa):
        said = secrets.scan([f"and then client_secret = '{make()}' for it" for _ in range(100)], net)
        plain = secrets.scan([f"and then request id {make()} for it" for _ in range(100)], net)
        assert sum(any(x[1] == 3 for x in s) for s in said) >= 90
        assert sum(any(x[1] == 3 for x in s) for s in plain) <= 10


def test_block_labeller_on_held_out_pages():
    pages, labels = html_text.labelled(150, seed=321)
    got = np.concatenate(html_text.labeller().labels(pages))
    want = np.concatenate(labels) > 0
    assert (got == want).mean() >= 0.99


def test_labeller_learns():
    pages, labels = html_text.labelled(60, seed=5)
    got = np.concatenate(html_text.train(pages, labels, epochs=8, batch=6).labels(pages))
    assert (got == (np.concatenate(labels) > 0)).mean() >= 0.9


def test_html_blocks():
    page = "<body><nav><a href=/a>Menu</a></nav><article><h1>T &amp; t</h1><p>One <b>two<br>three<p>Four &nbsp; five</article><script>x<p></script><footer>&copy; f</footer>"
    assert [b.text for b in html_text.parse(page)] == ["Menu", "T & t", "One two three", "Four five", "© f"]


def test_extract(spark):
    rnd = random.Random(2)
    paras = [say(rnd, 40).capitalize() + "." for _ in range(5)]
    page = "<html><body><nav><ul><li><a href=/x>Home</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>Head line</h1>" + "".join(f"<p>{p}</p>" for p in paras) + "</article><footer>&copy; site</footer></body></html>"
    got = html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "\n".join(["Head line", *paras]) and got["n_chars"] == len(got["text"])


def test_secret_network_reports_keys_of_other_generators():
    rnd = random.Random(5)
    pick = lambda s, n: "".join(rnd.choice(s) for _ in range(n))
    low, mixed = "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    shapes = [lambda: pick(low, 32), lambda: "dop_v1_" + pick("0123456789abcdef", 23), lambda: "shpat_" + pick("0123456789ABCDEF", 32), lambda: pick(mixed, 16)]
    for shape in shapes:
        texts = [f"the report from office said {shape()} was set for all users" for _ in range(100)]
        assert sum(any(x[1] == 3 for x in s) for s in secrets.scan(texts, secrets.network())) >= 85


def test_odd_markup():
    text = lambda page: [b.text for b in html_text.parse(page)]
    assert text("<p a'b>it's</p><p>more") == ["it's", "more"]
    assert text('<p title="a > b">q</p>') == ["q"]
    assert text('<p class="never>goes on') == ["goes on"]  # no second quote: the tag ends at the first ">"
    assert text('<p class="a>x</p><p id="b">y</p>') == ["y"]  # the value ends at the next quote, as browsers read it
    assert text('<svg width=1/>after <svg><path d="x"/>in</svg>then<math><mi>x</mi></math>') == ["after thenx"]
    assert text("<noscript>open text") == ["open text"] and text("<p>a<script>x<p>b") == ["a"]
    assert text("a < b and c<d> e") == ["a < b and c e"]


def test_deep_and_long_pages():
    start = time.time()
    deep = "<div class=x>a" * 20_000
    assert len(html_text.parse(deep)) == 20_000
    assert len(html_text.parse("</b></p>" + "<p class='" * 20_000)) <= 1
    assert len(html_text.parse("<svg>" * 20_000 + "x")) == 1
    assert time.time() - start < 20


def test_a_page_of_many_blocks_goes_alone():
    """Memory follows the longest page, not its neighbours in the batch, and results are those of single pages."""
    rnd = random.Random(3)
    small = [html_text.generated(rnd).replace(html_text.MARK, "") for _ in range(20)]
    large = "<article>" + "".join(f"<p>{say(rnd, 3)}" for _ in range(20_000))
    net = html_text.labeller()
    tracemalloc.start()
    got = html_text.texts([*small, large], net)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 300e6
    assert got == [html_text.texts([p], net)[0] for p in [*small, large]]


def test_labeller_equals_plain_loops():
    rnd, net = random.Random(4), html_text.labeller()
    w, n = net.w, html_text.STATE
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for _ in range(3):
        page = html_text.inputs(html_text.parse(html_text.generated(rnd).replace(html_text.MARK, "")))
        x = [np.concatenate([w["paths"][list(p)].mean(0), w["words"][q].mean(0), m]) for p, q, m in zip(*page)]

        def states(xs, k):
            h, c, out = np.zeros(n), np.zeros(n), []
            for v in xs:
                z = v @ w["w" + k] + h @ w["u" + k] + w["b" + k]
                i, f, g, o = (z[j * n : (j + 1) * n] for j in range(4))
                c = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
                h = sigmoid(o) * np.tanh(c)
                out.append(h)
            return out

        fore, back = states(x, "f"), states(x[::-1], "b")[::-1]
        want = [np.concatenate([a, b, v]) @ w["wo"] + w["bo"] for a, b, v in zip(fore, back, x)]
        got = net.forward([page, page])[0]
        assert np.abs(got - np.array(want)[:, None]).max() < 1e-3


def test_secret_network_leaves_mail_hosts():
    texts = [f"was geschit, st.{k}@mail{k % 10}.example.com was, and www{k}.thering.org or" for k in range(100)]
    assert sum(any(x[1] == 3 for x in s) for s in secrets.scan(texts, secrets.network())) <= 1


def brute_lines(texts):
    """Texts (doc_id: text, all unlike) without recurring lines: every line against every template of its leaf."""
    lines = {k: {x: re.split(r"[\x20\x09-\x0D]+", x.strip(" \t\v\f\r")) for x in t.split("\n")} for k, t in texts.items()}
    lines = {k: {x: [re.sub(".*[0-9].*", "<*>", w) for w in ws] for x, ws in own.items() if len(ws) >= 4} for k, own in lines.items()}
    leaves, who = collections.defaultdict(list), collections.defaultdict(set)
    for k, own in lines.items():
        for x, ws in own.items():
            leaves[len(ws), tuple(ws[:3])].append((k, x, " ".join(ws)))
            who[x].add(k)
    gone = collections.defaultdict(set)
    for (size, _), found in leaves.items():
        count = collections.Counter(m for _, _, m in found)
        templates, joined = [], {}
        for m in sorted(count, key=lambda m: (-count[m], np.uint64(xxhash.xxh64_intdigest(m, 42)).astype(np.int64))):
            ws = m.split(" ")
            agree = [sum(a == b for a, b in zip(t, ws)) for t in templates]
            if agree and max(agree) >= 0.6 * size:
                k = agree.index(max(agree))
                templates[k] = [a if a == b else "<*>" for a, b in zip(templates[k], ws)]
            else:
                k = len(templates)
                templates.append(ws)
            joined[m] = k
        for k in range(len(templates)):
            own = {d for d, _, m in found if joined[m] == k}
            if len(own) >= (2 if size >= 10 else 3):
                for d, x, m in found:
                    if joined[m] == k and d != min(own):
                        gone[d].add(x)
        for d, x, _ in found:
            if size < 10 and len(who[x]) > 1 and d != min(who[x]):
                gone[d].add(x)
    return {k: "\n".join(x for x in t.split("\n") if x not in gone[k]) for k, t in texts.items()}


def test_lines_equal_brute_force(spark):
    rnd = random.Random(31)
    kinds = ["we saw the {} of {} and then {} went to {} again", "error {} in the {} of {} at line {}", "a b c {}", "a b c {} {} {}\u00a0{}", "\u0661 \t read {} more of {} here {}"]
    line = lambda: rnd.choice(kinds).format(*[rnd.choice(["7", "x1", "red", "blue", "town", "sea", "it", "\u0662"]) for _ in range(4)]) + rnd.choice(["", " ", " end", " 5"])
    texts = {k: "\n".join([f"{k} own"] + [line() for _ in range(rnd.randint(1, 9))]) for k in range(60)}
    df = spark.createDataFrame([(k, t, "a") for k, t in texts.items()], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    want = brute_lines(texts)
    assert sum(want[k] != texts[k] for k in texts) > 30 and got == want


def test_a_leaf_of_many_lines():
    rnd, leaf = random.Random(32), line_dedup.Leaf()
    names = [f"w{k}" for k in range(3000)]
    start = time.time()
    found = [leaf.add(["on", "the", "day", *[rnd.choice(names) for _ in range(9)]], k) for k in range(50_000)]
    assert time.time() - start < 40
    assert len(set(found)) > 40_000


def test_lines_of_two_texts(spark):
    rnd = random.Random(14)
    passage, short = say(rnd, 50), "five words that come twice"
    alike = ["we all went to Rome", "we all went to Bonn"]
    rows = [
        (1, "\n".join([say(rnd, 15), passage, short, alike[0]]), "a"),
        (2, "\n".join([say(rnd, 15), passage, "yes", alike[1]]), "a"),
        (3, "\n".join([say(rnd, 15), short, "yes"]), "a"),
        (4, "Page 12 of the long list of all things here\n" + say(rnd, 15), "a"),
        (5, "Page 77 of the long list of all things here\n" + say(rnd, 15), "a"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    left = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(df).collect()}
    gone = {k: [x for x in t.split("\n") if x not in left[k]] for k, t, _ in rows}
    assert gone == {1: [], 2: [passage], 3: [short], 4: [], 5: ["Page 77 of the long list of all things here"]}
    assert sum(r["n_dropped"] for r in line_dedup.line_dedup(df, pairs=False).collect()) == 0


def test_minhash_bands_find_pairs_near_the_threshold():
    rng, found, m = np.random.default_rng(15), 0, 100
    share, n = np.linspace(0.5, 0.6, 400), 0
    for j in share:
        both = int(np.ceil(2 * m * j / (1 + j)))  # of m shingles each; J_P = both / (2 m - both)
        ids = rng.integers(0, 1 << 48, 2 * m - both, dtype=np.uint64)
        a, b = ids[:m], np.concatenate([ids[:both], ids[m:]])
        s = minhash_dedup.sketch(np.repeat([0, 1], m), np.concatenate([a, b]), np.ones(2 * m), 2)
        bands = (s[0] == s[1])[: minhash_dedup.BANDS * minhash_dedup.ROWS].reshape(minhash_dedup.BANDS, minhash_dedup.ROWS)
        found, n = found + bands.all(1).any(), n + 1
    print("recall", found, n)
    assert found >= 0.99 * n
