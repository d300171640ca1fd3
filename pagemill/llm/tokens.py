"""Token ids of whole texts by a public word-level BPE, cached by word.

The tokenizer's own pipeline (NFC, lower case, a word pattern, then BPE inside each word) makes a word's
ids independent of its surroundings, so a text whose characters are all in a range where Python's
normalisation provably agrees with the tokenizer's is cut into words here and looked up; any other
text goes to the tokenizer whole. Both ways give the same ids.

No word spans white space: a batch is split there, its distinct parts alone are cut into words, the words not met yet are encoded
together, and the ids are gathered by part. A word's ids are kept up to a number of words; beyond, words are encoded once a block.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 600_000
BLOCK = 1 << 23  # characters cut at once, or one text
AT_ONCE = 10_000  # words encoded at once
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _ranges(codes: list[int]) -> str:
    return "".join(re.escape(chr(c)) for c in codes)


def _simple() -> list[int]:
    """Code points below U+0250 that are one NFC, lower-case-stable unit here and in the tokenizer."""
    ok = [9, 10, 13, *range(32, 127)]
    for c in range(0xA0, 0x250):
        ch = chr(c)
        if len(ch.lower()) == 1 and unicodedata.normalize("NFC", ch) == ch and unicodedata.normalize("NFC", ch.lower()) == ch.lower():
            if ord(ch.lower()) < 0x250:
                ok.append(c)
    return ok


class WordIds:
    """ids(text) as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model for words that are cut and normal already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        simple = _simple()
        kind = {c: unicodedata.category(chr(c))[0] for c in simple}
        letters = _ranges([c for c in simple if kind[c] == "L"])
        digits = _ranges([c for c in simple if kind[c] == "N"])
        self.simple = re.compile(f"[{_ranges(simple)}]*").fullmatch
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\\s{letters}{digits}]+").findall
        encode = self.encode

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                got = encode(word)
                if len(self) < CACHE and len(word) < 100:
                    self[word] = got
                return got

        self.cache = Cache()

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.simple(text) is None or "<|" in text and any(s in text for s in SPECIAL):
            return self.encode(text)
        return b"".join(map(self.cache.__getitem__, self.cut(text.lower())))

    def many(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text; a null text has none."""
        out, block, held = [b""] * len(texts), [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if self.simple(text) is None or "<|" in text and any(s in text for s in SPECIAL):
                out[k] = self.encode(text)
                continue
            block.append(k)
            held += len(text)
            if held >= BLOCK:
                self._block(texts, block, out)
                block, held = [], 0
        if block:
            self._block(texts, block, out)
        return out

    def _block(self, texts: list, at: list[int], out: list[bytes]) -> None:
        # of white space, simple texts have \xa0 beside ASCII's
        lower = pa.array([texts[k].lower().replace("\xa0", " ") for k in at], pa.large_string())
        parts = pc.ascii_split_whitespace(lower)
        coded = parts.flatten().dictionary_encode()
        ids = pa.array(self._parts(coded.dictionary), pa.large_binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int64, len(ids) + 1, 8 * ids.offset)
        edges = ends[parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        data = memoryview(data or b"")
        for k, a, b in zip(at, edges, edges[1:]):
            out[k] = bytes(data[a:b])

    def _parts(self, distinct: pa.Array) -> list[bytes]:
        """ids of parts without white space; the empty part, at the edges of a text, has none."""
        joined = pa.scalar(distinct, pa.large_list(distinct.type))
        parts = pc.binary_join(joined, pa.scalar(" ", distinct.type)).as_py().split(" ")
        out = list(map(self.cache.get, parts))
        plain, cuts, words = [], {}, set()
        for k, got in enumerate(out):
            if got is None:
                if parts[k].isalpha():
                    plain.append(k)
                    words.add(parts[k])
                else:
                    cuts[k] = cut = self.cut(parts[k])
                    words.update(cut)
        of = self._words(words)
        for k in plain:
            out[k] = of[parts[k]]
        for k, cut in cuts.items():
            out[k] = b"".join(map(of.__getitem__, cut))
        return out

    def _words(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, each one word by the tokenizer's pattern."""
        cache = self.cache
        of = {w: cache.get(w) for w in words}
        new = [w for w, got in of.items() if got is None]
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            got = self.bare.encode(" ".join(some), add_special_tokens=False)
            ids, word = np.array(got.ids, "<u4"), np.array(got.word_ids, np.int64)
            first = np.searchsorted(word, np.arange(len(some) + 1))
            if len(word) == 0 or word[-1] != len(some) - 1 or (np.diff(first) < 1).any():
                of.update((w, self.encode(w)) for w in some)  # some word has no ids
                continue
            raw, first = ids.tobytes(), (4 * first).tolist()
            of.update(zip(some, (raw[a:b] for a, b in zip(first, first[1:]))))
        for w in new[: max(0, CACHE - len(cache))]:
            if len(w) < 100:
                cache[w] = of[w]
        return of


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
