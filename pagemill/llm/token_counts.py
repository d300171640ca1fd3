"""Token counts: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, for every end position, the vocabulary pieces that end there, longest
first; the dynamic program keeps only the best score and its number of pieces for each position, never
the pieces. Ties follow the unigram tokenizer: starts are tried from the left and only a strictly better
score replaces, so the earliest start (longest last piece) wins; a character with no piece of its
own takes the lowest score less 10 and becomes its UTF-8 bytes.

The vocabulary is that of a public SentencePiece file (pieces and scores as they are; its byte pieces
serve as fallback), read as a unigram model with a space marker before each word. No piece may hold the
marker after another character (a vocabulary with such a piece is refused), so words are independent and each worker caches counts by word.

Null texts count 0, as empty ones do; repeated rows repeat; an empty table gives no rows; texts are read whole, however long, a word at a time;
extra columns are kept (one named like the output is replaced).
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table

MARK, UNKNOWN, CACHE = "▁", 10.0, 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece file: unknown first, then byte pieces, then normal ones."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    kept = [(sp.id_to_piece(i), float(sp.get_score(i))) for i in ids if not sp.is_control(i) and not sp.is_unknown(i)]
    return [("<unk>", 0.0), *kept]


class Counter:
    """count(text): pieces of the best segmentation."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        if any(MARK in piece.lstrip(MARK) for piece, _ in vocab):
            raise ValueError("a piece holds the space marker after another character: words would not be independent")
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN
        word = self.word

        class Cache(dict):
            def __missing__(self, key: str) -> int:
                n = word(key)
                if len(self) < CACHE and len(key) < 100:
                    self[key] = n
                return n

        self.cache = Cache()

    def word(self, word: str) -> int:
        n = len(word)
        score: list[float | None] = [None] * (n + 1)
        count = [0] * (n + 1)
        score[0] = 0.0
        ends: list[list] = [[] for _ in range(n)]
        for end, value in self.automaton.iter(word):
            ends[end].append(value)
        for i in range(n):
            best, pieces, single = None, 0, False
            for length, own in ends[i]:
                single |= length == 1
                s = score[i + 1 - length] + own
                if best is None or s > best:
                    best, pieces = s, count[i + 1 - length] + 1
            if not single:
                s = score[i] + self.unknown
                if best is None or s > best:
                    best, pieces = s, count[i] + len(word[i].encode())
            score[i + 1], count[i + 1] = best, pieces
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", MARK)
        words = (marked if marked[0] == MARK else MARK + marked).split(MARK)
        return sum(map(self.cache.__getitem__, [MARK + w for w in words[1:]]))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs without its text, with the count in `out` (a column of that name is replaced)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, out)]
    schema = T.StructType([*kept, T.StructField(out, T.LongType())])

    def run(batches):
        count = counter(path).count
        for batch in batches:
            n = pa.array([count(t or "") for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], n], names=[*batch.schema.names[1:], out])

    return docs.select(text, *[f.name for f in kept]).mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
