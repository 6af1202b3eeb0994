"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary pieces that end at each character of a word, longest
first. Dynamic programming carries only the best score and its number of pieces, so no segmentation is
kept. Ties go to the piece that starts first (the longest): a later candidate must score strictly more.
A character that no single-character piece covers costs the least score of the vocabulary less 10 and
counts as one piece for each of its UTF-8 bytes. These are the rules of the Unigram model of
``tokenizers`` with byte fallback, split at spaces, with the word mark before each word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import prepare, table, text_or_empty

#: Stands for a space and before the first word.
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words of up to CACHE_CHARS characters are remembered, up to CACHE_WORDS of them in a worker.
CACHE_CHARS, CACHE_WORDS = 48, 400_000


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of a sentencepiece file with unigram log-probabilities.

    The file's merge order ranks its pieces by frequency, so each piece gets Zipf's probability of its
    rank. Control pieces keep their places and aren't matched in text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    total = math.log(sum(1 / (k + 1) for k in range(n)))
    return [(model.id_to_piece(k), -math.log(k + 1) - total) for k in range(n)]


class Counter(dict):
    """Maps a word (without its mark) to its number of pieces; words are counted when first asked for."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def best(self, text: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of ``text`` as it stands."""
        n, unknown = len(text), self.unknown
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, best, pieces, single = 0, None, 0, True  # of the prefix that ends at ``at``
        for end, (length, value) in self.automaton.iter(text):
            while at <= end:  # close this prefix and open the next one
                if not single and (best is None or score[at - 1] + unknown > best):
                    best, pieces = score[at - 1] + unknown, count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
                if at:
                    score[at], count[at] = best, pieces
                at, best, single = at + 1, None, False
            start = at - length
            candidate = score[start] + value
            if best is None or candidate > best:
                best, pieces = candidate, count[start] + 1
            single = single or length == 1
        while at <= n:
            if not single and (best is None or score[at - 1] + unknown > best):
                best, pieces = score[at - 1] + unknown, count[at - 1] + len(text[at - 1].encode("utf-8", "surrogatepass"))
            if at:
                score[at], count[at] = best, pieces
            at, best, single = at + 1, None, False
        return score[n], count[n]

    def __missing__(self, word: str) -> int:
        count = self.best(MARK + word)[1]
        if len(word) <= CACHE_CHARS and len(self) < CACHE_WORDS:
            self[word] = count
        return count

    def count(self, text: str) -> int:
        """Pieces of a whole text; an empty text has none. A mark in the text counts as a space, and no mark is put before a first space."""
        if MARK in text:
            text = text.replace(MARK, " ")
        return sum(map(self.__getitem__, text.removeprefix(" ").split(" "))) if text else 0


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens and n_words (runs between spaces) of every whole text; null texts are empty, with no token.

    Of segmentations of equal score that of the rules above counts, whose piece starts first. Nothing is shuffled. Repeated rows give
    repeated rows, an empty table none; other columns of ``docs`` are ignored.
    """
    prepare(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _counters:
            _counters[vocabulary_path] = Counter(read_vocabulary(vocabulary_path))
        counter = _counters[vocabulary_path]
        for rows in batches:
            texts = rows.column(1)
            tokens, words = [], []
            for at in range(rows.num_rows):
                text = texts[at].as_py()
                tokens.append(counter.count(text))
                words.append(text.count(" ") + 1 if text else 0)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tokens, pa.int64()), pa.array(words, pa.int64())], ["doc_id", "n_tokens", "n_words"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(counted, "doc_id long, n_tokens long, n_words long")


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
