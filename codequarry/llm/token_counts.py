"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches in a word by their ends,
longest first. Dynamic programming keeps, for each end, the best score and the
number of pieces on its path, and no path. Ties and unknown characters follow
the tokenizers library's unigram model: a later candidate must be strictly
better, so that of equal paths the one with the longest last piece stays; a
character without a piece of its own costs ten below the worst score, and
with byte fallback counts as many pieces as it has bytes.

A text's words are its maximal runs without ASCII white space, each led by the
vocabulary's space mark; pieces never span words. The vocabulary file is a
parameter; its pieces travel in a broadcast of that file's size. Null and empty
texts have no pieces. Rows are independent; extra columns are ignored.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.hashing import batches
from codequarry.runtime import ship

SPACE_MARK = "▁"
CACHE_WORDS, LONGEST_CACHED = 300_000, 64


def vocabulary(model_file: str) -> list[tuple[str, float]]:
    """(piece, score) by id, of a sentencepiece file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.find = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.find.add_word(piece, (len(piece), score))
        self.find.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10.0
        self.byte_fallback = byte_fallback
        self.cache: dict[bytes, tuple[float, int]] = {}

    def count(self, text: str) -> tuple[float, int]:
        """Best score and its number of pieces."""
        n = len(text)
        score, count = [0.0] * (n + 1), [0] * (n + 1)
        at, known = 0, False  # the end whose candidates are being met, and whether its last character is a piece
        best = None

        def close(end, known):
            nonlocal best
            if not known:
                candidate = score[end - 1] + self.unknown
                if best is None or candidate > best[0]:
                    best = candidate, count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.byte_fallback else 1)
            score[end], count[end] = best
            best = None

        for last, (size, value) in self.find.iter(text):
            end = last + 1
            while at < end:
                if at:
                    close(at, known)
                at, known = at + 1, False
            candidate = value + score[end - size]
            if best is None or candidate > best[0]:
                best = candidate, count[end - size] + 1
            known |= size == 1
        while at <= n:
            if at:
                close(at, known)
            at, known = at + 1, False
        return score[n], count[n]

    def word(self, word: bytes) -> tuple[float, int]:
        found = self.cache.get(word)
        if found is None:
            found = self.count(SPACE_MARK + word.decode("utf-8", "replace"))
            if len(word) <= LONGEST_CACHED:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found


def _count(pieces, byte_fallback):
    def run(found):
        counter = UnigramCounter(pieces.value, byte_fallback)
        get, word = counter.cache.get, counter.word
        for batch in found:
            for first, texts in batches(batch.column(1)):
                rows = []
                for t in texts:
                    each = [get(w) or word(w) for w in t.split()]
                    rows.append((len(each), sum([e[1] for e in each]), sum([e[0] for e in each])))
                types = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", "n_words", "n_tokens", "score"]
                )

    return run


def token_counts(documents: DataFrame, model_file: str, byte_fallback: bool = True) -> DataFrame:
    """doc_id, n_words, n_tokens and the summed score of each whole text; one pass without a shuffle."""
    spark = documents.sparkSession
    ship(spark)
    pieces = spark.sparkContext.broadcast(vocabulary(model_file))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(_count(pieces, byte_fallback), "doc_id long, n_words long, n_tokens long, score double")


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
