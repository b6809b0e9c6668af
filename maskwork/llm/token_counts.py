"""Token counts under a unigram vocabulary, by a Viterbi pass that carries counts only.

Words are cut at white space and led by the vocabulary's space mark. An Aho-Corasick automaton of the
vocabulary lists all pieces that end at each character of a word; dynamic programming keeps, for each
character, the best score of a way there and its number of tokens, and no way itself. Ties go to the
way whose last piece begins first, and an unknown character costs the least score less ten and counts
its bytes, as in the public unigram encoders. Each distinct word of a batch is solved once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwork.llm.wordcache import WordCache
from maskwork.llm.words import chunks

CHUNK = 1_000_000
MARK = "▁"
PENALTY = 10.0


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a public model file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Token counts of words under ``pieces``."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.singles = {piece for piece, _ in pieces if len(piece) == 1}

    def count(self, word: str) -> int:
        text = MARK + word
        best, tokens = [0.0], [0]
        singles, unknown = self.singles, self.unknown
        matches = self.automaton.iter(text)
        pending = next(matches, None)
        for at, char in enumerate(text):
            top, held = None, 0
            # the automaton lists the pieces that end here from the longest to the shortest
            while pending is not None and pending[0] == at:
                length, score = pending[1]
                value = best[at + 1 - length] + score
                if top is None or value > top:
                    top, held = value, tokens[at + 1 - length] + 1
                pending = next(matches, None)
            if char not in singles:
                value = best[at] + unknown
                if top is None or value > top:
                    top, held = value, tokens[at] + len(char.encode("utf-8", "surrogatepass"))
            best.append(top)
            tokens.append(held)
        return tokens[-1]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """One count per word, as the word cache wants it."""
        return np.fromiter(map(self.count, words), np.int32, len(words)), np.ones(len(words), np.int64)


def token_counts(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_words, n_chars of every row, in one pass.

    Null and empty texts have no tokens; null ids stay; repeated rows get equal rows; other columns are ignored.
    """

    def run(batches):
        cache = WordCache(Counter(vocabulary(path)).encode)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                counts, bounds = cache.ids_of(texts[a:b])
                total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a), pa.array(total[bounds[1:]] - total[bounds[:-1]]), pa.array(np.diff(bounds)),
                     pa.array([len(t or "") for t in texts[a:b]], pa.int64())],
                    ["doc_id", "n_tokens", "n_words", "n_chars"])

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_words bigint, n_chars bigint")
