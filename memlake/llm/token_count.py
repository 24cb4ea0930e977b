"""Count-only Viterbi over a unigram vocabulary.

Gives the number of pieces, and their score, of each text's best segmentation without making
the pieces. An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming
over the positions carries the best score and its piece count.

Tie rule, as in the public unigram tokenizers: matches are tried by their start, earliest
first, and replace what is there only if strictly better; so of equal scores the one whose
last piece is longest stays. A character that starts no single-character match gets the
lowest score less 10, and counts one piece per UTF-8 byte if the vocabulary has byte pieces,
else one per run of such characters.

White space: spaces become U+2581, one of which goes before the text. No piece of the
vocabulary has U+2581 after another character (checked when it is read), so the best
segmentation never crosses a word's start, and words are solved one by one and cached.

Defined cases: a null or empty text has 0 pieces and score 0; every row gives one row; columns
beyond doc_id and text are not read. Texts are counted whole, however long; the automaton's
work is linear in a word's length times the longest piece.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of the words in each of the two generations of a worker's cache, each word counting
#: WORD_COST more; words of more than LONG_WORD characters are never kept.
CACHE_CHARS, WORD_COST, LONG_WORD = 30_000_000, 90, 64
#: A word with the spaces before it.
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def read_vocabulary(model_file: str) -> tuple[dict[str, float], bool]:
    """Scores of the normal pieces of a SentencePiece file, and whether it has byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = {}
    bytes_too = False
    for i in range(model.get_piece_size()):
        bytes_too |= model.is_byte(i)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            pieces[model.id_to_piece(i)] = model.get_score(i)
    return pieces, bytes_too


class Unigram:
    """Counts pieces of words; ``scores`` maps each piece to its score."""

    def __init__(self, scores: dict[str, float], byte_pieces: bool):
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece crosses the start of a word")
        self._automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._singles = {p for p in scores if len(p) == 1}
        self._byte_pieces, self._unknown = byte_pieces, min(scores.values()) - UNKNOWN_PENALTY
        self._young: dict[str, tuple[int, float]] = {}
        self._old: dict[str, tuple[int, float]] = {}
        self._held = 0

    def solve(self, word: str) -> tuple[int, float]:
        """Piece count and score of the best segmentation."""
        n = len(word)
        if self._singles.issuperset(word):  # no unknown character
            best, count, last = [0.0] * (n + 1), [0] * (n + 1), -1
            for end, (length, score) in self._automaton.iter(word):  # at an end the longest first
                value = best[end + 1 - length] + score
                if end != last or value > best[end + 1]:
                    best[end + 1], count[end + 1], last = value, count[end + 1 - length] + 1, end
            return count[n], best[n]
        return self._solve_unknown(word)

    def _solve_unknown(self, word: str) -> tuple[int, float]:
        n = len(word)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        single = [False] * n
        for end, (length, score) in self._automaton.iter(word):
            ending[end].append((end - length + 1, score))
            single[end] |= length == 1
        # best score and count before each position, and whether the last piece is unknown
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(n):
            options = ending[end]
            if not single[end]:
                options.append((end, self._unknown))
            top = None
            for start, score in sorted(options):  # the earliest start first
                value = best[start] + score
                if top is None or value > top:
                    top, at = value, start
            unseen = at == end and not single[end]
            if not unseen:
                more = 1
            elif self._byte_pieces:
                more = len(word[end].encode("utf-8", "surrogatepass"))
            else:
                more = 0 if unknown[end] else 1
            best[end + 1], count[end + 1], unknown[end + 1] = top, count[at] + more, unseen
        return count[n], best[n]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        young, old, pieces, score = self._young, self._old, 0, 0.0
        if text[0] == " " or "  " in text:
            words = [w[1:] for w in _WORD.findall(SPACE + text.replace(" ", SPACE))]
        else:  # one space before each word, which is left out here
            words = text.split(" ")
        for word in words:
            found = young.get(word)
            if found is None:
                found = old.get(word) or self.solve(SPACE + word)
                if len(word) <= LONG_WORD:
                    young[word] = found
                    self._held += len(word) + WORD_COST
            pieces += found[0]
            score += found[1]
        if self._held > CACHE_CHARS:
            self._old, self._young, self._held = young, {}, 0
        return pieces, score


@functools.lru_cache(maxsize=1)
def _model(model_file: str) -> Unigram:
    return Unigram(*read_vocabulary(model_file))


def count_tokens(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars, n_tokens and score of every whole text; the file must be at the same
    path on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            counted = [model.count(x) for x in texts]
            columns = [batch.column(0), pa.array([len(x or "") for x in texts], pa.int64()), pa.array([c for c, _ in counted], pa.int64()), pa.array([s for _, s in counted], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint, score double")
