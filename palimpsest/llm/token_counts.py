"""Token counts by dynamic programming over a shared trie.

The pieces of a vocabulary are a unigram model.  Their scores are fitted on the whole
corpus by Viterbi training: the distinct pre-tokens are counted by a shuffle, each is
segmented at its best score, and a piece's next score is the logarithm of its share of all
pieces used, in whole millionths (``SMOOTHING`` uses are added to each).  Training starts
from the pieces' order in the file.  Only sums by piece, bounded by the vocabulary, reach
the driver.

A pre-token is a word between ASCII white space with the vocabulary's word mark before it.
In counting, distinct pre-tokens are inserted in a trie; a node's forward score, the best
over all segmentations of its prefix, is computed when the node is made and serves every
pre-token below it.  Terminal counts are kept per pre-token and summed per document.  In
training, pre-tokens come in order, and one path of the trie is enough.

A character that no piece covers counts as its UTF-8 bytes, each at ``BYTE_BELOW`` under the
lowest piece.  Among segmentations of equal score the one with fewer tokens counts.
``NODES``, ``WORDS`` and ``LONG`` bound memory and change no result.

Defined results.  Null, empty and blank texts have 0 tokens.  A row per input row.  An empty
corpus leaves the starting order.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize
from .common import column_bytes

#: Nodes of a trie, words remembered, and characters of a pre-token that still enters the trie.
NODES, WORDS, LONG = 400_000, 200_000, 200
ROUNDS, SMOOTHING, BYTE_BELOW = 2, 0.5, 10_000_000
MARK = "▁"
#: A segmentation's value: score times 2**32, less the tokens; the larger value is the better one.
SHIFT = 32


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def first_scores(path: str) -> dict[str, int]:
    """Piece -> starting score, of all but control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): round(-1e6 * math.log(i + 2))
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


def next_scores(scores: dict[str, int], used: dict[str, int]) -> dict[str, int]:
    """Logarithm of each piece's smoothed share of the pieces used."""
    total = sum(used.values()) + SMOOTHING * len(scores)
    return {p: round(1e6 * math.log((used.get(p, 0) + SMOOTHING) / total)) for p in scores}


class Lattice:
    """Best values of prefixes; pieces are found backwards from their end, through a trie of reversed pieces."""

    def __init__(self, scores: dict[str, int]):
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = (score << SHIFT) - 1
        self.byte = (min(scores.values()) - BYTE_BELOW << SHIFT) - 1

    def best(self, text: str, end: int, forward: list[int]) -> int:
        """Best value of the first ``end`` characters, from those of shorter prefixes."""
        return self.step(text, end, forward)[0]

    def step(self, text: str, end: int, forward: list[int]) -> tuple[int, int]:
        """``best`` and where its last piece begins; -1 for a character written as bytes."""
        node, begin, start = self.root, end, -1
        best = forward[end - 1] + len(text[end - 1].encode("utf-8", "replace")) * self.byte
        while begin:
            begin -= 1
            node = node.get(text[begin])
            if node is None:
                break
            gain = node.get("")
            if gain is not None and forward[begin] + gain > best:
                best, start = forward[begin] + gain, begin
        return best, start


class TrieCounts(dict):
    """Word bytes -> value of its best segmentation; bounded, as the trie behind it."""

    def __init__(self, scores: dict[str, int]):
        self.lattice = Lattice(scores)
        self.older: dict[bytes, int] = {}
        self._fresh_trie()

    def _fresh_trie(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.value = [0]

    def __missing__(self, word: bytes) -> int:
        value = self.older.get(word)
        if value is None:
            value = self._value(MARK + word.decode("utf-8", "replace"))
        if len(self) >= WORDS:  # words in use come back from the older half
            self.older = dict(self)
            self.clear()
        if len(word) <= LONG:
            self[word] = value
        return value

    def _value(self, text: str) -> int:
        forward = [0]
        best = self.lattice.best
        if len(text) > LONG:
            for end in range(1, len(text) + 1):
                forward.append(best(text, end, forward))
            return forward[-1]
        if len(self.value) > NODES:
            self._fresh_trie()
        child, values, node = self.child, self.value, 0
        for end, char in enumerate(text, 1):
            step = (node, char)
            node = child.get(step)
            if node is None:
                node = child[step] = len(values)
                values.append(best(text, end, forward))
            forward.append(values[node])
        return forward[-1]

    def text(self, text: bytes | None) -> tuple[int, int, int]:
        """Words, tokens and score of a whole text."""
        words = text.split() if text else []
        value = sum(map(self.__getitem__, words))
        tokens = -value % (1 << SHIFT)
        return len(words), tokens, (value + tokens) >> SHIFT


class SortedSegments:
    """Pieces of the best segmentations of pre-tokens that come in order: equal beginnings are kept."""

    def __init__(self, scores: dict[str, int]):
        self.lattice = Lattice(scores)
        self.text, self.forward, self.start = "", [0], [-1]

    def pieces(self, text: str) -> Iterator[str]:
        same = 0
        while same < min(len(text), len(self.text)) and text[same] == self.text[same]:
            same += 1
        del self.forward[same + 1 :], self.start[same + 1 :]
        for end in range(same + 1, len(text) + 1):
            value, start = self.lattice.step(text, end, self.forward)
            self.forward.append(value)
            self.start.append(start)
        self.text = text
        end = len(text)
        while end:
            start = self.start[end]
            if start >= 0:
                yield text[start:end]
            end = start if start >= 0 else end - 1


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)`` of all documents' words."""
    words = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+")
    return docs.select(F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


def pieces_used(words: DataFrame, scores: dict[str, int]) -> DataFrame:
    """``(piece, n)``: uses of the pieces in the best segmentations of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, used = SortedSegments(scores), Counter()
        for batch in batches:
            for word, n in zip(column_bytes(batch, "word"), batch.column("n").to_pylist()):
                for piece in segments.pieces(MARK + word.decode("utf-8", "replace")):
                    used[piece] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(used), pa.string()), pa.array(list(used.values()), pa.int64())], names=["piece", "n"])

    return words.sortWithinPartitions("word").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def fit_scores(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> dict[str, int]:
    """Piece scores after ``rounds`` of Viterbi training on all documents."""
    scores = first_scores(path or vocabulary_file())
    words = materialize(word_counts(docs), "words")
    for _ in range(rounds):
        used = {r["piece"]: r["n"] for r in pieces_used(words, scores).collect()}  # at most the vocabulary
        if used:
            scores = next_scores(scores, used)
    discard(words)
    return scores


def token_counts(docs: DataFrame, scores: dict[str, int] | None = None) -> DataFrame:
    """``(doc_id, n_words, n_tokens, score)``; score: of the best segmentations, in millionths.

    ``scores`` by piece are fitted on ``docs`` where none are given.
    """
    scores = fit_scores(docs) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TrieCounts(scores)
        for batch in batches:
            rows = [counts.text(t) for t in column_bytes(batch, "text")]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_tokens", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, n_tokens long, score long")
