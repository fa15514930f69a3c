"""Token counts of a piece vocabulary with byte fallback, without making ids.

The characters of a word form a linked list. A heap holds the adjacent pairs that are a
piece, best score first, leftmost first. Each merge joins two symbols, so the count is the
number of symbols at the start less the number of merges. A character that no piece
starts from counts as its bytes and never merges.
"""

from __future__ import annotations

import re
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text

#: Distinct words that a worker keeps before it starts anew.
KEPT = 1_000_000

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def merge_count(word: str, scores: dict[str, float]) -> int:
    """How often two neighbours of ``word`` merge: the pair of the best score first, ties leftmost first."""
    size = len(word)
    ends = list(range(1, size + 1))  # a symbol is word[start:ends[start]]; 0 marks one that was taken in
    left = list(range(-1, size - 1))
    get = scores.get
    heap = [(-score, i, i + 2) for i in range(size - 1) if (score := get(word[i : i + 2])) is not None]
    heapify(heap)
    merges = 0
    while heap:
        _, at, end = heappop(heap)
        middle = ends[at]
        # A stale entry: one of its two symbols has grown or is gone.
        if not middle or middle >= end or ends[middle] != end:
            continue
        merges += 1
        ends[at], ends[middle] = end, 0
        before = left[at]
        if end < size:
            left[end] = at
            after = ends[end]
            if (score := get(word[at:after])) is not None:
                heappush(heap, (-score, at, after))
        if before >= 0 and (score := get(word[before:end])) is not None:
            heappush(heap, (-score, before, end))
    return merges


class Counts(dict):
    """Tokens of words, each counted when it is first looked up. A space stands for the mark of a word's start."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__()
        self.scores = scores

    def __missing__(self, word: str) -> int:
        symbols = sum(1 if c in self.scores else len(c.encode()) for c in word)
        count = self[word] = symbols - (merge_count(word, self.scores) if len(word) > 1 else 0)
        return count


class PieceCounter:
    """Count the tokens of texts with a piece vocabulary file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix:
            raise ValueError("only vocabularies that keep the text as it is are counted")
        pieces = model.pieces
        scores = {p.piece.replace("▁", " "): p.score for p in pieces if p.type == p.NORMAL}
        if any(" " in piece.lstrip(" ") for piece in scores):
            raise ValueError("a piece reaches over a word's end")
        # Nothing merges over a character that no piece holds, so a line's end may end a word.
        line = "" if any("\n" in piece for piece in scores) else r"\n"
        self.words = re.compile(rf" *[^ {line}]+| +" + (f"|{line}" if line else ""))
        self.counts = Counts(scores)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.counts) > KEPT:
            self.counts.clear()
        return sum(map(self.counts.__getitem__, self.words.findall(" " + text.replace("▁", " "))))


KNOWN: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The counter of a vocabulary, with what its worker has counted before."""
    if path not in KNOWN:
        KNOWN[path] = PieceCounter(path)
    return KNOWN[path]


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Bytes and tokens of every text, and whether the tokens exceed ``limit``.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated results,
    other columns are not carried, an empty table gives an empty one.
    """

    def make():
        count = counter(vocabulary).count

        def counted(keys: list[int], texts: list[str]) -> dict[str, list]:
            tokens = list(map(count, texts))
            return {
                "doc_id": keys,
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": tokens,
                "over_limit": [n > limit for n in tokens],
            }

        return counted

    return map_columns(docs, [F.col(f"`{doc_id}`").cast("long"), whole_text(text)], make, COUNTS)
