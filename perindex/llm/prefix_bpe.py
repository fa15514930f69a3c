"""Byte-level BPE by a traversal of the trie of distinct words.

The last token of an encoding decides how it may go on: a token can follow if merging the
bytes of both gives just these two. So the encoding of a prefix is the one token that ends
there and may follow the encoding of what stands before it. The distinct words of a batch go
into a trie, and a walk in depth carries the last token of each prefix downwards; what words
share at their start is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.llm.text_batches import map_columns, whole_text
from perindex.llm.word_ids import byte_characters

#: Distinct words that a worker keeps before it starts anew, bytes of their results, and words in one trie.
KEPT, KEPT_BYTES, TRIE_WORDS = 700_000, 64 << 20, 20_000

# In texts of these characters alone, the vocabulary's word pattern is the one below.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
PLAIN_TEXT = re.compile(rf"[\t\n\r -~{LETTERS}]*\Z")
PLAIN_WORDS = re.compile(
    rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
)

CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def shared_start(a: bytes, b: bytes) -> int:
    """Bytes that two words have in common at their start."""
    if a[0] != b[0]:
        return 0
    if b.startswith(a):
        return len(a)
    return next(i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y)


def branch_depths(shared: list[int]) -> list[list[int]]:
    """For each word of an ordered list the depths at which later words branch off its own part.

    ``shared[i]`` is what word i shares with the word before. A later word branches off the last
    word before it that goes on beyond what they share.
    """
    branches: list[list[int]] = [[] for _ in shared]
    owners: list[tuple[int, int]] = []  # words whose own parts are still open: where they start, and number
    for number, depth in enumerate(shared):
        while owners and owners[-1][0] > depth:
            owners.pop()
        if owners and owners[-1][0] == depth:
            owners.pop()  # this node exists already
        elif depth:
            branches[owners[-1][1]].append(depth)
        owners.append((depth, number))
    return [sorted(depths) for depths in branches]


class PrefixBpe:
    """Encode and decode texts with a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        model = content["model"]
        self.bytes_of = {i: self._bytes(t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(self._bytes(a), self._bytes(b)): k for k, (a, b) in enumerate(pairs)}
        self.seams, self.halves = self._seams()
        self.steps, self.ends = self._steps()
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.words_of = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.follows: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.shown: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.held = 0

    def _bytes(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    def _seams(self) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int, int]]]:
        """The rank of each pair of tokens, and of each token the rank and the halves it is made from.

        The check at the seam of two tokens needs one way to make a token, out of earlier ones.
        """
        seams = {(self.id_of[a], self.id_of[b]): k for (a, b), k in self.rank.items()}
        halves = {token: (-1, token, token) for token in self.bytes_of}
        for (a, b), k in self.rank.items():
            made = self.id_of[a + b]
            if halves[made][0] >= 0 or k <= max(halves[self.id_of[a]][0], halves[self.id_of[b]][0]):
                raise ValueError("a token is made in two ways, or out of later ones")
            halves[made] = (k, self.id_of[a], self.id_of[b])
        return seams, halves

    def _steps(self) -> tuple[dict[int, int], dict[int, int]]:
        """A trie of all tokens: the place after ``256 * place + byte``, and the token that ends at a place."""
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for data, token in self.id_of.items():
            place = 0
            for byte in data:
                place = steps.setdefault(256 * place + byte, len(steps) + 1)
            ends[place] = token
        return steps, ends

    def merged(self, data: bytes) -> list[bytes]:
        """The merge rules applied to a few bytes, lowest rank first, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, first: int, second: int) -> bool:
        """Whether no merge reaches over the seam of two tokens while both are put together.

        Looking back in time, the token made last falls into its halves first; those at the
        seam stay in view. A pair there merges if it comes before either is taken in: of equal
        ranks the pair further left comes first.
        """
        known = self.follows.get((first, second))
        if known is None:
            if len(self.follows) > KEPT:
                self.follows.clear()
            left, right, left_until, right_until = first, second, 1 << 60, 1 << 60
            while True:
                rank = self.seams.get((left, right))
                if rank is not None and rank < left_until and rank <= right_until:
                    known = False
                    break
                left_made, _, left_half = self.halves[left]
                right_made, right_half, _ = self.halves[right]
                if left_made < 0 and right_made < 0:
                    known = True
                    break
                if left_made >= right_made:
                    left, left_until = left_half, left_made
                else:
                    right, right_until = right_half, right_made
            self.follows[first, second] = known
        return known

    def may_start(self, token: int) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = len(self.merged(self.bytes_of[token])) == 1
        return known

    def last_token(self, open_: list[tuple[int, int]], last: list[int]) -> int:
        """The token that ends the encoding of a prefix, given that of every shorter prefix.

        ``open_`` has, longest first, the start of each run of bytes up to here that begins some token,
        and its place in the trie of tokens.
        """
        for start, place in open_:
            token = self.ends.get(place)
            if token is not None and (self.may_follow(last[start], token) if start else self.may_start(token)):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of distinct words, from one walk through their trie.

        The walk meets the words in their order: each one goes on from the node that it shares with
        the word before. A node without a branch has no object, it is a byte of a word and its last
        token, so a run of any length takes a few bytes for each of its bytes.
        """
        order = sorted(words)
        shared = [0, *(shared_start(a, b) for a, b in zip(order, order[1:], strict=False))]
        found: dict[bytes, tuple[int, ...]] = {}
        last, step = array("i", [0]), self.steps.get
        nodes: list[tuple[int, list[tuple[int, int]]]] = [(0, [(0, 0)])]
        for word, depth, branches in zip(order, shared, branch_depths(shared), strict=True):
            while nodes[-1][0] > depth:
                nodes.pop()
            open_ = nodes[-1][1]
            del last[depth + 1 :]
            for until in (*branches, len(word)):
                for at in range(depth, until):
                    byte = word[at]
                    open_ = [(start, to) for start, place in open_ if (to := step(256 * place + byte)) is not None]
                    last.append(self.last_token(open_, last))
                    open_.append((at + 1, 0))
                if until in branches:
                    nodes.append((until, open_))
                depth = until
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= len(self.bytes_of[last[at]])
            found[word] = tuple(reversed(ids))
        return found

    def split(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if any(special in text for special in self.special):
            parts = [part for part in self.cut.split(text) if part]
            return [w for part in parts for w in ([part] if part in self.special else self.split(part))]
        if PLAIN_TEXT.match(text):
            return PLAIN_WORDS.findall(text)
        return [text[a:b] for _, (a, b) in self.words_of(text)]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet."""
        if len(self.shown) > KEPT or self.held > KEPT_BYTES:
            self.shown, self.decoded, self.held = {}, {}, 0
        new = sorted(words - self.shown.keys())
        for at in range(0, len(new), TRIE_WORDS):
            block = new[at : at + TRIE_WORDS]
            plain = {w: w.encode() for w in block if w not in self.special}
            found = self.encode_words(w for w in plain.values() if w)
            for word in block:
                ids = (self.special[word],) if word in self.special else found[plain[word]]
                self.shown[word] = ",".join(map(str, ids))
                self.decoded[word] = b"".join([self.bytes_of[i] for i in ids])
                self.held += len(self.shown[word]) + len(word)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        split = [self.split(text) for text in texts]
        self.learn(set().union(*split))
        return [[int(i) for word in words for i in self.shown[word].split(",")] for words in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


KNOWN: dict[str, PrefixBpe] = {}


def encoder(path: str) -> PrefixBpe:
    """The encoder of a vocabulary, with what its worker has encoded before."""
    if path not in KNOWN:
        KNOWN[path] = PrefixBpe(path)
    return KNOWN[path]


def coded_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Number and digest of the ids of every text, and the digest of the text decoded from them.

    A null text counts as empty: no tokens, the digests of nothing. Repeated rows give repeated
    results, other columns are not carried, an empty table gives an empty one.
    """

    def make():
        bpe = encoder(vocabulary)

        def code(keys: list[int], texts: list[str]) -> dict[str, list]:
            split = [bpe.split(text) for text in texts]
            bpe.learn(set().union(*split))
            shown = [",".join(map(bpe.shown.__getitem__, words)) for words in split]
            back = [b"".join(map(bpe.decoded.__getitem__, words)).decode("utf-8", "replace") for words in split]
            return {
                "doc_id": keys,
                "n_tokens": [s.count(",") + 1 if s else 0 for s in shown],
                "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in shown],
                "decoded_sha256": [hashlib.sha256(s.encode()).hexdigest() for s in back],
            }

        return code

    return map_columns(docs, [F.col(f"`{doc_id}`").cast("long"), whole_text(text)], make, CODED, rows=500)
