"""Token ids of whole texts, put together from the ids of their words.

The vocabulary drops white space and never joins what white space separates, so the
ids of a text are those of its words in order. A word is encoded once and kept; the
words of a corpus repeat so often that most of a text costs one look-up for each word.
"""

from __future__ import annotations

import os
import re
import struct

#: Words and word parts that a task keeps; beyond that it starts anew.
KEPT = 400_000

#: White space to Python's split() but not to the vocabulary's pattern.
SEPARATORS = re.compile("[\x1c-\x1f]")

# Letters of these ranges are their own composed form and have one lower-case letter,
# so words made of them need no normaliser: the library's model gets them directly.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
PLAIN = re.compile(rf"[!-~{LETTERS}]*\Z")
PLAIN_TEXT = re.compile(rf"[\t-\r -~{LETTERS}]*\Z")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿā-ſ]+|[0-9]|[^a-z0-9ß-öø-ÿā-ſ]+")
MARKS = re.compile(r"[^\sa-z0-9ß-öø-ÿā-ſ]{2}")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    codes = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(codes[b]) for b in range(256)]


class Words(dict):
    """Ids of plain words, each encoded when it is first looked up."""

    def __init__(self, model, shown: list[str]) -> None:
        super().__init__()
        self.model, self.shown = model, shown

    def __missing__(self, word: str) -> bytes:
        parts = PARTS.findall(word.lower())
        if parts == [word]:
            shown = word if word.isascii() else "".join([self.shown[b] for b in word.encode()])
            ids = [token.id for token in self.model.tokenize(shown)]
            found = struct.pack(f"<{len(ids)}I", *ids)
        else:
            found = b"".join([self[part] for part in parts])
        self[word] = found
        return found


class WordIds:
    """Encode texts to the little-endian 32-bit ids of a word vocabulary."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.words = Words(self.tokenizer.model, byte_characters())

    def library(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        plain = PLAIN.match(word) and not self.special.search(word)
        return self.words[word] if plain else self.library(word)

    def encode(self, text: str) -> bytes:
        if len(self.words) > KEPT:
            self.words.clear()
        if not PLAIN_TEXT.match(text) or self.special.search(text):
            return self.library(text) if SEPARATORS.search(text) else b"".join(map(self.word, text.split()))
        text = text.lower()
        if not MARKS.search(text):  # a mark that stands alone is a part of its own
            text = text.replace(".", " . ").replace(",", " , ")
        return b"".join(map(self.words.__getitem__, text.split()))
