"""The walk through the trie of words: shared prefixes, branches and long runs."""

from __future__ import annotations

import random
import resource

import public_tokenizers
from tokenizers import Tokenizer

from perindex.llm import prefix_bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_branches_are_the_inner_nodes_of_the_trie():
    rnd = random.Random(2)
    for _ in range(200):
        words = sorted({bytes(rnd.choices(b"ab", k=rnd.randint(1, 7))) for _ in range(rnd.randint(1, 25))})
        shared = [0, *(prefix_bpe.shared_start(a, b) for a, b in zip(words, words[1:], strict=False))]
        branches = prefix_bpe.branch_depths(shared)
        made = [(w[:d]) for w, depths in zip(words, branches, strict=True) for d in depths]
        assert len(made) == len(set(made))
        assert set(made) == {b[:d] for d, b in zip(shared, words, strict=True) if d}
        assert all(d > s for s, depths in zip(shared, branches, strict=True) for d in depths)


def test_words_with_shared_starts_equal_the_library():
    rnd, library = random.Random(3), Tokenizer.from_file(BYTE)
    stems = ["inter", "internation", "über", "aaaa", "the", "x"]
    words = {rnd.choice(stems) * rnd.randint(1, 4) + "".join(rnd.choices("aenst", k=rnd.randint(0, 6))) for _ in range(3000)}
    found = prefix_bpe.PrefixBpe(BYTE).encode_words(w.encode() for w in words)
    for word in words:
        assert list(found[word.encode()]) == library.encode(word, add_special_tokens=False).ids


def test_a_run_without_a_space_takes_little_memory():
    rnd, library = random.Random(4), Tokenizer.from_file(BYTE)
    run = "".join(rnd.choices("abcdefghij", k=1_500_000))
    bpe = prefix_bpe.PrefixBpe(BYTE)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids, longer = bpe.encode_batch([run, run + "zz"])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024
    assert bpe.decode(ids) == run and bpe.decode(longer) == run + "zz"
    assert library.encode(run[:20_000], add_special_tokens=False).ids[:-20] == ids[: len(library.encode(run[:20_000], add_special_tokens=False).ids) - 20]
