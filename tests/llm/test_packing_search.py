"""Packing against plain Python: token pieces by the library, and a local search without a bound on partners."""

import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from perindex.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")


def total(bins, lengths):
    return [sum(lengths[i] for i in b) for b in bins]


def test_a_bin_finds_its_partner_beyond_many_emptier_ones():
    # One bin of 50, eighty of 60 that cannot exchange with it, and one that can: 45 and 20.
    lengths = [50, *[60] * 80, 45, 20]
    bins = [[i] for i in range(81)] + [[81, 82]]
    packed = packing.empty_bins(bins, lengths, 100)
    assert len(packed) == 81
    assert sorted(i for b in packed for i in b) == list(range(83))
    assert max(total(packed, lengths)) <= 100


@pytest.mark.parametrize("seed", range(6))
def test_no_gaining_exchange_is_left(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 70) for _ in range(rng.choice([0, 1, 40, 150]))]
    first = packing.best_fit(lengths, 100)
    packed = packing.empty_bins(first, lengths, 100)
    assert sorted(i for b in packed for i in b) == list(range(len(lengths)))
    assert len(packed) <= len(first)
    fill = total(packed, lengths)
    assert all(f <= 100 for f in fill)
    if len(packed) > -(-sum(lengths) // 100):
        for giver, a in zip(packed, fill):
            for taker, b in zip(packed, fill):
                if giver is not taker and a <= b < 100:
                    sides = [[lengths[i] for i in x] for x in (giver, taker)]
                    assert packing.exchange(*sides, 100 - b)[0] == 0


def test_pieces_are_those_of_the_library(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "été", "中文", "x1", ",", "\n", "\U0001f642", "  "]
    texts = [None, "", " ", "a" * 700, *[" ".join(rng.choices(words, k=rng.choice([1, 30, 400]))) for _ in range(20)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library, expected = Tokenizer.from_file(WORD), []
    for doc, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            expected.append((doc, piece, start, len(part), crc))
    rows = packing.pack_documents(docs, WORD, capacity=64).collect()
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(tuple(r[n] for n in names) for r in rows) == expected
    # As many sequences as the tokens need, or hardly more than one search over all pieces.
    lengths = [e[3] for e in expected]
    whole = packing.empty_bins(packing.best_fit(lengths, 64), lengths, 64)
    assert len({r["sequence_id"] for r in rows}) <= len(whole)
