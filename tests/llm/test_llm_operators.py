"""Operators against libraries, brute force and edge cases, on small fixtures."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from perindex.llm import (
    conversations,
    language_id,
    license_scan,
    packing,
    piece_counts,
    posting_lists,
    prefix_bpe,
    quality_rules,
    simhash,
)

BYTE, PIECE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


def texts() -> list[str | None]:
    rnd = random.Random(4)
    letters = " \n\tabTheing.,'s1é▁日\x1c\xa0​😀<|>"
    made = ["".join(rnd.choices(letters, k=rnd.randint(0, 200))) for _ in range(60)]
    odd = ["a" * 3000, " " * 300, "\n\n \n", "<|endoftext|>x<|endoftext|>", "a▁b ▁", "I'll they've 'S", "<s> </s><unk>", "the the cat " * 900]
    return [None, "", *odd, *made, "same words here", "same words here"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with an extra column whose name the operators use themselves."""
    rows = [(i, t, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_trie_encoding_equals_the_library(docs):
    library, got = Tokenizer.from_file(BYTE), by_id(prefix_bpe.coded_documents(docs, BYTE))
    for i, text in enumerate(texts()):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha(",".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == sha(library.decode(ids, skip_special_tokens=False))
    assert prefix_bpe.coded_documents(docs.limit(0), BYTE).count() == 0


def test_heap_counts_equal_the_library(docs):
    library, got = sentencepiece.SentencePieceProcessor(model_file=PIECE), by_id(piece_counts.token_counts(docs, PIECE, 1000))
    for i, text in enumerate(texts()):
        count = len(library.encode(text or ""))
        assert (got[i]["n_tokens"], got[i]["over_limit"], got[i]["n_bytes"]) == (count, count > 1000, len((text or "").encode()))
    assert piece_counts.token_counts(docs.limit(0), PIECE, 1).count() == 0


def test_packing_places_every_piece_once(docs):
    rows = packing.pack_documents(docs, WORD, capacity=64).collect()
    library, sequences = Tokenizer.from_file(WORD), {}
    lengths = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in enumerate(texts())}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    for i, length in lengths.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == i) == length
    assert packing.pack_documents(docs.limit(0), WORD, 64).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_no_packing_block_outgrows_its_bound(spark, monkeypatch, repeated):
    """Pieces of over half a sequence are loose on every level, and meet in bounded blocks all the same."""
    count, bound, largest, level = 3000, 100, [], packing._pack_level

    def watched(pieces, *rest):
        packed = level(pieces, *rest)
        blocks = packed.withColumn("block", packed.sequence_id.bitwiseAND(-(1 << 24))).groupBy("block").count()
        largest.append(blocks.agg({"count": "max"}).first()[0])
        return packed

    monkeypatch.setattr(packing, "_pack_level", watched)
    key = "7" if repeated else "id"
    pieces = spark.range(count).selectExpr(
        f"{key} as doc_id", "0 as piece", "0L as start", f"2100L + {key} % 1500 as length", f"{key} as ids_crc32"
    ).selectExpr("cast(doc_id as long) doc_id", "piece", "start", "length", "cast(ids_crc32 as long) ids_crc32")
    rows = packing.pack(pieces, 4096, block_pieces=bound).collect()
    assert max(largest) <= 2 * bound and len(largest) > 1
    assert len({r["sequence_id"] for r in rows}) == len(rows) == count
    assert all(r["offset"] == 0 for r in rows)


def test_loose_bins_of_all_blocks_are_packed_again(spark):
    rnd = random.Random(6)
    lengths = [rnd.randint(600, 3500) for _ in range(2500)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), 4096, block_pieces=200).collect()
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096
    assert sorted(r["doc_id"] for r in packed) == list(range(2500))
    assert len(sequences) <= 1.03 * len(packing.best_fit(lengths, 4096))


def test_license_base_equals_brute_force(spark):
    rnd = random.Random(2)
    words = "under the MIT license Apache License, Version 2.0 CC BY-NC cc by nc and é 日 x".split(" ")
    made = [None, "", "cc by nc cc by nc", *(" ".join(rnd.choices(words, k=30)) for _ in range(300))]
    got = by_id(license_scan.scan_documents(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")))
    for i, text in enumerate(made):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(k, label) for phrase, label in license_scan.BASE.items() for k in range(len(found))
                if found[k : k + len(phrase.split())] == phrase.split()]
        row, places = got[i], sorted(k for k, _ in hits)
        assert (row["n_words"], row["n_base"]) == (len(found), len(hits))
        assert (row["first_word"], row["last_word"]) == ((places[0], places[-1]) if hits else (None, None))
        base = sorted({label for _, label in hits})
        assert row["base_labels"] == ",".join(base) and set(base) <= set(row["labels"].split(",")) | set()
        assert 0 <= row["score"] <= 1


def test_contained_detections_give_way():
    scanner = license_scan.Scanner(license_scan.signatures())
    assert len(license_scan.signatures()) >= 200
    assert [f[0] for f in scanner.detections("licensed under the gnu general public license version 3")] == ["gpl-3"]
    assert [f[0] for f in scanner.detections("cc by nc sa 4 0")] == ["cc-by-nc-sa-4.0"]


def test_simhash_components_equal_brute_force(spark):
    rnd = random.Random(8)
    base = [[f"w{rnd.randint(0, 500)}" for _ in range(rnd.randint(0, 120))] for _ in range(40)]
    made = [None, "", " \t", "One two", "one TWO"]
    for words in base:
        for _ in range(rnd.randint(1, 5)):
            copy = list(words)
            if copy and rnd.random() < 0.7:
                copy[rnd.randrange(len(copy))] = "changed"
            made.append(" ".join(copy))
    docs = spark.createDataFrame([(i + 3, t) for i, t in enumerate(made)], "doc_id long, text string")
    prints = []
    for text in made:
        words = re.findall(r"[^ \t-\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, p in enumerate(prints):
            for j, q in enumerate(prints):
                if (p ^ q).bit_count() <= 4 and label[j] > label[i]:
                    label[j], changed = label[i], True
    got = by_id(simhash.near_duplicates(docs))
    for i, value in enumerate(prints):
        assert (got[i + 3]["fingerprint"], got[i + 3]["component_id"]) == (f"{value:016x}", label[i] + 3)
    kept = simhash.one_of_each(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({x + 3 for x in label})


def test_large_groups_are_dealt_again():
    rnd = np.random.default_rng(1)
    centre = rnd.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([centre ^ (np.uint64(1) << rnd.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]))
    a, b = simhash.forest(values, 4)
    near = np.bitwise_count(a ^ b)
    assert len(a) and len(a) < len(values) and near.max() <= 64
    index = simhash.GrayIndex(values)
    pairs = sum(len(i) for i, _ in index.links(4))
    assert pairs == sum((np.bitwise_count(values[i + 1 :] ^ v) <= 4).sum() for i, v in enumerate(values))


def test_no_group_of_near_copies_outgrows_its_bound(spark, monkeypatch):
    """A family that agrees on all bands of the second deal, a chain and loners, against all pairs."""
    rng, bound, largest, forests = np.random.default_rng(5), 64, [], simhash._forests

    def watched(groups, key, *rest):
        sizes = groups.groupBy(*key).count().agg({"count": "max"}).first()[0]
        largest.append(sizes or 0)
        return forests(groups, key, *rest)

    monkeypatch.setattr(simhash, "_forests", watched)
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    low = np.array([sum(1 << int(b) for b in rng.choice(24, 3, replace=False)) for _ in range(400)], np.uint64)
    far = np.array([sum(1 << int(b) for b in rng.choice(26, 11, replace=False)) for _ in range(250)], np.uint64)
    chain = np.bitwise_xor.accumulate(one[:20]) ^ one[40]
    loners = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    values = np.unique(np.concatenate([low, far, chain, loners]))
    label, apart = np.arange(len(values)), np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    while True:
        after = np.where(apart, label[None, :], len(values)).min(axis=1)
        if (after == label).all():
            break
        label = after
    nodes = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "hash long")
    got = {r["hash"]: r["label"] for r in simhash.components(simhash.links(nodes, 4, group=bound)).collect()}
    names = [got.get(int(v), int(v)) for v in values.view(np.int64)]
    assert len(set(zip(names, label.tolist(), strict=True))) == len(set(names)) == len(set(label.tolist())) > 50
    assert max(largest) <= 2 * bound


def test_chat_collapse(spark):
    turns = ["hi", "hello", "more", None]
    logs = [(1, i, "user", t) for i, t in enumerate(turns[:2])] + [(2, i, "user", t) for i, t in enumerate(turns)]
    logs += [(3, i, "user", t) for i, t in enumerate(turns)] + [(4, 0, "user", "other"), (5, 0, "bot", "hi"), (None, 0, "user", "x")]
    logs += [(6, i, "user", f"long {i}") for i in range(200)] + [(7, i, "user", f"long {i}") for i in range(130)]
    df = spark.createDataFrame(logs, "conv_id long, turn long, role string, text string")
    rows = conversations.collapse_and_render(df).collect()
    assert {r["conv_id"] for r in rows} == {2, 3, 4, 5, 6}
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    expected = con.execute(conversations.ORACLE).fetchall()
    assert sorted((r["conv_id"], r["piece"], r["n_turns"], r["n_piece_turns"], r["chat"]) for r in rows) == sorted(
        (int(a), int(b), int(c), int(d), e) for a, b, c, d, e in expected
    )


def test_posting_lists_reach_the_neighbours(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(1500, 16)), 3)
    points[700:1000] = points[100]
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in posting_lists.search(df).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(range(0, 1500, 100))
    hits = 0
    for q in got:
        far = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1500), far))[:10]
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(far[i] - s) < 1e-12 for i, s in got[q].values())
        hits += len(set(best.tolist()) & {i for i, _ in got[q].values()})
    assert hits >= 0.9 * 10 * len(got)
    assert posting_lists.search(df.limit(0)).count() == 0
    assert posting_lists.search(df.filter("vec_id in (0, 1, 2)")).count() == 2


def test_language_is_learned_and_held_out(spark):
    tables = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(tables)
    rows = language_id.predict(tables, model).join(tables.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the of and " * 5000)], "doc_id long, text string")
    got = by_id(language_id.predict(odd, model))
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in model.languages
    assert language_id.fit(tables.limit(0)) is None


def test_long_texts_of_large_alphabets_keep_their_language():
    rng = np.random.default_rng(9)
    # Two languages of 3,000 letters each, half of them in common, with their own letter pairs.
    alphabets = {k: rng.permutation(np.arange(0x4E00 + at, 0x4E00 + at + 3000)) for k, at in (("aa", 0), ("bb", 1500))}

    def text(lang, size):
        return "".join(map(chr, alphabets[lang][(3000 * rng.random(size) ** 2).astype(int)]))

    labels = ["aa", "bb"] * 30
    model = language_id.solve(labels, [language_id.present(text(x, 2000)) for x in labels])
    made = ["aa", "bb"] * 3
    names, scores = language_id.languages([text(x, 300_000) for x in made], model)
    assert names == made
    one, other = (language_id.present(text(x, 300_000)) for x in ("aa", "bb"))
    assert len(np.intersect1d(one, other)) < 0.5 * len(one)


def test_every_language_is_learned(spark):
    names = [f"l{k:03}" for k in range(230)]
    rows = [(4 * i + j, " ".join(chr(0x4E00 + 20 * k + (i + m) % 20) for m in range(12)), x)
            for k, x in enumerate(names) for j in range(3) for i in [k]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    learned = {r["lang"] for r in docs.filter(~language_id.held_out()).collect()}
    assert len(learned) > 200 and set(model.languages) == learned
    texts = {x: t for _, t, x in rows if x in learned}
    assert language_id.languages(list(texts.values()), model)[0] == list(texts)


def test_quality_counts_and_rules(spark):
    text = "a b c a b c\nx # $\nx # $\n\n"
    counts = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), quality_rules.text_counts(text), strict=False))
    assert counts == {"n_words": 12, "word_chars": 12, "n_symbols": 4, "n_dup_lines": 1, "n_repeat_words": 12}
    assert quality_rules.repeated_words([b"a"] * 5) == 5 and quality_rules.text_counts("")[:5] == (0,) * 5
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    stats = quality_rules.statistics(docs)
    rules = quality_rules.learn_from(stats, labels)
    judged = quality_rules.judge(stats, rules).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = ([r["kept"] for r in judged if r["quality"] == q] for q in (1, 0))
    assert rules and sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)
    assert quality_rules.learn_from(stats, labels.limit(0)) == []


def test_the_seam_check_agrees_with_merging():
    bpe = prefix_bpe.PrefixBpe(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(2)
    tokens = [t for t in bpe.bytes_of if t not in bpe.special.values()]
    pairs = rng.choice(tokens, (4000, 2)).tolist()
    near = [i for ids in bpe.encode_batch([t or "" for t in texts()]) for i in ids][:3000]
    runs = [t for t in tokens if len(set(bpe.bytes_of[t])) == 1 and len(bpe.bytes_of[t]) < 40]
    pairs += list(zip(near, near[1:], strict=False)) + [(a, b) for a in runs for b in runs]
    for a, b in pairs:
        both = bpe.merged(bpe.bytes_of[a]) == [bpe.bytes_of[a]] and bpe.merged(bpe.bytes_of[b]) == [bpe.bytes_of[b]]
        if both:
            assert bpe.may_follow(a, b) == (bpe.merged(bpe.bytes_of[a] + bpe.bytes_of[b]) == [bpe.bytes_of[a], bpe.bytes_of[b]])


def test_exchange_carries_most():
    rng = np.random.default_rng(4)
    for _ in range(200):
        giver, taker = (rng.integers(1, 30, rng.integers(1, 6)).tolist() for _ in range(2))
        room = int(rng.integers(1, 20))
        picks = [[(i,) for i in range(len(x))] + [(i, j) for i in range(len(x)) for j in range(i)] for x in (giver, taker)]
        gains = [
            sum(giver[i] for i in g) - sum(taker[i] for i in t)
            for g in picks[0] for t in [(), *picks[1]] if len(g) == 1 or len(t) == 1
        ]
        gain, given, taken = packing.exchange(giver, taker, room)
        assert gain == max([g for g in gains if 0 < g <= room], default=0)
        assert gain == sum(giver[i] for i in given) - sum(taker[i] for i in taken)
