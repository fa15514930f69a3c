"""Pipeline stages against plain Python, on documents planted among those of the smallest tables."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


@pytest.fixture(scope="module")
def docs(spark):
    """The given documents, copies of three of them, and texts with personal data."""
    known = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long = [r for r in sorted(known) if len(words_of(r[1])) > 200][:3]
    rows, at = list(known), 10_000_000
    for _, text, lang, source, _ in long:
        changed = text.rsplit(" ", 1)[0] + " ending"
        for copy in (text, text.upper(), changed):
            rows.append((at, copy, lang, source, len(copy)))
            at += 1
    for extra in ("write to jane.doe@example.org now", "card 4111 1111 1111 1111 please", "no data 4111 1111 1111 1112"):
        rows.append((at, extra, "en", "planted", len(extra)))
        at += 1
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def plain_fingerprint(text: str | None) -> int:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = words_of(lower)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_one_document_of_each_group_stays(spark, docs):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    group = {key: key for key in prints}

    def root(key: int) -> int:
        while group[key] != key:
            key = group[key]
        return key

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                first, second = sorted((root(a), root(b)))
                group[second] = first
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    groups = Counter(root(key) for key in prints)
    assert max(groups.values()) >= 3
    assert Counter(root(key) for key in kept) == dict.fromkeys(groups, 1)


def test_base_rules_reject_and_nothing_is_changed(spark, docs):
    def fails(text: str | None) -> bool:
        words = words_of(text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
        return len(words) < 50 or 100 * len(repeated) > 50 * len(words)

    before = {r["doc_id"]: r for r in docs.collect()}
    kept = corpus_pipeline.quality(spark, docs, FOLDER).collect()
    assert all(r == before[r["doc_id"]] for r in kept)
    assert not any(fails(r["text"]) for r in kept)
    passed = [key for key, r in before.items() if not fails(r["text"])]
    assert len(kept) > 0.75 * len(passed)


def test_planted_personal_data_goes_and_other_texts_stay(spark, docs):
    after = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, docs, FOLDER).collect()}
    before = {r["doc_id"]: r for r in docs.collect()}
    assert after.keys() == before.keys()
    planted = {r["text"]: after[key]["text"] for key, r in before.items() if r["source"] == "planted"}
    assert planted == {
        "write to jane.doe@example.org now": "write to <email> now",
        "card 4111 1111 1111 1111 please": "card <card> please",
        "no data 4111 1111 1111 1112": "no data 4111 1111 1111 1112",
    }
    plain = [key for key, r in before.items() if r["text"] and not re.search(r"[0-9@]", r["text"])]
    assert plain
    assert all(after[key]["text"] == before[key]["text"] for key in plain)


def test_packed_pieces_hold_the_ids_of_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in docs.collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for number, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[r["doc_id"], number] = (at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    rows = corpus_pipeline.pack(spark, docs, FOLDER).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
