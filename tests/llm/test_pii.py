from __future__ import annotations

import hashlib
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from perindex.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text: str) -> list[tuple]:
    found = []
    for number, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                kind == "email"
                or (kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == "card" and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == "phone" and 10 <= len(digits) <= 15)
            )
            if ok:
                found.append((m.start(), number, m.end(), kind))
    return sorted(found)


def texts() -> list[str | None]:
    rnd = random.Random(5)
    parts = ["a@b.co", "x.y@", "@", "é😀", "1.2.3.4", "300.1.1.1", "001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+49 (30) 1234-5678", "+1", "5500005555555559", " ", "\n", ".", "-", "_", "12", "w@d.e_f@g.h", "1.2.3", "card ", "9" * 30]
    made = ["".join(rnd.choices(parts, k=rnd.randint(1, 25))) for _ in range(400)]
    return [None, "", "a" * 60000, "1" * 60000, "1 " * 20000, "a.b@" * 5000, "x@" + "y." * 20000, *made]


def test_base_spans_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        base = brute(text or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in base)
        assert got[key]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (text or "")[:200]
        for kind in BASE:
            assert got[key][f"n_{kind}"] == sum(k == kind for *_, k in base)


def test_iban_context_and_redaction(spark):
    text = "IBAN DE89 3704 0044 0532 0130 00, not DE88370400440532013000. mail a@b.org"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, None)], "doc_id long, text string, spans_of string")
    rows = pii.report(docs).orderBy("doc_id").collect()
    assert [r["n_iban"] for r in rows] == [1, 1, 0] and rows[0]["top_score"] == 1.0
    redacted = pii.redact(docs).orderBy("doc_id").collect()
    assert redacted[0]["text"] == "IBAN <iban>, not DE88370400440532013000. mail <email>"
    assert redacted[2]["text"] is None and redacted[0]["spans_of"] == "x"
    assert pii.report(docs.limit(0)).count() == 0


def test_running_sums(spark):
    rows = [(i, [random.Random(i).randint(0, 9) for _ in range(n)]) for i, n in enumerate((1, 2, 127, 128, 129, 256, 1000))]
    df = spark.createDataFrame(rows, "n int, x array<long>").repartition(2)
    for r in df.select("x", pii.running_sums(F.col("x")).alias("sums")).collect():
        assert r["sums"] == list(itertools.accumulate(r["x"]))


def test_very_many_hits_in_one_text(spark):
    texts = [" ".join(f"u{i}@h{i}.org é" for i in range(n)) for n in (10_000, 60_000)]
    seconds = []
    for text in texts:
        docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
        pii.report(docs).collect()
        begin = time.perf_counter()
        (row,) = pii.report(docs).collect()
        seconds.append(time.perf_counter() - begin)
        spans = brute(text)
        assert row["n_email"] == len(spans) == text.count("@")
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()
    assert seconds[1] < 15 * seconds[0] + 5  # 36 times as long if it grew with the square
