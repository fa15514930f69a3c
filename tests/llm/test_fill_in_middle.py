"""Fill-in-the-middle examples against a plain decoder of texts."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from perindex.llm import fill_in_middle as fim


def texts() -> list[str | None]:
    rnd = random.Random(12)
    letters = "ab \n\n\r é日😀<P\x00"
    made = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(150)]
    marks = ["has <P> mark", "<S>", "x<M>", "<<P", "P>", "<S", "ends with <", "> begins", "é\n<M", "S>\n日"]
    return [None, "", "\n", "\n\n", "one", "é", "😀\n" * 3, *marks, "long é line\n" * 20_000, *made, "same\ntext", "same\ntext"]


def expected(key: int, text: str | None, unit: str, seed: int, percent: int, spm: int) -> tuple:
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "lines" else list(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)


@pytest.mark.parametrize("unit", ["lines", "chars"])
@pytest.mark.parametrize(("seed", "percent", "spm"), [(7, 100, 50), (3, 60, 20)])
def test_examples_equal_a_plain_construction(docs, unit, seed, percent, spm):
    made = fim.transform(docs, seed=seed, unit=unit, fim_percent=percent, spm_percent=spm)
    rows = made.withColumn("back", fim.restored()).collect()
    assert len(rows) == len(texts())
    for r in rows:
        text = texts()[r["doc_id"]]
        got = (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])
        assert got == expected(r["doc_id"], text, unit, seed, percent, spm)
        assert r["back"] == (text or "")


def test_index_converts_both_ways():
    text = "aé日b😀\nzz" * 50
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.ExceptionIndex(data)
    points = np.arange(len(text) + 1)
    cuts = np.array([len(text[:i].encode()) for i in points])
    assert (index.to_bytes(points) == cuts).all()
    assert (index.to_points(cuts) == points).all()
    assert len(index.bytes_at) == 150  # three exceptions in each repetition


def test_batches_are_cut_by_bytes(docs, monkeypatch):
    offsets = np.array([0, 5, 5, 30, 31, 40])
    monkeypatch.setattr(fim, "BATCH_BYTES", 10)
    assert list(fim.slices(offsets)) == [(0, 2), (2, 3), (3, 5)]
    assert list(fim.slices(np.array([0]))) == []


def test_empty_table_repeated_rows_and_null_ids(spark, docs):
    assert fim.digests(docs.limit(0)).count() == 0
    rows = spark.createDataFrame([(None, "a\nb"), (None, "a\nb"), (1, None), (1, None)], "doc_id long, text string")
    got = fim.digests(rows).groupBy(*fim.digests(rows).columns).count().collect()
    assert sorted(r["count"] for r in got) == [2, 2]
    assert {r["restored_sha256"] for r in got} == {hashlib.sha256(t.encode()).hexdigest() for t in ("a\nb", "")}


def test_other_column_names_and_units(spark):
    rows = spark.createDataFrame([(4, "x y")], "`my id` long, body string")
    got = fim.transform(rows, doc_id="my id", text="body", unit="chars").select(F.col("n")).collect()
    assert got[0]["n"] == 3
    with pytest.raises(ValueError, match="unit"):
        fim.transform(rows, unit="words")
