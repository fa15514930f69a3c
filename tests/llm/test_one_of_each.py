"""One document of each near-duplicate group: repeats, nulls, ties, and documents that move once."""

import pytest

from perindex.llm import simhash

SCHEMA = "doc_id long, text string, hash string, row string, label int"


def sentence(seed: int) -> str:
    return " ".join(f"w{seed}x{i}" for i in range(60))


@pytest.fixture()
def docs(spark):
    rows = [
        (5, sentence(1), "a", "r", 1),
        (3, sentence(1), "b", "r", 1),
        (3, sentence(1), "b", "r", 1),  # the same row again
        (3, sentence(2), "c", "r", 1),  # the same id with another text
        (None, sentence(1), "d", "r", 1),
        (None, sentence(3), "e", "r", 1),
        (None, sentence(3), "f", "r", 1),
        (9, None, "g", "r", 1),
        (8, "", "h", "r", 1),
        (7, " \n", "i", "r", 1),
        *[(100 + i, sentence(4), "k", "r", 1) for i in range(300)],
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_the_smallest_id_of_each_group_stays_once(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert got == sorted([
        (False, 3, sentence(1)), (False, 3, sentence(2)), (True, 0, sentence(3)), (False, 7, " \n"), (False, 100, sentence(4)),
    ])


def test_an_empty_table_stays_empty(docs):
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_documents_move_once_and_by_their_row(docs):
    plan = simhash.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row" in plan
    assert plan.count("Exchange hashpartitioning(row") == plan.count("Exchange ") == 2  # documents and winners
    assert "Aggregate" not in plan


def test_a_key_dealt_into_parts_keeps_its_minimum(spark, monkeypatch):
    rows = [(7, i, None if i % 2 else i) for i in range(40)] + [(8, 1, 5), (9, 2, None)]
    df = spark.createDataFrame(rows, "label long, hash long, first_id long")
    got = simhash.with_least(df, "label", "first_id", "hash", 6, "least")
    assert set(got.columns) == {*df.columns, "least"}
    found = {(r["label"], r["hash"]): r["least"] for r in got.collect()}
    assert len(found) == len(rows) and found == {(a, b): {7: 0, 8: 5, 9: None}[a] for a, b, _ in rows}
    # One long chain and one star, with parts of three rows.
    monkeypatch.setattr(simhash, "SALT_ROWS", 3)
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1080)]
    labels = {r["hash"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    # The smallest node of a component is its label and has no row.
    assert labels == {**{i: 0 for i in range(1, 51)}, **{i: 1000 for i in range(1001, 1080)}}
