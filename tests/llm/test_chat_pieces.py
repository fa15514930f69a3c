"""Chat pieces of conversations whose turns have no numbers, repeat, or repeat whole rows."""

import random

import duckdb

from perindex.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cell string, total string"


def expected(df) -> list[tuple]:
    con = duckdb.connect()
    con.register("conversations", df.toPandas())
    return sorted((int(a), int(b), int(c), int(d), e) for a, b, c, d, e in con.execute(conversations.ORACLE).fetchall())


def rows_of(df) -> list[tuple]:
    return sorted(
        (r["conv_id"], r["piece"], r["n_turns"], r["n_piece_turns"], r["chat"])
        for r in conversations.collapse_and_render(df).collect()
    )


def test_null_and_repeated_numbers_make_bounded_pieces(spark):
    rnd = random.Random(3)
    logs = [(1, None, rnd.choice(["user", "bot"]), f"free {i}") for i in range(300)]
    logs += [(2, 5, "user", "again") for _ in range(210)] + [(2, 5, "user", f"other {i}") for i in range(20)]
    logs += [(3, i // 40, "user", f"t {i}") for i in range(500)]
    logs += [(4, None, None, None), (4, None, None, None), (4, 0, "", ""), (5, -3, "user", "early"), (5, 70, "bot", "late")]
    # Logged again turn by turn: a prefix in numbers, one without numbers, and an equal copy.
    logs += [(10, i, "user", f"s {i}") for i in range(130)] + [(11, i, "user", f"s {i}") for i in range(131)]
    logs += [(12, i, "user", f"s {i}") for i in range(131)] + [(13, None, "user", "again") for _ in range(90)]
    logs += [(14, 0, "user", "again") for _ in range(95)]
    logs = [(*r, "x", None) for r in logs]
    rnd.shuffle(logs)
    df = spark.createDataFrame(logs, SCHEMA).repartition(5)
    got = rows_of(df)
    assert got == expected(df)
    assert max(r[3] for r in got) <= conversations.BLOCK
    assert {10, 13}.isdisjoint(r[0] for r in got) and {1, 2, 3, 4, 5, 11, 12, 14} == {r[0] for r in got}


def test_random_logs_equal_the_statement(spark):
    rnd = random.Random(9)
    logs = [
        (rnd.choice([None, *range(12)]), rnd.choice([None, 0, 1, 2, 64, 65, 200]), rnd.choice(["user", "bot", None]), rnd.choice(["a", "b", None]), "x", "y")
        for _ in range(1500)
    ]
    df = spark.createDataFrame(logs, SCHEMA).repartition(3)
    assert rows_of(df) == expected(df)


def test_an_empty_log_gives_no_pieces(spark):
    assert conversations.collapse_and_render(spark.createDataFrame([], SCHEMA)).collect() == []
