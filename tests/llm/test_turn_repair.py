"""Structure repair against a table of all audits, and against its SQL."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import duckdb
import pytest

from perindex.llm import turn_repair as tr

NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def plain_search(symbols: str) -> tuple[int, str]:
    """Least cost and audit by keeping the best audit of every role sequence's state, row by row."""
    def follows(roles: str) -> str:
        return "u" if roles in ("", "s") or roles.endswith("a") else "a"

    def state(roles: str) -> str:
        return roles if roles in ("", "s") else roles[-1]

    best = {"": (0, "", "")}
    for symbol in [*symbols, None]:
        found: dict[str, tuple[int, str, str]] = {}
        for cost, audit, roles in best.values():
            for inserts in range(3):
                ways = []
                if symbol is None:
                    ways.append((0, "", roles))
                else:
                    ways.append((2, "D", roles))
                    late = 5 if symbol.isupper() else 0
                    if symbol != "d":
                        ways.append((1 + late, "R", roles + follows(roles)))
                        kept = symbol.lower()
                        if kept == follows(roles) or (kept == "s" and roles == ""):
                            ways.append((late, "K", roles + kept))
                for more, letter, after in ways:
                    item = (cost + 5 * inserts + more, audit + "I" * inserts + letter, after)
                    found[state(after)] = min(item, found.get(state(after), item))
                roles += follows(roles)
        best = found
    return min(item[:2] for key, item in best.items() if key in ("", "a"))


def repaired_symbols(symbols: str) -> tuple[int, str]:
    steps = [tr.ROW_STEPS[s] for s in symbols]
    leave, cost = tr.last_state(tr.merged(steps))
    states = tr.crossings(steps, tr.EMPTY, leave)
    audits = [tr.EDITS[s][states[i], states[i + 1]][1] for i, s in enumerate(symbols)]
    return cost, "".join(audits) + tr.TAIL[leave]


def test_all_short_conversations():
    for n in range(5):
        for symbols in itertools.product("dsuaxUA", repeat=n):
            assert repaired_symbols("".join(symbols)) == plain_search("".join(symbols)), symbols


def test_long_random_conversations():
    rnd = random.Random(13)
    for _ in range(150):
        symbols = "".join(rnd.choices(tr.SYMBOLS, weights=rnd.choices(range(1, 9), k=9), k=rnd.randint(5, 120)))
        assert repaired_symbols(symbols) == plain_search(symbols), symbols


def test_merged_runs_act_like_their_rows():
    rnd = random.Random(5)
    for _ in range(60):
        symbols = "".join(rnd.choices(tr.SYMBOLS, k=40))
        cut = rnd.randint(1, 39)
        halves = [tr.part_step(symbols[:cut]), tr.part_step(symbols[cut:])]
        assert tr.merged(halves) == tr.part_step(symbols)
        assert tr.unpacked(tr.packed(halves[0])) == halves[0]
        leave, _ = tr.last_state(tr.merged(halves))
        whole = tr.crossings([tr.ROW_STEPS[s] for s in symbols], tr.EMPTY, leave)
        assert tr.crossings(halves, tr.EMPTY, leave)[1] == whole[cut]


def logs() -> list[tuple]:
    rnd = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    said = ["Hi.", "what", "é!", " \t\n", None, "", "done?  ", "same.", "a\x0b.\x0c", "x" * 500 + "."]
    rows = []
    for conv in range(60):
        for turn in range(rnd.randint(0, 9)):
            number = rnd.choice([turn, turn, turn, turn + 3, None, -turn])
            rows.append((conv, number, rnd.choice(roles[: rnd.choice([3, 7])]), rnd.choice(said), 1))
    rows += [(100, t, ("user", "assistant")[t % 2], f"turn {t}.", 2) for t in range(300)]  # long, hardly a fault
    rows += [(101, 5, "user", "same.", 3)] * 80  # one row again and again
    rows += [(102, None, rnd.choice(roles), rnd.choice(said), 4) for _ in range(90)]  # no turn numbers
    rows += [(None, 1, "user", "No id.", 5), (None, 2, "assistant", "Still.", 5)]
    rows += [(103, t, None, None, 6) for t in range(4)] + [(-5, 2, "user", None, 6)]
    return rows


def expected(rows: list[tuple]) -> Counter:
    duck = duckdb.connect()
    duck.execute('create table conversations (conv_id bigint, turn bigint, role varchar, "text" varchar)')
    if rows:
        duck.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    cursor = duck.execute(tr.ORACLE)
    names = [d[0] for d in cursor.description]
    return Counter(tuple(sorted(zip(names, row, strict=True))) for row in cursor.fetchall())


def table(spark, rows):
    # The columns after the first four clash with names that the operator uses itself.
    made = [(*r[:4], r[4], r[4]) for r in rows]
    return spark.createDataFrame(made, "conv_id long, turn long, role string, text string, place int, part int").repartition(5)


@pytest.mark.parametrize(("part", "fan"), [(9, 12), (2, 1), (3, 2)])
def test_report_equals_sql(spark, monkeypatch, part, fan):
    """Small parts and fan-outs send one conversation over many parts and several levels."""
    monkeypatch.setattr(tr, "PART_BITS", part)
    monkeypatch.setattr(tr, "FAN_BITS", fan)
    got = Counter(tuple(sorted(r.asDict().items())) for r in tr.repair_damaged(table(spark, logs())).collect())
    assert got == expected(logs())


def test_repaired_turns_follow_the_pattern(spark):
    rows = [r[:4] for r in logs() if None not in r[:4]]
    repair = tr.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns: dict[int, list] = {}
    for r in sorted(repair.repaired().collect(), key=lambda r: (r["place"], r["number"])):
        turns.setdefault(r["conv_id"], []).append(r)
    assert turns
    for key, conversation in turns.items():
        roles = [r["role"] for r in conversation]
        body = roles[1:] if roles[0] == "system" else roles
        assert body, key
        assert all(("user", "assistant")[i % 2] == r or r[0] == "ua"[i % 2] for i, r in enumerate(body))
        assert len(body) % 2 == 0
        assert all(r["text"] == "" for r in conversation if r["edit"] == "I")


def test_empty_table(spark):
    assert tr.repair_damaged(table(spark, logs()).limit(0)).count() == 0
    assert expected([]) == Counter()


def test_conversation_without_rows_after_damage(spark):
    gone = [(c, t) for c in range(40) for t in range(40) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:1]
    rows = [(c, t, "user", "Gone.", 1) for c, t in gone]
    (row,) = tr.repair_damaged(table(spark, rows)).collect()
    assert (row["audit"], *(row[n] for n in NUMBERS)) == ("", 0, 0, 0, 0, 0, 0)
    assert Counter([tuple(sorted(row.asDict().items()))]) == expected(rows)
