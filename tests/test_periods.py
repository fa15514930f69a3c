from __future__ import annotations

from conftest import day

from perindex.functions.periods import period_of, period_or_during, visit_in_period

INTERVAL = "date '2020-03-05' as s, date '2020-03-10' as e"
INVERTED = "date '2020-03-10' as s, date '2020-03-05' as e"
MISSING = "cast(null as date) as s, cast(null as date) as e"


def periods(spark, interval, rule, dates):
    df = spark.createDataFrame([(i, day(d)) for i, d in enumerate(dates)], "i int, d date")
    rows = df.selectExpr("i", "d", *interval.split(", ")).select("i", rule("d", "s", "e").alias("p"))
    return [r.p for r in sorted(rows.collect())]


DATES = ["2020-03-04", "2020-03-05", "2020-03-07", "2020-03-10", "2020-03-11", None]


def test_point_rule(spark):
    assert periods(spark, INTERVAL, period_of, DATES) == [
        "before", "during", "during", "during", "after", None,
    ]
    assert periods(spark, INVERTED, period_of, DATES) == [
        "before", "before", "before", "after", "after", None,
    ]
    assert periods(spark, MISSING, period_of, DATES) == [None] * 6


def test_lab_rule(spark):
    assert periods(spark, INTERVAL, period_or_during, DATES) == [
        "before", "during", "during", "during", "after", "during",
    ]
    assert periods(spark, INVERTED, period_or_during, DATES) == [
        "before", "before", "after", "after", "after", "during",
    ]
    assert periods(spark, MISSING, period_or_during, DATES) == ["during"] * 6


def test_visit_rule(spark):
    spans = [
        ("2020-03-01", "2020-03-04"),
        ("2020-03-01", None),
        ("2020-03-04", "2020-03-06"),
        ("2020-03-05", "2020-03-10"),
        ("2020-03-06", None),
        ("2020-03-09", "2020-03-12"),
        ("2020-03-11", None),
        (None, "2020-03-01"),
        (None, None),
    ]
    df = spark.createDataFrame(
        [(i, day(a), day(b)) for i, (a, b) in enumerate(spans)], "i int, a date, b date"
    ).selectExpr("*", *INTERVAL.split(", "))
    tests = visit_in_period("a", "b", "s", "e")
    rows = sorted(df.select("i", *[t.alias(p) for p, t in tests.items()]).collect())
    found = [[p for p in ("before", "during", "after") if r[p]] for r in rows]
    assert found == [
        ["before"], ["before"], [], ["during"], ["during"], [], ["after"], ["before"], [],
    ]
