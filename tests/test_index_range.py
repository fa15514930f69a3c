from __future__ import annotations

from conftest import by_key, day

from perindex.operators.index_range import (
    combine_cohorts,
    index_range,
    index_range_nulls_first,
    one_visit_per_day,
)
from perindex.sources import schemas


def visit(person, number, start, end=None, macro=None):
    row = dict(
        person_id=person, visit_occurrence_id=number, visit_start_date=day(start),
        visit_end_date=day(end),
    )
    if macro:
        row |= dict(
            macrovisit_id=number * 10, macrovisit_start_date=day(macro[0]),
            macrovisit_end_date=day(macro[1]),
        )
    return row


def setup(table):
    cohort = table(
        "cohort",
        *[
            dict(person_id=p, covid_index=day("2020-06-15"), pasc_code_after_four_weeks=p % 2)
            for p in (1, 2, 3, 4, 5, 6, 7)
        ],
    )
    visits = table(
        "visits",
        # 1 has no visit. 2: one undated visit and dated ones.
        visit(2, 20, None, "2020-06-20"),
        visit(2, 21, "2020-06-14", "2020-06-18"),
        visit(2, 22, "2020-06-01"),
        # 3: two undated visits.
        visit(3, 30, None, "2020-06-16"),
        visit(3, 31, None),
        # 4: two visits equally near, the later one with the smaller id.
        visit(4, 41, "2020-06-13", "2020-06-13"),
        visit(4, 40, "2020-06-17", "2020-06-19"),
        # 5: the visit has no end and starts after the index date.
        visit(5, 50, "2020-06-18"),
        # 6: the macro visit wins over the visit's own dates.
        visit(6, 60, "2020-06-16", "2020-06-16", ("2020-06-10", "2020-06-25")),
        # 7: two visits on one day.
        visit(7, 71, "2020-06-15", "2020-06-30"),
        visit(7, 70, "2020-06-15", "2020-06-16"),
        # Not in the cohort.
        visit(8, 80, "2020-06-15"),
    )
    return cohort, visits


def test_one_row_per_person(table):
    cohort, visits = setup(table)
    found = index_range(cohort, visits)
    assert found.columns == schemas.INDEX_RANGE.names
    rows = by_key(found, "person_id")
    assert sorted(rows) == [1, 2, 3, 4, 5, 6, 7] and found.count() == 7
    interval = {p: (r["index_start_date"], r["index_end_date"]) for p, r in rows.items()}
    index = day("2020-06-15")
    assert interval[1] == (index, index) and rows[1]["visit_occurrence_id"] is None
    assert rows[2]["visit_occurrence_id"] == 21
    assert interval[3] == (index, day("2020-06-16")) and rows[3]["visit_occurrence_id"] == 30
    assert rows[4]["visit_occurrence_id"] == 40
    assert interval[5] == (day("2020-06-18"), index)
    assert interval[6] == (day("2020-06-10"), day("2020-06-25"))
    assert rows[7]["visit_occurrence_id"] == 70
    assert rows[3]["pasc_code_after_four_weeks"] == 1


def test_undated_visits_outrank_in_the_variant(table):
    cohort, visits = setup(table)
    rows = index_range_nulls_first(cohort, visits).collect()
    picked = sorted((r.person_id, r.visit_occurrence_id or 0) for r in rows)
    assert picked == [(1, 0), (2, 20), (3, 30), (3, 31), (4, 40), (5, 50), (6, 60), (7, 70)]


def test_a_hot_person_is_cut_to_one_row_per_day(spark, table):
    cohort, _ = setup(table)
    visits = spark.range(30_000).selectExpr(
        "id as visit_occurrence_id",
        "if(id % 3 = 0, 1, id) as person_id",
        "date_add(date '2020-01-01', cast(id % 50 as int)) as visit_start_date",
        "cast(null as date) as visit_end_date",
        "cast(null as bigint) as macrovisit_id",
        "cast(null as date) as macrovisit_start_date",
        "cast(null as date) as macrovisit_end_date",
    )
    assert one_visit_per_day(visits).where("person_id = 1").count() == 50
    row = by_key(index_range(cohort, visits), "person_id")[1]
    assert (row["visit_occurrence_id"], row["visit_start_date"]) == (99, day("2020-02-19"))


def test_cohorts_combine_with_null_outcomes(spark, table):
    cohort, _ = setup(table)
    blinded = cohort.selectExpr("person_id + 100 as person_id", "covid_index")
    rows = by_key(combine_cohorts(cohort, blinded), "person_id")
    assert len(rows) == 14 and rows[101]["pasc_code_after_four_weeks"] is None


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_both_sizes_of_cohort_agree(table):
    cohort, visits = setup(table)
    cohort = cohort.unionByName(cohort).unionByName(cohort.where("person_id = 4"))
    small, large = (index_range(cohort, visits, small=s) for s in (True, False))
    rows = [sorted(tuple(r) for r in df.collect()) for df in (small, large)]
    assert rows[0] == rows[1] and len(rows[0]) == 7
    for df in (small, large):
        assert "SortAggregate" not in plan_of(df)
        assert "HashAggregate" in plan_of(df)


def test_visits_of_a_small_cohort_are_shuffled_once(table):
    cohort, visits = setup(table)
    # One exchange folds the cohort, one the visits; the join needs none.
    assert plan_of(index_range(cohort, visits, small=True)).count("Exchange hashpartitioning") == 2


def test_extreme_ids_and_dates(table):
    cohort = table(
        "cohort",
        dict(person_id=1, covid_index=day("2020-06-15")), dict(person_id=1, covid_index=day("0001-01-01")),
        dict(person_id=2, covid_index=None), dict(person_id=3, covid_index=day("9999-12-31")),
        dict(person_id=4, covid_index=day("2020-06-15")),
    )
    visits = table(
        "visits",
        visit(1, (1 << 63) - 1, "2020-06-14"), visit(1, -(1 << 63), "2020-06-16"), visit(1, 5, "9999-12-31"),
        visit(2, 9, "2020-01-02"), visit(2, 8, "2020-01-05"),
        visit(3, 1, "0001-01-01"), visit(3, 2, None),
        visit(4, (1 << 63) - 1, None, "2020-07-01"),
    )
    for small in (True, False):
        found = by_key(index_range(cohort, visits, small=small), "person_id")
        # Equally near: the smaller id, which is negative.
        assert found[1]["index_start_date"] == day("2020-06-16")
        # Without an index date the smallest id wins.
        assert found[2]["index_start_date"] == day("2020-01-05")
        assert found[3]["index_start_date"] == day("0001-01-01")
        # An undated visit is still a visit: it gives the end.
        assert (found[4]["index_start_date"], found[4]["index_end_date"]) == (day("2020-06-15"), day("2020-07-01"))
