"""The index interval of each person: the visit nearest to the index date."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.operators.lookup import is_small
from perindex.sources import schemas

# More days than lie between any two dates of the calendar's years 1 to 9999.
FARTHEST = 10_000_000

_VISIT_COLUMNS = [
    "macrovisit_id",
    "visit_end_date",
    "macrovisit_start_date",
    "macrovisit_end_date",
]


def one_visit_per_day(visits: DataFrame) -> DataFrame:
    """The visit with the smallest id of each person and start date.

    Only that one can win among equally near visits, so a person is cut to at
    most one row per calendar day before anything is shuffled by person.
    """
    return visits.groupBy("person_id", "visit_start_date").agg(
        F.min("visit_occurrence_id").alias("visit_occurrence_id"),
        *[F.min_by(c, "visit_occurrence_id").alias(c) for c in _VISIT_COLUMNS],
    )


def _interval(df: DataFrame) -> DataFrame:
    start = F.coalesce("macrovisit_start_date", "visit_start_date", "covid_index")
    end = F.coalesce("macrovisit_end_date", "visit_end_date", "covid_index")
    return df.withColumn("index_start_date", start).withColumn("index_end_date", end).select(
        *schemas.INDEX_RANGE.fieldNames()
    )


def _closeness() -> Column:
    """Place of a visit among those of its person, smallest first, as one number of fixed width.

    Its digits are the days between start and index date, the visit's id, and the
    index date, which tells repeated persons apart. Undated visits, and then a person
    without any, have more days than dates can lie apart. An aggregation can keep a
    decimal in its buffer, so it hashes; over a struct it would have to sort.
    """
    apart = F.abs(F.datediff("visit_start_date", "covid_index"))
    days = F.when(apart < FARTHEST, apart).when(apart.isNotNull(), FARTHEST - 1)
    none = F.when(F.col("visit_occurrence_id").isNull(), FARTHEST + 1).otherwise(FARTHEST)
    far = F.coalesce(days, none).cast("decimal(8,0)")
    # Ids and dates may be negative, so both are counted from the smallest one.
    number = F.coalesce("visit_occurrence_id", F.lit(0)).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    date = F.coalesce(F.unix_date("covid_index"), F.lit(0)).cast("decimal(11,0)") + F.lit(Decimal(1 << 31))
    visit = far * F.lit(Decimal(1 << 64)) + number
    return (visit.cast("decimal(28,0)") * F.lit(Decimal(1 << 32)) + date).cast("decimal(38,0)")


def index_range(cohort: DataFrame, visits: DataFrame, small: bool | None = None) -> DataFrame:
    """One row per cohort person with ``index_start_date`` and ``index_end_date``.

    The nearest visit wins by days between its start and the index date, then by
    smallest id; visits without a start date come last. Without any visit both
    ends are the index date. A person listed many times has the row nearest to a visit.

    A cohort of counted size is broadcast: each task folds its visits to one row per
    person, and only those rows are shuffled. A larger cohort is joined by person,
    with the visits folded by day before, so no person has more than one per day.
    """
    once = cohort.distinct()  # repeated rows must not multiply with the visits
    if small is None:
        small = is_small(cohort)
    if small:
        listed = F.broadcast(once.withColumnRenamed("person_id", "listed"))
        found = visits.select("person_id", "visit_occurrence_id", "visit_start_date", *_VISIT_COLUMNS)
        found = found.join(listed, F.col("person_id") == F.col("listed")).drop("listed")
        # Each person also has a row without a visit, which loses to any other.
        rows = found.unionByName(cohort, allowMissingColumns=True)
    else:
        rows = once.join(one_visit_per_day(visits), "person_id", "left")
    payload = ["visit_occurrence_id", "visit_start_date", *_VISIT_COLUMNS, *(c for c in cohort.columns if c != "person_id")]
    nearest = rows.withColumn("__order", _closeness()).groupBy("person_id").agg(
        *[F.min_by(c, "__order").alias(c) for c in payload]
    )
    return _interval(nearest)


def index_range_nulls_first(cohort: DataFrame, visits: DataFrame) -> DataFrame:
    """The variant in which visits without a start date outrank every other.

    A person with such visits gets one row for each of them; everyone else gets
    the nearest visit. Kept for comparison, the features use ``index_range``.
    """
    undated = visits.where(F.col("visit_start_date").isNull())
    first = _interval(
        cohort.join(undated.select("person_id", "visit_occurrence_id", "visit_start_date",
                                   *_VISIT_COLUMNS), "person_id")
    )
    rest = cohort.join(undated.select("person_id").distinct(), "person_id", "left_anti")
    dated = visits.where(F.col("visit_start_date").isNotNull())
    return first.unionByName(index_range(rest, dated))


def combine_cohorts(labelled: DataFrame, blinded: DataFrame) -> DataFrame:
    """Training and blinded cohorts in one table; outcomes of the latter are null."""
    return labelled.unionByName(blinded, allowMissingColumns=True)


def index_interval(index: DataFrame) -> DataFrame:
    """The three columns that the period joins need."""
    return index.select("person_id", "index_start_date", "index_end_date")
