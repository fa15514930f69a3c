"""Point events: daily pre-aggregation, period assignment and the wide pivot.

A point event is a row ``(person_id, event_date, feature, value)``. Everything
the features need from the events of one day is a total, a count and a minimum,
so ``daily`` folds them first. The shuffle it needs is by person, date and
feature, with partial sums on the map side; only day rows are then shuffled by
person, and no person has more of those than calendar days times features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.functions.columns import sql_list, sql_literal
from perindex.functions.periods import period_of
from perindex.operators.index_range import index_interval


def daily(events: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total, count and minimum of a person's values of a feature on one day.

    ``keys`` are columns to fold by beside them.
    """
    return events.groupBy("person_id", "event_date", "feature", *keys).agg(
        F.sum("value").alias("total"),
        F.count(F.lit(1)).alias("n"),
        F.min("value").alias("low"),
    )


def daily_counts(events: DataFrame) -> DataFrame:
    """Events of a feature per person and day."""
    return events.groupBy("person_id", "event_date", "feature").agg(F.count(F.lit(1)).alias("n"))


def with_period(
    rows: DataFrame, index: DataFrame, how: str = "inner", rule=period_of, date: str = "event_date"
) -> DataFrame:
    """Attach the person's index interval and say in which period each row lies."""
    joined = rows.join(index_interval(index), "person_id", how)
    period = rule(date, "index_start_date", "index_end_date")
    return joined.withColumn("period", period).drop("index_start_date", "index_end_date")


def allowed(periods: dict[str, tuple[str, ...]]) -> str:
    """SQL test that a row's period is one of those its feature counts in."""
    by_periods: dict[tuple[str, ...], list[str]] = {}
    for feature, listed in periods.items():
        by_periods.setdefault(listed, []).append(feature)
    return " or ".join(
        f"(feature in ({sql_list(features)}) and period in ({sql_list(listed)}))"
        for listed, features in by_periods.items()
    )


def wide(rows: DataFrame, keys: list[str], slots: dict[str, str], value: str) -> DataFrame:
    """One row per key and one sum of ``value`` per slot, 0 for a slot without rows.

    The explicit slots make this a single aggregation: no job is needed to find
    the pivot values and no join to bring the periods together.
    """
    return rows.groupBy(*keys).agg(
        *[
            F.expr(f"coalesce(sum({value}) filter (where {test}), 0)").alias(name)
            for name, test in slots.items()
        ]
    )


def cell(feature: str, period: str) -> str:
    return f"feature = {sql_literal(feature)} and period = {sql_literal(period)}"
