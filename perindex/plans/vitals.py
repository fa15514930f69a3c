"""Vital signs: averages before, during and after the index interval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perindex.operators.concepts import concept_lookup
from perindex.operators.events import cell, daily, with_period
from perindex.operators.lookup import lookup_join
from perindex.registry import PERIODS, CodeGroup

# Plausible range of a vital sign, upper end excluded.
LOWEST, HIGHEST = 0, 900


def vital_events(
    measurement: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """Measurements of a vital sign whose value is present and plausible."""
    value = F.col("value_as_number")
    valid = measurement.where(value.isNotNull() & (value >= LOWEST) & (value < HIGHEST))
    return lookup_join(
        valid.withColumnRenamed("measurement_date", "event_date"),
        concept_lookup(concept_sets, group, distinct=True),
        "measurement_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "event_date"),
    )


def vital_points(*args, **kwargs) -> DataFrame:
    return vital_events(*args, **kwargs).select(
        "person_id", "event_date", "feature", F.col("value_as_number").alias("value")
    )


def vital_stats(
    measurement: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Long form: average, sample deviation and count per person, period and sign.

    Days carry count, mean and squared deviation from their own mean. The final
    deviation adds the days' own to that of the day means around the period mean,
    which stays accurate where a difference of large sums would not.
    """
    points = vital_points(measurement, concept_sets, group, small)
    days = points.groupBy("person_id", "event_date", "feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("spread"),
    )
    keys = ["person_id", "feature", "period"]
    group_rows = Window.partitionBy(*keys)
    total = F.sum("n").over(group_rows)
    rows = with_period(days, index, how="left").withColumn(
        "group_mean", F.sum(F.col("n") * F.col("mean")).over(group_rows) / total
    )
    count = F.sum("n")
    apart = F.col("mean") - F.col("group_mean")
    squares = F.sum(F.col("spread") + F.col("n") * apart * apart)
    return rows.groupBy(*keys).agg(
        F.max("group_mean").alias("vital_avg"),
        F.when(count > 1, F.sqrt(squares / (count - 1))).alias("vital_stddev"),
        count.alias("vital_count"),
    )


def vitals(
    measurement: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Wide form: ``<sign>_<period>`` averages, null where there were none."""
    days = daily(vital_points(measurement, concept_sets, group, small))
    rows = with_period(days, index).where(F.col("period").isNotNull())
    averages = []
    for feature in group.names:
        for period in PERIODS:
            test = f"filter (where {cell(feature, period)})"
            average = f"sum(total) {test} / sum(n) {test}"
            averages.append(F.expr(average).alias(f"{feature}_{period}"))
    return rows.groupBy("person_id").agg(*averages)
