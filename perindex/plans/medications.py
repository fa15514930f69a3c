"""Medication counts in the periods each medication is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.operators.concepts import concept_lookup
from perindex.operators.events import allowed, cell, daily_counts, wide, with_period
from perindex.operators.lookup import lookup_join
from perindex.registry import CodeGroup


def medication_events(
    drug_exposure: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """Drug exposures in one of the code sets, with their feature."""
    return lookup_join(
        drug_exposure.withColumnRenamed("drug_exposure_start_date", "event_date"),
        concept_lookup(concept_sets, group, distinct=True),
        "drug_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "event_date"),
    )


def medication_points(*args, **kwargs) -> DataFrame:
    """Medication events as point events; a count needs no value."""
    return medication_events(*args, **kwargs).select(
        "person_id", "event_date", "feature", F.lit(None).cast("double").alias("value")
    )


def _days(drug_exposure, concept_sets, index, group, small) -> DataFrame:
    days = daily_counts(medication_events(drug_exposure, concept_sets, group, small))
    return with_period(days, index).where(allowed(group.periods))


def medication_counts(
    drug_exposure: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Long form: exposures per person, period and medication."""
    days = _days(drug_exposure, concept_sets, index, group, small)
    return days.groupBy("person_id", "period", "feature").agg(F.sum("n").alias("med_count"))


def medications(
    drug_exposure: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Wide form: ``<medication>_<period>`` counts, 0 where there were none."""
    slots = {f"{f}_{p}": cell(f, p) for f, periods in group.periods.items() for p in periods}
    days = _days(drug_exposure, concept_sets, index, group, small)
    return wide(days, ["person_id"], slots, "n")
