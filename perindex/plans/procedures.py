"""Procedure counts before, during and after the index interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.operators.concepts import concept_lookup
from perindex.operators.events import cell, daily_counts, wide, with_period
from perindex.operators.lookup import lookup_join
from perindex.registry import PERIODS, CodeGroup


def procedure_events(
    procedures: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """Procedures in one of the code sets, with their feature."""
    return lookup_join(
        procedures.withColumnRenamed("procedure_date", "event_date"),
        concept_lookup(concept_sets, group),
        "procedure_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "event_date"),
    )


def procedure_points(*args, **kwargs) -> DataFrame:
    """Procedure events as point events; a count needs no value."""
    return procedure_events(*args, **kwargs).select(
        "person_id", "event_date", "feature", F.lit(None).cast("double").alias("value")
    )


def _days(procedures, concept_sets, index, group, small) -> DataFrame:
    days = daily_counts(procedure_events(procedures, concept_sets, group, small))
    return with_period(days, index).where(F.col("period").isNotNull())


def procedure_counts(
    procedures: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """One row per person and period, one count per procedure."""
    days = _days(procedures, concept_sets, index, group, small)
    slots = {f: f"feature = '{f}'" for f in group.names}
    return wide(days, ["person_id", "period"], slots, "n")


def procedures_wide(
    procedures: DataFrame,
    concept_sets: DataFrame,
    index: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Wide form: ``<period>_<procedure>`` counts, 0 where there were none."""
    days = _days(procedures, concept_sets, index, group, small)
    slots = {f"{p}_{f}": cell(f, p) for p in PERIODS for f in group.names}
    return wide(days, ["person_id"], slots, "n")
