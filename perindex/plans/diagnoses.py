"""Diagnosis counts per person, over the whole record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.operators.concepts import concept_lookup
from perindex.operators.lookup import lookup_join
from perindex.registry import CodeGroup


def diagnosis_events(
    conditions: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """Conditions in one of the code sets, with their feature."""
    return lookup_join(
        conditions,
        concept_lookup(concept_sets, group),
        "condition_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "visit_occurrence_id"),
    )


def diagnosis_counts(
    conditions: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """One row per person with a listed diagnosis, one count per feature.

    The counts combine on the map side, so a hot person sends one row per task.
    """
    events = diagnosis_events(conditions, concept_sets, group, small)
    return events.groupBy("person_id").agg(
        *[F.expr(f"count_if(feature = '{name}')").alias(name) for name in group.names]
    )
