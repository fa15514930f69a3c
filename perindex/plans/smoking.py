"""Smoking status from observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.operators.concepts import concept_lookup
from perindex.operators.lookup import lookup_join
from perindex.registry import CodeGroup


def smoking_status(
    observation: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """``person_id, smoker = 1`` for everyone with a smoking observation."""
    events = lookup_join(
        observation,
        concept_lookup(concept_sets, group),
        "observation_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "observation_date"),
    )
    return events.select("person_id").distinct().withColumn("smoker", F.lit(1))
