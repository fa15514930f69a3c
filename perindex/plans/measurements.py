"""Vitals and labs from a single pass over the measurements, the largest table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from perindex import registry as R
from perindex.functions.columns import sql_list
from perindex.operators.concepts import concept_lookup
from perindex.operators.lookup import lookup_join
from perindex.plans import labs, vitals
from perindex.registry import Registry


def measurement_points(
    measurement: DataFrame, concept_sets: DataFrame, registry: Registry, small: bool | None = None
) -> DataFrame:
    """Point events of both families: the rows of ``vital_points`` and ``lab_points``.

    One lookup names the lab panel or the vital sign of a concept. A vital sign
    must lie in its plausible range; a lab value goes through names and units.
    """
    signs = registry.vitals.names
    lookup = concept_lookup(concept_sets, registry.labs).unionByName(
        concept_lookup(concept_sets, registry.vitals, distinct=True)
    )
    rows = lookup_join(
        measurement.where("person_id is not null and value_as_number is not null")
        .withColumnRenamed("measurement_date", "event_date"),
        lookup.withColumnRenamed("feature", "panel"),
        "measurement_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "event_date"),
    )
    plausible = rows.where(
        f"panel not in ({sql_list(signs)}) or "
        f"(value_as_number >= {vitals.LOWEST} and value_as_number < {vitals.HIGHEST})"
    )
    standard = labs.standardise(plausible, own_features=tuple(signs))
    return standard.where(f"feature in ({sql_list(signs + R.LAB_FEATURES)})").select(
        "person_id", "event_date", "feature", "value"
    )
