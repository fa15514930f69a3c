"""Concept-set selection: which concept ids feed which feature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.functions.columns import map_sql, sql_list
from perindex.registry import CodeGroup, Registry
from perindex.operators.lookup import is_small


def feature_of(group: CodeGroup) -> Column:
    """Feature of a concept-set row: by set name where listed, else by code set."""
    by_code = map_sql("codeset_id", {k: v for k, v in group.features.items() if v})
    by_name = map_sql("concept_set_name", group.set_names)
    return F.expr(f"coalesce({by_name}, {by_code})" if group.set_names else by_code)


def members_of(concept_sets: DataFrame, codesets: list[int]) -> DataFrame:
    """The members of some code sets; the filter reaches the scan."""
    return concept_sets.where(f"codeset_id in ({sql_list(codesets)})")


def tag_concepts(concept_sets: DataFrame, group: CodeGroup) -> DataFrame:
    """Members of a group with feature, allowed periods and preferred unit.

    One filtered scan and a ``distinct`` stand for a union of one branch per
    feature.
    """
    periods = {f: "_".join(p) for f, p in group.periods.items()}
    return (
        members_of(concept_sets, group.codesets)
        .select(
            "codeset_id", "concept_id", "concept_set_name", "concept_name",
            feature_of(group).alias("feature"),
        )
        .withColumn("temporality", F.expr(map_sql("feature", periods)))
        .withColumn("preferred_unit", F.expr(map_sql("feature", group.units)))
        .distinct()
    )


def concept_lookup(concept_sets: DataFrame, group: CodeGroup, distinct: bool = False) -> DataFrame:
    """``concept_id, feature`` of a group, ready to join with events.

    ``distinct`` removes repeated members, as a union of branches does; without
    it a repeated member counts twice, as in a plain join.
    """
    members = members_of(concept_sets, group.codesets)
    if distinct:
        members = members.select(
            "codeset_id", "concept_id", "concept_set_name", "concept_name"
        ).distinct()
    named = members.select("concept_id", feature_of(group).alias("feature"))
    return named.where("feature is not null") if group.set_names else named


def all_small(concept_sets: DataFrame, registry: Registry) -> bool:
    """One size check that holds for the lookup of every family."""
    return is_small(members_of(concept_sets, registry.codesets()))
