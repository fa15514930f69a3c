"""Visit utilisation: index-visit flags, length of stay, visit counts per period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.functions.codes import VISIT_WORDS, visit_types
from perindex.functions.periods import visit_in_period
from perindex.operators.concepts import concept_lookup
from perindex.operators.index_range import index_interval
from perindex.operators.lookup import is_small, lookup_join
from perindex.registry import PERIODS, CodeGroup

TYPES = ("ed", "ip", "op", "tele")


def coerce_los(df: DataFrame, los_max: int | None) -> DataFrame:
    """Set stays that are negative or longer than ``los_max`` to 0 days.

    Without a limit the stays are left as they are.
    """
    if los_max is None:
        return df
    los = F.col("los")
    return df.withColumn("los", F.when((los > los_max) | (los < 0), 0).otherwise(los))


def stays(visits: DataFrame, los_max: int | None = None) -> DataFrame:
    """Visits with the stay they belong to, its length in days and their type.

    The stay is the macro visit where there is one. A stay that has not ended
    counts 0 days.
    """
    start = F.coalesce("macrovisit_start_date", "visit_start_date")
    end = F.coalesce("macrovisit_end_date", "visit_end_date")
    los = F.when(end.isNotNull(), F.datediff(end, start)).otherwise(0)
    staged = visits.select(
        "person_id",
        "visit_occurrence_id",
        "visit_start_date",
        "visit_end_date",
        "visit_concept_name",
        start.alias("stay_start_date"),
        end.alias("stay_end_date"),
        los.alias("los"),
    )
    return coerce_los(staged, los_max).withColumns(visit_types("visit_concept_name"))


def icu_visits(
    procedures: DataFrame,
    conditions: DataFrame,
    observation: DataFrame,
    concept_sets: DataFrame,
    group: CodeGroup,
    small: bool | None = None,
) -> DataFrame:
    """Distinct ids of the visits with an ICU concept in any of three tables."""
    concepts = concept_lookup(concept_sets, group).select("concept_id").distinct()
    if small is None:
        small = is_small(concepts)  # counted once for all three
    sources = (
        (procedures, "procedure_concept_id"),
        (conditions, "condition_concept_id"),
        (observation, "observation_concept_id"),
    )
    evidence = [
        lookup_join(
            df.select("visit_occurrence_id", code), concepts, code, "concept_id", small,
            spread_by=("visit_occurrence_id",),
        ).select("visit_occurrence_id")
        for df, code in sources
    ]
    ids = reduce(DataFrame.unionByName, evidence)
    return ids.where(F.col("visit_occurrence_id").isNotNull()).distinct()


def flag_icu(visits: DataFrame, icu: DataFrame) -> DataFrame:
    """Visits with ``is_icu``; evidence ids are distinct, so no visit is repeated."""
    marked = icu.withColumn("__icu", F.lit(1))
    joined = visits.join(marked, "visit_occurrence_id", "left")
    return joined.withColumn("is_icu", F.coalesce("__icu", F.lit(0))).drop("__icu")


def _stay_average(rows: DataFrame, name: str) -> DataFrame:
    once = rows.groupBy("person_id", "stay_start_date", "stay_end_date", "los").agg(
        F.count(F.lit(1)).alias("visits")
    )
    return once.groupBy("person_id").agg(F.avg("los").alias(name))


def icu_los(staged: DataFrame, icu: DataFrame) -> DataFrame:
    """Average length of the distinct stays that include an ICU visit."""
    return _stay_average(staged.join(icu, "visit_occurrence_id", "left_semi"), "avg_icu_los")


def los_stats(staged: DataFrame, icu: DataFrame) -> DataFrame:
    """Average length of all distinct stays and of the ICU stays, 0 without any."""
    overall = _stay_average(staged, "avg_los")
    return overall.join(icu_los(staged, icu), "person_id", "left").na.fill(0, ["avg_icu_los"])


def _patterns(staged: DataFrame, *more: Column) -> DataFrame:
    """Visits folded by person, dates and stay; counts and flags add up from here."""
    return staged.groupBy(
        "person_id", "visit_start_date", "visit_end_date", "stay_start_date", "stay_end_date", "los"
    ).agg(
        F.count(F.lit(1)).alias("visits"),
        *[F.sum(f"is_{t}").alias(f"n_{t}") for t in TYPES],
        *[
            F.expr(f"bool_or(not contains(visit_concept_name, '{word}'))").alias(f"not_{t}")
            for t, word in VISIT_WORDS.items()
        ],
        *more,
    )


def _flags() -> list:
    """Index-visit flags over all of a person's visits, whatever their date.

    ``is_index_op`` asks for a visit that is not an emergency, one that is not
    inpatient and one that is not remote; they need not be the same visit.
    """
    tests = {t: f"sum(n_{t}) > 0" for t in VISIT_WORDS}
    tests["op"] = " and ".join(f"bool_or(not_{t})" for t in VISIT_WORDS)
    return [F.expr(f"if({test}, 1, 0)").alias(f"is_index_{t}") for t, test in tests.items()]


def _counts(periods=PERIODS, types=TYPES) -> list:
    return [
        F.expr(f"sum(n_{t}) filter (where in_{p})").alias(f"{p}_{t}_cnt")
        for p in periods
        for t in types
    ]


def _with_periods(df: DataFrame) -> DataFrame:
    """``in_before``, ``in_during`` and ``in_after`` of each visit pattern."""
    tests = visit_in_period(
        "visit_start_date", "visit_end_date", "index_start_date", "index_end_date"
    )
    return df.withColumns({f"in_{period}": test for period, test in tests.items()})


def index_visit_flags(index: DataFrame, staged: DataFrame) -> DataFrame:
    """One row per person of the index range."""
    joined = index_interval(index).join(_patterns(staged), "person_id", "left")
    return joined.groupBy("person_id").agg(*_flags())


def visit_counts(index: DataFrame, staged: DataFrame) -> DataFrame:
    """Visits of each type per period; null where a period had no visit at all."""
    joined = _with_periods(_patterns(staged).join(index_interval(index), "person_id"))
    counted = joined.where("in_before or in_during or in_after")
    return counted.groupBy("person_id").agg(*_counts())


def fill_utilization(df: DataFrame) -> DataFrame:
    """0 for flags and counts, -1 for the lengths of stay."""
    fills = dict.fromkeys(R.INDEX_FLAG_COLUMNS + R.VISIT_COUNT_COLUMNS, 0)
    return df.na.fill(fills | dict.fromkeys(R.LOS_COLUMNS, -1))


def utilization(
    index: DataFrame, visits: DataFrame, icu: DataFrame, los_max: int | None = None
) -> DataFrame:
    """One row per person of the index range with every utilisation feature.

    Everything comes from one pass over the visits: they are flagged by their ICU
    evidence, patterns are joined with the index once, folded to stays, then to
    persons, and the two folds need no further shuffle. ``icu`` has distinct ids.
    """
    staged = flag_icu(stays(visits, los_max), icu)
    patterns = _patterns(staged, F.max("is_icu").alias("is_icu"))
    joined = _with_periods(index_interval(index).join(patterns, "person_id", "left"))
    per_stay = joined.groupBy("person_id", "stay_start_date", "stay_end_date", "los").agg(
        *_counts(types=("ed", "ip", "op")),
        F.sum("visits").alias("visits"),
        *[F.sum(f"n_{t}").alias(f"n_{t}") for t in VISIT_WORDS],
        *[F.bool_or(f"not_{t}").alias(f"not_{t}") for t in VISIT_WORDS],
        F.max("is_icu").alias("is_icu"),
    )
    per_person = per_stay.groupBy("person_id").agg(
        *_flags(),
        F.avg("los").alias("avg_los"),
        F.expr("avg(los) filter (where is_icu = 1)").alias("avg_icu_los"),
        F.sum("visits").alias("visits"),
        *[F.sum(c).alias(c) for c in R.VISIT_COUNT_COLUMNS],
    )
    icu_average = F.when(
        F.col("visits").isNotNull(), F.coalesce("avg_icu_los", F.lit(0).cast("double"))
    )
    return fill_utilization(
        per_person.withColumn("avg_icu_los", icu_average).select("person_id", *R.UTILIZATION_COLUMNS)
    )


def last_visit_name(index: DataFrame, visits: DataFrame) -> DataFrame:
    """Per person of the index range, the visit name that sorts last; null without any.

    The names are folded before the join, so persons bring at most one row each.
    """
    last = visits.groupBy("person_id").agg(F.max("visit_concept_name").alias("visit_concept_name"))
    return index.select("person_id").join(last, "person_id", "left")
