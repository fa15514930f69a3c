"""The feature table: one imputed row per person."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.functions.columns import sql_list
from perindex.functions.periods import period_of, period_or_during
from perindex.operators.concepts import all_small, concept_lookup
from perindex.operators.events import allowed, daily
from perindex.operators.index_range import index_interval, index_range
from perindex.operators.lookup import lookup_join
from perindex.plans import labs, medications, utilization
from perindex.plans.demographics import demographics
from perindex.plans.measurements import measurement_points
from perindex.registry import Registry
from perindex.session import materialize

SMOKER = "smoker"
# Persons whose wide rows one task builds.
PERSONS_PER_TASK = 20_000
EVENT_COLUMNS = (
    R.VITAL_COLUMNS
    + R.LAB_COLUMNS
    + R.SMOKING_COLUMNS
    + R.DIAGNOSIS_COLUMNS
    + R.MEDICATION_COLUMNS
    + R.PROCEDURE_COLUMNS
)


# Tag of the rows that say that a visit has an ICU concept; no feature has such a name.
ICU = "icu visit"


def _points(
    events: DataFrame, code: str, lookup: DataFrame, small: bool, date: str | None = None
) -> DataFrame:
    """Point events and ICU evidence of a table, from one scan and one lookup of its codes.

    Evidence is about a visit whoever has it, so it carries the visit's id and
    neither person nor date.
    """
    rows = lookup_join(
        events, lookup, code, "concept_id", small, spread_by=("person_id", "visit_occurrence_id")
    ).where(f"feature <> '{ICU}' or visit_occurrence_id is not null")
    return rows.selectExpr(
        f"if(feature = '{ICU}', null, person_id) as person_id",
        f"if(feature = '{ICU}', null, {date or 'cast(null as date)'}) as event_date",
        "feature",
        "cast(null as double) as value",
        f"if(feature = '{ICU}', visit_occurrence_id, null) as icu_visit",
    )


def tagged_days(
    tables: dict[str, DataFrame], registry: Registry, small: bool | None = None
) -> DataFrame:
    """All point events folded by day, and the distinct ids of the visits with an ICU concept.

    Every event table is scanned once: a code's lookup row says whether it feeds a
    feature or is ICU evidence. The evidence has the tag ``ICU`` and its visit in
    ``icu_visit``, which is null elsewhere.
    """
    concepts = tables["concept_set_members"]
    if small is None:
        small = all_small(concepts, registry)
    icu = concept_lookup(concepts, registry.icu).select("concept_id").distinct()
    icu = icu.withColumn("feature", F.lit(ICU))

    def with_icu(group) -> DataFrame:
        return concept_lookup(concepts, group).unionByName(icu)

    smokers = concept_lookup(concepts, registry.smoking).withColumn("feature", F.lit(SMOKER))
    elsewhere = F.lit(None).cast("bigint").alias("icu_visit")
    points = [
        measurement_points(tables["measurement"], concepts, registry, small).select("*", elsewhere),
        medications.medication_points(
            tables["drug_exposure"], concepts, registry.medications, small
        ).select("*", elsewhere),
        _points(
            tables["procedure_occurrence"], "procedure_concept_id", with_icu(registry.procedures),
            small, "procedure_date",
        ),
        _points(
            tables["condition_occurrence"], "condition_concept_id", with_icu(registry.diagnoses), small
        ),
        _points(tables["observation"], "observation_concept_id", smokers.unionByName(icu), small),
    ]
    return daily(reduce(DataFrame.unionByName, points), ("icu_visit",))


def event_features(
    tables: dict[str, DataFrame], index: DataFrame, registry: Registry, small: bool | None = None
) -> DataFrame:
    """All event-based features of a person in one pass.

    Every family is a stream of point events, so they are stacked, folded by day,
    joined with the index once and pivoted once, instead of one index join, one
    pivot and one assembly join per family.
    """
    return _pivot(tagged_days(tables, registry, small), index, registry)


def _family(registry: Registry) -> Column:
    """Family of a feature; names are unique across families."""
    listed = {
        "lab": R.LAB_FEATURES,
        "vital": registry.vitals.names,
        "procedure": registry.procedures.names,
        "medication": registry.medications.names,
    }
    tests = " ".join(f"when feature in ({sql_list(v)}) then '{k}'" for k, v in listed.items())
    return F.expr(f"case {tests} else 'ever' end")


def person_parts(index: DataFrame) -> int | None:
    """Parts of the tables by person, by the counted persons of a stored index; none where they are few.

    Shuffled day rows shrink far, and each person of a part becomes a row of the full
    width, so parts cut by shuffled bytes would hold too many persons. Not fewer parts
    than the other shuffles have, or the wide rows would be shuffled to meet those.
    """
    spark, persons = index.sparkSession, index.count()
    if persons <= PERSONS_PER_TASK * spark.sparkContext.defaultParallelism:
        return None
    return max(math.ceil(persons / PERSONS_PER_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def _pivot(days: DataFrame, index: DataFrame, registry: Registry, parts: int | None = None) -> DataFrame:
    """One row per person with a column per slot.

    The days are dealt by person once, before anything else: the index, the sum of a
    slot, the pivot and the assembly all find their rows there. Dealt by slot instead,
    each slot would go on as a row of the pivot's full width.
    """
    interval = ("event_date", "index_start_date", "index_end_date")
    # Smoking status and diagnoses count over the whole record.
    period = (
        F.when(F.col("family") == "lab", period_or_during(*interval))
        .when(F.col("family") == "ever", "ever")
        .otherwise(period_of(*interval))
    )
    rows = (
        days.where(f"feature <> '{ICU}'")
        .repartition(*([parts] if parts else []), "person_id")
        .withColumn("family", _family(registry))
        .join(index_interval(index), "person_id", "left")
        .withColumn("period", period)
        .where(f"period is not null and (family <> 'medication' or {allowed(registry.medications.periods)})")
        .selectExpr(
            "person_id",
            f"""case family when 'lab' then {labs.SLOT}
                when 'procedure' then concat(period, '_', feature)
                when 'ever' then feature
                else concat(feature, '_', period) end as slot""",
            # Smoking is a status: a person's folded row counts once.
            f"""cast(case when family = 'lab' then low when family = 'vital' then total
                when feature = '{SMOKER}' then 1 else n end as double) as amount""",
            "case when family = 'lab' and low is not null then 1 when family = 'vital' then n end as weight",
        )
    )
    # Counts have no weight and stay sums; the others become weighted averages.
    value = F.expr("sum(amount) / coalesce(sum(weight), 1)")
    return rows.groupBy("person_id").pivot("slot", EVENT_COLUMNS).agg(value)


def impute(df: DataFrame) -> DataFrame:
    """Fill missing counts with 0 and missing vitals, labs and smoking with -1."""
    return df.na.fill(dict.fromkeys(R.ZERO_FILLED, 0) | dict.fromkeys(R.MINUS_ONE_FILLED, -1))


def assemble(person: DataFrame, families: list[DataFrame], index: DataFrame) -> DataFrame:
    """Left-join the families to the persons, add the label, keep the contract's columns.

    A family travels through the joins as one struct. Sorts and joins then move a
    single value per row and keep their generated code, which hundreds of separate
    columns would cost them; the columns come back in the last projection.
    """
    found, joined = {}, None
    for i, family in enumerate([person, *families, index.select("person_id", R.LABEL)]):
        names = [c for c in family.columns if c != "person_id"]
        found |= {c: f"__{i}.{c}" for c in names}
        packed = family.select("person_id", F.struct(*names).alias(f"__{i}")) if names else family
        joined = packed if joined is None else joined.join(packed, "person_id", "left")
    typed = [
        f"cast({found.get(c, 'null')} as {'double' if c in R.DOUBLE_COLUMNS else 'bigint'}) as {c}"
        for c in R.FEATURE_COLUMNS
    ]
    return joined.selectExpr("person_id", *typed, f"{found[R.LABEL]} as {R.LABEL}")


def require_one_row_per_person(index: DataFrame) -> None:
    if not index.groupBy("person_id").count().filter("count > 1").isEmpty():
        raise ValueError("the index range holds a person more than once")


def feature_table(
    tables: dict[str, DataFrame],
    registry: Registry,
    index: DataFrame | None = None,
    los_max: int | None = None,
) -> DataFrame:
    """Person, 261 imputed features and the label.

    The index range has three consumers and is stored between; an index that
    already is a stored table can be passed in, with one row per person. The folded events have two, features
    and ICU stays, and are stored as well, so that no event table is scanned twice.
    """
    if index is None:
        index = materialize(index_range(tables["cohort"], tables["visits"]), "index_range")
    else:
        require_one_row_per_person(index)
    days = materialize(tagged_days(tables, registry), "tagged_days")
    icu = days.where(f"feature = '{ICU}'").select(F.col("icu_visit").alias("visit_occurrence_id"))
    families = [
        _pivot(days, index, registry, person_parts(index)),
        utilization.utilization(index, tables["visits"], icu, los_max),
    ]
    person = demographics(tables["person"])
    person = person.withColumn("Asian_Indian", F.lit(0))
    return impute(assemble(person, families, index))
