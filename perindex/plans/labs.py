"""Lab values: name and unit harmonisation, daily pick, averages per period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.functions.columns import sql_list
from perindex.functions.periods import period_or_during
from perindex.operators.concepts import concept_lookup
from perindex.operators.events import daily, with_period
from perindex.operators.lookup import lookup_join
from perindex.registry import CodeGroup


def curate(
    measurement: DataFrame, concept_sets: DataFrame, group: CodeGroup, small: bool | None = None
) -> DataFrame:
    """Measurements of a lab panel that have a person and a value."""
    present = measurement.where(
        F.col("person_id").isNotNull() & F.col("value_as_number").isNotNull()
    )
    return lookup_join(
        present.withColumnRenamed("measurement_date", "event_date"),
        concept_lookup(concept_sets, group).withColumnRenamed("feature", "panel"),
        "measurement_concept_id",
        "concept_id",
        small,
        spread_by=("person_id", "event_date"),
    )


def name_table(spark: SparkSession, as_written: bool = False) -> DataFrame:
    """The lab dictionary as a frame of constant size."""
    return spark.createDataFrame(
        R.lab_names(as_written), "panel string, measurement_concept_name string, feature string"
    )


def unit_table(spark: SparkSession) -> DataFrame:
    """The unit rules as a frame of constant size."""
    return spark.createDataFrame(
        R.unit_rules(), "rule_feature string, rule_unit string, factor double, to_unit string"
    )


def standardise(
    curated: DataFrame, as_written: bool = False, own_features: tuple[str, ...] = ()
) -> DataFrame:
    """Feature name, and the value and unit after the unit rules.

    Both tables are literals of the driver, so their broadcast is bounded. Names
    without an entry are dropped. A value whose unit is not accepted is null.
    Panels in ``own_features`` are features already and need no name.
    """
    spark = curated.sparkSession
    names = F.broadcast(name_table(spark, as_written))
    on = ["panel", "measurement_concept_name"]
    if own_features:
        own = f"if(panel in ({sql_list(own_features)}), panel, feature)"
        named = (
            curated.join(names, on, "left")
            .withColumn("feature", F.expr(own))
            .where("feature is not null")
        )
    else:
        named = curated.join(names, on)
    rules = F.broadcast(unit_table(spark))
    matches = (F.col("feature") == F.col("rule_feature")) & F.col("unit_concept_name").eqNullSafe(
        F.col("rule_unit")
    )
    known = F.col("rule_feature").isNotNull()
    strict = F.expr(f"feature in ({sql_list(R.STRICT_FEATURES)})")
    raw = F.col("value_as_number")
    value = F.when(known, raw * F.col("factor")).when(~strict, raw)
    unit = F.when(known, F.col("to_unit")).otherwise(F.col("unit_concept_name"))
    return named.join(rules, matches, "left").select(
        "person_id",
        "event_date",
        "panel",
        "feature",
        value.alias("value"),
        unit.alias("unit"),
        "value_as_number",
        "unit_concept_name",
    )


def pick(standard: DataFrame) -> DataFrame:
    """One raw and one standardised (value, unit) per person, day and feature.

    The smallest accepted value wins; rejected ones come last, then raw value and
    unit decide, so the choice does not depend on row order.
    """
    order = F.struct(
        F.col("value").isNull(),
        F.col("value"),
        F.col("value_as_number"),
        F.col("unit_concept_name").isNull(),
        F.col("unit_concept_name").alias("raw_unit"),
        F.col("unit").alias("unit"),
    )
    picked = standard.groupBy("person_id", "event_date", "panel", "feature").agg(
        F.min(order).alias("p")
    )
    return picked.select(
        "person_id",
        "event_date",
        "panel",
        "feature",
        F.col("p.value_as_number").alias("raw_value"),
        F.col("p.raw_unit").alias("raw_unit"),
        F.col("p.value").alias("value"),
        F.col("p.unit").alias("unit"),
    )


def panel_by_day(standard: DataFrame, panel: str, features: list[str]) -> DataFrame:
    """A panel as one row per person and day: ``<feature>_value`` and ``_unit``."""
    rows = pick(standard.where(F.col("panel") == panel))
    cells = []
    for feature in features:
        here = f"filter (where feature = '{feature}')"
        cells.append(F.expr(f"max(value) {here}").alias(f"{feature}_value"))
        cells.append(F.expr(f"max(unit) {here}").alias(f"{feature}_unit"))
    return rows.groupBy("person_id", "event_date").agg(*cells)


def merge_panels(htwt: DataFrame, cmp: DataFrame, cbc: DataFrame) -> DataFrame:
    """Outer join of the three panels by person and day, keyed on the first.

    Days without a height or weight keep one row per remaining panel. Written as
    left joins plus the unmatched days of each panel: a chain of full outer joins
    would send all those days, whose first key is null, to a single task.
    """
    keys = ["person_id", "event_date"]
    matched = htwt.join(cmp, keys, "left").join(cbc, keys, "left")
    for panel in (cmp, cbc):
        alone = panel.join(htwt.select(*keys), keys, "left_anti")
        matched = matched.unionByName(alone, allowMissingColumns=True)
    return matched


def immunoassay_by_day(standard: DataFrame) -> DataFrame:
    """Immunoassay values, one row per person and day. Units play no part."""
    rows = standard.where(F.col("panel") == "immuno")
    return rows.groupBy("person_id", "event_date").agg(
        *[
            F.expr(f"min(value) filter (where feature = '{f}')").alias(f)
            for f in R.IMMUNO_FEATURES
        ]
    )


def lab_points(standard: DataFrame) -> DataFrame:
    """Standardised values as point events, for the features of the contract.

    The daily minimum of these is what ``pick`` chooses, as a plain number.
    """
    return standard.where(f"feature in ({sql_list(R.LAB_FEATURES)})").select(
        "person_id", "event_date", "feature", "value"
    )


def _days(standard: DataFrame, index: DataFrame) -> DataFrame:
    days = daily(lab_points(standard)).select("person_id", "event_date", "feature", "low")
    return with_period(days, index, how="left", rule=period_or_during)


def lab_means(standard: DataFrame, index: DataFrame) -> DataFrame:
    """Long form: mean of the daily values per person, period and feature."""
    return _days(standard, index).groupBy("person_id", "period", "feature").agg(
        F.avg("low").alias("value")
    )


SLOT = "concat(period, '_', feature, '_value')"


def labs(standard: DataFrame, index: DataFrame) -> DataFrame:
    """Wide form: ``<period>_<feature>_value`` means, null where there were none.

    180 conditional averages would cost 180 tests per row and lose code
    generation; the pivot with listed slots finds each row's cell by hashing.
    """
    rows = _days(standard, index).withColumn("slot", F.expr(SLOT))
    return rows.groupBy("person_id").pivot("slot", R.LAB_COLUMNS).agg(F.avg("low"))
