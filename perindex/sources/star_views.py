"""Clinical-shaped views over the star-schema Parquet tables used for checks.

Nulls, inverted intervals, open visits and odd units are derived from the keys,
so every view grows with the tables it reads.
"""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.functions.columns import sql_list, sql_literal
from perindex.operators.lookup import is_small

# Lines that one task joins with their orders.
LINES_PER_TASK = 1_000_000

# Units spread over the measurements of the demo views.
DEMO_UNITS = (
    None,
    "No matching concept",
    "percent",
    "meter",
    "kilogram",
    "gram per deciliter",
    "femtoliter",
    "million per microliter",
    "trillion per liter",
    "picogram",
    "thousand per microliter",
    "billion per liter",
    "millimole per liter",
    "milligram per deciliter",
    "unit per liter",
    "international unit per liter",
    "inch (US)",
    "Inches",
    "ounce (avoirdupois)",
    "gram",
    "oz",
    "milliliter",
    "pound (US)",
    "centimeter",
)

# Demo code sets: the size of a part is its code set.
DEMO = R.Registry(
    medications=R.CodeGroup(
        features=dict(zip(range(1, 12), R.MEDICATION_PERIODS)), periods=R.MEDICATION_PERIODS
    ),
    vitals=R.CodeGroup(features=dict(zip(range(28, 33), R.VITALS)), units=R.VITAL_UNITS),
    diagnoses=R.CodeGroup(features=dict(zip(range(12, 20), R.DIAGNOSES))),
    procedures=R.CodeGroup(features=dict(zip(range(20, 28), R.PROCEDURES))),
    smoking=R.CodeGroup(features={33: "smoker"}),
    icu=R.CodeGroup(features={34: "icu"}),
    labs=R.CodeGroup(
        features={35: "htwt", 36: "htwt", 37: "cbc", 38: "cmp", 39: "cmp", 40: "immuno"}
    ),
)
# Names given to the measurements of a lab code set, by part key.
DEMO_LAB_NAMES = {
    35: list(R.WEIGHT_NAMES),
    36: list(R.HEIGHT_NAMES),
    37: list(R.CBC_NAMES),
    38: list(R.CMP_NAMES),
    39: list(R.CMP_NAMES),
    40: list(R.IMMUNO_NAMES),
}

_COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint",
    "documents": "doc_id bigint, lang string, n_chars bigint",
    "labels": "doc_id bigint, quality int",
}


class ClinicalViews:
    """The views of one table folder, each built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_COLUMNS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def person(self) -> DataFrame:
        customer, nation = self._table("customer"), self._table("nation")
        joined = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.selectExpr(
            "c_custkey as person_id",
            "1930 + cast(c_custkey % 80 as int) as year_of_birth",
            "case c_custkey % 3 when 0 then 8532 when 1 then 8507 else 0 end as gender_concept_id",
            "case c_mktsegment when 'AUTOMOBILE' then 8515 when 'BUILDING' then 8516 "
            "when 'FURNITURE' then 8527 when 'HOUSEHOLD' then 8557 else 8552 end as race_concept_id",
            "case n_regionkey when 0 then 38003563 when 1 then 38003564 else 0 end "
            "as ethnicity_concept_id",
        )

    @cached_property
    def concept_sets(self) -> DataFrame:
        """A third of the concepts sit in a second code set as well."""
        part = self._table("part")
        first = part.selectExpr(
            "cast(p_size as bigint) as codeset_id",
            "p_partkey as concept_id",
            "p_type as concept_set_name",
            "p_name as concept_name",
        )
        second = part.where("p_partkey % 3 = 0").selectExpr(
            "100 + p_partkey % 7 as codeset_id",
            "p_partkey as concept_id",
            "p_brand as concept_set_name",
            "p_name as concept_name",
        )
        return first.unionByName(second)

    @cached_property
    def visits(self) -> DataFrame:
        return self._table("orders").selectExpr(
            "o_orderkey as visit_occurrence_id",
            "o_custkey as person_id",
            "case when o_orderkey % 97 = 0 then null else cast(o_orderdate as date) end "
            "as visit_start_date",
            "case when o_orderkey % 5 = 0 then null else "
            "date_add(cast(o_orderdate as date), cast(o_orderkey % 12 as int)) end as visit_end_date",
            "case o_orderpriority when '1-URGENT' then 'Emergency Room Visit' "
            "when '2-HIGH' then 'Inpatient Visit' when '3-MEDIUM' then 'Telehealth Visit' "
            "when '4-NOT SPECIFIED' then null else 'Office Visit' end as visit_concept_name",
            "case when o_orderstatus = 'P' then o_orderkey end as macrovisit_id",
            "case when o_orderstatus = 'P' then date_sub(cast(o_orderdate as date), 1) end "
            "as macrovisit_start_date",
            "case when o_orderstatus = 'P' then "
            "date_add(cast(o_orderdate as date), cast(o_orderkey % 15 as int)) end "
            "as macrovisit_end_date",
        )

    @cached_property
    def cohort(self) -> DataFrame:
        return self._table("customer").selectExpr(
            "c_custkey as person_id",
            "date_add(date '1997-01-01', cast(c_custkey * 37 % 900 as int)) as covid_index",
            "case when c_custkey % 5 = 0 then 1 else 0 end as pasc_code_after_four_weeks",
            "case when c_custkey % 50 = 1 then 1 else 0 end as pasc_code_prior_four_weeks",
            "case when c_custkey % 5 = 0 then 28 + cast(c_custkey % 200 as int) end as time_to_pasc",
        )

    @cached_property
    def blinded_cohort(self) -> DataFrame:
        """A second cohort, of other persons, whose outcomes are withheld."""
        return self.cohort.select((F.col("person_id") + 1_000_000_000).alias("person_id"), "covid_index")

    def _second_feed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("person_id", F.col("person_id") + 1_000_000_000)

    @cached_property
    def blinded_visits(self) -> DataFrame:
        return self._second_feed(self.visits)

    @cached_property
    def blinded_conditions(self) -> DataFrame:
        return self._second_feed(self.condition_occurrence)

    @cached_property
    def _line_parts(self) -> int | None:
        """Parts of the join of lines and orders, by their counted rows; none where the orders are few.

        Keys that follow each other shrink so far in a shuffle that parts cut by its
        bytes would hold millions of rows, each sorted in one task.
        """
        if is_small(self._table("orders")):
            return None
        rows = self._table("lineitem").count()
        return max(self.spark.sparkContext.defaultParallelism, math.ceil(rows / LINES_PER_TASK))

    def _lines(self, *columns: str) -> DataFrame:
        """Lines with the customer of their order, and ``columns`` computed of a line alone.

        Those are computed below the join: a filter by code passes renamed columns
        only, and below the join it spares the other lines the shuffle.
        """
        lines = self._table("lineitem").selectExpr("l_orderkey", "l_partkey", "l_linestatus", "l_returnflag", *columns)
        owners = self._table("orders").select("o_orderkey", "o_custkey")
        if self._line_parts:
            lines = lines.repartition(self._line_parts, "l_orderkey")
            owners = owners.repartition(self._line_parts, "o_orderkey")
        return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))

    def _measured_lines(self) -> DataFrame:
        units = ", ".join("null" if u is None else sql_literal(u) for u in DEMO_UNITS)
        return self._lines(
            "cast(l_shipdate as date) as measurement_date",
            "case when l_quantity = 13 then null when l_quantity = 17 then cast(950 as double) "
            "when l_quantity = 19 then cast(-1 as double) else l_quantity end as value_as_number",
            f"array({units})[cast(l_suppkey % {len(DEMO_UNITS)} as int)] as unit_concept_name",
        )

    def _measurements(self, lines: DataFrame) -> DataFrame:
        return lines.selectExpr(
            "o_custkey as person_id",
            "l_orderkey as visit_occurrence_id",
            "measurement_date",
            "l_partkey as measurement_concept_id",
            "value_as_number",
            "unit_concept_name",
            *[c for c in lines.columns if c == "measurement_concept_name"],
        )

    @cached_property
    def measurement(self) -> DataFrame:
        """Measurements without concept names, as the vitals need them."""
        return self._measurements(self._measured_lines())

    @cached_property
    def named_measurement(self) -> DataFrame:
        """Measurements with concept names, as the labs need them."""
        picks = " ".join(
            f"when p_size = {codeset} then "
            f"array({sql_list(names)})[cast(p_partkey % {len(names)} as int)]"
            for codeset, names in DEMO_LAB_NAMES.items()
        )
        name = f"case when p_partkey % 11 = 0 then p_type {picks} end"
        names = self._table("part").selectExpr("p_partkey", f"{name} as measurement_concept_name")
        lines = self._measured_lines().join(names, F.col("l_partkey") == F.col("p_partkey"))
        return self._measurements(lines)

    @cached_property
    def drug_exposure(self) -> DataFrame:
        lines = self._lines("cast(l_shipdate as date) as shipped", "l_suppkey")
        return lines.where("l_linestatus = 'O'").selectExpr(
            "o_custkey as person_id",
            "l_partkey as drug_concept_id",
            "shipped as drug_exposure_start_date",
            "l_suppkey as drug_type_concept_id",
        )

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        return self._lines().where("l_linestatus = 'F'").selectExpr(
            "o_custkey as person_id",
            "l_orderkey as visit_occurrence_id",
            "l_partkey as condition_concept_id",
        )

    @cached_property
    def procedure_occurrence(self) -> DataFrame:
        lines = self._lines("cast(l_shipdate as date) as procedure_date")
        return lines.where("l_returnflag = 'R'").selectExpr(
            "o_custkey as person_id",
            "l_orderkey as visit_occurrence_id",
            "l_partkey as procedure_concept_id",
            "procedure_date",
        )

    @cached_property
    def observation(self) -> DataFrame:
        return self._table("events").selectExpr(
            "user_id as person_id",
            "event_id as visit_occurrence_id",
            "cast(ts as date) as observation_date",
            "event_id % 2000 as observation_concept_id",
        )

    @cached_property
    def scores(self) -> DataFrame:
        labels, documents = self._table("labels"), self._table("documents")
        return labels.join(documents, "doc_id").selectExpr(
            "doc_id as person_id",
            "lang as subgroup",
            "quality as true_label",
            "round(n_chars / (n_chars + cast(1000 as double)), 2) as predict_prob",
        )

    def tables(self) -> dict[str, DataFrame]:
        """The inputs of the feature table, under the names the plans use."""
        return {
            "person": self.person,
            "concept_set_members": self.concept_sets,
            "visits": self.visits,
            "cohort": self.cohort,
            "drug_exposure": self.drug_exposure,
            "measurement": self.named_measurement,
            "observation": self.observation,
            "condition_occurrence": self.condition_occurrence,
            "procedure_occurrence": self.procedure_occurrence,
        }
