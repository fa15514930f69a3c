"""Age and one-hot gender, race and ethnicity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.functions import codes

REFERENCE_YEAR = 2022
# The categories that become columns; other codes become none.
RACE_COLUMNS = (
    "Asian",
    "Black or African American",
    "Native Hawaiian or Other Pacific Islander",
    "White",
)


def code_labels(person: DataFrame) -> DataFrame:
    """Persons with the names of their coded attributes."""
    return person.select(
        "person_id",
        "year_of_birth",
        codes.label("gender_concept_id", codes.GENDERS).alias("gender_concept_name"),
        codes.label("race_concept_id", codes.RACES).alias("race_concept_name"),
        codes.label("ethnicity_concept_id", codes.ETHNICITIES).alias("ethnicity_concept_name"),
    )


def demographics(person: DataFrame, year: int = REFERENCE_YEAR) -> DataFrame:
    """One row per person: age in ``year`` and category counts, nulls as 0."""
    def counts(column: str, names) -> list:
        return [
            F.count(F.when(F.col(column) == n, 1)).alias(n.replace(" ", "_")) for n in names
        ]

    grouped = code_labels(person).groupBy("person_id", "year_of_birth").agg(
        *counts("race_concept_name", RACE_COLUMNS),
        *counts("ethnicity_concept_name", codes.ETHNICITIES.values()),
        *counts("gender_concept_name", codes.GENDERS.values()),
    )
    age = F.coalesce(F.lit(year) - F.col("year_of_birth"), F.lit(0))
    return grouped.withColumn("age", age).drop("year_of_birth")
