"""Column contracts of the input and output tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES: dict[str, DataType] = {
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "date": DateType(),
}


def table_schema(ddl: str) -> StructType:
    """A schema from ``name type, ...``, without needing a running session."""
    pairs = [column.split() for column in ddl.split(",")]
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


PERSON = table_schema(
    "person_id bigint, year_of_birth int, gender_concept_id bigint, "
    "race_concept_id bigint, ethnicity_concept_id bigint"
)
CONCEPT_SET_MEMBERS = table_schema(
    "codeset_id bigint, concept_id bigint, concept_set_name string, concept_name string"
)
DRUG_EXPOSURE = table_schema(
    "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, "
    "drug_type_concept_id bigint"
)
MEASUREMENT = table_schema(
    "person_id bigint, visit_occurrence_id bigint, measurement_date date, "
    "measurement_concept_id bigint, measurement_concept_name string, value_as_number double, "
    "value_as_concept_id bigint, unit_concept_id bigint, unit_concept_name string, "
    "measurement_source_concept_id bigint, measurement_source_concept_name string, "
    "range_low double, range_high double"
)
OBSERVATION = table_schema(
    "person_id bigint, visit_occurrence_id bigint, observation_date date, "
    "observation_concept_id bigint"
)
CONDITION_OCCURRENCE = table_schema(
    "person_id bigint, visit_occurrence_id bigint, condition_concept_id bigint"
)
PROCEDURE_OCCURRENCE = table_schema(
    "person_id bigint, visit_occurrence_id bigint, procedure_concept_id bigint, "
    "procedure_date date"
)
VISITS = table_schema(
    "visit_occurrence_id bigint, person_id bigint, visit_start_date date, visit_end_date date, "
    "visit_concept_name string, macrovisit_id bigint, macrovisit_start_date date, "
    "macrovisit_end_date date"
)
COHORT = table_schema(
    "person_id bigint, covid_index date, pasc_code_after_four_weeks int, "
    "pasc_code_prior_four_weeks int, time_to_pasc int"
)
INDEX_RANGE = table_schema(
    "person_id bigint, visit_occurrence_id bigint, macrovisit_id bigint, covid_index date, "
    "visit_start_date date, visit_end_date date, macrovisit_start_date date, "
    "macrovisit_end_date date, index_start_date date, index_end_date date, "
    "pasc_code_after_four_weeks int, pasc_code_prior_four_weeks int, time_to_pasc int"
)
PREDICTIONS = table_schema("person_id bigint, predict_prob double")

TABLES = {
    "person": PERSON,
    "concept_set_members": CONCEPT_SET_MEMBERS,
    "drug_exposure": DRUG_EXPOSURE,
    "measurement": MEASUREMENT,
    "observation": OBSERVATION,
    "condition_occurrence": CONDITION_OCCURRENCE,
    "procedure_occurrence": PROCEDURE_OCCURRENCE,
    "visits": VISITS,
    "cohort": COHORT,
    "index_range": INDEX_RANGE,
    "predictions": PREDICTIONS,
}

# Columns without which a table says nothing. The others may be absent and are null then.
KEYS = {
    "person": ["person_id"],
    "concept_set_members": ["concept_id"],
    "drug_exposure": ["person_id", "drug_concept_id", "drug_exposure_start_date"],
    "measurement": ["person_id", "measurement_concept_id", "measurement_date"],
    "observation": ["person_id", "observation_concept_id", "observation_date"],
    "condition_occurrence": ["person_id", "visit_occurrence_id", "condition_concept_id"],
    "procedure_occurrence": ["person_id", "procedure_concept_id", "procedure_date"],
    "visits": ["person_id", "visit_occurrence_id", "visit_start_date"],
    "cohort": ["person_id", "covid_index"],
    "index_range": ["person_id", "index_start_date", "index_end_date"],
    "predictions": ["person_id"],
}


def keys_of(schema: StructType) -> list[str]:
    """The key columns of a contract."""
    return next((KEYS[name] for name, known in TABLES.items() if known == schema), [])
