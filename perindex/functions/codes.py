"""Labels of coded person attributes and visit types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perindex.functions.columns import map_sql

# Standard concept ids.
GENDERS = {8532: "FEMALE", 8507: "MALE"}
ETHNICITIES = {38003563: "Hispanic or Latino", 38003564: "Not Hispanic or Latino"}
RACES = {
    8515: "Asian",
    8516: "Black or African American",
    8527: "White",
    8552: "Unknown",
    8557: "Native Hawaiian or Other Pacific Islander",
    8657: "American_Indian_or_AL_Native",
}


# What the name of a visit of each type contains.
VISIT_WORDS = {"ed": "Emergency", "ip": "Inpatient", "tele": "Tele"}


def label(column: str, labels: dict[int, str]) -> Column:
    """Name of a code, or the empty string for any other code."""
    return F.expr(f"coalesce({map_sql(column, labels)}, '')")


def visit_types(name: str) -> dict[str, Column]:
    """0/1 flags of a visit name. A visit without a name has no type at all."""
    tests = {f"is_{t}": f"contains({name}, '{word}')" for t, word in VISIT_WORDS.items()}
    tests["is_op"] = "not (" + " or ".join(tests.values()) + ")"
    return {flag: F.expr(f"if({test}, 1, 0)") for flag, test in tests.items()}
