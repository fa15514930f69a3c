"""Schema-level helpers: renames, missing columns, fills."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def affix(
    df: DataFrame, prefix: str = "", suffix: str = "", keys: tuple[str, ...] = ("person_id",),
    drop: tuple[str, ...] = ("period",),
) -> DataFrame:
    """Rename every column but the keys with a prefix or suffix; drop the period."""
    kept = [c for c in df.columns if c not in drop]
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c + suffix) for c in kept])


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by dictionary and turn spaces into underscores; unknown names are ignored."""
    return df.toDF(*[names.get(c, c).replace(" ", "_") for c in df.columns])


def add_missing(df: DataFrame, columns: list[str], fill: object = 0) -> DataFrame:
    """Append the expected columns that ``df`` lacks, filled with a literal."""
    absent = [c for c in columns if c not in df.columns]
    return df.select("*", *[F.lit(fill).alias(c) for c in absent])


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop the columns whose whole name matches a regular expression."""
    return df.drop(*[c for c in df.columns if re.fullmatch(pattern, c)])


def sql_literal(value: object) -> str:
    """A number or a string as a SQL literal."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def sql_list(values) -> str:
    return ", ".join(sql_literal(v) for v in values)


def map_sql(column: str, mapping: dict) -> str:
    """SQL that looks ``column`` up in a small constant mapping; a missing key gives null."""
    if not mapping:
        return "cast(null as string)"
    pairs = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in mapping.items())
    return f"map({pairs})[{column}]"


def replace_values(df: DataFrame, column: str, mapping: dict[str, str], keep_unmapped: bool = True) -> DataFrame:
    """Replace the values of ``column`` by dictionary, through a hash lookup.

    Values without an entry are kept, or their rows dropped. The dictionary comes
    from the driver as literals, so the broadcast does not grow with the data.
    """
    pairs = df.sparkSession.createDataFrame(
        list(mapping.items()), f"`{column}` string, __to string"
    )
    joined = df.join(F.broadcast(pairs), column, "left" if keep_unmapped else "inner")
    value = F.coalesce("__to", column) if keep_unmapped else F.col("__to")
    return joined.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])
