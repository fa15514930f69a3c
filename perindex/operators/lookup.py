"""Joining a large event table with a dimension that is usually, not always, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perindex.session import materialize

# A lookup row is an id or two and a short label, so this is some 100 MB at most.
BROADCAST_ROWS = 1_000_000
# A code is hot if it has more events than this, and more than one event in HOT_SHARE:
# fewer than HOT_SHARE codes can be.
TASK_ROWS = 1_000_000
HOT_SHARE = 1000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Count ``df`` and compare. The count is distributed and reads no column."""
    return df.count() <= max_rows


def hot_keys(df: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """``hot_key, salts``: the keys with too many rows for one task, and the tasks they need.

    The counts combine on the map side and read one column. Below ``HOT_SHARE``
    rows by definition, so the result can be broadcast whatever the size of ``df``.
    """
    counts = materialize(df.groupBy(F.col(key).alias("hot_key")).agg(F.count(F.lit(1)).alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = max(task_rows, total // HOT_SHARE)
    return counts.where(F.col("hot_key").isNotNull() & (F.col("n") > most)).select(
        "hot_key", F.ceil(F.col("n") / most).cast("int").alias("salts")
    )


def salted_sides(
    events: DataFrame, lookup: DataFrame, event_key: str, lookup_key: str, spread_by: tuple[str, ...],
    task_rows: int = TASK_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: hot codes have as many as their count asks for, all others one.

    The lookup is repeated for the hot codes alone.
    """
    hot = F.broadcast(hot_keys(events, event_key, task_rows))
    salts = F.coalesce("salts", F.lit(1))
    left = events.join(hot, F.col(event_key) == F.col("hot_key"), "left")
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("hot_key", "salts")
    right = lookup.join(hot, F.col(lookup_key) == F.col("hot_key"), "left")
    right = right.withColumn("__lookup_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("hot_key", "salts")
    return left, right


def lookup_join(
    events: DataFrame,
    lookup: DataFrame,
    event_key: str,
    lookup_key: str,
    small: bool | None = None,
    spread_by: tuple[str, ...] = ("person_id",),
    how: str = "inner",
) -> DataFrame:
    """Join events with a lookup on one key each; the lookup's key is dropped.

    A lookup of counted size is broadcast, so the events do not move and a hot
    code costs nothing. An inner join first keeps the events that have a code of the
    lookup: that filter goes below the joins that ``events`` is made of, so events
    without one are not shuffled there. Above the bound the events are shuffled by code, and by a
    salt where the counted events of a code are too many for one task: a code that
    holds a third of the events spreads over tasks in proportion, and no other
    code's lookup rows are repeated.
    """
    if small is None:
        small = is_small(lookup)
    if small:
        on = F.col(event_key) == F.col(lookup_key)
        if how == "inner":
            events = events.join(F.broadcast(lookup.select(lookup_key)), on, "left_semi")
        return events.join(F.broadcast(lookup), on, how).drop(lookup_key)
    salted, repeated = salted_sides(events, lookup, event_key, lookup_key, spread_by)
    on = (F.col(event_key) == F.col(lookup_key)) & (F.col("__salt") == F.col("__lookup_salt"))
    return salted.join(repeated, on, how).drop(lookup_key, "__salt", "__lookup_salt")
