"""Train/test split that depends on the person alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 16


def uniform(key: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) fixed by key and seed, the same on any partitioning."""
    text = F.concat_ws(":", F.col(key) if isinstance(key, str) else key, F.lit(seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def assign_split(df: DataFrame, test_share: float | None, seed: int = SEED) -> DataFrame:
    """Add ``split``: ``test`` for ``test_share`` of the persons, else ``train``.

    Without a share every row goes to ``full``.
    """
    if test_share is None:
        return df.withColumn("split", F.lit("full"))
    if not 0 < test_share < 1:
        raise ValueError("test_share must lie between 0 and 1")
    train = uniform("person_id", seed) < 1 - test_share
    return df.withColumn("split", F.when(train, "train").otherwise("test"))


def random_split(df: DataFrame, test_share: float, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test frames; together they are the input."""
    marked = assign_split(df, test_share, seed)
    return tuple(marked.where(F.col("split") == s).drop("split") for s in ("train", "test"))
