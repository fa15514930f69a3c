"""Top contributing factors of a person's score under a linear model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_factors(df: DataFrame, coefficients: dict[str, float], k: int = 3) -> DataFrame:
    """The ``k`` largest contributions per person, as ``rank, factor, contribution``.

    For a linear model the exact contribution of a feature is its coefficient
    times the distance from its mean. All features of a person sit in one row, so
    ranking is a sort inside that row and needs no shuffle. Ties go by name.
    """
    names = list(coefficients)
    means = df.agg(F.struct(*[F.avg(n).alias(n) for n in names]).alias("m")).scalar()
    parts = [
        F.struct(
            (-(F.lit(float(coefficients[n])) * (F.col(n) - F.col("__means")[n]))).alias("down"),
            F.lit(n).alias("factor"),
        )
        for n in names
    ]
    ranked = F.slice(F.sort_array(F.array(*parts)), 1, k)
    return (
        df.withColumn("__means", means)
        .select("person_id", F.posexplode(ranked).alias("pos", "part"))
        .select(
            "person_id",
            (F.col("pos") + 1).alias("rank"),
            F.col("part.factor").alias("factor"),
            (-F.col("part.down")).alias("contribution"),
        )
    )
