"""Ranking metrics: cumulative counts by score, ROC and precision-recall curves.

A running total over every distinct score must not run in one task. The distinct
scores are dealt into ranges of bounded size; the range totals give each range its
offset, and the running total inside a range starts there. Any number of rows takes
this one way; few rows make one range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perindex.session import materialize, materialize_counted

SCORE, LABEL = "predict_prob", "true_label"
# Distinct scores that one task may put in order.
ROWS_PER_BUCKET = 100_000


def labelled(scores: DataFrame) -> DataFrame:
    """Scored rows with a known label, the score as a double.

    A score that is null or not a number is unknown. Infinite scores rank as the
    extremes that they are.
    """
    score = F.col(SCORE).cast("double")
    return scores.withColumn(SCORE, score).where(
        F.col(LABEL).isNotNull() & F.col(SCORE).isNotNull() & ~F.isnan(SCORE)
    )


def by_score(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Positives and negatives of each distinct score; ties become one row."""
    return labelled(scores).groupBy(*by, SCORE).agg(
        F.sum(F.col(LABEL).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(LABEL)).cast("bigint")).alias("neg"),
    )


def ranges(rows: DataFrame, by: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Stored ``rows`` of ``by_score`` with ``bucket``: ranges in the order of group and falling score.

    The number of ranges follows the number of rows. The ranges are stored with the
    rows, so that every reader sees the same ones.
    """
    stored, count = materialize_counted(rows, "distinct_scores")
    buckets = math.ceil(count / rows_per_bucket)
    if buckets < 2:
        return stored.withColumn("bucket", F.lit(0))
    dealt = stored.repartitionByRange(buckets, *by, F.desc(SCORE))
    return materialize(dealt.withColumn("bucket", F.spark_partition_id()), "score_ranges")


def steps(
    scores: DataFrame, by: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Distinct scores with cumulative counts from the highest score down.

    ``tp`` and ``fp`` count the rows scored at least as high; ``positives`` and
    ``negatives`` are the totals of the group. ``next_pos`` and ``next_neg`` are
    the counts of the next lower score. The scores are evaluated once and stored.
    """
    rows = ranges(by_score(scores, by), by, rows_per_bucket)
    totals = rows.groupBy(*by, "bucket").agg(
        F.sum("pos").alias("bucket_pos"),
        F.sum("neg").alias("bucket_neg"),
        F.max_by("pos", SCORE).alias("top_pos"),
        F.max_by("neg", SCORE).alias("top_neg"),
    )
    # One row per group and range, so these windows are short.
    group = Window.partitionBy(*by)
    down = group.orderBy("bucket")
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"of_{c}") for c in (*by, "bucket")],
        F.coalesce(F.sum("bucket_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bucket_neg").over(above), F.lit(0)).alias("neg_above"),
        F.sum("bucket_pos").over(group).alias("positives"),
        F.sum("bucket_neg").over(group).alias("negatives"),
        F.lead("top_pos").over(down).alias("next_top_pos"),
        F.lead("top_neg").over(down).alias("next_top_neg"),
    )
    within = Window.partitionBy(*by, "bucket").orderBy(F.desc(SCORE))
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    # Rows of a group that has no name belong together as well.
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "bucket")]
    joined = rows.join(offsets, same)
    return joined.select(
        *by,
        F.col(SCORE),
        "pos",
        "neg",
        (F.col("pos_above") + F.sum("pos").over(upto)).alias("tp"),
        (F.col("neg_above") + F.sum("neg").over(upto)).alias("fp"),
        "positives",
        "negatives",
        F.coalesce(F.lead("pos").over(within), F.col("next_top_pos")).alias("next_pos"),
        F.coalesce(F.lead("neg").over(within), F.col("next_top_neg")).alias("next_neg"),
    )


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, 0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


# Marks the highest score of a group among its steps.
HIGHEST = "(tp = pos and fp = neg)"


def _points(
    rows: DataFrame, by: tuple[str, ...], point: dict[str, Column], end: tuple[float, float]
) -> DataFrame:
    """One curve point per step, and the end point from the row of the highest score."""
    own = F.struct(F.col(SCORE).alias("threshold"), *[c.alias(n) for n, c in point.items()])
    ends = [F.lit(value).alias(name) for name, value in zip(point, end)]
    extra = F.struct(F.lit(None).cast("double").alias("threshold"), *ends)
    return rows.select(
        *by, F.inline(F.when(F.expr(HIGHEST), F.array(own, extra)).otherwise(F.array(own)))
    )


def precision_recall_curve(
    scores: DataFrame, by: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Precision and recall at every distinct score, and the end point (1, 0)."""
    point = {
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.when(F.col("positives") == 0, 1.0).otherwise(F.col("tp") / F.col("positives")),
    }
    return _points(steps(scores, by, rows_per_bucket), by, point, (1.0, 0.0))


def roc_curve(
    scores: DataFrame,
    by: tuple[str, ...] = (),
    drop_intermediate: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """False and true positive rates by threshold, and the start point (0, 0).

    With ``drop_intermediate`` a point is left out where the counts of its score
    and of the next lower one are equal: it lies on a straight stretch of the
    curve. The first and the last point always stay.
    """
    rows = steps(scores, by, rows_per_bucket)
    if drop_intermediate:
        bends = "pos <> next_pos or neg <> next_neg"
        rows = rows.where(f"{HIGHEST} or next_pos is null or {bends}")
    point = {
        "fpr": F.col("fp") / F.nullif(F.col("negatives"), F.lit(0)),
        "tpr": F.col("tp") / F.nullif(F.col("positives"), F.lit(0)),
    }
    return _points(rows, by, point, (0.0, 0.0))


def area_under_roc() -> Column:
    """Aggregate over ``steps``: each negative counts the positives ranked above it,
    and half of those it ties with. Null with only one class."""
    wins = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    pairs = F.max("positives") * F.max("negatives").cast("double")
    return wins / F.nullif(pairs, F.lit(0).cast("double"))


def average_precision_of() -> Column:
    """Aggregate over ``steps``: precision at each score, weighted by its recall gain."""
    gain = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    return ratio(gain, F.max("positives"))


def auroc(scores: DataFrame, by: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    return steps(scores, by, rows_per_bucket).groupBy(*by).agg(area_under_roc().alias("area_under_roc"))


def average_precision(
    scores: DataFrame, by: tuple[str, ...] = (), rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    return (
        steps(scores, by, rows_per_bucket)
        .groupBy(*by)
        .agg(average_precision_of().alias("average_precision"))
    )
