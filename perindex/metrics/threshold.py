"""Metrics at a threshold, calibration, score distribution, and the metric set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex.metrics.curves import (
    LABEL,
    ROWS_PER_BUCKET,
    SCORE,
    area_under_roc,
    average_precision_of,
    labelled,
    ratio,
    steps,
)

BINS = 10


def predicted(threshold: float) -> Column:
    """1 above the threshold, 0 on it and below."""
    return F.when(F.col(SCORE) > threshold, 1).otherwise(0)


def with_predictions(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("pred_label", predicted(threshold))


def _cells(threshold: float) -> dict[str, Column]:
    truth, guess = F.col(LABEL), predicted(threshold)
    return {
        name: F.sum(F.when((truth == t) & (guess == g), 1).otherwise(0))
        for name, t, g in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))
    }


def confusion(scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """``tp, fp, fn, tn`` in one row per group."""
    cells = [c.alias(n) for n, c in _cells(threshold).items()]
    return labelled(scores).groupBy(*by).agg(*cells)


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    }


def precision_recall_f1(
    scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ()
) -> DataFrame:
    """Precision, recall and F1 of the positive class; 0 where undefined."""
    values = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return confusion(scores, threshold, by).select(*by, *[c.alias(n) for n, c in values.items()])


def class_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, and their averages.

    ``accuracy`` carries its value in all three columns. The one row of counts is
    unpivoted; nothing is shuffled after it.
    """
    counts = confusion(scores, threshold)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one, zero = _prf(tp, fp, fn), _prf(tn, fn, fp)
    n1, n0 = tp + fn, tn + fp
    names = ("precision", "recall", "f1_score")
    rows = {
        "0": {m: zero[m] for m in names} | {"support": n0},
        "1": {m: one[m] for m in names} | {"support": n1},
        "accuracy": {m: ratio(tp + tn, n1 + n0) for m in names} | {"support": n1 + n0},
        "macro avg": {m: (zero[m] + one[m]) / 2 for m in names} | {"support": n1 + n0},
        "weighted avg": {m: ratio(zero[m] * n0 + one[m] * n1, n1 + n0) for m in names}
        | {"support": n1 + n0},
    }
    entries = F.array(
        *[
            F.struct(F.lit(label).alias("class"), *[c.alias(n) for n, c in row.items()])
            for label, row in rows.items()
        ]
    )
    return counts.select(F.inline(entries))


def bin_edges(bins: int = BINS) -> list[float]:
    """Inner edges of equal bins on [0, 1], as the doubles a linear grid gives."""
    return [i * (1.0 / bins) for i in range(1, bins)]


def _bin(closed_left: bool, bins: int) -> Column:
    """Bin number as the count of inner edges passed.

    Edges are literals: multiplying a score by the number of bins would put some
    edge scores into the wrong bin.
    """
    score = F.col(SCORE)
    passed = [
        F.when(score >= e if closed_left else score > e, 1).otherwise(0) for e in bin_edges(bins)
    ]
    return sum(passed[1:], passed[0])


def calibration_curve(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """Mean score and share of positives per bin; a score on an edge belongs below it.
    Empty bins are absent."""
    binned = labelled(scores).withColumn("bin", _bin(False, bins))
    return binned.groupBy("bin").agg(
        F.avg(SCORE).alias("prob_pred"),
        F.avg(LABEL).alias("prob_true"),
        F.count(F.lit(1)).alias("n"),
    )


def brier_score(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    error = F.col(SCORE) - F.col(LABEL)
    return labelled(scores).groupBy(*by).agg(F.avg(error * error).alias("brier_score"))


def score_histogram(scores: DataFrame, bins: int = BINS) -> DataFrame:
    """Scores per bin on [0, 1]; a score on an edge belongs above it, 1 to the last bin."""
    inside = scores.where(F.col(SCORE).between(0, 1)).withColumn("bin", _bin(True, bins))
    counts = inside.groupBy("bin").agg(F.count(F.lit(1)).alias("found"))
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    filled = every.join(F.broadcast(counts), "bin", "left")
    return filled.select("bin", F.coalesce("found", F.lit(0).cast("bigint")).alias("n"))


def metric_set(
    scores: DataFrame, threshold: float = 0.5, by: tuple[str, ...] = ("dataset",),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Every scalar metric, one row per group, from one pass over the distinct scores."""
    score, pos, neg = F.col(SCORE), F.col("pos"), F.col("neg")
    high = score > threshold
    tp = F.sum(F.when(high, pos).otherwise(0))
    fp = F.sum(F.when(high, neg).otherwise(0))
    fn = F.sum(F.when(high, 0).otherwise(pos))
    error = F.sum(pos * (score - 1) * (score - 1) + neg * score * score)
    values = _prf(tp, fp, fn) | {
        "area_under_roc": area_under_roc(),
        "average_precision": average_precision_of(),
        "brier_score": error / F.sum(pos + neg),
        "n": F.sum(pos + neg),
    }
    return steps(scores, by, rows_per_bucket).groupBy(*by).agg(*[c.alias(n) for n, c in values.items()])
