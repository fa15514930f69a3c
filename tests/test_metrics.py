from __future__ import annotations

import math
import random

import pytest

from perindex.metrics import curves, threshold

random.seed(5)
DATA = [
    (g, round(random.betavariate(2, 3), 2), int(random.random() < 0.3))
    for g in ("a", "b")
    for _ in range(400)
]


@pytest.fixture(scope="module")
def scores(spark):
    rows = [*DATA, ("a", 0.4, None), ("b", None, 1)]
    return spark.createDataFrame(rows, "dataset string, predict_prob double, true_label int")


def pairs(group=None):
    return [(s, y) for g, s, y in DATA if group in (None, g)]


def brute_auroc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def counts_at(rows, limit):
    tp = sum(1 for s, y in rows if s >= limit and y)
    return tp, sum(1 for s, y in rows if s >= limit and not y)


def brute_ap(rows):
    total, recall, area = sum(y for _, y in rows), 0.0, 0.0
    for limit in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = counts_at(rows, limit)
        area += (tp / total - recall) * tp / (tp + fp)
        recall = tp / total
    return area


# 50 rows a bucket forces the offsets; the default needs none here.
@pytest.mark.parametrize("rows_per_bucket", [7, 50, curves.ROWS_PER_BUCKET])
def test_areas(scores, rows_per_bucket):
    found = curves.auroc(scores, rows_per_bucket=rows_per_bucket).first()[0]
    assert found == pytest.approx(brute_auroc(pairs()), abs=1e-12)
    found = curves.average_precision(scores, rows_per_bucket=rows_per_bucket).first()[0]
    assert found == pytest.approx(brute_ap(pairs()), abs=1e-12)
    for r in curves.auroc(scores, ("dataset",), rows_per_bucket).collect():
        assert r.area_under_roc == pytest.approx(brute_auroc(pairs(r.dataset)), abs=1e-12)


@pytest.mark.parametrize("rows_per_bucket", [7, 50, curves.ROWS_PER_BUCKET])
def test_steps_count_ties_once(scores, rows_per_bucket):
    rows = curves.steps(scores, rows_per_bucket=rows_per_bucket).collect()
    assert len(rows) == len({s for s, _ in pairs()})
    ordered = sorted(rows, key=lambda r: -r.predict_prob)
    for here, below in zip(ordered, ordered[1:]):
        assert (here.tp, here.fp) == counts_at(pairs(), here.predict_prob)
        assert (here.next_pos, here.next_neg) == (below.pos, below.neg)
    assert ordered[-1].next_pos is None and ordered[-1].tp == ordered[-1].positives


@pytest.mark.parametrize("rows_per_bucket", [7, curves.ROWS_PER_BUCKET])
def test_curves(scores, rows_per_bucket):
    total = sum(y for _, y in pairs())
    full = curves.roc_curve(scores, drop_intermediate=False, rows_per_bucket=rows_per_bucket).collect()
    points = {(r.fpr, r.tpr) for r in full}
    for r in full:
        if r.threshold is not None:
            tp, fp = counts_at(pairs(), r.threshold)
            assert r.tpr == tp / total and r.fpr == fp / (800 - total)
    assert (0.0, 0.0) in points and (1.0, 1.0) in points
    fewer = curves.roc_curve(scores, rows_per_bucket=rows_per_bucket).collect()
    assert {(r.fpr, r.tpr) for r in fewer} <= points and len(fewer) <= len(full)
    outline = sorted((r.fpr, r.tpr) for r in fewer)
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(outline, outline[1:]))
    assert area == pytest.approx(brute_auroc(pairs()))
    pr = curves.precision_recall_curve(scores, rows_per_bucket=rows_per_bucket).collect()
    assert sum(r.threshold is None for r in pr) == 1 and len(pr) == len(full)
    for r in pr:
        if r.threshold is not None:
            tp, fp = counts_at(pairs(), r.threshold)
            assert r.precision == tp / (tp + fp) and r.recall == tp / total


def test_intermediate_points_lie_on_straight_stretches(spark):
    rows = [(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 0), (0.5, 0), (0.4, 1)]
    scores = spark.createDataFrame(rows, "predict_prob double, true_label int")
    kept = {r.threshold for r in curves.roc_curve(scores).collect()}
    assert kept == {None, 0.9, 0.8, 0.5, 0.4}


def test_a_skewed_score_does_not_fill_one_bucket(spark):
    scores = spark.range(3000).selectExpr(
        "if(id % 3 = 0, 0.5, id / 3000) as predict_prob", "cast(id % 2 as int) as true_label"
    )
    sizes = [r["count"] for r in curves.ranges(curves.by_score(scores), (), 100).groupBy("bucket").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 400
    one, many = (curves.auroc(scores, rows_per_bucket=n).first()[0] for n in (10**6, 100))
    assert one == pytest.approx(many, abs=1e-12)


@pytest.mark.parametrize("kind", ["double", "float", "decimal(9,3)"])
@pytest.mark.parametrize("rows_per_bucket", [3, curves.ROWS_PER_BUCKET])
def test_any_score_type_and_odd_scores(spark, kind, rows_per_bucket):
    rows = [(round(s, 1), y) for _, s, y in DATA[:60]]
    odd = [] if kind.startswith("decimal") else [(float("inf"), 1), (float("-inf"), 0)]
    unknown = [] if kind.startswith("decimal") else [(float("nan"), 1), (float("nan"), 0)]
    frame = spark.createDataFrame([*rows, *odd, *unknown, (None, 1)], "predict_prob double, true_label int")
    scores = frame.withColumn("predict_prob", frame.predict_prob.cast(kind))
    found = curves.auroc(scores, rows_per_bucket=rows_per_bucket).first()[0]
    assert found == pytest.approx(brute_auroc([*rows, *odd]), abs=1e-12)
    row = threshold.metric_set(scores.selectExpr("*", "string(null) as dataset"), rows_per_bucket=rows_per_bucket).first()
    assert row.n == len(rows) + len(odd) and row.area_under_roc == pytest.approx(found)


def test_threshold_metrics(scores):
    tp = sum(1 for s, y in pairs() if s > 0.5 and y)
    fp = sum(1 for s, y in pairs() if s > 0.5 and not y)
    fn = sum(1 for s, y in pairs() if s <= 0.5 and y)
    row = threshold.confusion(scores).first()
    assert (row.tp, row.fp, row.fn, row.tn) == (tp, fp, fn, 800 - tp - fp - fn)
    prf = threshold.precision_recall_f1(scores).first()
    assert prf.precision == pytest.approx(tp / (tp + fp)) and prf.recall == pytest.approx(tp / (tp + fn))
    assert prf.f1_score == pytest.approx(2 * tp / (2 * tp + fp + fn))
    brier = sum((s - y) ** 2 for s, y in pairs()) / 800
    assert threshold.brier_score(scores).first()[0] == pytest.approx(brier)
    report = {r["class"]: r for r in threshold.class_report(scores).collect()}
    assert report["1"].precision == prf.precision and report["1"].support == tp + fn
    assert report["accuracy"].recall == pytest.approx((tp + row.tn) / 800)
    assert report["macro avg"].f1_score == pytest.approx((report["0"].f1_score + report["1"].f1_score) / 2)


@pytest.mark.parametrize("rows_per_bucket", [20, curves.ROWS_PER_BUCKET])
def test_metric_set_agrees_with_its_parts(scores, rows_per_bucket):
    for row in threshold.metric_set(scores, 0.4, rows_per_bucket=rows_per_bucket).collect():
        part = scores.where(scores.dataset == row.dataset)
        prf = threshold.precision_recall_f1(part, 0.4).first()
        assert (row.precision, row.recall, row.f1_score) == tuple(prf)
        assert row.area_under_roc == pytest.approx(brute_auroc(pairs(row.dataset)))
        assert row.average_precision == pytest.approx(brute_ap(pairs(row.dataset)))
        assert row.brier_score == pytest.approx(threshold.brier_score(part).first()[0])


def test_edges(spark):
    grid = [i / 10 for i in range(11)] + [0.25, 0.99]
    scores = spark.createDataFrame([(s, 1) for s in grid], "predict_prob double, true_label int")
    calibration = {r.bin: r.n for r in threshold.calibration_curve(scores).collect()}
    # Left-open bins: 0 and 0.1 share the first one.
    assert calibration == {0: 2, 1: 1, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2}
    edges = [i * 0.1 for i in range(11)]
    histogram = {r.bin: r.n for r in threshold.score_histogram(scores).collect()}
    for b in range(10):
        inside = [s for s in grid if edges[b] <= s < edges[b + 1] or (b == 9 and s == 1.0)]
        assert histogram[b] == len(inside)
    few = spark.createDataFrame([(0.05, 1), (1.5, 0)], "predict_prob double, true_label int")
    assert sorted(tuple(r) for r in threshold.score_histogram(few).collect()) == [
        (b, int(b == 0)) for b in range(10)
    ]


def test_one_class_only(spark):
    for label in (0, 1):
        scores = spark.createDataFrame([(0.2, label), (0.8, label)], "predict_prob double, true_label int")
        row = threshold.metric_set(scores.selectExpr("*", "'x' as dataset")).first()
        assert row.area_under_roc is None and not math.isnan(row.brier_score)
        assert row.average_precision == label
    empty = scores.where("false")
    assert curves.roc_curve(empty).count() == 0 and curves.precision_recall_curve(empty).count() == 0
