from __future__ import annotations

import threading

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.metrics.threshold import metric_set
from perindex.ml import model as M
from perindex.ml.explain import top_factors
from perindex.ml.split import assign_split, random_split
from perindex.plans import jobs
from perindex.sources.readers import read_predictions

COLUMNS = ["age", "copd", "obesity"]


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(600).selectExpr(
        "id as person_id", "20 + id % 60 as age", "id % 2 as copd", "id % 3 as obesity",
        f"cast(if(id % 2 = 1 and id % 60 > 30, 1, 0) as int) as {R.LABEL}",
    )


def test_split_does_not_depend_on_partitions(spark, people):
    def chosen(n):
        rows = assign_split(people.repartition(n), 0.25).where("split = 'test'").collect()
        return {r.person_id for r in rows}

    assert chosen(1) == chosen(7) and 100 < len(chosen(3)) < 200
    train, test = random_split(people, 0.25)
    assert train.count() + test.count() == 600 and train.join(test, "person_id").count() == 0
    assert assign_split(people, None).select("split").distinct().collect() == [("full",)]
    for share in (0, 1, 1.5):
        with pytest.raises(ValueError):
            assign_split(people, share)


def test_fit_save_load_score(people, tmp_path):
    model = M.fit(people, M.boosted_trees(rounds=3), COLUMNS)
    M.save(model, str(tmp_path / "m"))
    unlabelled = people.drop(R.LABEL).where("person_id < 10")
    scored = M.score_datasets(M.load(str(tmp_path / "m")), {"a": unlabelled, "b": unlabelled})
    rows = scored.collect()
    assert len(rows) == 20 and scored.columns == ["person_id", "predict_prob", "true_label", "dataset"]
    assert all(0 <= r.predict_prob <= 1 for r in rows)
    again = {r.person_id: r.predict_prob for r in M.score(model, unlabelled).collect()}
    assert all(again[r.person_id] == r.predict_prob for r in rows)
    for withheld in ([], ["a"], ["a", "b"]):
        tables = {n: people.drop(R.LABEL) if n in withheld else people.withColumn("more", F.lit(n)) for n in ("a", "b")}
        metrics = jobs.infer(tables, str(tmp_path / "m"), str(tmp_path / "p")).collect()
        assert {r.dataset: r.n for r in metrics} == {n: 600 for n in ("a", "b") if n not in withheld}
        written = read_predictions(people.sparkSession, str(tmp_path / "p"))
        assert {(r.dataset, r["count"]) for r in written.groupBy("dataset").count().collect()} == {("a", 600), ("b", 600)}


def test_vectorize_keeps_the_order(people):
    row = M.vectorize(people, COLUMNS).where("person_id = 5").first()
    assert list(row.features) == [25.0, 1.0, 2.0]


def test_unlabelled_rows_are_not_trained_on(people):
    withheld = people.withColumn(R.LABEL, F.expr(f"if(person_id < 10, null, {R.LABEL})"))
    rows = M.training_rows(withheld)
    assert rows.count() == 590
    assert {(r.label, r.class_weight) for r in rows.select("label", "class_weight").distinct().collect()} == {
        (0.0, 1.0), (1.0, 5.0),
    }


def test_a_fitted_model_scores_after_metrics_and_measures_its_own_scores(people):
    ranked = people.selectExpr("'a' as dataset", "person_id / 600 as predict_prob", f"{R.LABEL} as true_label")
    assert metric_set(ranked).first().n == 600
    model = M.fit(people, LogisticRegression(weightCol="class_weight", maxIter=5), COLUMNS)
    assert len(M.score(model, people).collect()) == 600
    measured = metric_set(M.score_datasets(model, {"a": people, "b": people.where("person_id < 100")})).collect()
    assert {r.dataset: r.n for r in measured} == {"a": 600, "b": 100}


def test_compare_and_grid(spark, people):
    train, test = random_split(people, 0.25)
    names = M.candidates(len(COLUMNS), rounds=2)
    rows = {r.model: r for r in M.compare(train, test, names, COLUMNS).collect()}
    assert set(rows) == set(names) and rows["decision_tree"].area_under_roc > 0.9
    found = M.grid_search(
        train, LogisticRegression(maxIter=5), {"regParam": [0.0, 0.1]}, COLUMNS, folds=2
    )
    results = M.grid_results(found, spark).collect()
    assert [r.params for r in results] == ["regParam=0.0", "regParam=0.1"]
    scored = M.score(M.best_pipeline(found, COLUMNS), test).collect()
    assert len(scored) == test.count() and all(0 <= r.predict_prob <= 1 for r in scored)


def test_the_search_assembles_once_and_shares_its_folds(people, monkeypatch):
    assembled, transform = [], M.VectorAssembler.transform
    monkeypatch.setattr(M.VectorAssembler, "transform", lambda self, *a: assembled.append(1) or transform(self, *a))
    folds = M.folds_of(people, COLUMNS, 3, 1)
    assert len(assembled) == 1
    sizes = {r.fold: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert set(sizes) == {0, 1, 2} and min(sizes.values()) > 150
    again = M.folds_of(people.repartition(7), COLUMNS, 3, 1).groupBy("fold").count().collect()
    assert {r.fold: r["count"] for r in again} == sizes
    M.grid_search(people, LogisticRegression(maxIter=2), {"regParam": [0.0, 0.1, 0.2]}, COLUMNS, folds=3)
    assert len(assembled) == 3  # the two above, and once for all combinations and folds


def test_the_search_caches_no_fold_and_finds_what_cross_validation_finds(people, monkeypatch):
    cached, persist = [], type(people).persist
    monkeypatch.setattr(type(people), "persist", lambda self, *a: cached.append(1) or persist(self, *a))
    noisy = F.expr("if(pmod(hash(person_id), 50) + age + 10 * obesity > 75, 1, 0)")
    people = people.withColumn(R.LABEL, noisy)
    estimator, grid = LogisticRegression(maxIter=10, elasticNetParam=1.0), {"regParam": [0.0, 0.1, 3.0]}
    found = M.grid_search(people, estimator, grid, COLUMNS, folds=3)
    assert not cached
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=found.getEstimatorParamMaps(), numFolds=3, foldCol="fold",
        evaluator=BinaryClassificationEvaluator(labelCol="label"),
    )
    plain = search.fit(M.folds_of(people, COLUMNS, 3, M.SEED))
    assert len(cached) == 6 and len(set(plain.avgMetrics)) > 1
    assert found.avgMetrics == pytest.approx(plain.avgMetrics) and found.stdMetrics == pytest.approx(plain.stdMetrics)
    assert list(found.bestModel.coefficients) == pytest.approx(list(plain.bestModel.coefficients))


def test_fits_of_a_search_run_together_as_far_as_their_rows_fit_in_memory(spark, people, monkeypatch):
    running, most, lock, fit = [], [], threading.Lock(), LogisticRegression.fit

    def counted(self, *a):
        with lock:
            running.append(1)
            most.append(len(running))
        try:
            return fit(self, *a)
        finally:
            running.pop()

    monkeypatch.setattr(LogisticRegression, "fit", counted)
    # 400 rows of three doubles are 9,600 bytes for a fit.
    for room, at_once in ((1, 1), (20_000, 2), (M.KEPT_PER_CORE, 3)):
        monkeypatch.setattr(M, "KEPT_PER_CORE", room / spark.sparkContext.defaultParallelism)
        assert M.fits_at_once(people, len(COLUMNS), 3, 3) == at_once
        most.clear()
        M.grid_search(people, LogisticRegression(maxIter=2), {"regParam": [0.0, 0.1, 0.2]}, COLUMNS, folds=3)
        assert len(most) == 10 and max(most) <= at_once  # nine fits of folds, and the best one


def test_an_empty_fold_is_an_error(people):
    first = M.uniform("person_id", M.SEED) * 3 < 1
    for rows, said in ((people.where(first), "training"), (people.where(~first), "validation")):
        with pytest.raises(ValueError, match=f"The {said} data at fold 0 is empty."):
            M.grid_search(rows, LogisticRegression(maxIter=2), {"regParam": [0.0]}, COLUMNS, folds=3)


def test_the_comparison_assembles_each_table_once(people, monkeypatch):
    assembled, transform = [], M.VectorAssembler.transform
    monkeypatch.setattr(M.VectorAssembler, "transform", lambda self, *a: assembled.append(1) or transform(self, *a))
    names = {f"weight {w}": LogisticRegression(maxIter=2, regParam=w) for w in (0.0, 0.1, 0.2)}
    rows = M.compare(people, people.where("person_id < 100"), names, COLUMNS).collect()
    assert {r.model: r.n for r in rows} == dict.fromkeys(names, 100)
    assert len(assembled) == 2  # training and test rows, whatever the number of classifiers


def test_a_fit_deals_its_rows_evenly_over_the_cores(spark, people, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    crowded = people.where("person_id < 590").coalesce(1).unionByName(people.where("person_id >= 590"))
    for rows_per_task in (M.ROWS_PER_TASK, 40):
        monkeypatch.setattr(M, "ROWS_PER_TASK", rows_per_task)
        vectors = M.training_vectors(crowded, COLUMNS)
        sizes = [r["count"] for r in vectors.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 600 and len(sizes) >= cores and max(sizes) < 2 * 600 / cores


def test_top_factors(people):
    weights = {"age": 0.1, "copd": 2.0, "obesity": -1.0}
    means = {n: people.agg(F.avg(n)).first()[0] for n in weights}
    found = {}
    for r in top_factors(people, weights, 2).collect():
        found.setdefault(r.person_id, {})[r.rank] = (r.factor, r.contribution)
    for p in people.collect():
        parts = sorted(((-w * (p[n] - means[n]), n) for n, w in weights.items()))[:2]
        for rank, (down, name) in enumerate(parts, 1):
            factor, amount = found[p.person_id][rank]
            assert factor == name and amount == pytest.approx(-down)
