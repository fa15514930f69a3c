"""Model fit, scoring, comparison and parameter search on Spark ML."""

from __future__ import annotations

import math
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perindex import registry as R
from perindex.metrics.threshold import metric_set
from perindex.ml.split import uniform
from perindex.session import checkpoint_dir, materialize

# The boosted-tree settings. The L1 and L2 penalties of other
# boosting libraries have no counterpart in Spark ML.
POSITIVE_WEIGHT = 5.0
MAX_DEPTH = 8
LEARNING_RATE = 0.1
FEATURE_SHARE = "0.5"
ROUNDS = 100
SEED = 16
# Rounds that rank candidates and parameters against each other; the chosen one is fitted with ROUNDS.
SEARCH_ROUNDS = 20
# The search: depth and learning rate around the settings above.
GRID = {"maxDepth": [4, 8], "stepSize": [0.05, 0.1]}
FOLDS = 3
# Rows of one stored part of the training vectors: some 100 MB of binned features.
ROWS_PER_TASK = 100_000
# Bytes of vectors, for each core, that the fits of a search may keep at one time. Trees keep them
# binned, in half of that, which leaves an executor of 2.5 GB a core the rest of its memory.
KEPT_PER_CORE = 1_000_000_000


def assembler(columns: list[str] | None = None) -> VectorAssembler:
    """Pass the feature columns through into one vector."""
    return VectorAssembler(
        inputCols=columns or R.FEATURE_COLUMNS, outputCol="features", handleInvalid="error"
    )


def vectorize(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return assembler(columns).transform(df)


def training_rows(df: DataFrame) -> DataFrame:
    """Labelled rows with ``label`` and the weight that balances the classes."""
    label = F.col(R.LABEL).cast("double")
    weight = F.when(label == 1, POSITIVE_WEIGHT).otherwise(1.0)
    return (
        df.where(F.col(R.LABEL).isNotNull())
        .withColumn("label", label)
        .withColumn("class_weight", weight)
    )


def boosted_trees(rounds: int = ROUNDS, seed: int = SEED) -> GBTClassifier:
    return GBTClassifier(
        maxDepth=MAX_DEPTH,
        stepSize=LEARNING_RATE,
        featureSubsetStrategy=FEATURE_SHARE,
        minInstancesPerNode=1,
        maxIter=rounds,
        weightCol="class_weight",
        seed=seed,
    )


def training_vectors(df: DataFrame, columns: list[str] | None = None, *extra: Column) -> DataFrame:
    """The labelled rows as vectors, assembled once and stored, dealt evenly over the cores.

    A fit goes through its rows many times, and every pass would assemble them anew.
    Stored feature tables shrink so far that parts cut by their bytes differ in rows,
    and the largest holds up every pass; so the rows are counted and dealt by person,
    into a multiple of the cores: read back, each core gets as many parts, small ones together.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    rows = training_rows(df)
    parts = cores * max(1, math.ceil(rows.count() / (cores * ROWS_PER_TASK)))
    vectors = assembler(columns).transform(rows).select("person_id", "label", "class_weight", "features", *extra)
    return materialize(vectors.repartition(parts, "person_id"), "training_vectors")


def fit(df: DataFrame, estimator=None, columns: list[str] | None = None) -> PipelineModel:
    """The assembler and a classifier that is fitted on the labelled rows of ``df``."""
    return PipelineModel([assembler(columns), fit_vectors(training_vectors(df, columns), estimator)])


def fit_vectors(vectors: DataFrame, estimator=None):
    """Fit a classifier on the rows of ``training_vectors``.

    Boosting checkpoints its running predictions every few rounds, given a folder:
    a lost executor then costs some rounds, not all of them.
    """
    checkpoint_dir(vectors.sparkSession)
    return (estimator or boosted_trees()).fit(vectors)


def score(model, df: DataFrame) -> DataFrame:
    """``person_id, predict_prob, true_label`` and, where present, ``dataset``.

    The label is null where a person, or the whole table, has none.
    """
    probability = vector_to_array("probability")[1]
    label = F.col(R.LABEL) if R.LABEL in df.columns else F.lit(None)
    extra = [F.col("dataset")] if "dataset" in df.columns else []
    return model.transform(df).select(
        "person_id", probability.alias("predict_prob"), label.cast("int").alias("true_label"), *extra
    )


def score_datasets(model, datasets: dict[str, DataFrame]) -> DataFrame:
    """Score several feature tables in one job, told apart by ``dataset``.

    Of each table the model's inputs, the person and the label are taken, so labelled
    and unlabelled tables go together, whatever else they carry.
    """
    inputs = model.stages[0].getInputCols()

    def tagged(name: str, df: DataFrame) -> DataFrame:
        label = F.col(R.LABEL) if R.LABEL in df.columns else F.lit(None)
        return df.select("person_id", *inputs, label.cast("int").alias(R.LABEL), F.lit(name).alias("dataset"))

    return score(model, reduce(DataFrame.unionByName, (tagged(n, df) for n, df in datasets.items())))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def candidates(n_features: int, seed: int = SEED, rounds: int = SEARCH_ROUNDS) -> dict:
    """The classifiers that are compared with each other."""
    return {
        "logistic_regression": LogisticRegression(weightCol="class_weight", maxIter=50),
        "decision_tree": DecisionTreeClassifier(weightCol="class_weight", seed=seed),
        "random_forest": RandomForestClassifier(weightCol="class_weight", seed=seed),
        "gradient_boosted_trees": boosted_trees(rounds, seed),
        "multilayer_perceptron": MultilayerPerceptronClassifier(
            layers=[n_features, 16, 2], maxIter=50, seed=seed
        ),
    }


def compare(
    train: DataFrame,
    test: DataFrame,
    estimators: dict | None = None,
    columns: list[str] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """One metric row per classifier on the test rows.

    Both tables are assembled once and stored; every classifier reads their vectors.
    """
    columns = columns or R.FEATURE_COLUMNS
    estimators = estimators or candidates(len(columns))
    trained = training_vectors(train, columns)
    tested = materialize(vectorize(test, columns).select("person_id", R.LABEL, "features"), "test_vectors")
    scored = [
        score(fit_vectors(trained, estimator), tested).withColumn("model", F.lit(name))
        for name, estimator in estimators.items()
    ]
    stored = materialize(reduce(DataFrame.unionByName, scored), "model_scores")
    return metric_set(stored, threshold, by=("model",))


def folds_of(df: DataFrame, columns: list[str] | None, folds: int, seed: int) -> DataFrame:
    """Labelled rows as vectors with a fold number that depends on the person alone, stored."""
    fold = F.floor(uniform("person_id", seed) * folds).cast("int").alias("fold")
    return training_vectors(df, columns, fold)


class StoredFoldsValidator(CrossValidator):
    """Cross validation on rows that are stored with their folds: each fit reads its own from there.

    ``CrossValidator`` caches the vectors of a fold beside what its fits cache of them.
    Rows beyond the memory then push each other out, and every pass of every fit reads
    from disk again. Nothing is cached here but by the fits, and the fits of all folds
    take turns, so cores do not wait for the last fit of a fold. Sub-models are not kept.
    """

    def _fit(self, dataset: DataFrame) -> CrossValidatorModel:
        estimator, evaluator = self.getEstimator(), self.getEvaluator()
        grid, fold, folds = self.getEstimatorParamMaps(), F.col(self.getFoldCol()), range(self.getNumFolds())
        filled = {r[0] for r in dataset.select(fold).distinct().collect()}
        for k in folds:
            if not filled - {k}:
                raise ValueError(f"The training data at fold {k} is empty.")
            if k not in filled:
                raise ValueError(f"The validation data at fold {k} is empty.")

        def measure(k: int, params) -> float:
            model = estimator.fit(dataset.where(fold != k), params)
            return evaluator.evaluate(model.transform(dataset.where(fold == k), params))

        # Each call gets its own copy of the thread's properties.
        calls = [
            inheritable_thread_target(dataset.sparkSession)(partial(measure, k, params))
            for k in folds
            for params in grid
        ]
        with ThreadPool(min(self.getParallelism(), len(calls))) as pool:
            found = list(pool.imap(lambda call: call(), calls))
        metrics = np.array(found).reshape(len(folds), len(grid))
        means = metrics.mean(axis=0)
        best = np.argmax(means) if evaluator.isLargerBetter() else np.argmin(means)
        model = estimator.fit(dataset, grid[best])
        return self._copyValues(CrossValidatorModel(model, list(means), None, list(metrics.std(axis=0))))


def fits_at_once(vectors: DataFrame, features: int, folds: int, most: int) -> int:
    """How many fits, ``most`` at the most, can keep their share of the rows in memory together."""
    kept = vectors.count() * (folds - 1) / folds * features * 8
    room = KEPT_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, int(room / max(1, kept))))


def grid_search(
    df: DataFrame,
    estimator=None,
    grid: dict[str, list] | None = None,
    columns: list[str] | None = None,
    folds: int = FOLDS,
    parallelism: int = 4,
    seed: int = SEED,
) -> CrossValidatorModel:
    """Cross-validated search over the parameters of one classifier, by AUROC.

    The vectors are assembled once and stored with their folds; every combination
    reads them from there, and all see the same folds. ``parallelism`` fits run at
    one time, fewer where their rows would not stay in memory together. The best
    model takes vectors, ``best_pipeline`` puts the assembler before it.
    """
    checkpoint_dir(df.sparkSession)
    estimator = estimator or boosted_trees(SEARCH_ROUNDS, seed)
    builder = ParamGridBuilder()
    for name, values in (grid or GRID).items():
        builder = builder.addGrid(estimator.getParam(name), values)
    vectors, combinations = folds_of(df, columns, folds, seed), builder.build()
    most = min(parallelism, len(combinations))
    search = StoredFoldsValidator(
        estimator=estimator,
        estimatorParamMaps=combinations,
        evaluator=BinaryClassificationEvaluator(labelCol="label"),
        numFolds=folds,
        foldCol="fold",
        parallelism=fits_at_once(vectors, len(columns or R.FEATURE_COLUMNS), folds, most),
    )
    return search.fit(vectors)


def best_pipeline(search: CrossValidatorModel, columns: list[str] | None = None) -> PipelineModel:
    """The best model of a search as a pipeline that scores feature tables."""
    return PipelineModel([assembler(columns), search.bestModel])


def grid_results(model: CrossValidatorModel, spark) -> DataFrame:
    """One row per parameter combination with its mean area under the curve."""
    rows = [
        (", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), float(metric))
        for params, metric in zip(model.getEstimatorParamMaps(), model.avgMetrics)
    ]
    return spark.createDataFrame(rows, "params string, area_under_roc double")
