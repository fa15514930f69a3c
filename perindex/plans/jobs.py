"""The three jobs: build the feature table, train, and score with metrics."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perindex.metrics.threshold import metric_set
from perindex.ml import model as M
from perindex.ml.split import SEED, assign_split
from perindex.operators.index_range import index_range
from perindex.plans.feature_table import feature_table
from perindex.registry import PRODUCTION, Registry
from perindex.session import materialize
from perindex.sources import schemas, versions
from perindex.sources.readers import empty_frame, read_features, read_omop, read_table
from perindex.sources.versions import path_exists
from perindex.sources.writers import write_predictions


def load_inputs(
    spark: SparkSession,
    folder: str,
    concept_sets: str,
    fmt: str = "parquet",
    may_lack: tuple[str, ...] = (),
) -> dict[str, DataFrame]:
    """The event tables, visits, cohort and concept sets of one data folder.

    An absent path is an error. ``visits`` and ``cohort`` are empty tables instead where
    ``may_lack`` names them.
    """
    tables = read_omop(spark, folder, fmt)
    for name in ("visits", "cohort"):
        path = f"{folder}/{name}.{fmt}"
        tables[name] = (
            empty_frame(spark, schemas.TABLES[name])
            if name in may_lack and not path_exists(spark, path)
            else read_table(spark, path, schemas.TABLES[name], fmt)
        )
    tables["concept_set_members"] = read_table(
        spark, concept_sets, schemas.CONCEPT_SET_MEMBERS, fmt
    )
    return tables


def featurize(
    tables: dict[str, DataFrame],
    output: str,
    registry: Registry = PRODUCTION,
    test_share: float | None = None,
    seed: int = SEED,
    los_max: int | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Write the index range and the feature table, and return the latter.

    An index range that exists already, such as one from ``read_index_range``, is
    used as it is; a person may occur in it once only. Both tables are written under
    a new version of the output, which becomes the current one when both are complete,
    so features never lie beside another run's index range, and an index range may
    come from the output folder itself. Both splits come from one evaluation of the plan.
    """
    spark = tables["person"].sparkSession
    if index is None:
        index = index_range(tables["cohort"], tables["visits"])

    def write(folder: str) -> None:
        index.write.parquet(f"{folder}/index_range")
        stored = spark.read.schema(schemas.INDEX_RANGE).parquet(f"{folder}/index_range")
        features = feature_table(tables, registry, stored, los_max)
        assign_split(features, test_share, seed).write.partitionBy("split").parquet(f"{folder}/features")

    versions.replace(spark, output, write, owned=("index_range", "features"))
    return read_features(spark, f"{output}/features")


def train(features: DataFrame, model_path: str, rounds: int = M.ROUNDS, seed: int = SEED) -> PipelineModel:
    model = M.fit(features, M.boosted_trees(rounds, seed))
    M.save(model, model_path)
    return model


def infer(
    datasets: dict[str, DataFrame], model_path: str, output: str, threshold: float = 0.5
) -> DataFrame:
    """Score the datasets, write the predictions, and return the metric set of each.

    The scores are stored once; predictions and metrics both read them from there. Persons
    without a label get predictions; a dataset without any has no row of metrics.
    """
    scored = materialize(M.score_datasets(M.load(model_path), datasets), "scores")
    write_predictions(scored, output)
    return metric_set(scored, threshold)


def shape(df: DataFrame) -> DataFrame:
    """Row and column count of a table, as a row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(len(df.columns))
    )
