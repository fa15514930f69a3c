"""Readers that bring any CSV or Parquet layout to the typed column contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, IntegerType, LongType, StructType

from perindex.registry import DOUBLE_COLUMNS
from perindex.sources import schemas
from perindex.sources.versions import path_exists, resolve


def _typed(column: Column, source: DataType, target: DataType) -> Column:
    """``column`` as ``target``; text that does not parse becomes null.

    Ids written as ``76.0`` are whole numbers: the decimal step keeps every digit
    of a 64-bit id, which a double would not. With any other fraction an id is null,
    never cut to another one.
    """
    if source == target:
        return column
    if isinstance(target, (LongType, IntegerType)):
        if isinstance(source, (LongType, IntegerType)):
            return column.try_cast(target)
        if isinstance(source, (DoubleType, FloatType)):
            return F.when(column == F.floor(column), column.try_cast(target))
        # Text: only zeros may follow the point, however many digits there are.
        text = F.trim(column.cast("string"))
        whole = F.regexp_extract(text, r"^([+-]?[0-9]+)(?:\.0*)?$", 1)
        exact = text.try_cast("decimal(38,6)")  # for text with an exponent
        return F.when(whole != "", whole.try_cast("decimal(38,0)").try_cast(target)).when(
            F.contains(F.lower(text), F.lit("e")) & (exact == F.floor(exact)), exact.try_cast(target)
        )
    return column.try_cast(target)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Pick the contract's columns by name and cast them.

    An absent key column is an error that names it; any other absent column is null.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    missing = [name for name in schemas.keys_of(schema) if name not in present]
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(present)}")
    return df.select(
        *[
            _typed(F.col(f.name), present[f.name], f.dataType).alias(f.name)
            if f.name in present
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """Read one table. CSV columns are found by header name and never inferred."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return conform(reader.load(path), schema)


def read_omop(
    spark: SparkSession, folder: str, fmt: str = "parquet", tables: list[str] | None = None
) -> dict[str, DataFrame]:
    """The event tables of a folder, one ``<table>.<fmt>`` each."""
    wanted = tables or [
        "person",
        "drug_exposure",
        "measurement",
        "observation",
        "condition_occurrence",
        "procedure_occurrence",
    ]
    return {
        name: read_table(spark, f"{folder}/{name}.{fmt}", schemas.TABLES[name], fmt)
        for name in wanted
    }


def empty_frame(spark: SparkSession, schema: StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_index_range(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored index range, or an empty one with the same columns."""
    path = resolve(spark, path)
    if path_exists(spark, path):
        return read_table(spark, path, schemas.INDEX_RANGE, fmt)
    return empty_frame(spark, schemas.INDEX_RANGE)


def empty_features(spark: SparkSession, columns: list[str]) -> DataFrame:
    """A feature family without rows: ``person_id`` and typed feature columns."""
    ddl = ", ".join(f"{c} {'double' if c in DOUBLE_COLUMNS else 'bigint'}" for c in columns)
    return empty_frame(spark, schemas.table_schema(f"person_id bigint, {ddl}"))


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A stored feature table; naming a split reads only that partition."""
    df = spark.read.parquet(resolve(spark, path))
    return df if split is None else df.where(F.col("split") == split)


def read_predictions(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Stored predictions: person, probability and, if there are several, dataset as text."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(resolve(spark, path))
    dataset = [F.col("dataset").cast("string").alias("dataset")] if "dataset" in df.columns else []
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.PREDICTIONS], *dataset)
