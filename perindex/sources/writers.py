"""Sinks. Every write is distributed; nothing passes through the driver.

A sink replaces its table by a new version, see ``versions``; the readers of
``readers`` find the current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from perindex.sources import versions


def _write(df: DataFrame, path: str, by: str | None, fmt: str) -> None:
    writer = df.write.format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if by is not None:
        writer = writer.partitionBy(by)
    writer.save(path)


def _split(df: DataFrame) -> str | None:
    return "split" if "split" in df.columns else None


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a feature table, one folder per split if it carries a ``split`` column."""
    versions.replace(df.sparkSession, path, lambda folder: _write(df, folder, _split(df), fmt))


def write_index_range(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a stored index range."""
    versions.replace(df.sparkSession, path, lambda folder: _write(df, folder, None, fmt))


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace ``person_id, predict_prob``, one folder per dataset if there are several."""
    rows = df.select(*[c for c in ("person_id", "predict_prob", "dataset") if c in df.columns])
    by = "dataset" if "dataset" in rows.columns else None
    versions.replace(df.sparkSession, path, lambda folder: _write(rows, folder, by, fmt))
