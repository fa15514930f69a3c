from __future__ import annotations

import datetime
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from perindex.session import get_session  # noqa: E402
from perindex.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "tests",
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": 8,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def table(spark):
    """Build a table of the contract from dictionaries; absent columns are null."""

    def build(name: str, *rows: dict):
        schema = schemas.TABLES[name]
        return spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in rows], schema)

    return build


def day(text: str | None) -> datetime.date | None:
    return None if text is None else datetime.date.fromisoformat(text)


def by_key(df, *keys: str) -> dict:
    rows = [r.asDict() for r in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
