"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from checks.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no tables")
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, duck, name):
    build = entry_points.queries()[name]
    status, rows, note = compare(spark, duck, FOLDER, build, ORACLES.get(name))
    assert status in ("ok", "rows"), note
    assert rows > 0


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry_points.queries())
