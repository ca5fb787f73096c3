"""Every query with SQL against DuckDB on the smallest tables; skipped where they aren't at hand."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CORE = [n for m in entry.MODULES if not m.__name__.startswith("okrug.llm") for n in getattr(m, "ORACLE", {})]


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test tables")
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, SF, name) in ("", "no rows")


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
