"""Queries with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import pytest

from okrug.llm.queries import ORACLE
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, connect(SF), SF, name) in ("", "no rows")
