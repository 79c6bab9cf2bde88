"""The queries that SQL can express against DuckDB, exactly."""

from __future__ import annotations

import pytest

from tests.comparing import DATA, assert_same, duck
from weekpulse.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, name, scale):
    folder = f"{DATA}/{scale}"
    assert_same(QUERIES[name](spark, folder).toPandas(), duck(folder).execute(ORACLE[name]).df())
