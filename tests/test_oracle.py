"""Every registered query against DuckDB, exactly."""

from __future__ import annotations

from dataclasses import replace

import pytest

from __spark_entry__ import entry
from tests.comparing import DATA, assert_same, duck
from weekpulse import Report
from weekpulse.oracle import ORACLE
from weekpulse.queries import CUT, LATE, QUERIES, SPEC
from weekpulse.sources.events import event_feed


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 22


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_duckdb(spark, name, scale):
    folder = f"{DATA}/{scale}"
    found = QUERIES[name](spark, folder)
    wanted = duck(folder).execute(ORACLE[name])
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
    assert {c: t for c, t in found.dtypes} == {d[0]: kinds[str(d[1])] for d in wanted.description}
    assert_same(found.toPandas(), wanted.df())


@pytest.mark.parametrize(
    "name, changed",
    [
        ("hourly_series_cut", lambda r, spec: r.hourly_series()),
        ("hourly_series_tz_wrap", lambda r, spec: r.hourly_series()),
        ("wow_known_subset", lambda r, spec: r.summary()),
    ],
)
def test_query_changes_without_its_operator(spark, name, changed):
    """The same report without the cut, the zone or the known lists has other rows."""
    spec = {
        "hourly_series_cut": replace(CUT, cut_hour=None),
        "hourly_series_tz_wrap": LATE,
        "wow_known_subset": SPEC,
    }[name]
    folder = f"{DATA}/sf0.01"
    without = changed(Report(event_feed(spark, folder, spec), spec), spec)
    assert sorted(map(tuple, without.collect())) != sorted(map(tuple, QUERIES[name](spark, folder).collect()))


def test_queries_reach_their_branch(spark):
    folder = f"{DATA}/sf0.01"
    cells = QUERIES["grid_early"](spark, folder)
    assert cells.filter("notif_today = 0 AND revenue_today = 0 AND install_today = 0 AND exp_today = 0").count() > 0
    assert [r.kind for r in QUERIES["insights_swing"](spark, folder).collect()][0] == "revenue_swing"
    assert {0, 1} <= {r.hour_shifted for r in QUERIES["hourly_shifted_wrap"](spark, folder).collect()}
    assert [r.grain for r in QUERIES["multi_grain_empty"](spark, folder).collect()] == ["total"]
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert QUERIES["wow_with_totals"](spark, folder).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept
