"""Slices of equal depth: each row once, and about as many rows each."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from unittest.mock import Mock

import duckdb
import pytest

from weekpulse.queries import BY_SOURCE, EARLY, SPEC
from weekpulse.sources.jdbc import equal_depth_predicates, histogram_statement, read_jdbc


def table_of(moments):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (date_hour TIMESTAMP, id BIGINT, brand TEXT, feature TEXT, source TEXT)")
    # Ids that say nothing about the time.
    ids = random.Random(1).sample(range(len(moments)), len(moments))
    connection.executemany("INSERT INTO t VALUES (?, ?, 'BUILDING', 'feature_1', 'FOTA')", list(zip(moments, ids)))
    return connection


def skewed(spec, n=900):
    """A third of all rows in one hour, others anywhere around the periods."""
    rng = random.Random(3)
    hot = spec.today.start + timedelta(hours=1)
    return [
        hot + timedelta(minutes=rng.randrange(60)) if k % 3 == 0
        else rng.choice([p.start for p in spec.periods]) + timedelta(minutes=rng.randrange(-120, 1500))
        for k in range(n)
    ]


@pytest.mark.parametrize("spec", [SPEC, EARLY, BY_SOURCE])
def test_each_row_once_and_even(spec):
    connection = table_of(skewed(spec))
    counts = dict(connection.execute(f"SELECT * FROM {histogram_statement('t', spec)}").fetchall())
    inside = sum(p.start <= m <= p.end for (m,) in connection.execute("SELECT date_hour FROM t").fetchall() for p in spec.periods if not p.empty)
    assert sum(counts.values()) == inside
    predicates = equal_depth_predicates(spec, counts, 6, split_column="id")
    found = [r for p in predicates for r in connection.execute(f"SELECT id, date_hour FROM t WHERE {p}").fetchall()]
    assert len(found) == len(set(found)) == inside
    depths = [connection.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in predicates]
    # A slice is not deeper than its share, but for how evenly the ids divide an hour.
    assert max(depths) <= 1.5 * -(-inside // 6)
    assert len(predicates) <= 6 * 2 + 2


def test_rows_that_came_after_the_count_are_read():
    connection = table_of(skewed(SPEC))
    for counts in ({}, {SPEC.today.start: 5}):
        where = equal_depth_predicates(SPEC, counts, 4)
        found = sum(connection.execute(f"SELECT count(*) FROM t WHERE {p}").fetchone()[0] for p in where)
        either = " OR ".join(f"date_hour BETWEEN '{p.start}' AND '{p.end}'" for p in SPEC.periods)
        assert found == connection.execute(f"SELECT count(*) FROM t WHERE {either}").fetchone()[0]


def test_an_hour_too_deep_stays_whole_without_a_column_to_split():
    hour = SPEC.today.start + timedelta(hours=2)
    where = equal_depth_predicates(SPEC, {hour: 100, hour + timedelta(hours=1): 1}, 10)
    assert where[1].startswith("date_hour >= TIMESTAMP '2024-01-15 03:00:00'") and len(where) == 3


def test_read_counts_first():
    spark = Mock()
    spark.read.jdbc.return_value.collect.return_value = [{"hour_start": datetime(2024, 1, 15, 3), "n": 7}]
    with pytest.raises(Exception):
        # The mock's columns are no fact table; the statements have been asked for by then.
        read_jdbc(spark, "jdbc:redshift://h/d", "rtm", SPEC, slices=4, split_column="id")
    first, second = spark.read.jdbc.call_args_list
    assert first.args[1].startswith("(SELECT DATE_TRUNC('hour', date_hour) AS hour_start, COUNT(*) AS n FROM rtm WHERE ")
    assert "brand IN ('AUTOMOBILE'" in first.args[1]
    assert second.kwargs["predicates"] == equal_depth_predicates(SPEC, {datetime(2024, 1, 15, 3): 7}, 4, "id")
