"""The fact table in a warehouse, read over JDBC in parallel."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from weekpulse.operators.measures import FACT_COLUMN
from weekpulse.sources.fact import as_fact
from weekpulse.spec import Period, ReportSpec, read_for

DEFAULT_PORT = 5439
QUERY_TIMEOUT_SECONDS = 120
FETCH_ROWS = 50_000


def warehouse_url(host: str, database: str, port: int = DEFAULT_PORT, kind: str = "redshift") -> str:
    return f"jdbc:{kind}://{host}:{port}/{database}"


# Also for readers of hourly sums: their revenue has six decimals.
REVENUE_SUM = "DECIMAL(38,6)"


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    spec: ReportSpec,
    properties: dict[str, str] | None = None,
    slice_hours: int = 1,
    split_column: str | None = None,
    splits: int = 1,
    slices: int | None = None,
) -> DataFrame:
    """One connection per slice of the report's two periods; nothing outside them is fetched.

    Spark adds the selected columns and the brand, feature and source filters to each statement.
    An hour too large for one connection is divided further by a whole-number column.

    With `slices`, the warehouse counts the selected rows of each hour first, and about that many slices
    of about equally many rows are read; `split_column` then divides only the hours that need it.
    """
    if slices is None:
        predicates = split_predicates(period_predicates(spec, slice_hours=slice_hours), split_column, splits)
    else:
        counts = rows_by_hour(spark, url, table, spec, properties)
        predicates = equal_depth_predicates(spec, counts, slices, split_column)
    rows = spark.read.jdbc(url, table, predicates=predicates, properties=connection_properties(properties))
    return read_for(as_fact(rows), spec)


def rows_by_hour(
    spark: SparkSession, url: str, table: str, spec: ReportSpec, properties: dict[str, str] | None = None
) -> dict[datetime, int]:
    """How many selected rows each hour of the two periods has: at most 48 numbers, counted in the warehouse."""
    found = spark.read.jdbc(url, histogram_statement(table, spec), properties=connection_properties(properties))
    return {row["hour_start"]: int(row["n"]) for row in found.collect()}


def histogram_statement(table: str, spec: ReportSpec) -> str:
    hour = "DATE_TRUNC('hour', date_hour)"
    either = " OR ".join(f"({c})" for c in period_predicates(spec, slice_hours=24))
    where = " AND ".join(f"({c})" for c in (either, *selection(spec)))
    return f"(SELECT {hour} AS hour_start, COUNT(*) AS n FROM {table} WHERE {where} GROUP BY {hour}) AS rows_by_hour"


def read_jdbc_sums(
    spark: SparkSession,
    url: str,
    table: str,
    spec: ReportSpec,
    properties: dict[str, str] | None = None,
    slice_hours: int = 24,
) -> DataFrame:
    """The selected rows summed in the warehouse by brand, feature, source and `date_hour`.

    Reports add rows up, so these sums stand for the rows, and as many come over the wire as there
    are keys. One connection per slice of the periods; its condition is inside the grouped statement,
    so that each connection groups its own rows only.
    """
    parts = [
        as_fact(spark.read.jdbc(url, sums_statement(table, spec, condition), properties=connection_properties(properties)))
        for condition in period_predicates(spec, slice_hours=slice_hours)
    ]
    return read_for(reduce(DataFrame.union, parts), spec)


def sums_statement(table: str, spec: ReportSpec, condition: str) -> str:
    """A grouped subquery that stands for the table. Selected values are quoted as texts.

    `table` is put in as it is given, as Spark does with its own `dbtable`.
    """
    keys = "brand, feature, source, date_hour"
    # Warehouses widen sums of whole numbers to numerics of their own; these are the fact table's types.
    sums = ", ".join(
        f"CAST(SUM({c}) AS {REVENUE_SUM if c == 'revenue' else 'BIGINT'}) AS {c}" for c in FACT_COLUMN.values()
    )
    where = " AND ".join(f"({c})" for c in (condition, *selection(spec)))
    return f"(SELECT {keys}, {sums} FROM {table} WHERE {where} GROUP BY {keys}) AS hourly_sums"


def selection(spec: ReportSpec) -> list[str]:
    conditions = []
    for name, values in (("brand", spec.selected_brands), ("feature", spec.selected_features)):
        if values:
            conditions.append(f"{name} IN ({', '.join(map(text_literal, values))})")
    if spec.selected_source is not None:
        conditions.append(f"source = {text_literal(spec.selected_source)}")
    return conditions


def text_literal(text: str) -> str:
    """A text in standard SQL. Backslashes are refused, since dialects read them differently."""
    if "\\" in text or "\0" in text:
        raise ValueError(f"not safe in a statement: {text!r}")
    return "'" + text.replace("'", "''") + "'"


def connection_properties(given: dict[str, str] | None = None) -> dict[str, str]:
    return {
        "queryTimeout": str(QUERY_TIMEOUT_SECONDS),
        "fetchsize": str(FETCH_ROWS),
        "preferTimestampNTZ": "true",
        **(given or {}),
    }


def period_predicates(
    spec: ReportSpec, column: str = "date_hour", slice_hours: int = 1
) -> list[str]:
    """Conditions that together hold for exactly the rows of both periods, once each."""
    step = timedelta(hours=slice_hours)
    return [
        condition
        for period in spec.periods
        for condition in _slices(period, column, step)
    ] or ["1 = 0"]


def split_predicates(predicates: list[str], column: str | None, splits: int) -> list[str]:
    if column is None or splits < 2:
        return predicates
    # Rows without a value go to split 0.
    return [
        f"({p}) AND COALESCE(ABS(MOD({column}, {splits})), 0) = {i}"
        for p in predicates
        for i in range(splits)
    ]


def equal_depth_predicates(
    spec: ReportSpec,
    counts: dict[datetime, int],
    slices: int,
    split_column: str | None = None,
    column: str = "date_hour",
) -> list[str]:
    """Conditions that hold for exactly the rows of both periods, once each, and for about equally many.

    Hours are put together as long as they have no more than their share. One with more is divided by
    `split_column`. Hours without a count are covered, too: rows may have come since.
    """
    share = max(1, -(-sum(counts.values()) // slices))
    found = []
    for period in spec.periods:
        start, held, at = period.start, 0, period.start
        while at <= period.end:
            n = counts.get(at, 0)
            if held and held + n > share:
                found += split_predicates([_part(column, start, at)], split_column, -(-held // share))
                start, held = at, 0
            held += n
            at += timedelta(hours=1)
        if not period.empty:
            last = f"{column} >= {_literal(start)} AND {column} <= {_literal(period.end)}"
            found += split_predicates([last], split_column, -(-held // share))
    return found or ["1 = 0"]


def _part(column: str, start: datetime, end: datetime) -> str:
    return f"{column} >= {_literal(start)} AND {column} < {_literal(end)}"


def _slices(period: Period, column: str, step: timedelta) -> list[str]:
    found, start = [], period.start
    while start <= period.end:
        end = start + step
        if end > period.end:
            found.append(f"{column} >= {_literal(start)} AND {column} <= {_literal(period.end)}")
        else:
            found.append(_part(column, start, end))
        start = end
    return found


def _literal(moment: datetime) -> str:
    return f"TIMESTAMP '{moment.isoformat(sep=' ')}'"
