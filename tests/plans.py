"""Reading physical plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def planned(df: DataFrame) -> str:
    """The plan before it runs, as one tree."""
    return df._jdf.queryExecution().executedPlan().toString()


def ran(df: DataFrame) -> str:
    """The plan as adaptive execution ended it."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def scans(plan: str, of: str) -> int:
    return len(re.findall(rf"FileScan parquet [^\n]*{of}", plan))


def hash_exchanges(plan: str) -> int:
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition")
