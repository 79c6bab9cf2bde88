"""Numbers as text. `format_number` rounds ties on the binary value; `format_string` does not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "N/A"

# Fixed patterns of the displayed values.
COUNT = "#,##0"
MONEY = "#,##0.00"
MILLS = "0.000"
TENTH_OF_MILLS = "0.0000"
SIGNED_PERCENT = "+0.0;-0.0"


def formatted(value: Column, pattern: str) -> Column:
    # The Python function takes a number of decimals only; a pattern goes by name.
    return F.call_function("format_number", value.cast("double"), F.lit(pattern))


def number(value: Column, pattern: str, before: str = "", after: str = "") -> Column:
    value = value.cast("double")
    text = F.concat(F.lit(before), formatted(value, pattern), F.lit(after))
    return F.when(value.isNull() | F.isnan(value), F.lit(MISSING)).otherwise(text)


def count(value: Column) -> Column:
    return number(value, COUNT)


def money(value: Column, pattern: str = MONEY) -> Column:
    return number(value, pattern, before="$")


def percent_change(value: Column) -> Column:
    return number(value, SIGNED_PERCENT, after="%")


def display_table(df: DataFrame) -> DataFrame:
    """Percent columns first, then money, then any other number; text stays as it is."""
    return df.select([_cell(field).alias(field.name) for field in df.schema.fields])


def _cell(field: T.StructField) -> Column:
    value = F.col(field.name)
    if "pct_diff" in field.name:
        return percent_change(value)
    if "revenue" in field.name:
        return money(value)
    if isinstance(field.dataType, T.NumericType):
        return count(value)
    return value
