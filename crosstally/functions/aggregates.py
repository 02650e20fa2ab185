"""Aggregate expressions with the engine's null, empty and rounding rules."""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import column_class, quoted, require_columns

# The supported aggregations.
AGGREGATIONS = ("sum", "count", "mean")


def exact(column: Column, data_type: T.DataType, scale: int | None) -> Column:
    """The value to add up.

    Sums of doubles depend on row order, hence on partitioning. With ``scale`` (digits after
    the point, e.g. 2 for money) doubles are added as decimals, and every run and every cluster
    size gives the same digits. Four digits more than ``scale`` are kept, so values that have more
    digits than announced are not rounded before they are added. Values have up to 28 digits in all, sums
    up to 38. NaN counts as null.
    """
    if isinstance(data_type, T.BooleanType):
        return column.cast("long")
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        column = F.when(~F.isnan(column), column)
        return column if scale is None else column.cast(T.DecimalType(28, min(scale + 4, 18)))
    return column


def total(column: Column) -> Column:
    """Sum that is 0.0 for no rows or only nulls, rounded to 6 digits."""
    return F.round(F.coalesce(F.sum(column).cast("double"), F.lit(0.0)), 6)


def average(column: Column) -> Column:
    """Mean over non-null values, null when there are none, rounded to 6 digits."""
    return F.round(F.try_divide(F.sum(column).cast("double"), F.count(column)), 6)


def share_percent(part: Column, whole: Column) -> Column:
    """0-100 scale; 0.0 when the whole is zero."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        part.cast("double") / whole.cast("double") * F.lit(100.0)
    )


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def sum_where(condition: Column, value: Column) -> Column:
    """Sum of ``value`` over the rows where ``condition`` holds; 0 when there are none."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def require_aggregation(aggregation: str) -> str:
    name = aggregation.lower()
    if name not in AGGREGATIONS:
        raise ReconcileInputError(f"unknown aggregation: {aggregation}")
    return name


def aggregate_column(
    df: DataFrame, metric: str | None, aggregation: str, scale: int | None = None
) -> Column:
    """The aggregate expression for ``sum``, ``mean`` or ``count`` over ``metric``."""
    name = require_aggregation(aggregation)
    if name == "count" and metric is None:
        return F.count(F.lit(1))
    if metric is None:
        raise ReconcileInputError(f"{name} needs a metric column")
    require_columns(df, [metric])
    if name == "count":
        return F.count(exact(quoted(metric), df.schema[metric].dataType, None))
    if column_class(df, metric) not in ("numeric", "boolean"):
        raise ReconcileInputError(f"{name} needs a numeric metric: {metric}")
    value = exact(quoted(metric), df.schema[metric].dataType, scale)
    return total(value) if name == "sum" else average(value)


def named(columns: Mapping[str, Column]) -> list[Column]:
    """Report columns under their names."""
    return [column.alias(name) for name, column in columns.items()]


def merge_single_rows(*frames: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    stacked = functools.reduce(
        lambda x, y: x.unionByName(y, allowMissingColumns=True), frames
    )
    return stacked.agg(*[F.max(quoted(c)).alias(c) for c in stacked.columns])


def rows_from(df: DataFrame, *rows: list[Column]) -> DataFrame:
    """Turn each input row into ``len(rows)`` rows, each given as a list of aliased columns."""
    return df.select(F.inline(F.array(*[F.struct(*r) for r in rows])))
