"""Known faults put into a copy of a table, and the truth about them.

A fault is chosen by a predicate and, where a fixed number of rows is wanted, by the first or
last ``count`` rows of a total order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import exact
from crosstally.functions.periods import as_timestamp, iso_text
from crosstally.functions.types import quoted, require_columns


def pick_rows(
    df: DataFrame,
    where: Column,
    order_by: Sequence[str] = (),
    count: int | None = None,
    last: bool = False,
) -> DataFrame:
    """The rows a fault will touch.

    With ``count`` the rows are the first (or last) of ``order_by``, which must be a total
    order; Spark keeps only ``count`` rows per task while choosing.
    """
    chosen = df.where(where)
    if count is None:
        return chosen
    if count < 0 or not order_by:
        raise ReconcileInputError("count needs order_by and must not be negative")
    require_columns(df, order_by)
    order = [quoted(c).desc_nulls_last() if last else quoted(c).asc_nulls_first() for c in order_by]
    return chosen.orderBy(*order).limit(count)


def inject_missing(df: DataFrame, picked: DataFrame, key: str) -> DataFrame:
    """``df`` without the picked keys; use ``drop_rows`` where a predicate says it all."""
    return df.join(picked.select(key), key, "left_anti").select(*df.columns)


def inject_duplicates(df: DataFrame, picked: DataFrame) -> DataFrame:
    """``df`` with the picked rows appended once more."""
    return df.unionByName(picked.select(*df.columns))


def inject_drift(
    df: DataFrame, picked: DataFrame, key: str, metric: str, amount: float, scale: int | None = None
) -> DataFrame:
    """``amount`` added to ``metric`` on the picked keys."""
    marked = df.join(
        picked.select(quoted(key).alias("__picked")).distinct(), quoted(key) == F.col("__picked"), "left"
    )
    moved = quoted(metric) + F.lit(amount)
    if scale is not None:
        moved = F.round(moved, scale)
    return marked.withColumn(
        metric, F.when(F.col("__picked").isNotNull(), moved).otherwise(quoted(metric))
    ).select(*df.columns)


def drop_rows(df: DataFrame, where: Column) -> DataFrame:
    """Missing rows chosen by a predicate alone: a filter, no join."""
    return df.where(~F.coalesce(where, F.lit(False)))


def drift_rows(df: DataFrame, where: Column, metric: str, amount: float, scale: int = 2) -> DataFrame:
    """Value drift chosen by a predicate alone: a projection, no join."""
    return df.withColumn(
        metric, F.when(where, F.round(quoted(metric) + F.lit(amount), scale)).otherwise(quoted(metric))
    )


def blank_values(df: DataFrame, where: Column, column: str) -> DataFrame:
    """Null in ``column`` where the predicate holds."""
    return df.withColumn(column, F.when(~F.coalesce(where, F.lit(False)), quoted(column)))


def inject_offsetting(
    df: DataFrame, missing: DataFrame, duplicated: DataFrame, key: str
) -> DataFrame:
    """Missing rows and as many extra copies of other rows, so that row counts agree."""
    return inject_duplicates(inject_missing(df, missing, key), duplicated)


def injection_truth(
    picked: DataFrame,
    fault: str,
    metric: str,
    segment: str,
    date: str,
    drift: float | None = None,
    scale: int | None = 2,
) -> DataFrame:
    """One row: how many rows a fault touches, what they are worth, their segments and period.

    For drift the amount is the signed effect on source minus warehouse.
    """
    value = exact(quoted(metric), picked.schema[metric].dataType, scale)
    when = as_timestamp(picked, date)
    amount = (
        F.coalesce(F.sum(value), F.lit(0)).cast("double")
        if drift is None
        else F.count(F.lit(1)) * F.lit(-drift)
    )
    return picked.agg(
        F.count(F.lit(1)).alias("affected_record_count"),
        F.round(amount, 2).alias("affected_amount"),
        F.min(segment).alias("first_segment"),
        F.max(segment).alias("last_segment"),
        iso_text(F.min(when)).alias("period_start"),
        iso_text(F.max(when)).alias("period_end"),
    ).select(F.lit(fault).alias("fault"), "*")

