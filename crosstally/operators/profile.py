"""Table and column profiles, and the column choices that follow from them.

The tall column profile is a small table (one row per column), whatever the data size.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import exact
from crosstally.functions.columns import (
    AMOUNT_WORDS,
    DATE_WORDS,
    DIMENSION_PRIORITY,
    FAVOURED_DIMENSION_WORDS,
    contains_any,
    contains_any_column,
    first_word_position,
    id_name_column,
    is_id_name,
)
from crosstally.functions.periods import as_timestamp
from crosstally.functions.types import column_class, nan_is_null, quoted, type_class
from crosstally.operators.duplicates import find_duplicates, groupable

# Thresholds of the profile rules.
IDENTIFIER_RATIO = 0.98
DATE_RATIO = 0.8
DISTINCT_MODES = ("exact", "auto", "approx")
ESTIMATE_ERROR = 0.02
LEAST_DIMENSION_VALUES = 2
MOST_DIMENSION_VALUES = 100


def _estimated_counts(df: DataFrame) -> dict[int, int]:
    """Distinct estimates of the columns whose exact count can decide nothing.

    An exact count matters for id-like names, near-unique columns (identifier, unique key) and
    small ones (dimension, constant); there is a wide margin around each threshold. One row
    comes to the driver, with two numbers per column at most.
    """
    found = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.approx_count_distinct(groupable(df, f.name), ESTIMATE_ERROR).alias(f"c{i}")
            for i, f in enumerate(df.schema.fields)
        ],
    ).first()
    margin = 10 * ESTIMATE_ERROR
    return {
        i: found[f"c{i}"]
        for i, name in enumerate(df.columns)
        if not is_id_name(name)
        and found[f"c{i}"] > 2 * MOST_DIMENSION_VALUES
        and found[f"c{i}"] < found["rows"] * IDENTIFIER_RATIO * (1 - margin)
    }


def _distinct_counts(df: DataFrame, skipped: Collection[int] = ()) -> DataFrame:
    """``position, distinct_values``: exact, nulls not counted.

    All columns are melted into (position, value) pairs with one typed slot per kind of value,
    so a single shuffle of de-duplicated narrow pairs serves every column, and a value that
    fills a third of a column is one pair per task. Texts are told apart by 128-bit hashes, so
    that long ones are not shuffled.
    """
    slots = {"numeric": "double", "long": "bigint", "text": "bigint", "more": "bigint"}

    def pair(position: int, field: T.StructField) -> Column:
        value, kind = quoted(field.name), type_class(field.dataType)
        whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if isinstance(field.dataType, whole) or kind == "boolean":
            slot, value = "long", value.cast("bigint")
        elif isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            slot, value = "numeric", value.cast("double")
        elif isinstance(field.dataType, T.DateType):
            slot, value = "long", F.unix_date(value).cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            slot, value = "long", F.unix_micros(value)
        elif kind in ("string", "numeric", "temporal"):
            slot, value = "text", value.cast("string")
        else:
            slot, value = "text", F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
        filled = {slot: value}
        if slot == "text":
            filled = {
                name: F.when(value.isNotNull(), F.xxhash64(F.lit(n), value))
                for n, name in enumerate(("text", "more"))
            }
        return F.struct(
            F.lit(position).alias("position"),
            *[
                filled.get(name, F.lit(None)).cast(spark_type).alias(name)
                for name, spark_type in slots.items()
            ],
        )

    melted = df.select(F.inline(
            F.array(*[pair(i, f) for i, f in enumerate(df.schema.fields) if i not in skipped])
        )
    )
    known = reduce(lambda x, y: x | y, [F.col(s).isNotNull() for s in slots])
    return melted.where(known).distinct().groupBy("position").agg(
        F.count(F.lit(1)).alias("distinct_values")
    )


def _is_date(df: DataFrame, column: str) -> Column:
    kind = column_class(df, column)
    if kind == "temporal":
        return F.lit(True)
    if kind != "string" or not contains_any(column, DATE_WORDS):
        return F.lit(False)
    parsed = F.count(as_timestamp(df, column)).cast("double")
    return F.coalesce(
        (F.count(quoted(column)) > 0) & (F.try_divide(parsed, F.count(F.lit(1))) >= DATE_RATIO),
        F.lit(False),
    )


@nan_is_null
def profile_columns(
    df: DataFrame, dataset: str, distinct: str = "exact", scale: int | None = None
) -> DataFrame:
    """One row per column: type, null and distinct counts, numeric summary and role flags.

    ``distinct="auto"`` is exact wherever a count decides a role and estimates the rest, which
    spares the shuffle of mid-sized value sets for a first pass of its own. ``"approx"``
    estimates everything in a single pass; near the thresholds flags may then be off.
    """
    if distinct not in DISTINCT_MODES:
        raise ReconcileInputError(f"distinct must be one of {', '.join(DISTINCT_MODES)}")
    estimates = _estimated_counts(df) if distinct == "auto" else {}
    exact_needed = distinct != "approx" and len(estimates) < len(df.columns)
    aggregates = [F.count(F.lit(1)).alias("row_count")]
    for i, field in enumerate(df.schema.fields):
        value = quoted(field.name)
        aggregates += [
            (F.count(F.lit(1)) - F.count(value)).alias(f"nulls_{i}"),
            _is_date(df, field.name).alias(f"date_{i}"),
        ]
        if type_class(field.dataType) == "numeric":
            added = F.sum(exact(value, field.dataType, scale)).cast("double")
            aggregates += [
                F.min(value).cast("double").alias(f"min_{i}"),
                F.max(value).cast("double").alias(f"max_{i}"),
                F.round(F.try_divide(added, F.count(value)), 6).alias(f"mean_{i}"),
                F.round(F.coalesce(added, F.lit(0.0)), 6).alias(f"sum_{i}"),
            ]
        if distinct == "approx":
            aggregates.append(F.approx_count_distinct(groupable(df, field.name)).alias(f"distinct_{i}"))
    measured = df.agg(*aggregates)

    def row(i: int, field: T.StructField) -> Column:
        numeric = type_class(field.dataType) == "numeric"

        def figure(name: str) -> Column:
            return (F.col(f"{name}_{i}") if numeric else F.lit(None).cast("double")).alias(name)

        return F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(i).alias("position"),
            F.lit(field.name).alias("column"),
            F.lit(field.dataType.simpleString()).alias("data_type"),
            F.col("row_count"),
            F.col(f"nulls_{i}").alias("null_count"),
            (
                F.col(f"distinct_{i}") if distinct == "approx"
                else F.lit(estimates.get(i, 0)).cast("long")
            ).alias("unique_count"),
            *[figure(n) for n in ("min", "max", "mean", "sum")],
            F.lit(numeric).alias("is_numeric"),
            F.col(f"date_{i}").alias("is_date"),
        )

    tall = measured.select(F.inline(F.array(*[row(i, f) for i, f in enumerate(df.schema.fields)])))
    if exact_needed:
        tall = tall.join(_distinct_counts(df, estimates), "position", "left").withColumn(
            "unique_count", F.coalesce("distinct_values", "unique_count")
        )
    identifier = (F.col("row_count") > 0) & (
        id_name_column(F.col("column"))
        | (F.coalesce(F.try_divide(F.col("unique_count"), F.col("row_count")), F.lit(0.0)) >= IDENTIFIER_RATIO)
    )
    return tall.withColumn("is_identifier", identifier).select(
        "dataset", "position", "column", "data_type", "row_count", "null_count", "unique_count",
        "min", "max", "mean", "sum", "is_numeric", "is_identifier", "is_date",
    )


@nan_is_null
def profile_table(df: DataFrame, dataset: str) -> DataFrame:
    """One row: ``dataset, row_count, duplicate_count`` (rows that take part in exact copies)."""
    return find_duplicates(df).select(
        F.lit(dataset).alias("dataset"), "row_count",
        F.col("duplicate_row_count").alias("duplicate_count"),
    )


def constant_columns(profile: DataFrame) -> DataFrame:
    """Columns with at most one value, which can separate nothing."""
    return profile.where(F.col("unique_count") <= 1)


def dimension_columns(profile: DataFrame) -> DataFrame:
    """Columns fit for segmenting, with both rankings (0 is best; ties go by name)."""
    fit = ~F.col("is_identifier") & ~F.col("is_date") & ~F.col("is_numeric") & F.col(
        "unique_count"
    ).between(LEAST_DIMENSION_VALUES, MOST_DIMENSION_VALUES)
    favoured = contains_any_column(F.col("column"), FAVOURED_DIMENSION_WORDS)
    return profile.where(fit).withColumn(
        "baseline_rank", F.when(favoured, 0).otherwise(1)
    ).withColumn("guide_rank", first_word_position(F.col("column"), DIMENSION_PRIORITY))


def amount_columns(profile: DataFrame) -> DataFrame:
    """Numeric columns named like money; the one at the lowest position is the choice."""
    return profile.where(F.col("is_numeric") & contains_any_column(F.col("column"), AMOUNT_WORDS))


def quality_review(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per dataset: duplicate rows and null cells, only where there are any."""
    nulls = columns.groupBy("dataset").agg(F.sum("null_count").alias("null_cell_count"))
    reviewed = tables.join(nulls, "dataset", "left").select(
        "dataset", "duplicate_count", F.coalesce("null_cell_count", F.lit(0)).alias("null_cell_count")
    )
    return reviewed.where((F.col("duplicate_count") > 0) | (F.col("null_cell_count") > 0))


def stack_profiles(profiles: Sequence[DataFrame]) -> DataFrame:
    """Profiles of several datasets as one table; the list order is kept in ``dataset_order``."""
    ordered = [p.withColumn("dataset_order", F.lit(i)) for i, p in enumerate(profiles)]
    return reduce(DataFrame.unionByName, ordered)
