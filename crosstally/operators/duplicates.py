"""Exact duplicate rows and repeated keys.

``duplicate_row_count`` counts *participants*: every row of a group with more than one member.
A repeated key alone is not an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.functions.aggregates import share_percent, sum_where
from crosstally.functions.types import nan_is_null, quoted, require_columns
from crosstally.operators.matching import PREVIEW_ROWS


def _checked(df: DataFrame, key_columns: Sequence[str] | None) -> list[str]:
    columns = list(dict.fromkeys(key_columns)) if key_columns else list(df.columns)
    require_columns(df, columns)
    return columns


def groupable(df: DataFrame, column: str) -> Column:
    """The column itself, or JSON text for types Spark cannot group by."""
    value = quoted(column)
    if "map<" in df.schema[column].dataType.simpleString():
        return F.to_json(F.struct(value.alias("m"))).alias(column)
    return value.alias(column)


@nan_is_null
def repeated_groups(df: DataFrame, key_columns: Sequence[str] | None = None) -> DataFrame:
    """Each repeated combination once, with its number of rows in ``copies``; nulls equal nulls.

    Copies collapse before the shuffle, so a group holding a third of all rows is no hot spot.
    """
    columns = _checked(df, key_columns)
    counted = df.groupBy(*[groupable(df, c) for c in columns]).agg(
        F.count(F.lit(1)).alias("copies")
    )
    return counted.where(F.col("copies") > 1)


def row_digest(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """128 bits that name a row's values: two hashes of the columns with different beginnings."""
    values = [groupable(df, c) for c in columns]
    missing = F.array(*[v.isNull() for v in values])
    return [
        F.xxhash64(F.lit(n), missing, *values).alias(f"__digest_{n}") for n in (1, 2)
    ]


@nan_is_null
def find_duplicates(df: DataFrame, key_columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``analysis_type, checked_columns, row_count, duplicate_row_count, ...``.

    Without ``key_columns`` whole rows are compared. Rows of any width are counted by a 128-bit digest, so
    long texts are not shuffled, and copies collapse before the shuffle.
    """
    columns = _checked(df, key_columns)
    digest = row_digest(df, columns)
    counted = df.select(*digest).groupBy("__digest_1", "__digest_2").agg(F.count(F.lit(1)).alias("copies"))
    found = counted.agg(
        sum_where(F.lit(True), F.col("copies")).alias("row_count"),
        sum_where(F.col("copies") > 1, F.col("copies")).alias("duplicate_row_count"),
        F.count_if(F.col("copies") > 1).alias("repeated_group_count"),
    )
    return found.select(
        F.lit("repeated_key" if key_columns else "exact_row").alias("analysis_type"),
        F.array(*[F.lit(c) for c in columns]).alias("checked_columns"),
        "row_count",
        "duplicate_row_count",
        "repeated_group_count",
        share_percent(F.col("duplicate_row_count"), F.col("row_count")).alias(
            "duplicate_percentage"
        ),
    )


def duplicate_preview(
    df: DataFrame, key_columns: Sequence[str] | None = None, limit: int = PREVIEW_ROWS
) -> DataFrame:
    """The first repeated groups in column order, with their multiplicity."""
    groups = repeated_groups(df, key_columns)
    return groups.orderBy(*[quoted(c) for c in groups.columns if c != "copies"]).limit(limit)


@nan_is_null
def duplicate_rows(df: DataFrame, key_columns: Sequence[str]) -> DataFrame:
    """All rows taking part in repeated keys (rows with a null key part included)."""
    columns = _checked(df, key_columns)
    # Structs compare field by field with null equal to null, which a plain equi-join is not.
    key = F.struct(*[groupable(df, c) for c in columns]).alias("__key")
    groups = df.select(key).groupBy("__key").agg(F.count(F.lit(1)).alias("copies"))
    repeated = groups.where(F.col("copies") > 1).select("__key")
    rows = df.select(key, *[quoted(c) for c in df.columns])
    return rows.join(repeated, "__key", "left_semi").drop("__key")
