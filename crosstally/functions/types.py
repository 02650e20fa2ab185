"""Schema-only checks: type classes, column presence, key compatibility.

Nothing here runs a Spark job.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError


def type_class(data_type: T.DataType) -> str:
    """Group Spark types into the classes inside which values can be compared."""
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in float columns, so that "missing" has one meaning everywhere."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(quoted(c)), quoted(c)).alias(c) if c in floats else quoted(c)
            for c in df.columns
        ]
    )


def nan_is_null(operator: Callable[..., Any]) -> Callable[..., Any]:
    """For public operators: every DataFrame they are given has null where it had NaN."""
    def cleaned(value: Any) -> Any:
        return nan_to_null(value) if isinstance(value, DataFrame) else value

    @functools.wraps(operator)
    def call(*args: Any, **options: Any) -> Any:
        return operator(*map(cleaned, args), **{k: cleaned(v) for k, v in options.items()})

    return call


def column_class(df: DataFrame, column: str) -> str:
    return type_class(df.schema[column].dataType)


def is_numeric(df: DataFrame, column: str) -> bool:
    return column_class(df, column) == "numeric"


def require_columns(df: DataFrame, columns: Iterable[str], dataset: str = "dataset") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ReconcileInputError(f"{dataset} has no column(s): {', '.join(missing)}")


def require_tolerance(tolerance: float) -> None:
    if tolerance < 0:
        raise ReconcileInputError("tolerance must not be negative")


def quoted(column: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col("`" + column.replace("`", "``") + "`")


def common_type(a: DataFrame, column_a: str, b: DataFrame, column_b: str) -> T.DataType:
    """The type Spark widens the two columns to; an error when their classes differ."""
    class_a, class_b = column_class(a, column_a), column_class(b, column_b)
    if class_a != class_b:
        raise ReconcileInputError(
            f"types differ: {column_a} is {class_a}, {column_b} is {class_b}"
        )
    return a.select(quoted(column_a)).union(b.select(quoted(column_b))).schema[0].dataType


def require_key_pair(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, name_a: str = "a", name_b: str = "b"
) -> T.DataType:
    """Check that both keys exist and can be compared; return their common type."""
    require_columns(a, [key_a], name_a)
    require_columns(b, [key_b], name_b)
    return common_type(a, key_a, b, key_b)
