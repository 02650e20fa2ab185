"""Totals, single values and whole rows of two tables compared.

Values are aligned by one tagged union grouped by key: a single shuffle, no join. A key that
repeats on a side collapses before the shuffle and is left out of the comparison, as the
pairing of its rows would be arbitrary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import (
    aggregate_column,
    count_where,
    exact,
    named,
    require_aggregation,
    rows_from,
    share_percent,
    sum_where,
)
from crosstally.functions.columns import shared_columns
from crosstally.functions.predicates import one_is_null, values_differ
from crosstally.functions.types import (
    nan_is_null,
    column_class,
    quoted,
    require_columns,
    require_key_pair,
    require_tolerance,
)
from crosstally.operators.matching import PREVIEW_ROWS


def aggregate_report(aggregation: str, a: Column, b: Column) -> dict[str, Column]:
    """The reported figures of an aggregate comparison, given both results."""
    signed = F.round(a.cast("double") - b.cast("double"), 6)
    percentage = F.when(b.cast("double") != 0, signed / F.abs(b.cast("double")) * 100)
    return {
        "aggregation": F.lit(aggregation),
        "dataset_a_result": a,
        "dataset_b_result": b,
        "absolute_difference": F.round(F.abs(signed), 6),
        "signed_difference_a_minus_b": signed,
        "percentage_difference_vs_b": F.round(percentage, 6),
    }


@nan_is_null
def compare_aggregates(
    a: DataFrame,
    b: DataFrame,
    metric_a: str | None = None,
    metric_b: str | None = None,
    aggregation: str = "sum",
    scale: int | None = None,
) -> DataFrame:
    """One row: the same aggregate on both tables, and how far apart the results are."""
    name = require_aggregation(aggregation)
    sides = a.agg(aggregate_column(a, metric_a, name, scale).alias("a")).unionByName(
        b.agg(aggregate_column(b, metric_b, name, scale).alias("b")), allowMissingColumns=True
    )
    both = sides.agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select(*named(aggregate_report(name, F.col("a"), F.col("b"))))


def _one(value: Column, data_type: T.DataType) -> Column:
    """Any value of a group that holds one non-null candidate."""
    ordered = (T.NumericType, T.BooleanType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return F.max(value) if isinstance(data_type, ordered) else F.first(value, ignorenulls=True)


@nan_is_null
def align_by_key(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    pairs: Sequence[tuple[str, str]],
    keep_null_keys: bool = False,
    digests: bool = False,
) -> DataFrame:
    """``key, rows_a, rows_b, is_pair, a0, b0, a1, b1, ...``: one row per key of either table.

    ``a<i>``/``b<i>`` hold the values of the i-th column pair and are meaningful where
    ``rows_a``/``rows_b`` is 1; ``is_pair`` tells that the key is unique on both sides. With
    ``digests`` texts are 128-bit digests, for callers that only ask whether two are equal: numbers
    are grouped by hash, where texts would have to be sorted.
    """
    key_type = require_key_pair(a, b, key_a, key_b)
    if not keep_null_keys:
        a, b = a.where(quoted(key_a).isNotNull()), b.where(quoted(key_b).isNotNull())
    side_a = a.select(
        quoted(key_a).cast(key_type).alias("key"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b"),
        *[quoted(x).alias(f"a{i}") for i, (x, _) in enumerate(pairs)],
    )
    side_b = b.select(
        quoted(key_b).cast(key_type).alias("key"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b"),
        *[quoted(y).alias(f"b{i}") for i, (_, y) in enumerate(pairs)],
    )
    tagged = side_a.unionByName(side_b, allowMissingColumns=True)
    texts = {
        name for i, (x, y) in enumerate(pairs) for name in (f"a{i}", f"b{i}")
        if digests and a.schema[x].dataType == b.schema[y].dataType == T.StringType()
    }

    def value(name: str) -> Column:
        if name not in texts:
            return _one(F.col(name), tagged.schema[name].dataType).alias(name)
        one, two = (
            F.max(F.when(F.col(name).isNotNull(), F.xxhash64(F.lit(n), F.col(name)))) for n in (1, 2)
        )
        return F.when(one.isNotNull(), F.struct(one.alias("one"), two.alias("two"))).alias(name)

    values = [value(name) for i in range(len(pairs)) for name in (f"a{i}", f"b{i}")]
    aligned = tagged.groupBy("key").agg(
        F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b"), *values
    )
    once = F.col("key").isNotNull() & (F.col("rows_a") == 1) & (F.col("rows_b") == 1)
    return aligned.withColumn("is_pair", once)


def repeated_measures(prefix: str = "") -> list[Column]:
    return [
        sum_where(F.col("key").isNotNull() & (F.col(rows) > 1), F.col(rows)).alias(
            f"{prefix}duplicate_key_record_count_{side}"
        )
        for side, rows in (("a", "rows_a"), ("b", "rows_b"))
    ]


def comparison_type(a: DataFrame, b: DataFrame, column_a: str, column_b: str) -> str:
    """``numeric`` for two numbers or a number and a boolean (1 or 0), else ``exact``."""
    classes = {column_class(a, column_a), column_class(b, column_b)}
    return "numeric" if "numeric" in classes <= {"numeric", "boolean"} else "exact"


def pair_differs(
    a: DataFrame, b: DataFrame, column_a: str, column_b: str, x: Column, y: Column,
    tolerance: float,
) -> Column:
    """Mismatch of two aligned values; values of different type classes are never equal."""
    numeric = comparison_type(a, b, column_a, column_b) == "numeric"
    if not numeric and column_class(a, column_a) != column_class(b, column_b):
        return ~(x.isNull() & y.isNull())
    return values_differ(x, y, numeric, tolerance)


def value_measures(
    a: DataFrame, b: DataFrame, column_a: str, column_b: str, index: int, tolerance: float,
    scale: int | None, prefix: str = "",
) -> list[Column]:
    """Aggregates over :func:`align_by_key` that compare column pair ``index``."""
    x, y = F.col(f"a{index}"), F.col(f"b{index}")
    differs = F.col("is_pair") & pair_differs(a, b, column_a, column_b, x, y, tolerance)
    return [
        count_where(F.col("is_pair")).alias(f"{prefix}matched_unique_key_count"),
        count_where(differs).alias(f"{prefix}value_mismatch_count"),
        *difference_measures(a, b, column_a, column_b, index, tolerance, scale, prefix),
    ]


def difference_measures(
    a: DataFrame, b: DataFrame, column_a: str, column_b: str, index: int, tolerance: float,
    scale: int | None, prefix: str = "",
) -> list[Column]:
    """The part of :func:`value_measures` that :func:`row_measures` does not give."""
    x, y = F.col(f"a{index}"), F.col(f"b{index}")
    differs = F.col("is_pair") & pair_differs(a, b, column_a, column_b, x, y, tolerance)
    measures = [
        count_where(F.col("is_pair") & one_is_null(x, y)).alias(f"{prefix}null_value_mismatch_count"),
        count_where(F.col("is_pair") & x.isNull() & y.isNull()).alias(f"{prefix}both_null_equal_count"),
    ]
    if comparison_type(a, b, column_a, column_b) != "numeric":
        nothing = F.max(F.lit(None).cast("double"))
        return [
            *measures,
            nothing.alias(f"{prefix}signed_difference_a_minus_b"),
            nothing.alias(f"{prefix}absolute_difference_sum"),
        ]
    delta = exact(x, a.schema[column_a].dataType, scale) - exact(
        y, b.schema[column_b].dataType, scale
    )
    return [
        *measures,
        F.round(sum_where(differs, delta).cast("double"), 6).alias(
            f"{prefix}signed_difference_a_minus_b"
        ),
        F.round(sum_where(differs, F.abs(delta)).cast("double"), 6).alias(
            f"{prefix}absolute_difference_sum"
        ),
    ]


def value_report(
    compared_as: str, prefix: str = "", matched: Column | None = None, mismatches: Column | None = None
) -> dict[str, Column]:
    """The reported figures, read from :func:`value_measures` output.

    ``matched`` and ``mismatches`` stand in for measures that are there under another name: one measure under
    several names makes Spark derive constraints for every combination of them.
    """
    matched = F.col(f"{prefix}matched_unique_key_count") if matched is None else matched
    mismatches = F.col(f"{prefix}value_mismatch_count") if mismatches is None else mismatches
    measured = (
        "null_value_mismatch_count", "both_null_equal_count", "signed_difference_a_minus_b",
        "absolute_difference_sum",
    )
    return {
        "matched_unique_key_count": matched,
        "equal_value_count": matched - mismatches,
        "value_mismatch_count": mismatches,
        "value_mismatch_percentage": share_percent(mismatches, matched),
        **{name: F.col(f"{prefix}{name}") for name in measured},
        "comparison_type": F.lit(compared_as),
    }


def _checked_value_pair(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, value_a: str, value_b: str, tolerance: float
) -> str:
    require_tolerance(tolerance)
    if key_a == value_a or key_b == value_b:
        raise ReconcileInputError("key and value must be different columns")
    require_columns(a, [key_a, value_a], "a")
    require_columns(b, [key_b, value_b], "b")
    return comparison_type(a, b, value_a, value_b)


@nan_is_null
def compare_values(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    value_a: str,
    value_b: str,
    tolerance: float = 0.0,
    scale: int | None = None,
) -> DataFrame:
    """One row: agreement of one value column over the keys that are unique on both sides."""
    compared_as = _checked_value_pair(a, b, key_a, key_b, value_a, value_b, tolerance)
    measured = align_by_key(a, b, key_a, key_b, [(value_a, value_b)]).agg(
        *value_measures(a, b, value_a, value_b, 0, tolerance, scale), *repeated_measures()
    )
    return measured.select(
        *named(value_report(compared_as)), "duplicate_key_record_count_a", "duplicate_key_record_count_b"
    )


@nan_is_null
def value_mismatches(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    value_a: str,
    value_b: str,
    tolerance: float = 0.0,
) -> DataFrame:
    """All differing keys: ``key, dataset_a_value, dataset_b_value, difference_a_minus_b``."""
    compared_as = _checked_value_pair(a, b, key_a, key_b, value_a, value_b, tolerance)
    x, y = F.col("a0"), F.col("b0")
    difference = F.lit(None).cast("double")
    if compared_as == "numeric":
        difference = F.round(x.cast("double") - y.cast("double"), 6)
    aligned = align_by_key(a, b, key_a, key_b, [(value_a, value_b)])
    differs = pair_differs(a, b, value_a, value_b, x, y, tolerance)
    return aligned.where(F.col("is_pair") & differs).select(
        "key",
        x.alias("dataset_a_value"),
        y.alias("dataset_b_value"),
        difference.alias("difference_a_minus_b"),
    )


def value_mismatch_preview(*arguments, limit: int = PREVIEW_ROWS, **options) -> DataFrame:
    """The first ``limit`` rows of :func:`value_mismatches` in key order."""
    return value_mismatches(*arguments, **options).orderBy("key").limit(limit)


def row_columns(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, columns: Sequence[str] | None
) -> list[str]:
    """The compared columns: the caller's, checked, or all that both tables share."""
    require_columns(a, [key_a], "a")
    require_columns(b, [key_b], "b")
    chosen = list(columns) if columns else shared_columns(a, b, key_a, key_b)
    if not chosen:
        raise ReconcileInputError("the tables share no value columns")
    if any(not isinstance(c, str) or not c for c in chosen):
        raise ReconcileInputError("compared columns must be non-empty names")
    if len(set(chosen)) < len(chosen):
        raise ReconcileInputError("compared columns must not repeat")
    if {key_a, key_b} & set(chosen):
        raise ReconcileInputError("compared columns must not include a key")
    require_columns(a, chosen, "a")
    require_columns(b, chosen, "b")
    return chosen


def _differences(
    a: DataFrame, b: DataFrame, columns: Sequence[str], tolerance: float
) -> list[Column]:
    return [
        F.col("is_pair") & pair_differs(a, b, c, c, F.col(f"a{i}"), F.col(f"b{i}"), tolerance)
        for i, c in enumerate(columns)
    ]


def any_of(conditions: Sequence[Column]) -> Column:
    found = F.lit(False)
    for condition in conditions:
        found = found | condition
    return found


def row_measures(
    a: DataFrame, b: DataFrame, columns: Sequence[str], tolerance: float, prefix: str = ""
) -> list[Column]:
    """Aggregates over :func:`align_by_key` with one column pair per compared column."""
    differs = _differences(a, b, columns, tolerance)
    return [
        count_where(F.col("is_pair")).alias(f"{prefix}matched_unique_key_count"),
        count_where(any_of(differs)).alias(f"{prefix}record_mismatch_count"),
        *[count_where(d).alias(f"{prefix}mismatch_{i}") for i, d in enumerate(differs)],
    ]


def _row_comparison(a, b, key_a, key_b, columns, tolerance):
    require_tolerance(tolerance)
    chosen = row_columns(a, b, key_a, key_b, columns)
    aligned = align_by_key(a, b, key_a, key_b, [(c, c) for c in chosen], digests=True)
    return chosen, aligned


@nan_is_null
def compare_rows(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    columns: Sequence[str] | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """One row: in how many uniquely matched records any of the compared columns differs."""
    chosen, aligned = _row_comparison(a, b, key_a, key_b, columns, tolerance)
    measured = aligned.agg(*row_measures(a, b, chosen, tolerance), *repeated_measures())
    return measured.select(
        F.array(*[F.lit(c) for c in chosen]).alias("columns_compared"),
        "matched_unique_key_count",
        "record_mismatch_count",
        "duplicate_key_record_count_a",
        "duplicate_key_record_count_b",
    )


@nan_is_null
def row_mismatches_by_column(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    columns: Sequence[str] | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """Tall form: ``column, comparison_type, mismatch_count`` for every compared column."""
    chosen, aligned = _row_comparison(a, b, key_a, key_b, columns, tolerance)
    measured = aligned.agg(*row_measures(a, b, chosen, tolerance))
    return rows_from(
        measured,
        *[
            [
                F.lit(c).alias("column"),
                F.lit(comparison_type(a, b, c, c)).alias("comparison_type"),
                F.col(f"mismatch_{i}").alias("mismatch_count"),
            ]
            for i, c in enumerate(chosen)
        ],
    )


@nan_is_null
def mismatched_keys(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    columns: Sequence[str] | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """Every differing key with the names of its differing columns."""
    chosen, aligned = _row_comparison(a, b, key_a, key_b, columns, tolerance)
    differs = _differences(a, b, chosen, tolerance)
    names = F.concat_ws(",", *[F.when(d, F.lit(c)) for d, c in zip(differs, chosen)])
    return aligned.where(any_of(differs)).select("key", names.alias("differing_columns"))
