"""The signed bridge between two totals.

``total(A) - total(B)`` is split into keys found on one side only, extra exact copies of rows
that both sides have, the rest of the difference on shared keys, and rows without a key.

One scan of each input: rows are counted per fingerprint (key, metric and every other shared
column; null equals null), and the key figures come from those counts. Exact copies collapse
before the first shuffle, and the many fingerprints of a heavy key before the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import count_where, exact, rows_from, sum_where
from crosstally.functions.columns import shared_columns
from crosstally.functions.types import (
    nan_is_null,
    column_class,
    common_type,
    quoted,
    require_columns,
    require_key_pair,
    require_tolerance,
)
from crosstally.operators.duplicates import groupable
from crosstally.operators.matching import PREVIEW_ROWS, key_counts

# The default closing tolerance and the smallest residual worth a bridge row.
DEFAULT_TOLERANCE = 0.01
SHOWN_RESIDUAL = 0.01


@nan_is_null
def fingerprint_counts(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, metric_a: str, metric_b: str
) -> DataFrame:
    """``key, metric, c0, c1, ..., count_a, count_b``: one row per distinct row of either side."""
    require_columns(a, [key_a, metric_a], "a")
    require_columns(b, [key_b, metric_b], "b")
    if not {column_class(a, metric_a), column_class(b, metric_b)} <= {"numeric", "boolean"}:
        raise ReconcileInputError("bridge metrics must be numeric on both sides")
    key_type = require_key_pair(a, b, key_a, key_b)
    context = shared_columns(a, b, key_a, key_b, metric_a, metric_b)
    for column in context:
        common_type(a, column, b, column)

    def side(df: DataFrame, key: str, metric: str, in_a: int) -> DataFrame:
        value = quoted(metric).cast("long") if column_class(df, metric) == "boolean" else quoted(metric)
        return df.select(
            quoted(key).cast(key_type).alias("key"), value.alias("metric"),
            *[groupable(df, c).alias(f"c{i}") for i, c in enumerate(context)],
            F.lit(in_a).alias("in_a"),
        )

    tagged = side(a, key_a, metric_a, 1).unionByName(side(b, key_b, metric_b, 0))
    names = ["key", "metric", *[f"c{i}" for i in range(len(context))]]
    return tagged.groupBy(*names).agg(
        F.sum("in_a").alias("count_a"), F.sum(1 - F.col("in_a")).alias("count_b")
    )


def _extra(own: str, other: str) -> Column:
    """Surplus copies on one side of a keyed row that both sides have."""
    both = F.col("key").isNotNull() & (F.col(own) > 0) & (F.col(other) > 0)
    return F.when(both, F.greatest(F.col(own) - F.col(other), F.lit(0))).otherwise(0)


def _key_figures(counts: DataFrame, scale: int | None) -> DataFrame:
    """Rows, metric sums and surplus copies per key and side."""
    value = F.coalesce(exact(F.col("metric"), counts.schema["metric"].dataType, scale), F.lit(0))
    aggregates = []
    for own, other in (("a", "b"), ("b", "a")):
        count, extra = F.col(f"count_{own}"), _extra(f"count_{own}", f"count_{other}")
        # Exact products are costly, and most rows are on one side or have no extra copies.
        aggregates += [
            F.sum(count).alias(f"rows_{own}"),
            sum_where(count > 0, value * count).alias(f"sum_{own}"),
            F.sum(extra).alias(f"extra_{own}"),
            sum_where(extra > 0, value * extra).alias(f"extra_sum_{own}"),
        ]
    return counts.groupBy("key").agg(*aggregates)


@nan_is_null
def bridge_summary(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    metric_a: str,
    metric_b: str,
    tolerance: float = DEFAULT_TOLERANCE,
    scale: int | None = None,
) -> DataFrame:
    """One row with every component of the difference and whether it closes.

    ``reconciliation_residual`` equals the metric on rows without a key, which belongs to no
    record set; ``null_key_metric_difference_a_minus_b`` names it.
    """
    require_tolerance(tolerance)
    counts = fingerprint_counts(a, b, key_a, key_b, metric_a, metric_b)
    keyed, in_a, in_b = F.col("key").isNotNull(), F.col("rows_a") > 0, F.col("rows_b") > 0
    always, only = F.lit(True), {"a": keyed & in_a & ~in_b, "b": keyed & in_b & ~in_a}
    shared = keyed & in_a & in_b
    aggregates = []
    for side in ("a", "b"):
        value, extra = F.col(f"sum_{side}"), F.col(f"extra_{side}")
        aggregates += [
            sum_where(always, value).alias(f"total_{side}"),
            count_where(only[side]).alias(f"only_keys_{side}"),
            sum_where(only[side], F.col(f"rows_{side}")).alias(f"only_rows_{side}"),
            sum_where(only[side], value).alias(f"only_sum_{side}"),
            sum_where(shared, value).alias(f"shared_sum_{side}"),
            sum_where(always, extra).alias(f"extra_{side}"),
            count_where(extra > 0).alias(f"extra_keys_{side}"),
            sum_where(always, F.col(f"extra_sum_{side}")).alias(f"extra_sum_{side}"),
            sum_where(~keyed, value).alias(f"keyless_sum_{side}"),
            sum_where(~keyed, F.col(f"rows_{side}")).alias(f"keyless_rows_{side}"),
        ]
    sums = _key_figures(counts, scale).agg(*aggregates)

    def amount(name: str) -> Column:
        return F.round(F.col(name).cast("double"), 6)

    net = F.round(amount("total_a") - amount("total_b"), 6)
    shared_difference = F.round(amount("shared_sum_a") - amount("shared_sum_b"), 6)
    shared_rest = F.round(shared_difference - amount("extra_sum_a") + amount("extra_sum_b"), 6)
    explained = F.round(
        amount("only_sum_a") - amount("only_sum_b")
        + amount("extra_sum_a") - amount("extra_sum_b") + shared_rest,
        6,
    )
    figures = sums.select(
        "*",
        net.alias("net"), shared_difference.alias("shared"), shared_rest.alias("rest"),
        explained.alias("explained"), F.round(net - explained, 6).alias("open"),
    )
    columns = [
        amount("total_a").alias("dataset_a_total"),
        amount("total_b").alias("dataset_b_total"),
        F.col("net").alias("net_difference_a_minus_b"),
    ]
    for side in ("a", "b"):
        columns += [
            F.col(f"only_keys_{side}").alias(f"dataset_{side}_only_unique_key_count"),
            F.col(f"only_rows_{side}").alias(f"dataset_{side}_only_row_count"),
            amount(f"only_sum_{side}").alias(f"dataset_{side}_only_metric_sum"),
            F.col(f"extra_{side}").alias(f"dataset_{side}_extra_exact_copy_count"),
            F.col(f"extra_keys_{side}").alias(f"dataset_{side}_extra_exact_copy_key_count"),
            amount(f"extra_sum_{side}").alias(f"dataset_{side}_extra_exact_copy_metric_sum"),
            (F.col(f"only_keys_{side}") <= PREVIEW_ROWS).alias(
                f"dataset_{side}_only_sample_is_complete"
            ),
            (F.col(f"extra_keys_{side}") <= PREVIEW_ROWS).alias(
                f"dataset_{side}_extra_sample_is_complete"
            ),
        ]
    return figures.select(
        *columns,
        F.col("shared").alias("shared_key_metric_difference_a_minus_b"),
        F.col("rest").alias("shared_key_residual_metric_difference_a_minus_b"),
        F.col("explained").alias("explained_difference_a_minus_b"),
        F.col("open").alias("reconciliation_residual"),
        F.round(amount("keyless_sum_a") - amount("keyless_sum_b"), 6).alias(
            "null_key_metric_difference_a_minus_b"
        ),
        (F.col("keyless_rows_a") + F.col("keyless_rows_b")).alias("null_key_row_count"),
        (F.abs("open") <= tolerance).alias("arithmetic_reconciles"),
        (F.abs("rest") <= tolerance).alias("fully_explained_by_key_gaps_and_exact_copies"),
        F.lit(
            ",".join([key_a, metric_a, *shared_columns(a, b, key_a, key_b, metric_a, metric_b)])
        ).alias("exact_copy_scope_columns"),
    )


def bridge_table(summary: DataFrame) -> DataFrame:
    """A :func:`bridge_summary` row as ``position, component, affected_count, signed_effect``.

    Components that affect nothing are left out; the last row is the net difference.
    """
    def entry(position: int, component: str, count: Column, effect: Column, shown: Column):
        return [
            F.lit(position).alias("position"),
            F.lit(component).alias("component"),
            count.cast("long").alias("affected_count"),
            effect.alias("signed_effect"),
            shown.alias("shown"),
        ]

    def counted(position: int, component: str, count: str, effect: Column):
        return entry(position, component, F.col(count), effect, F.col(count) > 0)

    nothing = F.lit(None)
    rest = F.col("shared_key_residual_metric_difference_a_minus_b")
    rows = rows_from(
        summary,
        counted(1, "keys_only_in_a", "dataset_a_only_unique_key_count",
                F.col("dataset_a_only_metric_sum")),
        counted(2, "keys_only_in_b", "dataset_b_only_unique_key_count",
                -F.col("dataset_b_only_metric_sum")),
        counted(3, "extra_exact_copies_in_a", "dataset_a_extra_exact_copy_count",
                F.col("dataset_a_extra_exact_copy_metric_sum")),
        counted(4, "extra_exact_copies_in_b", "dataset_b_extra_exact_copy_count",
                -F.col("dataset_b_extra_exact_copy_metric_sum")),
        entry(5, "other_shared_key_differences", nothing, rest, F.abs(rest) > SHOWN_RESIDUAL),
        counted(6, "null_key", "null_key_row_count",
                F.col("null_key_metric_difference_a_minus_b")),
        entry(7, "net_difference", nothing, F.col("net_difference_a_minus_b"), F.lit(True)),
    )
    return rows.where("shown").drop("shown")


@nan_is_null
def extra_copies(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, metric_a: str, metric_b: str,
    side: str = "a",
) -> DataFrame:
    """Every row with surplus copies on ``side``: fingerprint, copy count and copied metric."""
    if side not in ("a", "b"):
        raise ReconcileInputError("side must be 'a' or 'b'")
    counts = fingerprint_counts(a, b, key_a, key_b, metric_a, metric_b)
    context = shared_columns(a, b, key_a, key_b, metric_a, metric_b)
    other = "b" if side == "a" else "a"
    extra = counts.withColumn("extra_copy_count", _extra(f"count_{side}", f"count_{other}"))
    return extra.where(F.col("extra_copy_count") > 0).select(
        "key",
        "extra_copy_count",
        "metric",
        F.round(F.col("metric").cast("double") * F.col("extra_copy_count"), 6).alias(
            "extra_metric_sum"
        ),
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(context)],
    )


def extra_copies_preview(*arguments, limit: int = PREVIEW_ROWS, **options) -> DataFrame:
    """The first ``limit`` rows of :func:`extra_copies` in fingerprint order, nulls last."""
    rows = extra_copies(*arguments, **options)
    order = ["key", "metric", *rows.columns[4:]]
    return rows.orderBy(*[quoted(c).asc_nulls_last() for c in order]).limit(limit)


@nan_is_null
def only_keys(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """All keys found on one side only: ``side, key, row_count``."""
    counts = key_counts(a, b, key_a, key_b).where(F.col("key").isNotNull())
    one_sided = counts.where((F.col("rows_a") == 0) | (F.col("rows_b") == 0))
    return one_sided.select(
        F.when(F.col("rows_b") == 0, "a").otherwise("b").alias("side"), "key",
        (F.col("rows_a") + F.col("rows_b")).alias("row_count"),
    )
