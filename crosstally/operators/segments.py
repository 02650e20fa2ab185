"""Totals by segment and period, and the segment in which two tables disagree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import (
    aggregate_column,
    merge_single_rows,
    require_aggregation,
    sum_where,
)
from crosstally.functions.periods import as_timestamp, frequency_unit, period_label, period_start
from crosstally.functions.predicates import apply_filters
from crosstally.functions.types import common_type, nan_is_null, quoted, require_columns
from crosstally.operators.matching import restrict_to_unmatched

# Size of a segment report unless the caller says otherwise.
DEFAULT_TOP = 20


@dataclass(frozen=True)
class SegmentResult:
    """``groups`` holds every group, ``top`` the largest by absolute value, ``summary`` one row."""

    groups: DataFrame
    top: DataFrame
    summary: DataFrame


def _periods_and_segments(
    rows: DataFrame,
    group_by: str | None,
    metric: str | None,
    aggregation: str,
    date_column: str | None,
    date_frequency: str,
    date_format: str | None,
    scale: int | None,
) -> DataFrame:
    """``value`` and ``record_count`` per segment and first day of a period (``__period``).

    Rows without a date form groups with a null period.
    """
    if not group_by and not date_column:
        raise ReconcileInputError("give group_by or date_column")
    if group_by and group_by == date_column:
        raise ReconcileInputError("group_by and date_column must differ")
    wanted = [c for c in (group_by, date_column, metric) if c]
    require_columns(rows, wanted)
    grouping: list[Column] = [quoted(group_by)] if group_by else []
    if date_column:
        unit = frequency_unit(date_frequency)
        start = period_start(as_timestamp(rows, date_column, date_format), unit)
        grouping.append(start.alias("__period"))
    return rows.groupBy(*grouping).agg(
        aggregate_column(rows, metric, aggregation, scale).alias("value"),
        F.count(F.lit(1)).alias("record_count"),
    )


def _labelled(
    groups: DataFrame, group_by: str | None, date_column: str | None, date_frequency: str
) -> DataFrame:
    """Groups with a period, labelled under the name of the date column."""
    columns = [quoted(group_by)] if group_by else []
    if date_column:
        groups = groups.where(F.col("__period").isNotNull())
        label = period_label(F.col("__period"), frequency_unit(date_frequency))
        columns.append(label.alias(date_column))
    return groups.select(*columns, "value", "record_count")


@nan_is_null
def segment_groups(
    rows: DataFrame,
    group_by: str | None,
    metric: str | None = None,
    aggregation: str = "count",
    date_column: str | None = None,
    date_frequency: str = "D",
    date_format: str | None = None,
    scale: int | None = None,
) -> DataFrame:
    """``value`` and ``record_count`` per segment and/or period; rows without a date are left out.

    Periods are grouped by their first day; only finished groups get a text label.
    """
    groups = _periods_and_segments(
        rows, group_by, metric, aggregation, date_column, date_frequency, date_format, scale
    )
    return _labelled(groups, group_by, date_column, date_frequency)


@nan_is_null
def segment_analysis(
    dataset: DataFrame,
    group_by: str | None,
    metric: str | None = None,
    aggregation: str = "count",
    filters: Sequence[Mapping[str, Any]] | None = None,
    date_column: str | None = None,
    date_frequency: str = "D",
    match_against: DataFrame | None = None,
    local_key: str | None = None,
    other_key: str | None = None,
    only_unmatched: bool = False,
    top_n: int = DEFAULT_TOP,
    date_format: str | None = None,
    scale: int | None = None,
) -> SegmentResult:
    """Filter, optionally keep only rows without a counterpart, then aggregate by segment.

    ``match_against`` matters only with ``only_unmatched``.
    """
    require_aggregation(aggregation)
    filtered = apply_filters(dataset, filters)
    rows = filtered
    if only_unmatched:
        # Only the columns the report needs travel through the anti join.
        needed = [c for c in dict.fromkeys((local_key, group_by, date_column, metric)) if c]
        require_columns(filtered, needed)
        rows = restrict_to_unmatched(
            filtered.select(*[quoted(c) for c in needed]), match_against, local_key, other_key
        )
    found = _periods_and_segments(
        rows, group_by, metric, aggregation, date_column, date_frequency, date_format, scale
    )
    groups = _labelled(found, group_by, date_column, date_frequency)
    keys = [quoted(c) for c in groups.columns if c not in ("value", "record_count")]
    if top_n < 1:
        raise ReconcileInputError("top_n must be 1 or more")
    limit = int(top_n)
    top = groups.orderBy(
        F.abs("value").desc_nulls_last(), *[k.asc_nulls_last() for k in keys]
    ).limit(limit)
    dated = F.col("__period").isNotNull() if date_column else F.lit(True)
    summary = found.agg(
        sum_where(dated, F.col("record_count")).alias("filtered_record_count"),
        F.count_if(dated).alias("result_count"),
        sum_where(F.lit(True), F.col("record_count")).alias("unmatched_records_analyzed"),
    ).withColumn("results_truncated", F.col("result_count") > limit)
    if only_unmatched:
        before = filtered.agg(F.count(F.lit(1)).alias("records_before_matching_filter"))
        summary = merge_single_rows(summary, before)
    else:
        summary = summary.drop("unmatched_records_analyzed")
    return SegmentResult(groups, top, summary)


@nan_is_null
def paired_segments(
    a: DataFrame,
    b: DataFrame,
    group_by: str,
    metric: str | None = None,
    aggregation: str = "sum",
    scale: int | None = None,
) -> DataFrame:
    """``segment, value_a, value_b, difference`` for every segment of either table.

    A segment missing on a side counts as 0 there. Each side is aggregated first, so only
    finished segment totals meet.
    """
    common_type(a, group_by, b, group_by)

    def side(df: DataFrame, name: str) -> DataFrame:
        groups = segment_groups(df, group_by, metric, aggregation, scale=scale)
        return groups.select(
            quoted(group_by).alias("segment"), F.col("value").cast("double").alias(name)
        )

    paired = side(a, "value_a").unionByName(side(b, "value_b"), allowMissingColumns=True)
    totals = paired.groupBy("segment").agg(
        F.coalesce(F.max("value_a"), F.lit(0.0)).alias("value_a"),
        F.coalesce(F.max("value_b"), F.lit(0.0)).alias("value_b"),
    )
    return totals.withColumn("difference", F.round(F.col("value_a") - F.col("value_b"), 6))


@nan_is_null
def localize_segment(
    a: DataFrame,
    b: DataFrame,
    group_by: str,
    metric: str | None = None,
    aggregation: str = "sum",
    scale: int | None = None,
) -> DataFrame:
    """The differing segments; ``is_localized`` when there is exactly one."""
    differing = paired_segments(a, b, group_by, metric, aggregation, scale).where(
        F.col("difference") != 0
    )
    count = differing.agg(F.count(F.lit(1))).scalar()
    return differing.withColumn("differing_segment_count", count).withColumn(
        "is_localized", F.col("differing_segment_count") == 1
    )


@nan_is_null
def localize_dimensions(
    a: DataFrame,
    b: DataFrame,
    dimensions: Sequence[str],
    metric: str | None = None,
    aggregation: str = "sum",
    scale: int | None = None,
) -> DataFrame:
    """One row per dimension: in how many of its segments the tables differ; the one that localises best first.

    ``dimension, rank, segment_count, differing_segment_count, is_localized, segment, difference``: the segment (as
    text) with the greatest difference, of equal ones the first, and null where none differs. A dimension with a
    single differing segment localises the gap; then come those with few of them, then those
    with none, which hide it.

    All dimensions are one pass: each row counts once per dimension, and segments shrink before the one shuffle.
    """
    names = list(dict.fromkeys(dimensions))
    if not names:
        raise ReconcileInputError("give at least one dimension")
    wanted = [*names, *([metric] if metric else [])]
    require_columns(a, wanted, "a")
    require_columns(b, wanted, "b")
    for name in names:
        common_type(a, name, b, name)

    def side(df: DataFrame, is_a: bool) -> DataFrame:
        segments = [F.struct(F.lit(n).alias("dimension"), quoted(n).cast("string").alias("segment")) for n in names]
        own = [quoted(metric).alias("metric")] if metric else []
        return df.select(F.inline(F.array(*segments)), *own).groupBy("dimension", "segment").agg(
            aggregate_column(df.select(*own) if own else df, "metric" if metric else None, aggregation, scale)
            .cast("double").alias("value_a" if is_a else "value_b")
        )

    paired = side(a, True).unionByName(side(b, False), allowMissingColumns=True)
    totals = paired.groupBy("dimension", "segment").agg(
        F.coalesce(F.max("value_a"), F.lit(0.0)).alias("value_a"),
        F.coalesce(F.max("value_b"), F.lit(0.0)).alias("value_b"),
    ).withColumn("difference", F.round(F.col("value_a") - F.col("value_b"), 6))
    differs = F.col("difference") != 0
    # The least is the greatest difference; a null segment comes after its equals.
    first = F.struct(
        (-F.abs("difference")).alias("size"), F.col("segment").isNull().alias("missing"), "segment", "difference"
    )
    found = totals.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("segment_count"), F.count_if(differs).alias("differing_segment_count"),
        F.min(F.when(differs, first)).alias("top"),
    )
    # One row per dimension, so a single window is small.
    order = Window.orderBy(F.col("differing_segment_count") == 0, "differing_segment_count", "dimension")
    return found.select(
        "dimension", F.row_number().over(order).alias("rank"), "segment_count", "differing_segment_count",
        (F.col("differing_segment_count") == 1).alias("is_localized"), F.col("top.segment").alias("segment"),
        F.col("top.difference").alias("difference"),
    )
