"""Which keys of one table have no counterpart in the other.

Counts come from one tagged union grouped by key: both inputs are scanned once, only keys are
shuffled, and repeated keys shrink before the shuffle. Whole unmatched rows come from an anti
join against distinct keys, whose heavy side Spark's skew join splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import (
    count_where,
    named,
    rows_from,
    share_percent,
    sum_where,
)
from crosstally.functions.columns import detail_columns
from crosstally.functions.types import nan_is_null, quoted, require_columns, require_key_pair

# Fixed value: rows shown in a preview.
PREVIEW_ROWS = 10


@nan_is_null
def key_counts(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``key, rows_a, rows_b``: one row per key found on either side (null is one key)."""
    key_type = require_key_pair(a, b, key_a, key_b)
    tagged = a.select(
        quoted(key_a).cast(key_type).alias("key"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")
    ).unionByName(
        b.select(
            quoted(key_b).cast(key_type).alias("key"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")
        )
    )
    return tagged.groupBy("key").agg(
        F.sum("in_a").alias("rows_a"), F.sum("in_b").alias("rows_b")
    )


def match_measures(own: str, other: str, prefix: str = "") -> list[Column]:
    """Aggregates over a per-key table that describe side ``own`` against side ``other``."""
    known, present = F.col("key").isNotNull(), F.col(own) > 0
    matched = known & present & (F.col(other) > 0)
    unmatched = known & present & (F.col(other) == 0)
    return [
        sum_where(known, F.col(own)).alias(f"{prefix}eligible_record_count"),
        sum_where(matched, F.col(own)).alias(f"{prefix}matched_count"),
        sum_where(unmatched, F.col(own)).alias(f"{prefix}unmatched_count"),
        count_where(unmatched).alias(f"{prefix}unmatched_unique_key_count"),
        sum_where(~known, F.col(own)).alias(f"{prefix}null_key_count"),
    ]


def match_report(prefix: str = "", limit: int = PREVIEW_ROWS) -> dict[str, Column]:
    """The reported match figures, read from :func:`match_measures` output.

    ``limit`` is the size of the preview that the sample figures speak of.
    """
    counts = (
        "eligible_record_count", "matched_count", "unmatched_count", "unmatched_unique_key_count",
        "null_key_count",
    )
    report = {name: F.col(f"{prefix}{name}") for name in counts}
    return {
        **report,
        "unmatched_percentage": share_percent(
            report["unmatched_count"], report["eligible_record_count"]
        ),
        "sample_is_complete": report["unmatched_unique_key_count"] <= limit,
        "sample_limit": F.lit(limit),
    }


@nan_is_null
def unmatched_summary(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, limit: int = PREVIEW_ROWS
) -> DataFrame:
    """One row: how many rows and keys of ``a`` have no counterpart in ``b``."""
    measured = key_counts(a, b, key_a, key_b).agg(*match_measures("rows_a", "rows_b"))
    return measured.select(*named(match_report(limit=limit)))


@nan_is_null
def unmatched_both_ways(
    a: DataFrame, b: DataFrame, key_a: str, key_b: str, limit: int = PREVIEW_ROWS
) -> DataFrame:
    """Two rows, ``a_without_b`` and ``b_without_a``, from a single pass over both tables."""
    measured = key_counts(a, b, key_a, key_b).agg(
        *match_measures("rows_a", "rows_b", "a_"), *match_measures("rows_b", "rows_a", "b_")
    )
    return rows_from(
        measured,
        [F.lit("a_without_b").alias("direction"), *named(match_report("a_", limit))],
        [F.lit("b_without_a").alias("direction"), *named(match_report("b_", limit))],
    )


@nan_is_null
def unmatched_rows(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """All rows of ``a`` whose non-null key does not occur in ``b``; columns as in ``a``."""
    key_type = require_key_pair(a, b, key_a, key_b)
    rows = a.where(quoted(key_a).isNotNull()).withColumn("__key", quoted(key_a).cast(key_type))
    keys = (
        b.where(quoted(key_b).isNotNull())
        .select(quoted(key_b).cast(key_type).alias("__key"))
        .distinct()
    )
    return rows.join(keys, "__key", "left_anti").select(*[quoted(c) for c in a.columns])


@nan_is_null
def unmatched_preview(
    a: DataFrame,
    b: DataFrame,
    key_a: str,
    key_b: str,
    details: Sequence[str] | None = None,
    limit: int = PREVIEW_ROWS,
) -> DataFrame:
    """The first ``limit`` unmatched keys in key order, one row each, with context columns.

    Where a key has several rows the one with the smallest details is shown, nulls last. Keys are
    chosen from the key counts, so only rows of the shown keys are looked up.
    """
    wanted = detail_columns(a, key_a, details)
    keys = (
        key_counts(a, b, key_a, key_b)
        .where(F.col("key").isNotNull() & (F.col("rows_a") > 0) & (F.col("rows_b") == 0))
        .orderBy("key").limit(limit)
    )
    if not wanted:
        return keys.orderBy("key").select(F.col("key").alias(key_a))
    key_type = keys.schema["key"].dataType
    rows = a.select(
        quoted(key_a).cast(key_type).alias("__key"),
        quoted(key_a).alias("__own_key"),
        F.struct(
            *[x for i, c in enumerate(wanted) for x in (quoted(c).isNull().alias(f"n{i}"), quoted(c).alias(f"d{i}"))]
        ).alias("__details"),
    )
    # Spark broadcasts the chosen keys by itself, as the limit bounds their number.
    shown = rows.join(keys.select(F.col("key").alias("__key")), "__key", "left_semi")
    first = shown.groupBy("__own_key").agg(F.min("__details").alias("__details"))
    return first.orderBy("__own_key").select(
        F.col("__own_key").alias(key_a),
        *[F.col("__details")[f"d{i}"].alias(c) for i, c in enumerate(wanted)],
    )


def restrict_to_unmatched(
    df: DataFrame,
    match_against: DataFrame | None,
    local_key: str | None,
    other_key: str | None,
) -> DataFrame:
    """The ``only_unmatched`` option shared by segment and impact analysis."""
    if match_against is None or not local_key or not other_key:
        raise ReconcileInputError("only_unmatched needs match_against, local_key and other_key")
    require_columns(df, [local_key])
    require_columns(match_against, [other_key], "match_against")
    return unmatched_rows(df, match_against, local_key, other_key)
