"""How many records, how much money, which dates and which main segment an issue touches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import exact, merge_single_rows, share_percent, sum_where
from crosstally.functions.periods import as_timestamp, iso_text
from crosstally.functions.predicates import apply_filters
from crosstally.functions.types import column_class, nan_is_null, quoted, require_columns
from crosstally.operators.matching import restrict_to_unmatched

IMPACT_COLUMNS = (
    "affected_record_count", "total_record_count", "affected_percentage", "affected_amount_sum",
    "affected_date_start", "affected_date_end", "primary_segment", "primary_segment_record_count",
    "primary_segment_percentage",
)


@nan_is_null
def business_impact(
    dataset: DataFrame,
    amount: str | None = None,
    date: str | None = None,
    segment: str | None = None,
    filters: Sequence[Mapping[str, Any]] | None = None,
    match_against: DataFrame | None = None,
    local_key: str | None = None,
    other_key: str | None = None,
    only_unmatched: bool = False,
    date_format: str | None = None,
    scale: int | None = None,
) -> DataFrame:
    """One row. Figures that were not asked for are null; the total counts unfiltered rows.

    Affected rows are aggregated once, by segment; everything else is read off those groups.
    Equal segment sizes are settled by segment name.
    """
    require_columns(dataset, [c for c in (amount, date, segment) if c])
    if amount and column_class(dataset, amount) not in ("numeric", "boolean"):
        raise ReconcileInputError(f"amount must be numeric: {amount}")
    affected = apply_filters(dataset, filters)
    if only_unmatched:
        needed = [c for c in dict.fromkeys((local_key, amount, date, segment)) if c]
        require_columns(affected, needed)
        affected = restrict_to_unmatched(
            affected.select(*[quoted(c) for c in needed]), match_against, local_key, other_key
        )
    nothing = F.lit(None)
    value = exact(quoted(amount), dataset.schema[amount].dataType, scale) if amount else nothing.cast("double")
    when = as_timestamp(dataset, date, date_format) if date else nothing.cast("timestamp_ntz")
    label = quoted(segment).cast("string") if segment else nothing.cast("string")
    groups = affected.groupBy(label.alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("amount"),
        F.min(when).alias("first"), F.max(when).alias("last"),
    )
    largest = F.min_by(
        F.struct("segment", "n"),
        F.struct((-F.col("n")).alias("size"), F.col("segment").isNull().alias("blank"), "segment"),
    )
    measured = groups.agg(
        sum_where(F.lit(True), F.col("n")).alias("affected"),
        F.round(sum_where(F.lit(True), F.col("amount")).cast("double"), 2).alias("amount"),
        F.min("first").alias("first"), F.max("last").alias("last"), largest.alias("largest"),
    )
    whole = dataset.agg(F.count(F.lit(1)).alias("total"))
    figures = merge_single_rows(measured, whole)
    report = {
        "affected_record_count": F.col("affected"),
        "total_record_count": F.col("total"),
        "affected_percentage": share_percent(F.col("affected"), F.col("total")),
        "affected_amount_sum": F.col("amount") if amount else nothing.cast("double"),
        "affected_date_start": iso_text(F.col("first")),
        "affected_date_end": iso_text(F.col("last")),
        "primary_segment": F.col("largest.segment") if segment else nothing.cast("string"),
        "primary_segment_record_count": F.col("largest.n") if segment else nothing.cast("long"),
        "primary_segment_percentage": (
            share_percent(F.col("largest.n"), F.col("affected")) if segment else nothing.cast("double")
        ),
    }
    return figures.select(*[report[c].alias(c) for c in IMPACT_COLUMNS])
