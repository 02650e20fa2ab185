"""Tolerant dates, period buckets and ISO text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import column_class, quoted

# Accepted frequency names per bucket.
FREQUENCIES = {
    "day": ("d", "day", "daily"),
    "week": ("w", "week", "weekly"),
    "month": ("m", "month", "monthly"),
    "quarter": ("q", "quarter", "quarterly"),
    "year": ("y", "year", "yearly"),
}

#: Date forms that a column of texts may have, the first of equally good ones preferred. The first is ISO text.
ISO = "ISO"
DATE_FORMATS = (
    ISO, "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "M-d-yyyy", "d-M-yyyy", "yyyy/M/d", "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy",
    "d MMMM yyyy", "MMMM d, yyyy",
)
#: Asks for the form that most values of the column have.
ELECTED = "elected"
_TIME = "[['T'][ ]H:mm[:ss[.SSS]]]"

_OFFSET = r"^\s*\d{4}-\d{1,2}-\d{1,2}[ T]\d.*([zZ]|[+-]\d{1,2}(:?\d{2})?)\s*$"
_ISO_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"


def frequency_unit(frequency: str) -> str:
    wanted = frequency.strip().lower()
    for unit, names in FREQUENCIES.items():
        if wanted in names:
            return unit
    raise ReconcileInputError(
        f"unknown date frequency {frequency!r}; use day, week, month, quarter or year"
    )


def _iso(value: Column) -> Column:
    # A text with an offset names a moment: it is told in UTC, as texts without one are.
    moment = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), value.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(value.rlike(_OFFSET), moment).when(
        value.rlike(_ISO_DATE), value.try_cast("timestamp_ntz")
    )


def _in_format(value: Column, date_format: str) -> Column:
    if date_format == ISO:
        return _iso(value)
    time = "" if date_format == "yyyyMMdd" else _TIME
    pattern = date_format + time if date_format in DATE_FORMATS else date_format
    return F.try_to_timestamp(F.trim(value) if time else value, F.lit(pattern)).cast("timestamp_ntz")


def date_formats(df: DataFrame, column: str) -> DataFrame:
    """``date_format, value_count, parsed_count, not_parsed_percentage``: how far each form fits the texts.

    One aggregate over the column, one row per form, the best first; values are the texts that are not blank.
    """
    if column_class(df, column) != "string":
        raise ReconcileInputError(f"dates are elected among texts: {column}")
    value = quoted(column)
    filled = F.length(F.trim(value)) > 0
    counted = df.agg(
        F.count_if(filled).alias("value_count"),
        *[F.count(_in_format(value, f)).alias(f"__{i}") for i, f in enumerate(DATE_FORMATS)],
    )
    told = counted.select(
        "value_count",
        F.posexplode(
            F.array(*[F.struct(F.lit(f).alias("date_format"), F.col(f"__{i}").alias("parsed_count")) for i, f in enumerate(DATE_FORMATS)])
        ).alias("place", "form"),
    )
    missed = F.when(F.col("value_count") == 0, F.lit(0.0)).otherwise(
        F.round((F.col("value_count") - F.col("form.parsed_count")) * 100.0 / F.nullif("value_count", F.lit(0)), 6)
    )
    return told.orderBy(F.desc("form.parsed_count"), "place").select(
        "form.date_format", "value_count", "form.parsed_count", missed.alias("not_parsed_percentage")
    )


def elected_format(df: DataFrame, column: str) -> str:
    """The form that fits most texts of the column; runs one aggregate and brings one name to the driver."""
    return date_formats(df, column).first()["date_format"]


def as_timestamp(df: DataFrame, column: str, date_format: str | None = None) -> Column:
    """The column as a timestamp, null where it is not a date.

    Strings must be ISO or have the ``date_format``, one of ``DATE_FORMATS`` (with a time of day or without) or any
    of Spark's patterns; ``ELECTED`` takes the form that fits most of them, which costs a job. Other types than
    string and date are null.
    """
    value, cls = quoted(column), column_class(df, column)
    if cls == "temporal":
        return value.cast("timestamp_ntz")
    if cls != "string":
        return F.lit(None).cast("timestamp_ntz")
    if date_format == ELECTED:
        date_format = elected_format(df, column)
    return _in_format(value, date_format or ISO)


def period_start(timestamp: Column, unit: str) -> Column:
    return F.date_trunc(unit, timestamp).cast("date")


def period_label(start: Column, unit: str) -> Column:
    """Text label of a period given its first day."""
    if unit == "day":
        return F.date_format(start, "yyyy-MM-dd")
    if unit == "week":
        last = F.date_add(start, 6)
        return F.concat_ws(
            "/", F.date_format(start, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd")
        )
    if unit == "month":
        return F.date_format(start, "yyyy-MM")
    if unit == "quarter":
        return F.concat(F.year(start).cast("string"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.date_format(start, "yyyy")


def iso_text(timestamp: Column) -> Column:
    """``2024-08-23T10:00:00``, with microseconds only where there are any."""
    whole = F.date_trunc("second", timestamp) == timestamp
    return F.when(whole, F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
