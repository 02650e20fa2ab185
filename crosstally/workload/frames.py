"""Source and warehouse tables derived from the given parquet tables.

``src`` is the order table under reconciliation names. The ``wh_*`` tables are the same orders
after known faults; each fault is a plain predicate, so it touches the same rows on any engine
and grows with the data.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.plans.injection import blank_values, drift_rows, drop_rows, inject_duplicates
from crosstally.sources.readers import read_parquet

DRIFT = 17.25


@lru_cache(maxsize=64)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The plan is kept per session, so that files are listed only once."""
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def src(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("order_priority"),
        F.col("o_totalprice").cast("double").alias("total_amount"),
    )


def between_days(first: str, last: str) -> Column:
    return F.col("order_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def is_missing() -> Column:
    """Urgent orders of the last month never arrived."""
    return (F.col("order_priority") == "1-URGENT") & (
        F.col("order_date") >= F.lit("2001-07-01").cast("date")
    )


def is_duplicated() -> Column:
    """Fulfilled orders of three loads were appended twice."""
    return (F.col("order_status") == "F") & (
        between_days("1995-01-01", "1995-01-31")
        | between_days("1996-12-25", "1996-12-31")
        | between_days("1997-06-01", "1997-06-05")
    )


def is_drifted() -> Column:
    """Large high-priority orders carry a wrong amount."""
    return (F.col("order_priority") == "2-HIGH") & (F.col("total_amount") >= 450000)


def lost_key() -> Column:
    return (F.month("order_date") == 12) & (F.dayofmonth("order_date") == 31)


def lost_priority() -> Column:
    return F.col("total_amount") < 10000


def lost_amount() -> Column:
    return between_days("1997-06-01", "1997-06-30")


def _with_flags(df: DataFrame) -> DataFrame:
    """Faults look at the original values, so they are decided before anything changes."""
    return df.select(
        "*", is_drifted().alias("drifted"), lost_key().alias("no_key"),
        lost_priority().alias("no_priority"), lost_amount().alias("no_amount"),
    )


def wh_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_rows(src(spark, sf_dir), is_missing())


def wh_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src(spark, sf_dir)
    return inject_duplicates(orders, orders.where(is_duplicated()))


def wh_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift_rows(src(spark, sf_dir), is_drifted(), "total_amount", DRIFT)


def _blanked(flagged: DataFrame) -> DataFrame:
    rows = blank_values(flagged, F.col("no_key"), "order_id")
    rows = blank_values(rows, F.col("no_priority"), "order_priority")
    rows = blank_values(rows, F.col("no_amount"), "total_amount")
    return rows.drop("drifted", "no_key", "no_priority", "no_amount")


def wh_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blanked(_with_flags(src(spark, sf_dir)))


def wh_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults; the appended copies equal the rows they copy."""
    flagged = _with_flags(drop_rows(src(spark, sf_dir), is_missing()))
    rows = _blanked(drift_rows(flagged, F.col("drifted"), "total_amount", DRIFT))
    return inject_duplicates(rows, rows.where(is_duplicated()))


def nan_for_null(df: DataFrame) -> DataFrame:
    """Amounts that are not known, as NaN."""
    return df.withColumn("total_amount", F.coalesce("total_amount", F.lit(float("nan"))))


def src_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source with the same lost priorities, so that null context must match null context."""
    return blank_values(src(spark, sf_dir), lost_priority(), "order_priority")
