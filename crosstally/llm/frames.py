"""Small helpers of the corpus operators: column picking, stored tables, long running sums."""

from __future__ import annotations

import ctypes
import math
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstally.functions.types import quoted
from crosstally.sources.writers import materialize, shared_folder

#: Words of the documents: runs of anything but ASCII white space.
WHITE = r"\x20\x09-\x0D"
WORD = rf"[^{WHITE}]+"


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[quoted(theirs).alias(ours) for ours, theirs in columns.items()])


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder: short lineage that outlives executors."""
    return materialize(df, f"llm-{label}")


class Scratch:
    """Stored tables that serve only the next steps, and go once what follows from them is stored."""

    def __init__(self) -> None:
        self._kept: list[tuple[SparkSession, str]] = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        spark = df.sparkSession
        path = f"{shared_folder(spark)}/crosstally-llm-{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._kept.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Nothing that is still to be computed may read one of the tables."""
        for spark, path in self._kept:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        self._kept.clear()


def released() -> None:
    """Gives memory that a finished task or fit freed back to the machine; workers and the driver live on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not every C library has it.
        pass


def word_count(text: Column) -> Column:
    """How many ``WORD`` a text holds; null: 0.

    Each word becomes one letter, with the white space before it, where ``regexp_count`` would first make an
    array of all words. A word is added at the end, or long white space there would be tried from each of its places.
    """
    letters = F.regexp_replace(F.concat(text, F.lit(" x")), rf"[{WHITE}]*{WORD}", "x")
    return F.coalesce(F.length(letters) - 1, F.lit(0)).cast("long")


def bucket_bits(rows: int, per_bucket: int) -> int:
    """Bits so that evenly spread ``rows`` give about ``per_bucket`` rows a bucket."""
    return max(0, math.ceil(math.log2(max(1, rows) / per_bucket)))


def running_sum(
    df: DataFrame, group: list[str], bucket: str, order: list[str], amount: str, name: str
) -> DataFrame:
    """Exclusive running sum of ``amount`` in each group, in the order (bucket, *order).

    A group may hold any share of the rows: tasks sort single buckets, and only the totals of
    buckets are summed along a group. Buckets must ascend with the order and have no nulls.
    """
    inside = Window.partitionBy(*group, bucket).orderBy(*order)
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, bucket)
        .agg(F.sum(amount).alias("__total"))
        .withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0)))
        .drop("__total")
    )
    own = F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(amount)
    return (
        df.withColumn("__own", own)
        .join(offsets, [*group, bucket])
        .withColumn(name, F.col("__own") + F.col("__offset"))
        .drop("__own", "__offset")
    )


def ranged(rows: DataFrame, order: list[str], label: str, scratch: Scratch) -> DataFrame:
    """``rows`` sorted by ``order`` over all partitions; ``at`` ascends, and counts on in a partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Rows equal in the order are told apart by a number, or one range might hold them all.
    numbered = scratch.stored(rows.withColumn("salt", F.monotonically_increasing_id()), f"{label}-rows")
    by = [*order, "salt"]
    return scratch.stored(
        numbered.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("salt")
        .withColumn("at", F.monotonically_increasing_id()),
        label,
    )


def spans_of(ranged: DataFrame, group: list[str]) -> DataFrame:
    """Per partition and group: first ``at``, how many rows, and how many of the group lie before."""
    spans = ranged.groupBy(*group, F.shiftright("at", 33).alias("part")).agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")
    )
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long")))


def place_in() -> Column:
    """A row's place in its group, from the columns of ``ranged`` and ``spans_of``."""
    return F.col("before") + F.col("at") - F.col("first")
