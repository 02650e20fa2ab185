"""Sinks, and the place for tables that must outlive an executor."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


# Spark's default text formats drop microseconds.
TIMESTAMP_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes inside values are doubled."""
    df.write.mode(mode).options(header=True, escape='"', **TIMESTAMP_FORMATS).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON document per line, with null fields."""
    df.write.mode(mode).options(ignoreNullFields=False, **TIMESTAMP_FORMATS).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


@lru_cache(maxsize=1)
def _one_machine_folder() -> str:
    return tempfile.mkdtemp(prefix="crosstally-")


def _master(spark: SparkSession) -> str:
    """Where the session runs; its settings need not tell."""
    return spark.conf.get("spark.master", None) or spark.sparkContext.master


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, as the session names it.

    Where it is unset a one-machine session gets a folder of its own; a cluster gets an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", _master(spark)):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or _one_machine_folder()).rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result survives lost executors, is computed once however often it is used, and its
    real size is known to the optimizer, so small results are broadcast without a hint.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crosstally-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
