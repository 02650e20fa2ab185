"""Session defaults for running the library outside a managed cluster (tests, bench)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(
    master: str, app_name: str = "crosstally", shuffle_partitions: int | None = None,
    memory: str = "8g",
) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster the submitter sets master, memory and ``spark.checkpoint.dir``.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
