"""Checks that were already made are not made again."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from crosstally.errors import ReconcileInputError
from crosstally.functions.text import signature_of
from crosstally.sources.writers import shared_folder


class CallStore:
    """Results of checks by signature: a table each, in one folder that outlives the session.

    A call is looked up before its check is planned, so an equal call scans none of the datasets. Two
    calls are equal when tool and arguments are; arguments name datasets, so a store is for one state of
    them, which ``state`` names (a load date, a table version). Without a ``folder`` the store lies
    in the session's shared folder. The driver keeps signatures only.
    """

    def __init__(self, spark: SparkSession, state: str, folder: str | None = None):
        if not state or "/" in state:
            raise ReconcileInputError("name the state of the datasets, without slashes")
        self._spark = spark
        self._folder = f"{(folder or shared_folder(spark)).rstrip('/')}/crosstally-calls/{state}"
        self._known: set[str] = set()

    def _path(self, signature: str) -> str:
        return f"{self._folder}/{signature}"

    def found(self, tool: str, arguments: Mapping[str, Any]) -> DataFrame | None:
        """The stored result of an equal call, if there is a whole one."""
        signature = signature_of(tool, dict(arguments))
        if signature not in self._known:
            try:
                # Written last, when every row is there.
                self._spark.read.format("binaryFile").load(f"{self._path(signature)}/_SUCCESS").first()
            except AnalysisException:
                return None
            self._known.add(signature)
        return self._spark.read.parquet(self._path(signature))

    def run(
        self, tool: str, arguments: Mapping[str, Any], check: Callable[[], DataFrame]
    ) -> DataFrame:
        """The result of the call: stored by an equal one, or of ``check``, which is then stored."""
        earlier = self.found(tool, arguments)
        if earlier is not None:
            return earlier
        signature = signature_of(tool, dict(arguments))
        check().write.mode("overwrite").parquet(self._path(signature))
        self._known.add(signature)
        return self._spark.read.parquet(self._path(signature))


class Planned:
    """The signatures of the checks that a plan holds already."""

    def __init__(self) -> None:
        self._made: set[str] = set()

    def is_new(self, tool: str, arguments: Mapping[str, Any]) -> bool:
        """True once per different call."""
        signature = signature_of(tool, dict(arguments))
        if signature in self._made:
            return False
        self._made.add(signature)
        return True
