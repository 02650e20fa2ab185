"""Named datasets of one reconciliation run."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import nan_to_null
from crosstally.sources.readers import read_csv, read_parquet


class DatasetRegistry:
    """Unique names to DataFrames; every dataset is also a temp view for ``spark.sql``."""

    def __init__(self) -> None:
        self._frames: dict[str, DataFrame] = {}

    def add(self, name: str, df: DataFrame, view: bool = False) -> DataFrame:
        if name in self._frames:
            raise ReconcileInputError(f"dataset name used twice: {name}")
        df = self._frames[name] = nan_to_null(df)
        if view:
            df.createOrReplaceTempView(name)
        return df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            known = ", ".join(sorted(self._frames))
            raise ReconcileInputError(f"unknown dataset {name!r}; available: {known}")
        return self._frames[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def items(self):
        return self._frames.items()


def load_datasets(spark: SparkSession, paths: Sequence[str]) -> DatasetRegistry:
    """CSV and Parquet inputs under their base names, which must differ."""
    if not paths:
        raise ReconcileInputError("give at least one dataset")
    names = [os.path.basename(p.rstrip("/")) for p in paths]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ReconcileInputError(f"dataset name used twice: {', '.join(repeated)}")
    datasets = DatasetRegistry()
    for name, path in zip(names, paths):
        reader = read_parquet if name.lower().endswith(".parquet") else read_csv
        datasets.add(name, reader(spark, path))
    return datasets
