"""Readers. All return lazy DataFrames; only CSV type inference runs a job, over one scan."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import nan_to_null, quoted

# Texts read as null in CSV input.
NULL_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df.select(*[quoted(c) for c in columns]) if columns else df)


def read_json(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """JSON, one document per line as ``write_json`` leaves it.

    With ``multi_line`` a file is one document (or one array) that may span lines; such a file cannot be split.
    """
    reader = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


_WHOLE = r"^[+-]?\d+$"
_NUMERAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def _inferred_types(text: DataFrame) -> dict[str, T.DataType]:
    """long, decimal, double, boolean or string per column, from one pass that returns one row.

    Whole numbers beyond a long are decimals (up to 38 digits) or stay strings, as doubles would
    make different keys equal. Only plain numerals are numbers: ``1D`` is a text.
    """
    def fits(name: str, kind: str):
        value = F.trim(quoted(name))
        if kind == "boolean":
            ok = F.lower(value).isin("true", "false")
        elif kind == "double":
            # A whole number that a double cannot hold exactly keeps the column from being one.
            big = value.rlike(_WHOLE) & (F.length(F.regexp_replace(value, "^[+-]?0*", "")) > 15)
            ok = value.rlike(_NUMERAL) & ~big
        else:
            ok = value.rlike(_WHOLE) & value.try_cast(kind).isNotNull()
        return F.coalesce(F.bool_and(F.when(value.isNotNull(), ok)), F.lit(kind == "double"))

    kinds = (
        ("bigint", T.LongType()), ("double", T.DoubleType()),
        ("decimal(38,0)", T.DecimalType(38, 0)), ("boolean", T.BooleanType()),
    )
    found = text.agg(
        *[fits(c, k).alias(f"{i}_{k}") for i, c in enumerate(text.columns) for k, _ in kinds]
    ).first()
    return {
        c: next((t for k, t in kinds if found[f"{i}_{k}"]), T.StringType())
        for i, c in enumerate(text.columns)
    }


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    null_markers: Sequence[str] = NULL_MARKERS,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header line; doubled quotes inside quoted values.

    Null markers become null before types are settled. Without ``schema`` every column is
    long, decimal, double, boolean or string; dates stay strings and are parsed on demand. A column
    without a name is called ``column_N`` by its place, from 1. A ``schema`` may leave columns of the file
    out only by name: those stay strings; a column that the file lacks is an error.
    ``multi_line`` allows line breaks inside values, but then a file cannot be split.
    """
    quoting = {"escape": '"', "multiLine": multi_line}
    name = os.path.basename(path.rstrip("/"))
    if not name.lower().endswith(".csv"):
        raise ReconcileInputError(f"only .csv input can be read here: {name}")
    try:
        header = spark.read.options(header=False, **quoting).csv(path).first()
    except AnalysisException as error:
        raise ReconcileInputError(f"cannot read {name}: {error.getCondition()}") from error
    named = [n for n in (header or []) if n is not None]
    names = [n if n is not None else f"column_{i}" for i, n in enumerate(header or [], 1)]
    if not named:
        raise ReconcileInputError(f"{name} has no columns")
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ReconcileInputError(f"{name} repeats column(s): {', '.join(repeated)}")
    absent = [f.name for f in schema.fields if f.name not in names] if schema is not None else []
    if absent:
        raise ReconcileInputError(f"{name} lacks column(s): {', '.join(absent)}")
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    text = (
        spark.read.options(header=True, enforceSchema=len(named) < len(names), mode="FAILFAST", **quoting)
        .schema(text_schema).csv(path)
    )
    text = text.select(
        *[F.when(~quoted(c).isin(*null_markers), quoted(c)).alias(c) for c in names]
    )
    types = (
        {f.name: f.dataType for f in schema.fields} if schema is not None else _inferred_types(text)
    )
    types = {c: types.get(c, T.StringType()) for c in names}
    typed = text.select(
        *[
            (quoted(c) if isinstance(types[c], T.StringType) else F.trim(quoted(c)).cast(types[c])).alias(c)
            for c in names
        ]
    )
    return nan_to_null(typed)
