from __future__ import annotations

import pytest
from results import rows, unordered
from pyspark.sql import types as T

from crosstally.errors import ReconcileInputError
from crosstally.functions.types import nan_to_null
from crosstally.sources.readers import read_csv, read_json, read_parquet
from crosstally.sources.registry import DatasetRegistry
from crosstally.sources.writers import (
    materialize, shared_folder, write_csv, write_json, write_parquet,
)


def csv(tmp_path, text, name="data.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_csv_types_and_null_markers(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, "id,amount,flag,day,note\n1,1.5,True,2024-01-02,x\n2,NA,false,,n/a\n"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string"]
    assert unordered(df) == [(1, 1.5, True, "2024-01-02", "x"), (2, None, False, None, None)]


def test_csv_with_schema_and_own_markers(spark, tmp_path):
    schema = T.StructType().add("id", "string").add("amount", "decimal(10,2)")
    df = read_csv(spark, csv(tmp_path, "id,amount\n01,2.50\n02,-\n"), schema, null_markers=("-",))
    assert [str(r) for r in unordered(df)] == ["('01', Decimal('2.50'))", "('02', None)"]


def test_csv_empty_column_is_double(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, "a,b\n1,\n2,NaN\n"))
    assert df.schema["b"].dataType == T.DoubleType()


@pytest.mark.parametrize(
    ("name", "text"), [("data.txt", "a\n1\n"), ("twice.csv", "a,a\n1,2\n"), ("empty.csv", "")]
)
def test_csv_errors(spark, tmp_path, name, text):
    with pytest.raises(ReconcileInputError):
        read_csv(spark, csv(tmp_path, text, name))


def test_missing_csv(spark, tmp_path):
    with pytest.raises(ReconcileInputError):
        read_csv(spark, str(tmp_path / "gone.csv"))


def test_sinks_round_trip(spark, tmp_path, orders):
    write_csv(orders, str(tmp_path / "o.csv"))
    write_parquet(orders, str(tmp_path / "o.parquet"))
    write_json(orders, str(tmp_path / "o.json"))
    expected = unordered(orders)
    assert unordered(read_csv(spark, str(tmp_path / "o.csv"))) == expected
    assert unordered(read_parquet(spark, str(tmp_path / "o.parquet"))) == expected
    assert unordered(read_json(spark, str(tmp_path / "o.json"), orders.schema)) == expected
    assert read_parquet(spark, str(tmp_path / "o.parquet"), ["amount"]).columns == ["amount"]


def test_manifest(spark, tmp_path):
    path = tmp_path / "truth.json"
    path.write_text('{\n "case_id": "x",\n "datasets": ["a", "b"]\n}\n', encoding="utf-8")
    assert rows(read_json(spark, str(path), multi_line=True)) == [("x", ["a", "b"])]


def test_nan_is_null(frame):
    df = frame("k long, v double", (1, float("nan")), (2, 1.0))
    assert unordered(nan_to_null(df)) == [(1, None), (2, 1.0)]


def test_registry(spark, orders, payments):
    datasets = DatasetRegistry()
    datasets.add("orders", orders, view=True)
    datasets.add("payments", payments)
    assert list(datasets) == ["orders", "payments"] and len(datasets) == 2
    assert spark.table("orders").count() == 5
    with pytest.raises(ReconcileInputError):
        datasets.add("orders", orders)
    with pytest.raises(ReconcileInputError, match="orders, payments"):
        datasets["refunds"]


def test_materialize_uses_the_shared_folder(spark, orders):
    kept = materialize(orders, "test")
    assert unordered(kept) == unordered(orders)
    assert shared_folder(spark) in kept.inputFiles()[0]


def test_shared_folder_without_a_setting():
    from types import SimpleNamespace

    def session(master, folder=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master)
        )

    assert shared_folder(session("local[4]")) == shared_folder(session("local[4]"))
    assert shared_folder(session("yarn", "hdfs://shared/x/")) == "hdfs://shared/x"
    with pytest.raises(RuntimeError):
        shared_folder(session("yarn"))


def test_csv_keeps_quotes_breaks_and_microseconds(spark, tmp_path, frame):
    import datetime as dt

    when = dt.datetime(2024, 1, 1, 10, 0, 0, 179575)
    df = frame("t string, at timestamp_ntz", ('say "hi", now', when), ("two\nlines", None), ("back\\slash", when))
    write_csv(df, str(tmp_path / "text.csv"))
    write_json(df, str(tmp_path / "text.json"))
    assert unordered(read_csv(spark, str(tmp_path / "text.csv"), df.schema, multi_line=True)) == unordered(df)
    assert unordered(spark.read.schema(df.schema).json(str(tmp_path / "text.json"))) == unordered(df)


def test_json_of_many_lines_and_files_comes_back_whole(spark, tmp_path):
    df = spark.range(0, 100, 1, 2).withColumnRenamed("id", "k")
    write_json(df, str(tmp_path / "many.json"))
    assert unordered(read_json(spark, str(tmp_path / "many.json"))) == [(i,) for i in sorted(range(100), key=lambda i: repr((i,)))]


def test_csv_numerals(spark, tmp_path):
    """Java's number suffixes are texts, and whole numbers beyond a long stay apart."""
    text = "a,b,c,d\n1D,12345678901234567890,1e3,12345678901234567890\n1F,12345678901234567891,.5,1.5\n"
    df = read_csv(spark, csv(tmp_path, text))
    assert [f.dataType.simpleString() for f in df.schema] == ["string", "decimal(38,0)", "double", "string"]
    assert df.select("b").distinct().count() == 2


def test_csv_unnamed_column(spark, tmp_path):
    df = read_csv(spark, csv(tmp_path, ",id,amount\n0,a,1.5\n1,b,2.5\n"))
    assert df.columns == ["column_1", "id", "amount"] and unordered(df) == [(0, "a", 1.5), (1, "b", 2.5)]


def test_csv_schema_must_be_met(spark, tmp_path):
    path = csv(tmp_path, "id,amount\n1,2.5\n")
    with pytest.raises(ReconcileInputError, match="lacks column"):
        read_csv(spark, path, T.StructType().add("id", "long").add("price", "double"))
    assert unordered(read_csv(spark, path, T.StructType().add("id", "long"))) == [(1, "2.5")]
