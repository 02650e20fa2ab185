from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from results import one, rows, unordered
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions import columns as cols
from crosstally.functions.aggregates import aggregate_column, share_percent
from crosstally.functions.periods import as_timestamp, frequency_unit, iso_text, period_label, period_start
from crosstally.functions.predicates import apply_filters
from crosstally.functions.text import (
    call_signature, has_whole_words, json_details, log_line, redact, signed_amount,
)


@pytest.fixture(scope="module")
def mixed(frame):
    return frame(
        "id long, name string, amount double, ok boolean, day date",
        (1, "a", 1.0, True, dt.date(2024, 1, 1)),
        (2, "b", 2.0, False, dt.date(2024, 1, 2)),
        (3, None, None, None, None),
    )


def ids(df, *conditions):
    return sorted(r["id"] for r in apply_filters(df, conditions).collect())


@pytest.mark.parametrize(
    ("column", "operator", "value", "expected"),
    [
        ("name", "eq", "a", [1]),
        ("name", "ne", "a", [2, 3]),
        ("name", "ne", None, [1, 2, 3]),
        ("name", "eq", None, []),
        ("name", "EQ", "b", [2]),
        ("amount", "gt", 1, [2]),
        ("amount", "gte", 1, [1, 2]),
        ("amount", "lt", 2.0, [1]),
        ("amount", "lte", 2.0, [1, 2]),
        ("name", "gt", "a", [2]),
        ("name", "in", ["a", "z"], [1]),
        ("name", "in", "a", [1]),
        ("name", "in", [], []),
        ("name", "in", [None, "b"], [2]),
        ("name", "not_in", ["a"], [2, 3]),
        ("name", "not_in", [None], [1, 2, 3]),
        ("name", "is_null", None, [3]),
        ("name", "not_null", None, [1, 2]),
        ("name", "eq", 1, []),
        ("id", "eq", "1", []),
        ("id", "ne", "1", [1, 2, 3]),
        ("id", "in", ["1", 2], [2]),
        ("id", "not_in", ["1", 2], [1, 3]),
        ("ok", "eq", True, [1]),
        ("ok", "eq", 0, [2]),
        ("id", "eq", True, [1]),
        ("day", "gte", "2024-01-02", [2]),
        ("day", "eq", dt.date(2024, 1, 1), [1]),
        ("day", "eq", "not a day", []),
    ],
)
def test_filters(mixed, column, operator, value, expected):
    assert ids(mixed, {"column": column, "operator": operator, "value": value}) == expected


def test_filters_combine_and_default_to_equality(mixed):
    assert ids(mixed, {"column": "name", "value": "a"}, {"column": "id", "operator": "lt", "value": 5}) == [1]
    assert ids(mixed) == [1, 2, 3]


@pytest.mark.parametrize(
    "condition",
    [
        {"column": "nope", "value": 1},
        {"column": "id", "operator": "like", "value": 1},
        {"column": "id", "operator": "gt", "value": "x"},
        {"column": "name", "operator": "lt", "value": 3},
        {"column": "name", "operator": "lt", "value": None},
    ],
)
def test_filter_errors(mixed, condition):
    with pytest.raises(ReconcileInputError):
        apply_filters(mixed, [condition])


def test_filter_reaches_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    kept = apply_filters(df, [{"column": "o_orderpriority", "value": "2-HIGH"}]).select("o_orderkey")
    plan = kept._jdf.queryExecution().toString()
    assert "EqualTo(o_orderpriority,2-HIGH)" in plan


def test_aggregates_of_nothing(frame):
    empty = frame("v double")
    found = one(
        empty.agg(*[aggregate_column(empty, m, a).alias(f"{a}{m}") for m, a in
                    (("v", "sum"), ("v", "mean"), ("v", "count"), (None, "count"))])
    )
    assert found == {"sumv": 0.0, "meanv": None, "countv": 0, "countNone": 0}


def test_aggregates_skip_nulls_and_add_booleans(frame):
    df = frame("v double, b boolean", (1.5, True), (None, True), (2.5, False))
    assert one(df.agg(aggregate_column(df, "v", "MEAN").alias("m")))["m"] == 2.0
    assert one(df.agg(aggregate_column(df, "b", "sum").alias("m")))["m"] == 2.0


def test_exact_sum_does_not_depend_on_order(frame):
    df = frame("v double", *[(0.1,)] * 10)
    assert one(df.agg(aggregate_column(df, "v", "sum", 2).alias("m")))["m"] == 1.0


@pytest.mark.parametrize(("metric", "name"), [("s", "sum"), (None, "sum"), ("v", "median"), ("x", "count")])
def test_aggregate_errors(frame, metric, name):
    df = frame("v double, s string", (1.0, "a"))
    with pytest.raises(ReconcileInputError):
        aggregate_column(df, metric, name)


def test_share_of_nothing_is_zero(spark):
    found = spark.range(1).select(share_percent(F.lit(0), F.lit(0)).alias("z"), share_percent(F.lit(1), F.lit(4)).alias("q"))
    assert rows(found) == [(0.0, 25.0)]


@pytest.mark.parametrize(
    ("frequency", "label"),
    [("D", "2024-08-23"), ("weekly", "2024-08-19/2024-08-25"), ("Month", "2024-08"),
     ("q", "2024Q3"), ("YEAR", "2024")],
)
def test_period_labels(frame, frequency, label):
    df = frame("d string", ("2024-08-23 10:11:12",))
    unit = frequency_unit(frequency)
    assert rows(df.select(period_label(period_start(as_timestamp(df, "d"), unit), unit))) == [(label,)]


def test_unknown_frequency():
    with pytest.raises(ReconcileInputError):
        frequency_unit("fortnight")


def test_tolerant_dates(frame):
    df = frame("d string", ("2024-08-23",), ("2024-08-23T10:00:00",), ("soon",), ("2024-13-77",), (None,))
    assert rows(df.select(iso_text(as_timestamp(df, "d")))) == [
        ("2024-08-23T00:00:00",), ("2024-08-23T10:00:00",), (None,), (None,), (None,),
    ]
    german = frame("d string", ("23.08.2024",))
    assert rows(german.select(iso_text(as_timestamp(german, "d", "dd.MM.yyyy")))) == [("2024-08-23T00:00:00",)]


def test_iso_text_keeps_microseconds(frame):
    df = frame("d string", ("2024-08-23 10:00:00.25",))
    assert rows(df.select(iso_text(as_timestamp(df, "d")))) == [("2024-08-23T10:00:00.250000",)]


def test_redaction(frame):
    df = frame("t string", ("key sk-or-v1-Ab_9-z,\n\tAuthorization: Bearer abc.def} end",), (None,))
    assert rows(df.select(redact(F.col("t")))) == [
        ("key [REDACTED_API_KEY], Authorization: Bearer [REDACTED]} end",), (None,),
    ]


def test_white_space_is_squeezed_as_in_python(frame):
    text = " a\u3000\u2003b \t\x85\n c\xa0d\u200be\x1cf  "
    df = frame("t string", (text,))
    assert rows(df.select(redact(F.col("t")))) == [(" ".join(text.split()),)]


def test_log_line_is_shortened_after_redaction_of_the_whole_text(frame):
    df = frame("t string", ("x" * 600 + " sk-or-v1-secret",), ("short",))
    line, whole = rows(df.select(log_line(F.col("t")), redact(F.col("t"))))[0]
    assert line == "x" * 500 + "..." and whole.endswith("[REDACTED_API_KEY]")


def test_signature_amount_json_words(frame):
    df = frame("tool string, args string, v double", ("t", "{}", -1234.5), ("t", "{}", float("nan")))
    found = df.select(
        call_signature(F.col("tool"), F.col("args")), signed_amount(F.lit(1234.5)), json_details(df, ["tool", "v"])
    )
    signature = hashlib.sha256(b"t:{}").hexdigest()[:16]
    assert rows(found)[0] == (signature, "+1,234.50", '{"tool":"t","v":-1234.5}')
    assert rows(found)[1][2] == '{"tool":"t","v":null}'
    words = frame("q string", ("Which Total-Amount differs?",), ("subtotal amounts",))
    assert rows(words.select(has_whole_words(F.col("q"), "total_amount"))) == [(True,), (False,)]


def test_automatic_details():
    columns = ["record_id", "value", "status", "created_at", "updated_at", "note", "region"]
    assert cols.automatic_details(columns, "record_id") == ["status", "created_at", "updated_at", "value"]
    assert cols.automatic_details(["id", "note"], "id") == []
    assert cols.automatic_details(["k", "source_id", "method"], "k") == ["method", "source_id"]


def test_explicit_details(orders):
    assert cols.detail_columns(orders, "order_id", ["amount", "order_id", "amount", "channel"]) == ["amount", "channel"]
    for bad in (["nope"], [""], [3]):
        with pytest.raises(ReconcileInputError):
            cols.detail_columns(orders, "order_id", bad)


def test_details_from_question():
    columns = ["order_id", "order_date", "amount"]
    assert cols.details_from_question("What Order-Date was it?", columns, "order_id") == ["order_date"]
    assert cols.details_from_question("amounts", columns, "order_id") is None


def test_word_choices_on_data(frame):
    df = frame("n string", ("Order_Priority",), ("note",), ("payment_method",))
    found = df.select(
        "n", cols.contains_any_column(F.col("n"), cols.FAVOURED_DIMENSION_WORDS),
        cols.first_word_position(F.col("n"), cols.DIMENSION_PRIORITY),
    )
    assert unordered(found) == [
        ("Order_Priority", True, 12), ("note", False, 12), ("payment_method", False, 10),
    ]
