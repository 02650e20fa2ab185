"""Equal calls are answered from what was stored; dates of texts in elected forms; wide sums."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from results import one, rows, unordered

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import aggregate_column
from crosstally.functions.periods import DATE_FORMATS, ELECTED, as_timestamp, date_formats
from crosstally.operators import duplicates, impact, segments
from crosstally.plans import baseline
from crosstally.plans.calls import CallStore
from crosstally.sources.registry import DatasetRegistry


@pytest.fixture
def trio(frame):
    datasets = DatasetRegistry()
    schema = "order_id string, amount double, region string"
    datasets.add("orders", frame(schema, ("1", 5.0, "n"), ("2", 6.0, "s"), ("2", 6.0, "s"), ("4", 1.0, "n")))
    datasets.add("bills", frame(schema, ("1", 5.0, "n"), ("2", 7.0, "s"), ("3", 2.0, "n")))
    datasets.add("tickets", frame(schema, ("1", 5.0, "n"), ("9", 7.0, "s"), ("3", 2.0, "w")))
    return datasets


class Counted:
    """A check that says how often it was planned."""

    def __init__(self, check):
        self.check, self.calls = check, 0

    def __call__(self, *arguments, **options):
        self.calls += 1
        return self.check(*arguments, **options)


def test_a_second_equal_call_scans_nothing(spark, frame, tmp_path):
    path = str(tmp_path / "data")
    frame("a long", (1,), (1,), (2,)).write.parquet(path)
    store = CallStore(spark, "monday", str(tmp_path))
    check = Counted(lambda: duplicates.find_duplicates(spark.read.parquet(path)))
    first = store.run("find_duplicates", {"dataset": "d"}, check)
    again = store.run("find_duplicates", {"dataset": "d"}, check)
    assert check.calls == 1 and one(first) == one(again) and one(again)["duplicate_row_count"] == 2
    # What it reads is the stored result, not the dataset.
    assert all("crosstally-calls/monday" in f for f in again.inputFiles())
    later = CallStore(spark, "monday", str(tmp_path))
    assert one(later.run("find_duplicates", {"dataset": "d"}, check)) == one(first) and check.calls == 1


def test_other_arguments_and_other_states_are_other_calls(spark, frame, tmp_path):
    check = Counted(lambda: frame("n long", (7,)))
    for state, arguments in (("a", {"x": 1}), ("a", {"x": 2}), ("b", {"x": 1}), ("a", {"x": 1})):
        assert rows(CallStore(spark, state, str(tmp_path)).run("t", arguments, check)) == [(7,)]
    assert check.calls == 3
    with pytest.raises(ReconcileInputError):
        CallStore(spark, "a/b", str(tmp_path))


def test_a_broken_write_is_made_again(spark, frame, tmp_path):
    store = CallStore(spark, "s", str(tmp_path))
    store.run("t", {}, lambda: frame("n long", (1,)))
    for kept in (tmp_path / "crosstally-calls" / "s").glob("*/_SUCCESS"):
        kept.rename(kept.with_name("_OTHER"))
    fresh = CallStore(spark, "s", str(tmp_path))
    assert rows(fresh.run("t", {}, lambda: frame("n long", (2,)))) == [(2,)]


def test_each_dataset_is_planned_once(trio, monkeypatch):
    counted = Counted(baseline.find_duplicates)
    monkeypatch.setattr(baseline, "find_duplicates", counted)
    found = baseline.reconcile(trio, scale=2)
    assert counted.calls == 3
    assert sorted(r["dataset_a"] for r in found.where("tool = 'find_duplicates'").collect()) == ["bills", "orders", "tickets"]


def test_a_stored_run_gives_the_same_ledger(spark, trio, tmp_path, monkeypatch):
    plain = unordered(baseline.reconcile(trio, scale=2))
    store = CallStore(spark, "s", str(tmp_path))
    assert unordered(baseline.reconcile(trio, scale=2, store=store)) == plain
    checks = Counted(baseline.find_duplicates), Counted(baseline.business_impact)
    monkeypatch.setattr(baseline, "find_duplicates", checks[0])
    monkeypatch.setattr(baseline, "business_impact", checks[1])
    assert unordered(baseline.reconcile(trio, scale=2, store=store)) == plain
    assert [c.calls for c in checks] == [0, 0]


@pytest.mark.parametrize(
    "texts, form, day",
    [
        (("12/31/2024", "01/02/2024", "x", None, " "), "M/d/yyyy", dt.datetime(2024, 1, 2)),
        (("31/12/2024", "01/02/2024"), "d/M/yyyy", dt.datetime(2024, 2, 1)),
        (("31.12.2024 10:30", "1.2.2024 00:00:05"), "d.M.yyyy", dt.datetime(2024, 2, 1, 0, 0, 5)),
        (("1/2/2024", "3/4/2024"), "M/d/yyyy", None),
        (("5 Jan 2024", "17 Feb 2024"), "d MMM yyyy", dt.datetime(2024, 2, 17)),
        (("January 5, 2024", "May 1, 2024"), "MMMM d, yyyy", dt.datetime(2024, 5, 1)),
        (("20240105", "20241231"), "yyyyMMdd", dt.datetime(2024, 1, 5)),
        (("2024-01-05", "2024-12-31 08:00:00"), "ISO", dt.datetime(2024, 1, 5)),
        (("2024/1/5",), "yyyy/M/d", dt.datetime(2024, 1, 5)),
        ((), "ISO", None),
    ],
)
def test_the_form_of_most_texts_is_elected(frame, texts, form, day):
    df = frame("d string", *[(t,) for t in texts])
    best = date_formats(df, "d").first()
    filled = [t for t in texts if t and t.strip()]
    assert best["date_format"] == form and best["value_count"] == len(filled)
    found = [r[0] for r in df.select(as_timestamp(df, "d", ELECTED)).collect()]
    assert sum(f is not None for f in found) == best["parsed_count"]
    assert day is None or day in found
    assert date_formats(df, "d").count() == len(DATE_FORMATS)


def test_elected_dates_in_reports(frame):
    df = frame("d string, v double", ("31/01/2024", 1.0), ("02/01/2024", 2.0), ("15/02/2024", 4.0), ("?", 8.0))
    groups = segments.segment_groups(df, None, "v", "sum", "d", "M", ELECTED, 2)
    assert unordered(groups) == [("2024-01", 3.0, 2), ("2024-02", 4.0, 1)]
    figures = one(impact.business_impact(df, "v", "d", date_format=ELECTED))
    assert "2024-01-02T00:00:00" in figures.values() and "2024-02-15T00:00:00" in figures.values()
    with pytest.raises(ReconcileInputError):
        date_formats(df, "v")


def test_sums_of_large_amounts(frame):
    df = frame("v double", (1e13,), (0.01,), (2.5e15,))
    assert one(df.agg(aggregate_column(df, "v", "sum", 2).alias("s")))["s"] == 2510000000000000.0


def test_sums_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.rand(3) * 1e13).alias("v"))
    sums = {one(df.repartition(n).agg(aggregate_column(df, "v", "sum", 2).alias("s")))["s"] for n in (1, 7, 211)}
    assert len(sums) == 1


def test_the_dimension_that_localises_comes_first(frame):
    schema = "region string, kind int, `odd name` boolean, v double"
    a = frame(schema, ("n", 1, True, 5.0), ("n", 2, False, 1.0), ("s", 1, True, 2.0), (None, 2, None, 3.0))
    b = frame(schema, ("n", 1, True, 4.0), ("n", 2, False, 3.0), ("s", 1, True, 2.0), (None, 2, None, 3.0))
    found = rows(segments.localize_dimensions(a, b, ["kind", "region", "odd name"], "v", scale=2).orderBy("rank"))
    assert found == [
        ("region", 1, 3, 1, True, "n", -1.0),
        ("kind", 2, 2, 2, False, "2", -2.0),
        ("odd name", 3, 3, 2, False, "false", -2.0),
    ]
    for name, _, count, differing, localized, _, _ in found:
        one_by_one = segments.localize_segment(a, b, name, "v", scale=2).collect()
        assert len(one_by_one) == differing and all(r["is_localized"] == localized for r in one_by_one)


def test_dimensions_without_a_gap(frame):
    df = frame("region string, v double", ("n", 1.0), (None, 2.0))
    assert rows(segments.localize_dimensions(df, df, ["region"], "v")) == [
        ("region", 1, 2, 0, False, None, None)
    ]
    counts = segments.localize_dimensions(df, df.limit(1), ["region"], None, "count")
    assert one(counts)["differing_segment_count"] == 1
    with pytest.raises(ReconcileInputError):
        segments.localize_dimensions(df, df, [], "v")
