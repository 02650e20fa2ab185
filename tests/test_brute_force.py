"""Random small tables with nulls, copies and repeated keys against plain Python loops."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from results import one, unordered

from crosstally.operators import bridge, compare, duplicates, impact, matching, segments

SCHEMA = "k long, v double, c string"


def table(seed: int, size: int) -> list[tuple]:
    rng = random.Random(seed)
    pick = lambda *options: rng.choice(options)
    rows = [
        (pick(None, *range(8)), pick(None, 0.5, 1.25, 2.0, -3.5), pick(None, "x", "y")) for _ in range(size)
    ]
    return rows + rng.choices(rows, k=size // 3)


@pytest.fixture(scope="module", params=range(4))
def sides(request, spark):
    a, b = table(request.param, 14), table(request.param + 100, 11)
    # Some whole rows are shared, so that copies meet copies.
    b = b + a[: 6]
    return a, b, spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)


def keys(rows):
    return {r[0] for r in rows if r[0] is not None}


def by_key(rows):
    groups = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            groups[r[0]].append(r)
    return groups


def money(rows):
    return sum(r[1] or 0.0 for r in rows)


def test_unmatched(sides):
    a, b, df_a, df_b = sides
    lost = [r for r in a if r[0] is not None and r[0] not in keys(b)]
    found = one(matching.unmatched_summary(df_a, df_b, "k", "k"))
    assert found["unmatched_count"] == len(lost)
    assert found["unmatched_unique_key_count"] == len(keys(lost))
    assert found["null_key_count"] == sum(r[0] is None for r in a)
    assert unordered(matching.unmatched_rows(df_a, df_b, "k", "k")) == sorted(lost, key=repr)


@pytest.mark.parametrize("columns", [None, ["k"], ["c", "v"]])
def test_duplicates(sides, columns):
    a, _, df_a, _ = sides
    places = [["k", "v", "c"].index(c) for c in columns or ["k", "v", "c"]]
    counts = Counter(tuple(r[i] for i in places) for r in a)
    found = one(duplicates.find_duplicates(df_a, columns))
    assert found["duplicate_row_count"] == sum(n for n in counts.values() if n > 1)
    assert found["row_count"] == len(a)
    rows = unordered(duplicates.duplicate_rows(df_a, columns or ["k", "v", "c"]))
    assert rows == sorted((r for r in a if counts[tuple(r[i] for i in places)] > 1), key=repr)


@pytest.mark.parametrize("tolerance", [0.0, 1.0])
def test_values_and_rows(sides, tolerance):
    a, b, df_a, df_b = sides
    left = {k: g[0] for k, g in by_key(a).items() if len(g) == 1}
    right = {k: g[0] for k, g in by_key(b).items() if len(g) == 1}
    pairs = [(left[k], right[k]) for k in left.keys() & right.keys()]

    def number_differs(x, y):
        return (x is None) != (y is None) or (x is not None and abs(x - y) > tolerance)

    found = one(compare.compare_values(df_a, df_b, "k", "k", "v", "v", tolerance))
    assert found["matched_unique_key_count"] == len(pairs)
    bad = [(x[1], y[1]) for x, y in pairs if number_differs(x[1], y[1])]
    assert found["value_mismatch_count"] == len(bad)
    assert found["signed_difference_a_minus_b"] == sum(x - y for x, y in bad if None not in (x, y))
    assert found["duplicate_key_record_count_a"] == sum(len(g) for g in by_key(a).values() if len(g) > 1)
    rows = one(compare.compare_rows(df_a, df_b, "k", "k", tolerance=tolerance))
    assert rows["record_mismatch_count"] == sum(number_differs(x[1], y[1]) or x[2] != y[2] for x, y in pairs)


def test_bridge(sides):
    a, b, df_a, df_b = sides
    found = one(bridge.bridge_summary(df_a, df_b, "k", "k", "v", "v"))
    only_a = [r for r in a if r[0] is not None and r[0] not in keys(b)]
    only_b = [r for r in b if r[0] is not None and r[0] not in keys(a)]
    count_a, count_b = (Counter(r for r in rows if r[0] is not None) for rows in (a, b))
    both = count_a.keys() & count_b.keys()
    extra_a = {r: count_a[r] - count_b[r] for r in both if count_a[r] > count_b[r]}
    extra_b = {r: count_b[r] - count_a[r] for r in both if count_b[r] > count_a[r]}
    assert found["net_difference_a_minus_b"] == money(a) - money(b)
    assert (found["dataset_a_only_row_count"], found["dataset_a_only_metric_sum"]) == (len(only_a), money(only_a))
    assert (found["dataset_b_only_unique_key_count"], found["dataset_b_only_metric_sum"]) == (len(keys(only_b)), money(only_b))
    assert found["dataset_a_extra_exact_copy_count"] == sum(extra_a.values())
    assert found["dataset_b_extra_exact_copy_metric_sum"] == sum((r[1] or 0) * n for r, n in extra_b.items())
    assert found["dataset_b_extra_exact_copy_key_count"] == len(keys(extra_b))
    keyless = money(r for r in a if r[0] is None) - money(r for r in b if r[0] is None)
    assert found["null_key_metric_difference_a_minus_b"] == keyless == found["reconciliation_residual"]
    copies = bridge.extra_copies(df_a, df_b, "k", "k", "v", "v", side="a").collect()
    assert {(r["key"], r["metric"], r["c"]): r["extra_copy_count"] for r in copies} == extra_a


def test_segments_and_impact(sides):
    a, b, df_a, df_b = sides
    lost = [r for r in a if r[0] is not None and r[0] not in keys(b)]
    options = {"match_against": df_b, "local_key": "k", "other_key": "k", "only_unmatched": True}
    found = segments.segment_analysis(df_a, "c", "v", "sum", **options)
    counts = Counter(r[2] for r in lost)
    assert {r["c"]: (r["value"], r["record_count"]) for r in found.groups.collect()} == {
        c: (money(r for r in lost if r[2] == c), n) for c, n in counts.items()
    }
    measured = one(impact.business_impact(df_a, "v", None, "c", **options))
    assert (measured["affected_record_count"], measured["affected_amount_sum"]) == (len(lost), round(money(lost), 2))
    if lost:
        best = min(counts.items(), key=lambda item: (-item[1], item[0] is None, item[0] or ""))
        assert (measured["primary_segment"], measured["primary_segment_record_count"]) == best
