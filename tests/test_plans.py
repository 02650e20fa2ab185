from __future__ import annotations

import json

import pytest
from results import one, rows, unordered
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.operators import bridge, compare, matching, segments
from crosstally.operators.profile import profile_columns, stack_profiles
from crosstally.operators.relationships import relationships
from crosstally.plans import evidence as ev
from crosstally.plans import injection, scoring
from crosstally.operators.compare import compare_rows
from crosstally.operators.duplicates import find_duplicates
from crosstally.plans.baseline import ImpactColumns, baseline_evidence, impact_columns, reconcile
from crosstally.sources.registry import DatasetRegistry, load_datasets
from crosstally.sources.writers import write_csv, write_parquet
from crosstally.workload.frames import src


def registry(**frames):
    datasets = DatasetRegistry()
    for name, df in frames.items():
        datasets.add(name, df)
    return datasets


def tools(evidence):
    return [r["tool"] for r in evidence.orderBy("evidence_id").collect()]


# Baseline

def test_baseline_on_orders_and_payments(orders, payments):
    found = reconcile(registry(orders=orders, payments=payments))
    names = tools(found)
    assert len(names) == 9
    assert {t: names.count(t) for t in set(names)} == {
        "compare_aggregates": 1, "find_unmatched_records": 2, "find_duplicates": 2,
        "compare_rows_by_key": 1, "compare_record_values": 1, "calculate_business_impact": 2,
    }
    by_id = {r["evidence_id"]: r for r in found.collect()}
    assert sorted(by_id) == [f"E00{i}" for i in range(1, 10)]
    assert all(r["attempt"] == 0 and len(r["signature"]) == 16 for r in by_id.values())
    details = json.loads(by_id["E008"]["details"])
    assert (by_id["E008"]["dataset_a"], details["affected_record_count"], details["affected_amount_sum"]) == ("orders", 2, 15.0)
    assert details["primary_segment"] == "Phone"
    assert details["affected_date_start"] == "2025-02-13T00:00:00"


def test_baseline_details_follow_the_question(orders, payments):
    plain = baseline_evidence(orders, payments, "order_id", "o", "p")
    asked = baseline_evidence(orders, payments, "order_id", "o", "p", question="Which channel?")
    pick = lambda e: json.loads(e.where("evidence_id = 'E002'").first()["details"])["detail_columns"]
    assert (pick(plain), pick(asked)) == ("order_date,amount,channel", "channel")


CLEAN = ((1, "Open", 10.0), (2, "Closed", 20.0))


def pair(frame, right, left=CLEAN):
    schema = "record_id long, status string, amount double"
    return registry(left=frame(schema, *left), right=frame(schema, *right))


def values(evidence):
    return {(r["tool"], r["dataset_a"]): r["value"] for r in evidence.collect()}


def test_clean_pair(frame):
    found = values(reconcile(pair(frame, CLEAN)))
    assert set(found.values()) == {0.0}
    assert ("calculate_business_impact", "left") not in found


def test_missing_row(frame):
    found = values(reconcile(pair(frame, CLEAN[:1])))
    assert found["find_unmatched_records", "left"] == 1
    assert found["find_unmatched_records", "right"] == 0
    assert found["calculate_business_impact", "left"] == 1


def test_extra_copy(frame):
    found = values(reconcile(pair(frame, (*CLEAN, CLEAN[1]))))
    assert found["find_duplicates", "right"] == 2 and found["find_duplicates", "left"] == 0


def test_drift(frame):
    found = values(reconcile(pair(frame, (CLEAN[0], (2, "Closed", 25.0)))))
    assert found["compare_rows_by_key", "left"] == 1 and found["compare_record_values", "left"] == 1


def test_one_to_many(frame):
    entities = frame("record_id string, status string, created_at string",
                     ("A", "Complete", "2024-01-01"), ("B", "Complete", "2024-01-02"), ("C", "Complete", "2024-01-03"))
    events = frame("record_id string, event_sequence long, event_value double", ("A", 1, 10.0), ("A", 2, 5.0), ("B", 1, 20.0))
    found = reconcile(registry(entities=entities, events=events))
    assert values(found)["find_unmatched_records", "entities"] == 1
    assert values(found)["find_unmatched_records", "events"] == 0
    assert "compare_rows_by_key" not in tools(found)
    profiles = stack_profiles([profile_columns(entities, "entities"), profile_columns(events, "events")])
    kept = ev.relevant_evidence(found, relationships(profiles))
    assert tools(kept) == ["find_unmatched_records", "find_unmatched_records", "calculate_business_impact"]


def test_orders_without_payment(frame):
    orders = frame("order_id string, order_status string, order_purchase_timestamp string",
                   ("A", "shipped", "2024-01-01 10:00:00"), ("B", "delivered", "2024-01-02 11:00:00"))
    payments = frame("order_id string, payment_sequence long, payment_value double", ("A", 1, 5.0), ("A", 2, 10.0))
    assert rows(matching.unmatched_preview(orders, payments, "order_id", "order_id")) == [
        ("B", "delivered", "2024-01-02 11:00:00")
    ]
    found = reconcile(registry(orders=orders, payments=payments)).where("tool = 'calculate_business_impact'")
    assert json.loads(one(found)["details"])["affected_date_start"] == "2024-01-02T11:00:00"


def test_shared_dataset_is_checked_once_per_run(frame):
    schema = "id long, v double"
    found = reconcile(registry(x=frame(schema, (1, 1.0), (2, 2.0)), y=frame(schema, (1, 1.0)), z=frame(schema, (2, 3.0))))
    calls = [(r["evidence_id"], r["tool"], r["pair"], r["dataset_a"]) for r in found.orderBy("evidence_id").collect()]
    assert [c[0] for c in calls] == [f"E{i + 1:03d}" for i in range(len(calls))]
    assert sorted(c[3] for c in calls if c[1] == "find_duplicates") == ["x", "y", "z"]
    assert [c[2] for c in calls] == sorted(c[2] for c in calls)


def test_impact_columns(orders):
    assert impact_columns(profile_columns(orders, "orders")) == ImpactColumns("amount", "order_date", "channel")


def test_nothing_to_reconcile(frame):
    with pytest.raises(ReconcileInputError):
        reconcile(DatasetRegistry())
    assert reconcile(registry(a=frame("x long", (1,), (1,)), b=frame("y long", (1,), (1,)))).count() == 0


def test_a_pair_that_cannot_be_checked_leaves_a_row(frame):
    """x and y share a number, z holds it as text: two pairs fail, one is checked."""
    x, y = frame("id long, v double", (1, 1.0), (2, 1.0)), frame("id long, v double", (1, 1.0), (3, 1.0))
    z = frame("id string, v double", ("1", 1.0), ("2", 1.0))
    found = reconcile(registry(x=x, y=y, z=z)).collect()
    failed = [r for r in found if r["tool"] == "check_failed"]
    assert sorted(r["pair"] for r in failed) == ["x|z", "y|z"] and all("types differ" in r["finding"] for r in failed)
    assert {r["pair"] for r in found} == {"x|y", "x|z", "y|z"}


def test_every_differing_column_gets_a_value_check(frame):
    schema = "id long, " + ", ".join(f"v{i} double" for i in range(6))
    left, right = frame(schema, (1, *[1.0] * 6)), frame(schema, (1, *[2.0] * 6))
    found = baseline_evidence(left, right, "id", "l", "r").where("tool = 'compare_record_values'")
    assert found.count() == 6
    assert baseline_evidence(left, right, "id", "l", "r", most_values=2).where("tool = 'compare_record_values'").count() == 2


def test_reconcile_files(spark, tmp_path, orders, payments):
    write_csv(orders, str(tmp_path / "orders.csv"))
    write_parquet(payments, str(tmp_path / "payments.parquet"))
    paths = [str(tmp_path / n) for n in ("orders.csv", "payments.parquet")]
    found = reconcile(load_datasets(spark, paths))
    assert found.count() == 9
    assert {r["dataset_a"] for r in found.collect()} == {"orders.csv", "payments.parquet"}
    for bad in ([], [paths[0], paths[0]]):
        with pytest.raises(ReconcileInputError):
            load_datasets(spark, bad)


# Evidence

def entry(frame, *calls):
    schema = ("pair string, seq int, attempt int, tool string, dataset_a string, dataset_b string, "
              "metric string, value double, finding string, details string, signature string")
    return frame(schema, *[
        (c.get("pair", "p"), c["seq"], c.get("attempt", 0), c["tool"], c.get("a", "x"), c.get("b"),
         "m", c.get("value", 1.0), "f", json.dumps(c.get("details", {})), c.get("sig", str(c["seq"])))
        for c in calls
    ])


def test_ledger_numbers_per_pair_and_drops_repeats(frame):
    calls = entry(
        frame, {"seq": 2, "tool": "t", "sig": "s"}, {"seq": 1, "tool": "t", "attempt": 1, "sig": "s"},
        {"seq": 1, "tool": "u", "sig": "r"}, {"pair": "q", "seq": 9, "tool": "t", "sig": "s"},
    )
    found = ev.ledger(calls).select("pair", "evidence_id", "tool", "attempt")
    assert unordered(found) == [("p", "E001", "u", 0), ("p", "E002", "t", 0), ("q", "E001", "t", 0)]


def test_relevance(frame):
    calls = entry(
        frame,
        {"seq": 1, "tool": "find_duplicates", "details": {"analysis_type": "repeated_key"}, "value": 9.0},
        {"seq": 2, "tool": "find_duplicates", "details": {"analysis_type": "exact_row"}, "value": 0.0},
        {"seq": 3, "tool": "find_duplicates", "details": {"analysis_type": "exact_row"}, "value": 2.0},
        {"seq": 4, "tool": "compare_aggregates", "details": {"aggregation": "count"}},
        {"seq": 5, "tool": "find_unmatched_records", "value": 1.0},
        {"seq": 6, "tool": "calculate_business_impact", "details": {"affected_record_count": 4, "total_record_count": 4}},
        {"seq": 7, "tool": "calculate_business_impact", "details": {"affected_record_count": 3, "total_record_count": 4}},
    )
    kept = lambda **o: sorted(r["seq"] for r in ev.relevant_evidence(calls, **o).collect())
    assert kept() == [3, 4, 5, 7]
    assert kept(duplicates_asked=True) == [1, 2, 3, 4, 5, 7]


def test_whole_table_impact_stays_without_a_narrower_issue(frame):
    calls = entry(frame, {"seq": 1, "tool": "calculate_business_impact",
                          "details": {"affected_record_count": 4, "total_record_count": 4}})
    assert ev.relevant_evidence(calls).count() == 1


def test_confidence_labels(frame):
    df = frame("c double, ok boolean", (0.85, True), (0.84, True), (0.65, True), (0.64, True), (0.99, False), (0.9, None))
    assert [r[0] for r in rows(df.select(ev.confidence_label(F.col("c"), F.col("ok"))))] == [
        "High", "Medium", "Medium", "Low", "Low", "Low",
    ]


def test_citations(frame):
    verdicts = frame("case_id long, verdict string, confidence double",
                     (1, "ACCEPT", 0.9), (2, "ACCEPT", 0.9), (3, "REJECT", 0.8), (4, "ACCEPT", 0.2))
    citations = frame("case_id long, evidence_id string", (1, "E001"), (1, "E999"), (2, "E999"), (2, "E999"))
    known = frame("evidence_id string", ("E001",), ("E002",))
    assert unordered(ev.check_citations(verdicts, citations, known)) == [
        (1, "ACCEPT", 0.9, 1, 1), (2, "REJECT", 0.3, 0, 1), (3, "REJECT", 0.8, 0, 0), (4, "REJECT", 0.2, 0, 0),
    ]


def test_details_in_long_form(frame):
    calls = entry(frame, {"seq": 1, "tool": "t", "details": {"n": 2, "s": "x"}})
    assert unordered(ev.details_map(calls).select("field", "field_value")) == [("n", "2"), ("s", "x")]


# Injection

def test_picks_are_first_or_last_of_a_total_order(frame):
    df = frame("id long, d string", (1, "b"), (2, "a"), (3, "b"), (4, None))
    everything = F.lit(True)
    assert rows(injection.pick_rows(df, everything, ["d", "id"], 2).select("id")) == [(4,), (2,)]
    assert rows(injection.pick_rows(df, everything, ["d", "id"], 2, last=True).select("id")) == [(3,), (1,)]
    with pytest.raises(ReconcileInputError):
        injection.pick_rows(df, everything, [], 2)


def test_injections(frame):
    df = frame("id long, v double", (1, 1.0), (2, 2.0), (3, None))
    two = df.where("id = 2")
    assert unordered(injection.inject_missing(df, two, "id")) == [(1, 1.0), (3, None)]
    assert injection.inject_duplicates(df, two).where("id = 2").count() == 2
    assert unordered(injection.inject_drift(df, two, "id", "v", 0.25)) == [(1, 1.0), (2, 2.25), (3, None)]
    assert unordered(injection.drift_rows(df, F.col("id") > 1, "v", 1.0)) == [(1, 1.0), (2, 3.0), (3, None)]
    assert unordered(injection.blank_values(df, F.col("id") == 1, "v")) == [(1, None), (2, 2.0), (3, None)]
    assert unordered(injection.drop_rows(df, F.col("v") > 1)) == [(1, 1.0), (3, None)]


# Scoring

def expectation_rows(spark, *lists):
    from crosstally.functions.aggregates import rows_from

    return rows_from(spark.range(1), *lists)


def test_scoring_needs_value_dataset_attempt_and_details(spark, frame):
    found = entry(
        frame,
        {"seq": 1, "tool": "find", "a": "source", "details": {"n": 60, "kind": "x"}},
        {"seq": 2, "tool": "find", "a": "other", "attempt": 1, "details": {"n": 60.005, "flag": True}},
    ).withColumn("case_id", F.lit("c")).withColumn("evidence_id", F.format_string("E%03d", "seq"))
    e, lit = scoring.expectation, F.lit
    expected = expectation_rows(
        spark,
        e("c", "both", "find", "n", lit(60)),
        e("c", "one", "find", "n", lit(60), "source"),
        e("c", "later", "find", "n", lit(60), attempt_min=1),
        e("c", "wrong", "find", "n", lit(61)),
        e("c", "kind", "find", "n", lit(60), details={"kind": "x"}),
        e("c", "flag", "find", "flag", lit("true")),
        e("c", "tool", "seek", "n", lit(60)),
    )
    scored = {r["check_id"]: (r["passed"], r["evidence_ids"]) for r in scoring.score_checks(expected, found).collect()}
    assert scored == {
        "both": (True, "E001,E002"), "one": (True, "E001"), "later": (True, "E002"), "wrong": (False, ""),
        "kind": (True, "E001"), "flag": (True, "E002"), "tool": (False, ""),
    }


def test_terms(frame):
    df = frame("t string", ("60 source records are MISSING",), ("A pipeline failure: missing",), ("all fine",), (None,))
    found = scoring.score_terms(df, "t", any_of=["Missing", "unmatched"], none_of=["pipeline", "etl"])
    assert rows(found.select("semantic_pass", "safety_pass")) == [(True, True), (True, False), (False, True), (False, True)]
    grouped = scoring.score_terms(df, "t", all_of=["missing"], each_group=[["60", "61"], ["source"]])
    assert [r[0] for r in rows(grouped.select("semantic_pass"))] == [True, False, False, False]


def test_call_counts(frame):
    found = entry(
        frame, {"seq": 1, "tool": "a", "attempt": 0}, {"seq": 2, "tool": "a", "attempt": 1},
        {"seq": 3, "tool": "b", "attempt": 2},
    ).withColumn("case_id", F.lit("c"))
    minimums = frame("case_id string, tool string, minimum int", ("c", "a", 1), ("c", "b", 1), ("d", "a", 1))
    assert unordered(scoring.score_call_counts(found, minimums)) == [("c", 2, True), ("d", 0, False)]


def test_pass_rate(frame):
    df = frame("suite string, passed boolean", ("x", True), ("x", False), ("x", True), ("y", False))
    assert unordered(scoring.pass_rate(df)) == [("x", 3, 2, 66.67), ("y", 1, 0, 0.0)]


# Known figures and invariants on the order table

@pytest.fixture(scope="module")
def golden(spark):
    """Faults by key arithmetic, with totals counted beforehand on another engine."""
    orders = src(spark, "/root/testdata/sf0.01")
    key = F.col("order_id")
    missing = (F.col("order_priority") == "1-URGENT") & (key % 37 == 0)
    flagged = injection.drop_rows(orders, missing).select(
        "*", ((F.col("order_priority") == "2-HIGH") & (key % 43 == 0)).alias("drift"),
        (key % 211 == 0).alias("no_key"), (key % 53 == 0).alias("no_priority"), (key % 59 == 0).alias("no_amount"),
    )
    moved = injection.drift_rows(flagged, F.col("drift"), "total_amount", 17.25)
    for flag, column in (("no_key", "order_id"), ("no_priority", "order_priority"), ("no_amount", "total_amount")):
        moved = injection.blank_values(moved, F.col(flag), column)
    # Copies are taken from the result, where some keys are gone already.
    twice = (F.col("order_status") == "F") & (key % 41 == 0)
    rows_ = injection.inject_duplicates(moved, moved.where(twice)).select(*orders.columns)
    source = injection.blank_values(orders, key % 53 == 0, "order_priority")
    return orders, source, rows_


def test_golden_bridge(golden):
    _, source, warehouse = golden
    found = one(bridge.bridge_summary(source, warehouse, "order_id", "order_id", "total_amount", "total_amount", scale=2))
    assert found["net_difference_a_minus_b"] == 53226073.92
    assert found["dataset_a_only_metric_sum"] == 42004935.13
    assert found["dataset_b_only_metric_sum"] == 0.0
    assert found["shared_key_metric_difference_a_minus_b"] == 30919408.80
    assert found["null_key_metric_difference_a_minus_b"] == -19698270.01
    assert found["reconciliation_residual"] == -19698270.01 and not found["arithmetic_reconciles"]
    assert (found["dataset_b_extra_exact_copy_count"], found["dataset_b_extra_exact_copy_metric_sum"]) == (112, 30472463.25)
    assert found["dataset_a_extra_exact_copy_count"] == 0
    assert found["shared_key_residual_metric_difference_a_minus_b"] == 61391872.05


def test_golden_counts(golden):
    orders, source, warehouse = golden
    assert warehouse.count() == 15032
    by_column = {r["column"]: r["mismatch_count"] for r in
                 compare.row_mismatches_by_column(source, warehouse, "order_id", "order_id").collect()}
    assert (by_column["order_priority"], by_column["total_amount"]) == (0, 316)
    assert one(compare.compare_rows(source, warehouse, "order_id", "order_id"))["matched_unique_key_count"] == 14728
    assert one(matching.unmatched_summary(orders, warehouse, "order_id", "order_id"))["unmatched_unique_key_count"] == 156


def test_invariants(golden):
    orders, _, warehouse = golden
    key = ("order_id", "order_id")
    both = {r["direction"]: r for r in matching.unmatched_both_ways(orders, warehouse, *key).collect()}
    for r in both.values():
        assert r["matched_count"] + r["unmatched_count"] == r["eligible_record_count"]
    there = one(compare.compare_values(orders, warehouse, *key, "total_amount", "total_amount", scale=2))
    back = one(compare.compare_values(warehouse, orders, *key, "total_amount", "total_amount", scale=2))
    assert there["equal_value_count"] + there["value_mismatch_count"] == there["matched_unique_key_count"]
    assert there["signed_difference_a_minus_b"] == -back["signed_difference_a_minus_b"]
    assert there["absolute_difference_sum"] == back["absolute_difference_sum"]
    ab = one(bridge.bridge_summary(orders, warehouse, *key, "total_amount", "total_amount", scale=2))
    ba = one(bridge.bridge_summary(warehouse, orders, *key, "total_amount", "total_amount", scale=2))
    assert ab["net_difference_a_minus_b"] == -ba["net_difference_a_minus_b"]
    parts = (ab["dataset_a_only_metric_sum"] - ab["dataset_b_only_metric_sum"]
             + ab["shared_key_metric_difference_a_minus_b"] + ab["null_key_metric_difference_a_minus_b"])
    assert abs(parts - ab["net_difference_a_minus_b"]) < 0.01
    total = sum(r["difference"] for r in segments.paired_segments(orders, warehouse, "order_priority", "total_amount", scale=2).collect())
    assert abs(total - ab["net_difference_a_minus_b"]) < 0.01


def test_the_source_of_all_cases_is_checked_for_duplicates_once(spark, monkeypatch):
    from crosstally.plans import baseline
    from crosstally.workload import cases

    orders = spark.createDataFrame(
        [(i, i, None, "F", "2-HIGH", 1.0 + i) for i in range(3)],
        "order_id long, customer_id long, order_date date, order_status string, order_priority string, total_amount double",
    )
    twice, made = orders.unionByName(orders.where("order_id = 1")), []
    monkeypatch.setattr(baseline, "find_duplicates", lambda df: made.append(df) or find_duplicates(df))
    shared = cases.SourceChecks()
    found = [
        cases.case_evidence(cases.Case("clean_control", orders, warehouse, orders), shared)
        for warehouse in (orders, twice, orders)
    ]
    assert [made.count(df) for df in (orders, twice)] == [3, 1]
    copies = [
        sorted(map(tuple, df.where("tool = 'find_duplicates'").select("dataset_a", "value").collect())) for df in found
    ]
    none, some = ("source_orders", 0.0), ("warehouse_orders", 2.0)
    assert copies == [[none, ("warehouse_orders", 0.0)], [none, some], [none, ("warehouse_orders", 0.0)]]


def test_texts_are_compared_without_a_sort(spark, frame):
    schema = "id long, t string, u string"
    a = frame(schema, (1, "x", None), (2, "y", ""), (3, "z", "w"), (None, "n", "n"))
    b = frame(schema, (1, "x", ""), (2, "Y", ""), (3, "z", "w"), (None, "m", "m"))
    compared = compare_rows(a, b, "id", "id")
    assert [tuple(r)[1:3] for r in compared.collect()] == [(3, 2)]
    assert "SortAggregate" not in compared._jdf.queryExecution().executedPlan().toString()
