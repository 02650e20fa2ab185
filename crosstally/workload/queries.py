"""The query catalogue: every operator over whole given tables, with SQL-comparable output.

Each function takes ``(spark, sf_dir)``. Arrays are joined to text and percentages rounded so
that another SQL engine can state the same result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.functions.columns import details_from_question
from crosstally.functions.periods import ELECTED, date_formats
from crosstally.functions.predicates import apply_filters
from crosstally.functions.text import (
    has_whole_words, json_details, normal_text, redact, shorten, signed_amount,
)
from crosstally.operators import bridge, compare, duplicates, impact, matching, profile
from crosstally.operators import relationships as related
from crosstally.operators import segments
from crosstally.plans import evidence as ev
from crosstally.plans import injection, scoring
from crosstally.plans.baseline import ImpactColumns, baseline_evidence, reconcile
from crosstally.sources.readers import read_csv, read_json
from crosstally.sources.registry import DatasetRegistry
from crosstally.sources.writers import materialize, shared_folder, write_csv, write_json
from crosstally.workload import cases
from crosstally.workload.frames import (
    is_drifted, is_duplicated, is_missing, nan_for_null, src, src_nulls, table, wh_drift, wh_dup, wh_missing,
    wh_mixed, wh_nulls,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY = ("order_id", "order_id")
MONEY = 2


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# Sources and sinks ---------------------------------------------------------------------------

def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/crosstally-{uuid.uuid4().hex}/{name}"


@query
def csv_round_trip(spark, sf_dir):
    path = _folder(spark, "orders.csv")
    write_csv(wh_nulls(spark, sf_dir), path)
    return read_csv(spark, path)


@query
def csv_with_schema(spark, sf_dir):
    events, path = table(spark, sf_dir, "events"), _folder(spark, "events.csv")
    write_csv(events, path)
    return read_csv(spark, path, events.schema)


@query
def json_round_trip(spark, sf_dir):
    orders, path = wh_nulls(spark, sf_dir), _folder(spark, "orders.json")
    write_json(orders, path)
    return read_json(spark, path, orders.schema)


@query
def csv_awkward(spark, sf_dir):
    """An unnamed column, whole numbers beyond a long, and texts that look like Java numbers."""
    key, path = F.col("order_id"), _folder(spark, "awkward.csv")
    orders = src(spark, sf_dir).select(
        key.alias(""), F.concat(F.lit("123456789012"), F.lpad(key.cast("string"), 10, "0")).alias("big"),
        F.concat(key.cast("string"), F.lit("D")).alias("code"), F.col("total_amount").alias("amount"),
    )
    write_csv(orders, path)
    return read_csv(spark, path).withColumn("big", F.col("big").cast("string"))


# Filters -------------------------------------------------------------------------------------

def _filtered(spark: SparkSession, sf_dir: str, *conditions: dict) -> DataFrame:
    return apply_filters(wh_nulls(spark, sf_dir), conditions)


@query
def filter_eq(spark, sf_dir):
    return _filtered(spark, sf_dir, {"column": "order_priority", "value": "2-HIGH"})


@query
def filter_ne_keeps_null(spark, sf_dir):
    return _filtered(
        spark, sf_dir, {"column": "order_priority", "operator": "ne", "value": "2-HIGH"}
    )


@query
def filter_range(spark, sf_dir):
    return _filtered(
        spark, sf_dir,
        {"column": "total_amount", "operator": "gte", "value": 100000},
        {"column": "total_amount", "operator": "lt", "value": 200000},
        {"column": "order_status", "operator": "gt", "value": "F"},
        {"column": "order_date", "operator": "lte", "value": "1999-12-31"},
    )


@query
def filter_in(spark, sf_dir):
    return _filtered(
        spark, sf_dir, {"column": "order_priority", "operator": "in", "value": ["2-HIGH", "5-LOW"]}
    )


@query
def filter_not_in_keeps_null(spark, sf_dir):
    return _filtered(
        spark, sf_dir,
        {"column": "order_priority", "operator": "not_in", "value": ["2-HIGH", "5-LOW"]},
    )


@query
def filter_null(spark, sf_dir):
    return _filtered(spark, sf_dir, {"column": "order_id", "operator": "is_null"})


@query
def filter_not_null(spark, sf_dir):
    return _filtered(
        spark, sf_dir,
        {"column": "order_id", "operator": "not_null"},
        {"column": "total_amount", "operator": "not_null"},
    )


@query
def filter_other_type(spark, sf_dir):
    return _filtered(
        spark, sf_dir,
        {"column": "customer_id", "operator": "ne", "value": "17"},
        {"column": "order_priority", "operator": "not_in", "value": [1, 2]},
        {"column": "order_status", "operator": "eq", "value": "O"},
    )


# Totals --------------------------------------------------------------------------------------

def _totals(spark, sf_dir, aggregation, metric):
    return compare.compare_aggregates(
        src(spark, sf_dir), wh_mixed(spark, sf_dir), metric, metric, aggregation, MONEY
    )


@query
def agg_compare_count(spark, sf_dir):
    return _totals(spark, sf_dir, "count", None)


@query
def agg_compare_count_column(spark, sf_dir):
    return _totals(spark, sf_dir, "count", "order_priority")


@query
def agg_compare_sum(spark, sf_dir):
    return _totals(spark, sf_dir, "sum", "total_amount")


@query
def agg_compare_mean(spark, sf_dir):
    return _totals(spark, sf_dir, "mean", "total_amount")


# Matching ------------------------------------------------------------------------------------

@query
def unmatched_orders_lineitem(spark, sf_dir):
    return matching.unmatched_rows(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )


@query
def unmatched_documents_labels(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return matching.unmatched_rows(documents, table(spark, sf_dir, "labels"), "doc_id", "doc_id")


@query
def unmatched_summary(spark, sf_dir):
    found = matching.unmatched_summary(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )
    return _round(found, "unmatched_percentage")


@query
def unmatched_summary_both_ways(spark, sf_dir):
    found = matching.unmatched_both_ways(src(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY)
    return _round(found, "unmatched_percentage")


@query
def unmatched_one_sided_keys(spark, sf_dir):
    return bridge.only_keys(src(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY)


@query
def unmatched_preview(spark, sf_dir):
    return matching.unmatched_preview(src(spark, sf_dir), wh_missing(spark, sf_dir), *KEY)


@query
def unmatched_preview_asked(spark, sf_dir):
    """The details that a question names, column by column, in the order of the table."""
    orders = src(spark, sf_dir)
    asked = details_from_question("Which order status and Total-Amount are missing?", orders.columns, "order_id")
    return matching.unmatched_preview(orders, wh_missing(spark, sf_dir), *KEY, asked)


@query
def unmatched_preview_repeated_keys(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("source", "lang", "n_chars", "doc_id")
    covered = documents.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")
    return matching.unmatched_preview(
        documents, covered.select("n_chars"), "n_chars", "n_chars", ["source", "lang", "doc_id"]
    )


# Duplicates ----------------------------------------------------------------------------------

def _duplicates(df, key_columns=None):
    found = duplicates.find_duplicates(df, key_columns)
    return _round(
        found.withColumn("checked_columns", F.concat_ws(",", "checked_columns")),
        "duplicate_percentage",
    )


@query
def dup_exact_rows(spark, sf_dir):
    return _duplicates(wh_dup(spark, sf_dir))


@query
def dup_exact_lineitem(spark, sf_dir):
    return _duplicates(table(spark, sf_dir, "lineitem"))


@query
def dup_repeated_key(spark, sf_dir):
    return _duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def dup_document_text(spark, sf_dir):
    return _duplicates(table(spark, sf_dir, "documents"), ["text"])


@query
def dup_preview(spark, sf_dir):
    return duplicates.duplicate_preview(
        table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]
    )


@query
def dup_rows(spark, sf_dir):
    return duplicates.duplicate_rows(wh_mixed(spark, sf_dir), ["order_id", "order_priority"])


# Values and rows -----------------------------------------------------------------------------

def _values(spark, sf_dir, column, tolerance):
    found = compare.compare_values(
        src(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY, column, column, tolerance, MONEY
    )
    return _round(found, "value_mismatch_percentage")


@query
def values_numeric(spark, sf_dir):
    return _values(spark, sf_dir, "total_amount", 0.0)


@query
def values_nan(spark, sf_dir):
    found = compare.compare_values(
        src(spark, sf_dir), nan_for_null(wh_mixed(spark, sf_dir)), *KEY, "total_amount", "total_amount", 0.0, MONEY
    )
    return _round(found, "value_mismatch_percentage")


@query
def values_numeric_tolerance(spark, sf_dir):
    return _values(spark, sf_dir, "total_amount", 20.0)


@query
def values_exact(spark, sf_dir):
    return _values(spark, sf_dir, "order_priority", 0.0)


@query
def values_mismatches(spark, sf_dir):
    return compare.value_mismatches(
        src(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY, "total_amount", "total_amount"
    )


@query
def values_mismatch_preview(spark, sf_dir):
    return compare.value_mismatch_preview(
        src(spark, sf_dir), wh_drift(spark, sf_dir), *KEY, "total_amount", "total_amount"
    )


@query
def rows_by_key_summary(spark, sf_dir):
    found = compare.compare_rows(src_nulls(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY)
    return found.withColumn("columns_compared", F.concat_ws(",", "columns_compared"))


@query
def rows_by_key_columns(spark, sf_dir):
    return compare.row_mismatches_by_column(src_nulls(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY)


@query
def rows_mismatched_keys(spark, sf_dir):
    return compare.mismatched_keys(src(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY)


# Bridge --------------------------------------------------------------------------------------

METRICS = ("total_amount", "total_amount")


@query
def bridge_summary(spark, sf_dir):
    return bridge.bridge_summary(
        src_nulls(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY, *METRICS, scale=MONEY
    )


@query
def bridge_nan(spark, sf_dir):
    return bridge.bridge_summary(
        src_nulls(spark, sf_dir), nan_for_null(wh_mixed(spark, sf_dir)), *KEY, *METRICS, scale=MONEY
    )


@query
def bridge_table(spark, sf_dir):
    table_ = bridge.bridge_table(bridge_summary(spark, sf_dir))
    return table_.withColumn("effect_text", signed_amount(F.col("signed_effect")))


@query
def bridge_extra_copies(spark, sf_dir):
    return bridge.extra_copies(
        src_nulls(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY, *METRICS, side="b"
    )


@query
def bridge_extra_copies_preview(spark, sf_dir):
    return bridge.extra_copies_preview(
        src_nulls(spark, sf_dir), wh_mixed(spark, sf_dir), *KEY, *METRICS, side="b"
    )


# Segments ------------------------------------------------------------------------------------

@query
def segment_count(spark, sf_dir):
    return segments.segment_groups(wh_nulls(spark, sf_dir), "order_priority")


@query
def segment_sum(spark, sf_dir):
    return segments.segment_groups(
        wh_nulls(spark, sf_dir), "order_priority", "total_amount", "sum", scale=MONEY
    )


@query
def segment_mean(spark, sf_dir):
    return segments.segment_groups(
        table(spark, sf_dir, "events"), "event_type", "value", "mean", scale=MONEY
    )


def _period(spark, sf_dir, frequency):
    return segments.segment_groups(
        src(spark, sf_dir), None, "total_amount", "sum", "order_date", frequency, scale=MONEY
    )


@query
def segment_day(spark, sf_dir):
    return segments.segment_groups(
        table(spark, sf_dir, "events"), None, "value", "sum", "ts", "D", scale=MONEY
    )


@query
def segment_week(spark, sf_dir):
    return _period(spark, sf_dir, "weekly")


@query
def segment_month(spark, sf_dir):
    return _period(spark, sf_dir, "Month")


@query
def segment_quarter(spark, sf_dir):
    return _period(spark, sf_dir, "Q")


@query
def segment_year(spark, sf_dir):
    return _period(spark, sf_dir, "year")


def _dates_as_texts(spark, sf_dir):
    """The orders with their date as texts of several forms, some of them not dates."""
    form = lambda pattern: F.date_format("order_date", pattern)
    return src(spark, sf_dir).withColumns({
        "month_first": form("MM/dd/yyyy"),
        "day_first": F.when(F.col("order_status") == "P", "unknown").otherwise(form("d/M/yyyy")),
        "named_month": form("d MMM yyyy"),
        "some_iso": F.when(F.col("order_priority") != "1-URGENT", form("yyyy-MM-dd")),
    })


@query
def date_format_election(spark, sf_dir):
    rows = _dates_as_texts(spark, sf_dir)
    return reduce(DataFrame.unionByName, [
        date_formats(rows, c).limit(1).withColumn("column", F.lit(c))
        for c in ("month_first", "day_first", "named_month", "some_iso")
    ])


@query
def segment_month_of_texts(spark, sf_dir):
    return segments.segment_groups(
        _dates_as_texts(spark, sf_dir), None, "total_amount", "sum", "day_first", "Month", ELECTED, MONEY
    )


@query
def details_as_json(spark, sf_dir):
    rows = wh_nulls(spark, sf_dir)
    columns = ["order_id", "customer_id", "order_status", "order_priority"]
    return rows.select("customer_id", "order_date", json_details(rows, columns).alias("details"))


@query
def segment_by_month_and_priority(spark, sf_dir):
    return segments.segment_analysis(
        src(spark, sf_dir), "order_priority", "total_amount", "sum",
        [{"column": "order_status", "operator": "ne", "value": "P"}],
        "order_date", "M", scale=MONEY,
    ).groups


def _unmatched_segments(spark, sf_dir):
    return segments.segment_analysis(
        src(spark, sf_dir), "order_status", "total_amount", "sum",
        match_against=wh_mixed(spark, sf_dir), local_key="order_id", other_key="order_id",
        only_unmatched=True, scale=MONEY,
    )


@query
def segment_unmatched(spark, sf_dir):
    return _unmatched_segments(spark, sf_dir).groups


@query
def segment_unmatched_summary(spark, sf_dir):
    return _unmatched_segments(spark, sf_dir).summary


@query
def segment_topk(spark, sf_dir):
    return segments.segment_analysis(
        src(spark, sf_dir), "customer_id", "total_amount", "sum", top_n=15, scale=MONEY
    ).top


@query
def segment_topk_large(spark, sf_dir):
    return segments.segment_analysis(
        src(spark, sf_dir), "customer_id", "total_amount", "sum", top_n=400, scale=MONEY
    ).top


@query
def segment_nan(spark, sf_dir):
    return segments.segment_groups(
        nan_for_null(wh_nulls(spark, sf_dir)), "order_priority", "total_amount", "sum", scale=MONEY
    )


@query
def segment_offset_times(spark, sf_dir):
    """The same moments written five hours east of UTC fall into the same days."""
    local = F.date_format(F.col("ts") + F.expr("INTERVAL 5 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    events = table(spark, sf_dir, "events").withColumn("ts", F.concat(local, F.lit("+05:00")))
    return segments.segment_groups(
        events, None, "value", "sum", date_column="ts", date_frequency="D", scale=MONEY
    )


@query
def segment_paired(spark, sf_dir):
    return segments.paired_segments(
        src(spark, sf_dir), wh_mixed(spark, sf_dir), "order_priority", "total_amount", scale=MONEY
    )


@query
def localize_segment(spark, sf_dir):
    return segments.localize_segment(
        src(spark, sf_dir), wh_drift(spark, sf_dir), "order_priority", "total_amount", scale=MONEY
    )


DIMENSIONS = ("order_status", "order_priority", "order_year")


@query
def localize_dimensions(spark, sf_dir):
    sides = [
        df.withColumn("order_year", F.year("order_date")) for df in (src(spark, sf_dir), wh_drift(spark, sf_dir))
    ]
    return segments.localize_dimensions(*sides, DIMENSIONS, "total_amount", scale=MONEY)


# Impact --------------------------------------------------------------------------------------

PERCENTAGES = ("affected_percentage", "primary_segment_percentage")


@query
def impact_filtered(spark, sf_dir):
    found = impact.business_impact(
        wh_nulls(spark, sf_dir), "total_amount", "order_date", "order_priority",
        [{"column": "order_status", "operator": "in", "value": ["F", "O"]}], scale=MONEY,
    )
    return _round(found, *PERCENTAGES)


@query
def impact_unmatched(spark, sf_dir):
    found = impact.business_impact(
        src(spark, sf_dir), "total_amount", "order_date", "order_priority",
        match_against=wh_mixed(spark, sf_dir), local_key="order_id", other_key="order_id",
        only_unmatched=True, scale=MONEY,
    )
    return _round(found, *PERCENTAGES)


@query
def impact_orders_without_lines(spark, sf_dir):
    found = impact.business_impact(
        table(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate", "o_orderpriority",
        match_against=table(spark, sf_dir, "lineitem"), local_key="o_orderkey",
        other_key="l_orderkey", only_unmatched=True, scale=MONEY,
    )
    return _round(found, *PERCENTAGES)


# Profiles and relationships ------------------------------------------------------------------

def _renamed(spark, sf_dir) -> dict[str, DataFrame]:
    """orders, lineitem and customer under names that share their keys."""
    lineitem = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("line_price"),
        F.col("l_returnflag").alias("return_status"),
    )
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("market_segment"),
    )
    return {"orders": wh_mixed(spark, sf_dir), "lineitem": lineitem, "customer": customer}


def _stored_profiles(spark, sf_dir) -> DataFrame:
    """Profiled once, however often the profile is read."""
    return materialize(_profiles(spark, sf_dir), "profiles")


def _profiles(spark, sf_dir) -> DataFrame:
    frames = {**_renamed(spark, sf_dir), "events": table(spark, sf_dir, "events")}
    return profile.stack_profiles(
        [profile.profile_columns(df, name, scale=MONEY) for name, df in frames.items()]
    )


@query
def profile_columns(spark, sf_dir):
    return _profiles(spark, sf_dir).drop("data_type")


@query
def profile_table(spark, sf_dir):
    frames = _renamed(spark, sf_dir)
    parts = [profile.profile_table(df, name) for name, df in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def constant_columns(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("batch", F.lit("labels"))
    found = profile.constant_columns(profile.profile_columns(labels, "labels"))
    return found.select("dataset", "column", "unique_count")


@query
def dimension_candidates(spark, sf_dir):
    return profile.dimension_columns(_profiles(spark, sf_dir)).select(
        "dataset", "column", "unique_count", "baseline_rank", "guide_rank"
    )


@query
def amount_columns(spark, sf_dir):
    return profile.amount_columns(_profiles(spark, sf_dir)).select("dataset", "column", "sum")


@query
def relationships(spark, sf_dir):
    return related.relationships(_stored_profiles(spark, sf_dir))


@query
def relationship_choice(spark, sf_dir):
    return related.choose_relationships(_stored_profiles(spark, sf_dir))


@query
def relationship_lines(spark, sf_dir):
    return related.relationship_lines(related.relationships(_stored_profiles(spark, sf_dir)))


@query
def quality_review(spark, sf_dir):
    return profile.quality_review(profile_table(spark, sf_dir), _profiles(spark, sf_dir))


# Baseline and evidence -----------------------------------------------------------------------

IMPACT = ImpactColumns("total_amount", "order_date", "order_priority")


def _baseline(spark, sf_dir, **options):
    return baseline_evidence(
        src(spark, sf_dir), wh_mixed(spark, sf_dir), "order_id", "source", "warehouse",
        IMPACT, IMPACT, MONEY, **options,
    )


def _evidence_report(evidence: DataFrame, *more: str) -> DataFrame:
    return evidence.select(
        "evidence_id", "tool", "dataset_a", "dataset_b", "metric", "value", "signature", *more
    )


@query
def baseline(spark, sf_dir):
    return _evidence_report(_baseline(spark, sf_dir))


@query
def baseline_findings(spark, sf_dir):
    """What each check found, in words, with two of the figures that its details hold."""
    figure = lambda name: F.get_json_object("details", f"$.{name}").cast("long")
    return _baseline(spark, sf_dir).select(
        "evidence_id", "tool", "finding",
        figure("unmatched_count").alias("unmatched_rows"), figure("matched_unique_key_count").alias("matched_keys"),
    )


@query
def baseline_with_inferred_key(spark, sf_dir):
    datasets = DatasetRegistry()
    datasets.add("source", src(spark, sf_dir))
    datasets.add("warehouse", wh_mixed(spark, sf_dir))
    return _evidence_report(reconcile(datasets, scale=MONEY))


@query
def baseline_many_pairs(spark, sf_dir):
    """Every pair of tables that shares a key is checked: counts and unmatched keys of each."""
    datasets = DatasetRegistry()
    for name, df in _renamed(spark, sf_dir).items():
        datasets.add(name, df)
    found = reconcile(datasets, scale=MONEY)
    return found.where(F.col("tool").isin("compare_aggregates", "find_unmatched_records")).select(
        "pair", "tool", "dataset_a", "value"
    )


@query
def evidence_dedup(spark, sf_dir):
    first = _baseline(spark, sf_dir).drop("evidence_id")
    again = first.withColumn("attempt", F.lit(1))
    return _evidence_report(ev.ledger(first, again), "attempt")


@query
def evidence_relevant(spark, sf_dir):
    profiles = profile.stack_profiles([
        profile.profile_columns(src(spark, sf_dir), "source", scale=MONEY),
        profile.profile_columns(wh_mixed(spark, sf_dir), "warehouse", scale=MONEY),
    ])
    grain = related.relationships(profiles).where(F.col("local_column") == "order_id")
    return _evidence_report(ev.relevant_evidence(_baseline(spark, sf_dir), grain))


@query
def citation_check(spark, sf_dir):
    return cases.checked_verdicts(spark, sf_dir)


@query
def confidence_label(spark, sf_dir):
    checked = cases.checked_verdicts(spark, sf_dir)
    return checked.select(
        "case_id", "confidence",
        ev.confidence_label(F.col("confidence"), F.col("verdict") == "ACCEPT").alias("label"),
    )


# Fault injection -----------------------------------------------------------------------------

@query
def inject_missing(spark, sf_dir):
    orders = src(spark, sf_dir)
    return injection.inject_missing(orders, cases.last_urgent(orders), "order_id")


@query
def inject_duplicates(spark, sf_dir):
    orders = src(spark, sf_dir)
    return injection.inject_duplicates(orders, cases.first_fulfilled(orders))


@query
def inject_drift(spark, sf_dir):
    orders = src(spark, sf_dir)
    return injection.inject_drift(
        orders, cases.last_high(orders), "order_id", "total_amount", cases.DRIFT, MONEY
    )


@query
def inject_offset(spark, sf_dir):
    orders = src(spark, sf_dir)
    missing, repeated = cases.offsetting_picks(orders)
    return injection.inject_offsetting(orders, missing, repeated, "order_id")


@query
def inject_truth(spark, sf_dir):
    orders = src(spark, sf_dir)
    truth = [
        injection.injection_truth(
            orders.where(is_missing()), "missing", "total_amount", "order_priority", "order_date"
        ),
        injection.injection_truth(
            orders.where(is_duplicated()), "duplicated", "total_amount", "order_status", "order_date"
        ),
        injection.injection_truth(
            orders.where(is_drifted()), "drifted", "total_amount", "order_priority", "order_date",
            drift=17.25,
        ),
    ]
    return truth[0].unionByName(truth[1]).unionByName(truth[2])


# Scoring -------------------------------------------------------------------------------------

@query
def score_checks(spark, sf_dir):
    scored = cases.scored_checks(spark, sf_dir, cases.DETERMINISTIC)
    return scored.withColumn("expected", F.col("expected").try_cast("double"))


@query
def score_pass_rate(spark, sf_dir):
    return cases.suite_pass_rate(spark, sf_dir)


@query
def score_call_counts(spark, sf_dir):
    return cases.call_counts(spark, sf_dir)


@query
def score_terms(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = scoring.score_terms(
        texts, "text", any_of=("the", "missing"), all_of=("in",),
        each_group=(("and", "der", "les"), ("on", "en")), none_of=("license", "etl", "http"),
    )
    return scored.select("doc_id", "semantic_pass", "safety_pass")


@query
def redact_text(spark, sf_dir):
    texts = table(spark, sf_dir, "documents")
    redacted = texts.select("doc_id", redact(F.col("text")).alias("redacted"))
    return redacted.withColumn("line", shorten(F.col("redacted")))


@query
def text_whole_words(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id", "turn", normal_text(F.col("text")).alias("normal"),
        has_whole_words(F.col("text"), "The").alias("has_the"),
    )
