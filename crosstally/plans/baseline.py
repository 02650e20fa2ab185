"""The fixed set of checks run on a pair of tables before anything else is asked.

Counts, unmatched keys in both directions, exact duplicates on both sides and row comparison
always run; value comparison for every differing numeric column, and impact for each
direction with unmatched rows. Sums, segments and the bridge are left to the caller.

All key-based checks are aggregates over one alignment of the two tables: one scan of each, one
shuffle. Which rows of the result apply is decided by filters on that aggregate, not by jobs
that come back to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.errors import ReconcileInputError
from crosstally.functions.aggregates import rows_from, sum_where
from crosstally.functions.columns import automatic_details, details_from_question, shared_columns
from crosstally.functions.types import is_numeric, require_columns
from crosstally.operators.compare import (
    aggregate_report,
    align_by_key,
    difference_measures,
    repeated_measures,
    row_measures,
    value_report,
)
from crosstally.operators.duplicates import find_duplicates
from crosstally.operators.impact import business_impact
from crosstally.operators.matching import match_measures, match_report
from crosstally.operators.profile import (
    amount_columns,
    dimension_columns,
    profile_columns,
    stack_profiles,
)
from crosstally.operators.relationships import choose_relationships
from crosstally.plans.calls import CallStore, Planned
from crosstally.plans.evidence import EVIDENCE_COLUMNS, HEADLINES, evidence_entry, ledger
from crosstally.sources.registry import DatasetRegistry
from crosstally.sources.writers import materialize


@dataclass(frozen=True)
class ImpactColumns:
    """The columns an impact figure is measured on; None where a table has none."""

    amount: str | None = None
    date: str | None = None
    segment: str | None = None


def impact_columns(profile: DataFrame) -> ImpactColumns:
    """First money column, first date column, best dimension.

    Brings three names to the driver, chosen on the executors from one row per column.
    """
    names = {
        "amount": amount_columns(profile).agg(F.min_by("column", "position")),
        "date": profile.where("is_date").agg(F.min_by("column", "position")),
        "segment": dimension_columns(profile).agg(
            F.min_by("column", F.struct("baseline_rank", "column"))
        ),
    }
    return ImpactColumns(**{role: frame.first()[0] for role, frame in names.items()})


def _key_checks(
    a: DataFrame, b: DataFrame, key: str, name_a: str, name_b: str, pair: str, scale: int | None,
    question: str, start: int, most_values: int | None,
) -> DataFrame:
    """Count, unmatched, row and value evidence from one aggregate over the aligned tables."""
    shared = shared_columns(a, b, key)
    numeric = [(i, c) for i, c in enumerate(shared) if is_numeric(a, c) and is_numeric(b, c)]
    aligned = align_by_key(a, b, key, key, [(c, c) for c in shared], keep_null_keys=True, digests=True)
    measured = aligned.agg(
        sum_where(F.lit(True), F.col("rows_a")).alias("count_a"),
        sum_where(F.lit(True), F.col("rows_b")).alias("count_b"),
        *match_measures("rows_a", "rows_b", "a_"),
        *match_measures("rows_b", "rows_a", "b_"),
        *row_measures(a, b, shared, 0.0, "rows_"),
        *[m for i, c in numeric for m in difference_measures(a, b, c, c, i, 0.0, scale, f"v{i}_")],
        *repeated_measures(),
    )
    pair_arguments = {"dataset_a": name_a, "dataset_b": name_b}
    key_arguments = {**pair_arguments, "key_column_a": key, "key_column_b": key}
    entries: list[list[Column]] = []

    def add(seq, tool, arguments, first, second, figures, finding, keep=F.lit(True)):
        metric = HEADLINES[tool]
        names = {"dataset_a": F.lit(first), "dataset_b": F.lit(second)}
        entries.append(
            evidence_entry(
                pair, start + seq, tool, arguments, first, second, metric, figures[metric], finding,
                {**names, **figures},
            )
            + [keep.alias("keep")]
        )

    counts = aggregate_report("count", F.col("count_a"), F.col("count_b"))
    add(
        1, "compare_aggregates",
        {**pair_arguments, "metric_column_a": "", "metric_column_b": "", "aggregation": "count"},
        name_a, name_b, counts,
        F.format_string(
            f"row counts of {name_a} and {name_b}: %s and %s", F.col("count_a"), F.col("count_b")
        ),
    )
    for seq, first, second, df, prefix in ((2, name_a, name_b, a, "a_"), (3, name_b, name_a, b, "b_")):
        details = details_from_question(question, df.columns, key)
        figures = match_report(prefix)
        shown = details if details is not None else automatic_details(df.columns, key)
        add(
            seq, "find_unmatched_records",
            {**key_arguments, "dataset_a": first, "dataset_b": second, "detail_columns": details},
            first, second, {**figures, "detail_columns": F.lit(",".join(shown))},
            F.format_string(
                f"%s keys (%s rows) of {first} have no match in {second}",
                figures["unmatched_unique_key_count"], figures["unmatched_count"],
            ),
        )
    repeated = {
        c: F.col(c) for c in ("duplicate_key_record_count_a", "duplicate_key_record_count_b")
    }
    if shared:
        rows = {
            "matched_unique_key_count": F.col("rows_matched_unique_key_count"),
            "record_mismatch_count": F.col("rows_record_mismatch_count"),
            "mismatches_by_column": F.struct(
                *[F.col(f"rows_mismatch_{i}").alias(c) for i, c in enumerate(shared)]
            ),
            **repeated,
        }
        add(
            6, "compare_rows_by_key", {**key_arguments, "columns": [], "tolerance": 0.0},
            name_a, name_b, rows,
            F.format_string(
                "%s of %s uniquely matched records differ",
                rows["record_mismatch_count"], rows["matched_unique_key_count"],
            ),
        )
    earlier: Column = F.lit(0)
    for i, column in numeric:
        differs = F.col(f"rows_mismatch_{i}") > 0
        same = F.col("rows_matched_unique_key_count"), F.col(f"rows_mismatch_{i}")
        figures = {**value_report("numeric", f"v{i}_", *same), **repeated}
        add(
            7 + i, "compare_record_values",
            {**key_arguments, "value_column_a": column, "value_column_b": column, "tolerance": 0.0},
            name_a, name_b,
            {"value_column_a": F.lit(column), "value_column_b": F.lit(column), **figures},
            F.format_string(
                f"{column} differs on %s of %s uniquely matched keys",
                figures["value_mismatch_count"], figures["matched_unique_key_count"],
            ),
            differs if most_values is None else differs & (earlier < most_values),
        )
        earlier = earlier + differs.cast("int")
    return rows_from(measured, *entries).where("keep").select(*EVIDENCE_COLUMNS)


def _duplicate_arguments(name: str) -> dict:
    return {"dataset": name, "key_columns": []}


def _duplicate_check(
    df: DataFrame, name: str, pair: str, seq: int, store: CallStore | None
) -> DataFrame:
    arguments = _duplicate_arguments(name)
    found = find_duplicates(df) if store is None else store.run(
        "find_duplicates", arguments, lambda: find_duplicates(df)
    )
    names = [c for c in found.columns if c != "checked_columns"]
    return found.select(
        *evidence_entry(
            pair, seq, "find_duplicates", arguments, name, None,
            "duplicate_row_count", F.col("duplicate_row_count"),
            F.format_string(f"%s rows of {name} are exact copies of each other",
                            F.col("duplicate_row_count")),
            {"dataset": F.lit(name), **{c: F.col(c) for c in names}},
        )
    )


def _impact_check(
    df: DataFrame, other: DataFrame, key: str, name: str, other_name: str, chosen: ImpactColumns,
    pair: str, seq: int, scale: int | None, store: CallStore | None,
) -> DataFrame:
    arguments = {
        "dataset": name, "amount_column": chosen.amount or "", "date_column": chosen.date or "",
        "segment_column": chosen.segment or "", "filters": [], "match_against_dataset": other_name,
        "local_key": key, "other_key": key, "only_unmatched": True,
    }

    def check() -> DataFrame:
        return business_impact(
            df, chosen.amount, chosen.date, chosen.segment, None, other, key, key, True, scale=scale
        )

    # Sums depend on the scale, which is no argument of the reported call.
    figures = check() if store is None else store.run(
        "calculate_business_impact", {**arguments, "scale": scale}, check
    )
    return figures.where(F.col("affected_record_count") > 0).select(
        *evidence_entry(
            pair, seq, "calculate_business_impact", arguments, name, other_name,
            "affected_record_count", F.col("affected_record_count"),
            F.format_string(f"%s unmatched records of {name} are affected",
                            F.col("affected_record_count")),
            {"dataset": F.lit(name), **{c: F.col(c) for c in figures.columns}},
        )
    )


def baseline_checks(
    a: DataFrame,
    b: DataFrame,
    key: str,
    name_a: str = "a",
    name_b: str = "b",
    impact_a: ImpactColumns = ImpactColumns(),
    impact_b: ImpactColumns = ImpactColumns(),
    scale: int | None = None,
    question: str = "",
    most_values: int | None = None,
    first: int = 0,
    planned: Planned | None = None,
    store: CallStore | None = None,
) -> DataFrame:
    """The checks of one pair, not numbered yet; ``first`` shifts their place in the run.

    ``most_values`` bounds the value comparisons shown, by default all differing columns. A check of a
    single dataset that ``planned`` knows is left out. With a ``store`` the checks that scan a dataset on their own
    (duplicates, impact) are read from there if an equal call was made, and stored if not.
    """
    require_columns(a, [key], name_a)
    require_columns(b, [key], name_b)
    pair = f"{name_a}|{name_b}"
    after_values = first + 7 + len(a.columns)
    planned = planned or Planned()
    checks = [_key_checks(a, b, key, name_a, name_b, pair, scale, question, first, most_values)]
    for seq, df, name in ((4, a, name_a), (5, b, name_b)):
        if planned.is_new("find_duplicates", _duplicate_arguments(name)):
            checks.append(_duplicate_check(df, name, pair, first + seq, store))
    checks += [
        _impact_check(a, b, key, name_a, name_b, impact_a, pair, after_values, scale, store),
        _impact_check(b, a, key, name_b, name_a, impact_b, pair, after_values + 1, scale, store),
    ]
    return reduce(DataFrame.unionByName, checks)


def baseline_evidence(a: DataFrame, b: DataFrame, key: str, *arguments, **options) -> DataFrame:
    """Numbered evidence for one pair; lazy. Takes the arguments of :func:`baseline_checks`."""
    return ledger(baseline_checks(a, b, key, *arguments, **options))


def _failed(spark: SparkSession, pair: str, left: str, right: str, seq: int, reason: str) -> DataFrame:
    """The ledger row of a pair whose checks cannot be built."""
    return spark.range(1).select(
        *evidence_entry(
            pair, seq, "check_failed", {"dataset_a": left, "dataset_b": right}, left, right,
            HEADLINES["check_failed"], F.lit(1), F.lit(f"not checked: {reason}"),
            {"dataset_a": F.lit(left), "dataset_b": F.lit(right), "reason": F.lit(reason)},
        )
    )


def reconcile(
    datasets: DatasetRegistry, question: str = "", scale: int | None = None,
    distinct: str = "exact", most_pairs: int | None = None, most_values: int | None = None,
    store: CallStore | None = None,
) -> DataFrame:
    """Profile all datasets once, pick the likely shared keys, and run the baseline on each pair.

    The profiles (one row per column) are stored and read from there; only names of keys and
    columns reach the driver. A pair that cannot be checked gets a ``check_failed`` row and the others go
    on; datasets without a shared identifier give an empty ledger. A dataset that is part of several pairs is
    checked for duplicates once; ``store`` keeps results for later runs.
    """
    if not len(datasets):
        raise ReconcileInputError("no datasets to reconcile")
    profiles = materialize(
        stack_profiles([profile_columns(df, n, distinct, scale) for n, df in datasets.items()]),
        "profiles",
    )
    chosen = choose_relationships(profiles, most_pairs).collect()
    used = sorted({n for r in chosen for n in (r["left_dataset"], r["right_dataset"])})
    roles = {n: impact_columns(profiles.where(F.col("dataset") == n)) for n in used}
    spark, checks, first, planned = profiles.sparkSession, [], 0, Planned()
    for left, right, key in chosen:
        a, b = datasets[left], datasets[right]
        try:
            found = baseline_checks(
                a, b, key, left, right, roles[left], roles[right], scale, question, most_values, first,
                planned, store,
            )
        except ReconcileInputError as error:
            found = _failed(spark, f"{left}|{right}", left, right, first, str(error))
        checks.append(found)
        first += 10 + len(a.columns)
    if not checks:
        checks = [_failed(spark, "", "", "", 0, "").where("false")]
    # All pairs are one run: its rows follow from the number of datasets and columns, not from their data.
    return ledger(*checks, run=None)
