"""Scoring of evidence and wording against known truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: numbers this close count as equal.
SCORE_TOLERANCE = 0.01


def expectation(
    case: str,
    check: str,
    tool: str,
    field: str,
    value: Column,
    dataset_a: str | None = None,
    attempt_min: int = 0,
    details: dict[str, str] | None = None,
) -> list[Column]:
    """The columns of one expectation; ``value`` is usually a column of the truth table."""
    fixed = [F.lit(x).cast("string") for kv in (details or {}).items() for x in kv]
    return [
        F.lit(case).alias("case_id"),
        F.lit(check).alias("check_id"),
        F.lit(tool).alias("tool"),
        F.lit(field).alias("field"),
        value.cast("string").alias("expected"),
        F.lit(dataset_a).cast("string").alias("expected_dataset"),
        F.lit(attempt_min).alias("attempt_min"),
        (F.create_map(*fixed) if fixed else F.create_map().cast("map<string,string>")).alias(
            "expected_details"
        ),
    ]


def same_value(found: Column, expected: Column) -> Column:
    """Equal text, or numbers within the scoring tolerance; never null."""
    gap = F.abs(found.try_cast("double") - expected.try_cast("double"))
    return F.coalesce(
        (found == expected) | F.coalesce(gap <= SCORE_TOLERANCE, F.lit(False)), F.lit(False)
    )


def score_checks(expectations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether some evidence row meets each expectation, and which rows do.

    ``evidence`` needs ``case_id, evidence_id, tool, dataset_a, attempt, details``. Rows meet on
    case and tool, where each case has one ledger entry per distinct check.
    """
    found = evidence.select(
        "case_id", "tool", "evidence_id", "attempt", F.col("dataset_a").alias("evidence_dataset"),
        F.from_json("details", "map<string,string>").alias("fields"),
    )
    joined = expectations.join(found, ["case_id", "tool"], "left")
    details_hold = F.forall(
        F.map_entries("expected_details"),
        lambda e: same_value(F.try_element_at(F.col("fields"), e["key"]), e["value"]),
    )
    holds = (
        F.col("evidence_id").isNotNull()
        & same_value(F.try_element_at(F.col("fields"), F.col("field")), F.col("expected"))
        & (F.col("attempt") >= F.col("attempt_min"))
        & (F.col("expected_dataset").isNull() | (F.col("expected_dataset") == F.col("evidence_dataset")))
        & details_hold
    )
    return joined.groupBy("case_id", "check_id", "tool", "field", "expected").agg(
        F.coalesce(F.bool_or(holds), F.lit(False)).alias("passed"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(holds, F.col("evidence_id"))))).alias(
            "evidence_ids"
        ),
    )


def contains_term(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """At least one term, in any case; true without terms."""
    found = F.lit(not terms)
    for term in terms:
        found = found | contains_term(text, term)
    return found


def all_terms(text: Column, terms: Sequence[str]) -> Column:
    held = F.lit(True)
    for term in terms:
        held = held & contains_term(text, term)
    return held


def score_terms(
    df: DataFrame,
    text: str,
    any_of: Sequence[str] = (),
    all_of: Sequence[str] = (),
    each_group: Sequence[Sequence[str]] = (),
    none_of: Sequence[str] = (),
) -> DataFrame:
    """Add ``semantic_pass`` (required wording) and ``safety_pass`` (no forbidden wording)."""
    value = F.coalesce(F.col(text), F.lit(""))
    semantic = any_term(value, any_of) & all_terms(value, all_of)
    for group in each_group:
        semantic = semantic & any_term(value, group)
    safe = ~any_term(value, none_of) if none_of else F.lit(True)
    return df.withColumn("semantic_pass", semantic).withColumn("safety_pass", safe)


def score_call_counts(evidence: DataFrame, minimums: DataFrame) -> DataFrame:
    """Per case: are there enough calls of every required tool beyond the baseline?

    ``minimums``: ``case_id, tool, minimum``. Baseline evidence (attempt 0) does not count.
    """
    calls = evidence.where(F.col("attempt") > 0).groupBy("case_id", "tool").agg(
        F.count(F.lit(1)).alias("calls")
    )
    counted = minimums.join(calls, ["case_id", "tool"], "left").withColumn(
        "calls", F.coalesce("calls", F.lit(0))
    )
    return counted.groupBy("case_id").agg(
        F.sum("calls").alias("required_tool_calls"),
        F.bool_and(F.col("calls") >= F.col("minimum")).alias("tool_calls_pass"),
    )


def pass_rate(results: DataFrame, by: str = "suite") -> DataFrame:
    """``runs, passed, pass_rate`` (0-100, two digits) per suite."""
    return results.groupBy(by).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.col("passed")).alias("passed"),
        F.round(F.avg(F.col("passed").cast("double")) * 100, 2).alias("pass_rate"),
    )
