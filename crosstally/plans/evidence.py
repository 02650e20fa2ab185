"""The evidence ledger: one row per executed check, and the rules applied to it."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crosstally.functions.text import call_signature, canonical_json
from crosstally.operators.relationships import with_cardinality

# The headline figure of each check.
HEADLINES = {
    "profile_dataset": "row_count",
    "compare_aggregates": "absolute_difference",
    "find_unmatched_records": "unmatched_unique_key_count",
    "compare_record_values": "value_mismatch_count",
    "compare_rows_by_key": "record_mismatch_count",
    "find_duplicates": "duplicate_row_count",
    "find_duplicates_by_key": "duplicate_row_count",
    "check_failed": "failed",
    "segment_analysis": "filtered_record_count",
    "reconcile_record_set_contributions": "net_difference_a_minus_b",
    "calculate_business_impact": "affected_record_count",
}

# Confidence labels and the cap for a verdict without a valid citation.
HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.65
UNCITED_CONFIDENCE = 0.3

EVIDENCE_COLUMNS = (
    "pair", "seq", "attempt", "tool", "dataset_a", "dataset_b", "metric", "value", "finding",
    "details", "signature",
)


def evidence_entry(
    pair: str,
    seq: int,
    tool: str,
    arguments: Mapping[str, Any],
    dataset_a: str,
    dataset_b: str | None,
    metric: str,
    value: Column,
    finding: Column,
    details: Mapping[str, Column],
    attempt: int = 0,
) -> list[Column]:
    """The columns of one evidence row, for use in ``select`` or ``rows_from``."""
    return [
        F.lit(pair).alias("pair"),
        F.lit(seq).alias("seq"),
        F.lit(attempt).alias("attempt"),
        F.lit(tool).alias("tool"),
        F.lit(dataset_a).alias("dataset_a"),
        F.lit(dataset_b).cast("string").alias("dataset_b"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        finding.alias("finding"),
        F.to_json(
            F.struct(*[c.alias(n) for n, c in details.items()]), {"ignoreNullFields": "false"}
        ).alias("details"),
        call_signature(F.lit(tool), F.lit(canonical_json(dict(arguments)))).alias("signature"),
    ]


def ledger(*evidence: DataFrame, run: str | None = "pair") -> DataFrame:
    """All evidence with repeated calls removed and ids ``E001``, ``E002``, ... per run.

    ``run`` names the column that tells runs apart; with None all rows are one run. A run has
    one row per distinct check, so numbering within a run is a small window.
    """
    rows = reduce(DataFrame.unionByName, evidence)
    keys = [run, "signature"] if run else ["signature"]
    others = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(
        F.min_by(F.struct(*others), F.struct("attempt", "seq")).alias("first")
    )
    flat = kept.select(*keys, "first.*").select(*rows.columns)
    order = Window.partitionBy(run or F.lit("one run")).orderBy("attempt", "seq", "signature")
    return flat.withColumn("evidence_id", F.format_string("E%03d", F.row_number().over(order)))


def detail(name: str) -> Column:
    """A field of the JSON details as text."""
    return F.get_json_object("details", f"$.{name}")


def relevant_evidence(
    evidence: DataFrame, related: DataFrame | None = None, duplicates_asked: bool = False
) -> DataFrame:
    """Drop evidence that says nothing about a discrepancy.

    Left out are repeated keys and zero-duplicate rows unless duplicates were asked for, row
    count comparisons of tables that are not one-to-one, and impact on a whole table when a
    narrower issue is known for the pair. ``related`` is the output of ``relationships``.
    """
    narrow_tools = ("find_unmatched_records", "compare_record_values", "compare_rows_by_key")
    narrow = evidence.groupBy("pair").agg(
        F.max(F.col("tool").isin(*narrow_tools) & (F.col("value") > 0)).alias("narrow")
    )
    rows = evidence.join(narrow, "pair", "left")
    is_count = (F.col("tool") == "compare_aggregates") & (detail("aggregation") == "count")
    duplicates = F.col("tool").startswith("find_duplicates")
    repeated_key = F.coalesce(detail("analysis_type") == "repeated_key", F.lit(False))
    whole_impact = (F.col("tool") == "calculate_business_impact") & (
        detail("affected_record_count") == detail("total_record_count")
    )
    drop = F.coalesce(whole_impact, F.lit(False)) & F.col("narrow")
    if not duplicates_asked:
        drop = drop | (duplicates & (repeated_key | (F.col("value") == 0)))
    if related is not None:
        rows = with_cardinality(rows, related)
        uneven = F.col("cardinality").isNotNull() & (F.col("cardinality") != "one_to_one")
        drop = drop | (F.coalesce(is_count, F.lit(False)) & uneven)
    return rows.where(~drop).select(*evidence.columns)


def confidence_label(confidence: Column, conclusive: Column) -> Column:
    return (
        F.when(~F.coalesce(conclusive, F.lit(False)), "Low")
        .when(confidence >= HIGH_CONFIDENCE, "High")
        .when(confidence >= MEDIUM_CONFIDENCE, "Medium")
        .otherwise("Low")
    )


def check_citations(verdicts: DataFrame, citations: DataFrame, known: DataFrame) -> DataFrame:
    """Accept a verdict only when it cites at least one known evidence id.

    ``verdicts``: ``case_id, verdict, confidence``; ``citations``: one row per ``case_id,
    evidence_id``; ``known``: ``evidence_id``. Adds the numbers of valid and rejected ids. An
    ACCEPT without a valid citation becomes REJECT with capped confidence.
    """
    ids = known.select("evidence_id").distinct().withColumn("is_known", F.lit(True))
    # Joined before anything is made distinct: one shuffle by id, whose heavy side Spark can split.
    cited = citations.select("case_id", "evidence_id").join(ids, "evidence_id", "left")
    counts = cited.groupBy("case_id").agg(
        F.count_distinct(F.when(F.col("is_known"), F.col("evidence_id"))).alias("valid"),
        F.count_distinct(F.when(F.col("is_known").isNull(), F.struct("evidence_id"))).alias("rejected"),
    )
    checked = verdicts.join(counts, "case_id", "left").select(
        "case_id", "verdict", "confidence",
        F.coalesce("valid", F.lit(0)).alias("valid_citation_count"),
        F.coalesce("rejected", F.lit(0)).alias("rejected_citation_count"),
    )
    uncited = (F.col("verdict") == "ACCEPT") & (F.col("valid_citation_count") == 0)
    return checked.select(
        "case_id",
        F.when(uncited, "REJECT").otherwise(F.col("verdict")).alias("verdict"),
        F.when(uncited, F.least("confidence", F.lit(UNCITED_CONFIDENCE)))
        .otherwise(F.col("confidence")).alias("confidence"),
        "valid_citation_count",
        "rejected_citation_count",
    )


def details_map(evidence: DataFrame) -> DataFrame:
    """Evidence in long form: one row per detail field, as text."""
    fields = F.from_json("details", "map<string,string>")
    return evidence.select(
        *[c for c in evidence.columns if c != "details"], F.explode(fields).alias("field", "field_value")
    )

