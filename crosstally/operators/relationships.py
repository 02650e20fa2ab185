"""Shared keys between profiled datasets, from their profiles alone.

Profiles are joined to themselves: store them first, or their data is profiled twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.functions.columns import id_name_column

# A cardinality seen from the other side.
REVERSED_CARDINALITY = {
    "one_to_one": "one_to_one", "one_to_many": "many_to_one",
    "many_to_one": "one_to_many", "many_to_many": "many_to_many",
}


def _identifier_pairs(profiles: DataFrame, condition: Column) -> DataFrame:
    keys = profiles.where("is_identifier").select(
        "dataset", "dataset_order", "column", "row_count", "null_count", "unique_count"
    )
    return keys.alias("l").join(
        keys.alias("r"), (F.col("l.column") == F.col("r.column")) & condition
    )


def relationships(profiles: DataFrame) -> DataFrame:
    """Same-named identifiers of two datasets, both directions, with the observed cardinality."""
    def unique(side: str) -> Column:
        return F.col(f"{side}.unique_count") == F.col(f"{side}.row_count") - F.col(f"{side}.null_count")

    def grain(is_unique: Column) -> Column:
        return F.when(is_unique, "one").otherwise("many")

    pairs = _identifier_pairs(profiles, F.col("l.dataset") != F.col("r.dataset"))
    return pairs.select(
        F.col("l.dataset").alias("dataset"),
        F.col("r.dataset").alias("other_dataset"),
        F.col("l.column").alias("local_column"),
        F.col("r.column").alias("other_column"),
        F.concat_ws("_to_", grain(unique("l")), grain(unique("r"))).alias("cardinality"),
        unique("l").alias("local_key_is_unique"),
        unique("r").alias("other_key_is_unique"),
    )


def choose_relationships(profiles: DataFrame, most: int | None = None) -> DataFrame:
    """The best key per dataset pair (most unique, then id-like, then by name), best pairs first.

    All pairs, or the ``most`` best.
    """
    def uniqueness(side: str) -> Column:
        rows = F.greatest(F.col(f"{side}.row_count"), F.lit(1))
        return F.col(f"{side}.unique_count") / rows

    pairs = _identifier_pairs(profiles, F.col("l.dataset_order") < F.col("r.dataset_order"))
    column = F.col("l.column")
    score = F.struct(
        (-(uniqueness("l") + uniqueness("r"))).alias("uniqueness"),
        F.when(id_name_column(column), 0).otherwise(1).alias("name_rank"),
        F.lower(column).alias("name"),
        column.alias("key"),
    )
    order = F.struct(F.col("l.dataset_order").alias("left"), F.col("r.dataset_order").alias("right"))
    best = pairs.groupBy(
        F.col("l.dataset").alias("left_dataset"), F.col("r.dataset").alias("right_dataset")
    ).agg(F.min(score).alias("score"), F.min(order).alias("position"))
    chosen = best.orderBy("score", "position")
    if most is not None:
        chosen = chosen.limit(most)
    return chosen.select("left_dataset", "right_dataset", F.col("score.key").alias("key"))


def relationship_lines(related: DataFrame) -> DataFrame:
    """``orders.id -> payments.id``, each line once, in order."""
    line = F.format_string(
        "%s.%s -> %s.%s", F.col("dataset"), F.col("local_column"), F.col("other_dataset"),
        F.col("other_column"),
    )
    return related.select(line.alias("relationship")).distinct().orderBy("relationship")


def reverse_cardinality(cardinality: Column) -> Column:
    """The same relationship seen from the other dataset; null when unknown."""
    reversed_names = F.create_map(*[F.lit(x) for kv in REVERSED_CARDINALITY.items() for x in kv])
    return F.try_element_at(reversed_names, cardinality)


def with_cardinality(evidence: DataFrame, related: DataFrame) -> DataFrame:
    """Add ``cardinality`` for ``dataset_a``/``dataset_b``, also when only the reverse is known."""
    forward = related.groupBy(
        F.col("dataset").alias("dataset_a"), F.col("other_dataset").alias("dataset_b")
    ).agg(F.min_by("cardinality", "local_column").alias("forward"))
    backward = related.groupBy(
        F.col("other_dataset").alias("dataset_a"), F.col("dataset").alias("dataset_b")
    ).agg(reverse_cardinality(F.min_by("cardinality", "local_column")).alias("backward"))
    pair = ["dataset_a", "dataset_b"]
    return (
        evidence.join(forward, pair, "left").join(backward, pair, "left")
        .withColumn("cardinality", F.coalesce("forward", "backward"))
        .drop("forward", "backward")
    )
