"""The bounded sample of labelled texts that classifiers are fitted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.llm.frames import stored


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int
) -> tuple[DataFrame | None, dict[int, int]]:
    """label, text of at most ``per_class`` different texts of each label, and the labels' row counts.

    The first by md5 of the id, then by hash of the text. However often an id repeats, among documents or
    labels, the sample stays within its bound: rows equal in id, text and label count once. None without labels.
    """
    labelled = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.md5(F.col("doc_id").cast("string"))
    ids = [
        r
        for label in sorted(counts)
        for r in labelled.where(F.col("label") == label).select("doc_id", "label").distinct()
        .orderBy(order, "doc_id").limit(per_class).collect()
    ]
    if not ids:
        return None, counts
    sample = docs.sparkSession.createDataFrame(ids, labelled.select("doc_id", "label").schema)
    texts = stored(
        docs.join(F.broadcast(sample), "doc_id").groupBy("label", "doc_id", F.xxhash64("text").alias("h"))
        .agg(F.any_value("text").alias("text")),
        "labelled",
    )
    key = ["label", "doc_id", "h"]
    first = [
        texts.where(F.col("label") == label).select(*key).orderBy(order, "doc_id", "h").limit(per_class)
        for label in sorted(counts)
    ]
    kept = F.broadcast(reduce(DataFrame.unionByName, first))
    # A null text has the hash of an empty one; no id of the sample is null.
    return texts.join(kept, key, "left_semi").select("label", "text"), counts
