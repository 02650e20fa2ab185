"""A corpus pipeline: documents in, a weighted mix of clean, distinct documents out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result
to the shared folder and reads it back for the next. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm import decontamination, line_dedup, minhash, mixing, quality
from crosstally.llm.frames import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.col("quality").alias("label")
    )
    learning = ~quality.held_out(F.col("doc_id"))
    model = quality.learn(docs.select("doc_id", "text").where(learning), labels.where(learning))
    # Columns travel by number, so none can clash with the score.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = quality.score(plain, model, plain.columns, plain.columns[docs.columns.index("text")])
    return scored.where(F.col("score") >= quality.LEAST_SCORE).drop("score").toDF(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs cut out; documents that held nothing else go."""
    cut, _ = line_dedup.dedup_lines(docs)
    emptied = (F.col("__n_removed") > 0) & (F.col("__n_removed") == F.col("__n_lines"))
    shortened = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.where(~emptied).withColumn("n_chars", shortened.cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of least id, of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontamination.without_leaks(docs, stored(leaks, "leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mixing.taken(*mixing.mix(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
]

#: The classifier's fit has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
