"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are put in a shuffled order and cut into blocks of equally many words, of
fewer words where a source would have only a few. A schedule of slots walks the golden-ratio sequence; each
point falls into one source's share of the unit interval (its target divided by what a slot of it yields), and the slot's rank among that source's slots says which block it takes
(after the last block the source starts again). Any prefix of the schedule is thus close to the
target weights, and so is the whole.

Defined results: a null text has no words; a null source is a source of its own, last in order;
rows with the same id are separate documents; an empty table gives no rows; other columns are
ignored. Documents without words take part with ``taken`` 0.

Scale: only word counts are kept from the texts. Runs over a source are split into buckets
(``frames.running_sum``), so a source may hold any share of the rows. Slots and pieces meet in a shuffle at
every size. One row per source is ranked in a single task, and the number of slots is the one figure the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.llm.frames import bucket_bits, picked, running_sum, stored, word_count

#: 2**32 divided by the golden ratio, odd: its multiples modulo 2**32 are a Weyl sequence.
GOLDEN = 2654435769
GRID = 1 << 32
CELL_BITS = 20
SLOTS_PER_CHUNK = 8192
DOCS_PER_BUCKET = 512
LEAST_BLOCKS = 32


def golden_point(slot: Column) -> Column:
    """``slot * GOLDEN mod 2**32``, in steps that stay within a long."""
    low, high = F.pmod(slot, F.lit(1 << 16)), F.pmod(F.shiftright(slot, 16), F.lit(1 << 16))
    carried = F.pmod(high * F.lit(GOLDEN), F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(low * F.lit(GOLDEN) + carried, F.lit(GRID))


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """60 bits of an md5 of the id: a fixed shuffled order, the same in any SQL engine."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """source, source_no, source_size, target from rows of (source, size).

    Sources by code point, null last, get the repeating ``weights`` of ``share`` times all
    words. No target exceeds ``most`` times the source's size; what is cut off goes to the others
    by weight. In the order of (cap / weight) the level that solves this is the highest of the
    levels got by capping the first 0, 1, 2, ... sources.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "source_no")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    factors = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_code_point))
        .withColumn("weight", F.element_at(factors, F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1))
        .withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        ranked.withColumn("level", level)
        .withColumn("level", F.max("level").over(everything))
        .select(
            "source", "source_no", "source_size",
            F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """``targets`` with the words of a source's block, the number of its blocks and the slots it is due.

    A source of fewer than ``LEAST_BLOCKS`` blocks gets at least twice that many of fewer words, of one at
    least; there a slot counts as the mean block, as the last one may be short. In larger sources, as in the
    SQL, it counts as a whole block, so they fall short by less than one part in ``LEAST_BLOCKS``.
    """
    small = F.col("source_size") < F.lit(LEAST_BLOCKS * block_words)
    words = F.when(small, F.greatest(F.lit(1), F.expr(f"source_size div {2 * LEAST_BLOCKS}"))).otherwise(F.lit(block_words))
    return (
        targets.withColumn("block", words.cast("long"))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn(
            "due", F.when(small & (F.col("blocks") > 0), F.col("target") / (F.col("source_size") / F.col("blocks")))
            .otherwise(F.col("target") / F.lit(block_words))
        )
    )


def schedule(targets: DataFrame, n_slots: int, most: float) -> DataFrame:
    """slot, source_no, slot_rank, block_no: which block of which source each slot takes.

    A slot that would take a source's blocks more than ``most`` times takes nothing.
    """
    spark = targets.sparkSession
    order = Window.orderBy("source_no")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("due").over(order.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("due").over(everything)
    edge = F.floor(upto / total * F.lit(float(GRID)))
    last = F.max("source_no").over(everything)
    cells = (
        targets.where("target > 0")
        .withColumn("high", F.when(F.col("source_no") == last, F.lit(GRID)).otherwise(edge))
        .withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0)))
        .where("high > low")
        .withColumn(
            "cell",
            F.explode(
                F.sequence(F.shiftright("low", CELL_BITS), F.shiftright(F.col("high") - 1, CELL_BITS))
            ),
        )
        .select("cell", "low", "high", "source_no", "blocks")
    )
    slots = (
        spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("point"))
        .withColumn("cell", F.shiftright("point", CELL_BITS))
        .join(cells, "cell")
        .where("point >= low and point < high")
        .withColumn("chunk", F.expr(f"slot div {SLOTS_PER_CHUNK}"))
        .withColumn("one", F.lit(1).cast("long"))
        .select("slot", "source_no", "blocks", "chunk", "one")
    )
    ranked = running_sum(slots, ["source_no"], "chunk", ["slot"], "one", "slot_rank")
    return ranked.where(F.col("slot_rank") < F.floor(F.col("blocks") * F.lit(float(most)))).select(
        "slot", "source_no", "slot_rank", F.pmod("slot_rank", "blocks").alias("block_no")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = 64,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix and its documents.

    First: one row per piece of a slot in the schedule, (slot, source_no, block_no, doc_id, start,
    first_word, words): words ``first_word`` up to ``first_word + words`` of a document. Second: one
    row per document, (doc_id, source, source_no, source_size, target, size, start), where
    (source_no, start) names a document with words.
    """
    sizes = stored(
        picked(docs, doc_id=doc_id, text=text, source=source).select(
            "doc_id", "source", word_count(F.col("text")).alias("size")
        ),
        "sizes",
    )
    targets = stored(with_blocks(source_targets(sizes, weights, share, most), block_words), "targets")
    due = targets.agg(F.sum("due")).first()[0] or 0.0
    bits = bucket_bits(sizes.count(), DOCS_PER_BUCKET)
    keyed = (
        sizes.join(targets, sizes["source"].eqNullSafe(targets["source"]))
        .select("doc_id", sizes["source"], "source_no", "source_size", "target", "size", "block")
        .withColumn("key", shuffle_key(F.col("doc_id"), seed))
        .withColumn("bucket", F.shiftright("key", 60 - bits))
    )
    placed = stored(
        running_sum(
            keyed, ["source_no"], "bucket", ["key", "doc_id", "size"], "size", "start"
        ).drop("key", "bucket"),
        "placed",
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("block_no", F.explode(F.expr("sequence(start div block, (start + size - 1) div block)")))
        .withColumn("low", F.greatest(F.col("start"), F.col("block_no") * F.col("block")))
        .withColumn("high", F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")))
        .select(
            "source_no", "block_no", "doc_id", "start",
            (F.col("low") - F.col("start")).alias("first_word"),
            (F.col("high") - F.col("low")).alias("words"),
        )
    )
    slots = schedule(targets, round(due), most)
    # A document makes many pieces, so the size of the stored table, which the optimizer goes by, tells little of theirs.
    mixed = slots.drop("slot_rank").join(pieces.hint("merge"), ["source_no", "block_no"])
    return mixed.select("slot", "source_no", "block_no", "doc_id", "start", "first_word", "words"), placed.drop("block")


def taken(mixed: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of each document."""
    used = mixed.groupBy("source_no", "start").agg(F.sum("words").alias("taken"))
    wordy = placed.where("size > 0").join(used, ["source_no", "start"], "left")
    wordless = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return wordy.unionByName(wordless).select(
        "doc_id", "size", "source_size", "target",
        F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"),
    )
