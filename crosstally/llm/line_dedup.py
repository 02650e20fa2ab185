"""Line dedup by a suffix array over line numbers, built by distributed prefix doubling.

The corpus is the sequence of its lines (documents by id, lines by place; blank lines do not count).
``rank_h`` orders all suffixes by their first h lines, within a document. From ``rank_h`` follows
``rank_2h``: the pair (rank_h here, rank_h h lines on) refines each group of equal rank. Groups of equal
rank_h are the intervals of the suffix array whose longest common prefix is at least h. Suffixes
that are alone in their group are settled and leave; doubling ends when no group can split, so the
work follows the repeated lines, not the corpus.

In an interval all but the first suffix, in corpus order, begin a later copy of the first. Where the next
suffix continues that copy it belongs to the same run; a run's full length (the longest common prefix with
its first occurrence) is the length of this chain, the depth of its last suffix, and what the levels below that
depth add. These are the maximal repeated runs. Those of ``min_lines`` lines or more are deleted, and
outside them, as runs of one, later copies of single lines of at least ``min_chars`` characters (code points):
a long line that is repeated alone goes, a short one stays. Every distinct line keeps its first occurrence.

Defined results: ``min_lines`` is a power of two; ``min_chars`` None leaves single lines alone; null texts stay
null, empty ones empty; blank lines (ASCII white space only) join no run and go with the deleted line before
them; rows of equal id but different texts are separate documents, ordered by a hash of the text; rows equal in
both are cut alike, as one document; an empty table gives no rows; other columns stay as they are, whatever
their names, but for columns named like the two figures of ``dedup_lines``, which these replace.

Scale: lines travel as two 64-bit hashes, only those that repeat. A suffix is one number, its position in
the corpus, so that all levels group and join by longs. Ranks number the distinct pairs, sorted by range, so no
frequent line is sorted in one task; a level brings the first suffix of each rank along. Every level is a table in
the shared folder. The repeated suffixes of one document are chained in one task. Texts are shuffled once, to
meet the lists of deleted lines; only texts that lose lines go through Python.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from crosstally.functions.types import quoted
from crosstally.llm.frames import Scratch, stored

MIN_LINES = 2
MIN_CHARS = 120
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row and sorts in corpus order; equal ids with different texts stay apart."""
    return F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h"))


def numbered_lines(docs: DataFrame, min_chars: int | None = None) -> DataFrame:
    """doc, place, lines, h1, h2, long of every line that is not blank; ``place`` counts those from 0.

    ``long`` tells that the line has ``min_chars`` characters or more.
    """
    kept = F.filter(_lines(F.col("text")), lambda x: F.ltrim(x, F.lit(BLANKS)) != "")
    line, size = F.col("line"), F.length("line")
    return (
        docs.select("doc", kept.alias("kept"))
        .select("doc", F.size("kept").alias("lines"), F.posexplode("kept").alias("place", "line"))
        .select(
            "doc", "place", "lines", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line, size).alias("h2"),
            (F.lit(False) if min_chars is None else size >= min_chars).alias("long"),
        )
    )


def _ranked(groups: DataFrame, order: list[str]) -> DataFrame:
    """``groups`` with ``rank``, from 1: their order, with gaps. No two are equal in ``order``."""
    return (
        groups.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("rank", F.monotonically_increasing_id() + 1)
    )


def document_starts(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """doc, lines, start of every document with lines: suffixes lie at ``start`` + ``place``, in corpus order.

    Between two documents at least one position is free.
    """
    docs = lines.where("place = 0").groupBy("doc").agg(F.max("lines").alias("lines"))
    # Stored, so that a document keeps its number.
    docs = scratch.stored(_ranked(docs, ["doc"]), "documents")
    part = F.shiftright(F.col("rank") - 1, 33)
    before = Window.partitionBy(part).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.col("lines") + F.lit(1).cast("long")).over(before), F.lit(0))
    return docs.select("doc", "lines", (F.shiftleft(part, 40) + own).alias("start"))


def _first_ranks(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """pos, start, left, long, rank of the lines that occur more than once: rank_1, by hash order."""
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    met = lines.join(_ranked(repeated, ["h1", "h2"]), ["h1", "h2"]).select("doc", "place", "lines", "long", "rank")
    # Rows equal in id and text are one document.
    return met.join(starts.select("doc", "start"), "doc").groupBy("doc", "place").agg(
        F.max(F.col("start") + F.col("place")).alias("pos"), F.max("start").alias("start"),
        F.max(F.col("lines") - F.col("place")).alias("left"), F.max("long").alias("long"),
        F.max("rank").alias("rank"),
    ).drop("doc", "place")


def _doubled(level: DataFrame, step: int, scratch: Scratch) -> DataFrame:
    """From the ranks of ``step`` lines those of twice as many, of the suffixes that share one.

    ``first_start`` and ``first_pos`` are the first suffix of that rank.
    """
    none = F.lit(None).cast("long")
    here = level.select("pos", "start", "left", F.col("rank").alias("r1"), none.alias("r2"))
    ahead = level.where(F.col("pos") - step >= F.col("start")).select(
        (F.col("pos") - step).alias("pos"), none.alias("start"), F.lit(None).cast("int").alias("left"),
        none.alias("r1"), F.col("rank").alias("r2"),
    )
    pairs = (
        here.unionByName(ahead).groupBy("pos")
        .agg(*[F.max(c).alias(c) for c in ("start", "left", "r1", "r2")])
        .where("r1 is not null")
        # Past the document's end ranks 0; a suffix that goes on alone is settled.
        .withColumn("r2", F.coalesce("r2", F.when(F.col("left") <= step, F.lit(0).cast("long"))))
        .where("r2 is not null")
    )
    pairs = scratch.stored(pairs, "pairs")
    groups = pairs.groupBy("r1", "r2").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"), F.min("pos").alias("first_pos")
    ).where("n > 1").drop("n")
    return pairs.join(_ranked(groups, ["r1", "r2"]), ["r1", "r2"]).select(
        "pos", "start", "left", "rank", "first_start", "first_pos", (F.col("r2") > 0).alias("goes_on")
    )


def suffix_levels(lines: DataFrame, starts: DataFrame, kept: Scratch) -> list[tuple[int, DataFrame]]:
    """[(h, table of pos, start, left, rank)]: rank_h for h = 1, 2, 4, ... of shared suffixes.

    The first table also has ``long``, see ``numbered_lines``, the others the first suffix of the rank.
    """
    passing = Scratch()
    level = kept.stored(_first_ranks(lines, starts), "level-1")
    levels, step = [(1, level)], 1
    while True:
        level = kept.stored(_doubled(level, step, passing), f"level-{2 * step}")
        passing.drop()
        step *= 2
        going = level.agg(F.count(F.lit(1)), F.count_if("goes_on")).first()
        if not going[0]:
            return levels
        levels.append((step, level.drop("goes_on")))
        if not going[1]:
            return levels


def _later(levels: list[tuple[int, DataFrame]], min_lines: int) -> DataFrame:
    """pos, start, h, first_start, first_pos: every copy after the first, at each depth."""
    later = []
    for h, table in levels:
        # A suffix that ends sooner is as deep as it is long.
        depth = F.least(F.lit(h), F.col("left"))
        if h < min_lines:
            if h > 1:
                continue
            table, depth = table.where("long"), F.lit(1)
        else:
            table = table.where(depth >= min_lines)
        if h == 1:
            first = table.groupBy("rank").agg(
                F.min("start").alias("first_start"), F.min("pos").alias("first_pos")
            )
            table = table.join(first, "rank")
        later.append(
            table.where("pos > first_pos").select("pos", "start", depth.alias("h"), "first_start", "first_pos")
        )
    return reduce(DataFrame.unionByName, later)


def _runs(docs: DataFrame, min_lines: int, min_chars: int | None) -> tuple[DataFrame, DataFrame]:
    """start, pos, length, first_start, first_pos of the maximal later copies, and ``document_starts``."""
    if min_lines < 1 or min_lines & (min_lines - 1):
        raise ValueError("min_lines must be a power of two")
    kept = Scratch()
    lines = kept.stored(numbered_lines(docs, min_chars), "lines")
    starts = stored(document_starts(lines, kept), "starts")
    levels = suffix_levels(lines, starts, kept)
    # The deepest interval of each later copy.
    deepest = _later(levels, min_lines).groupBy("pos").agg(
        F.max("start").alias("start"), F.max("h").alias("h"),
        F.max_by("first_start", "h").alias("first_start"), F.max_by("first_pos", "h").alias("first_pos"),
    )
    along = Window.partitionBy("start").orderBy("pos")
    continues = (
        (F.lag("pos").over(along) + 1 == F.col("pos"))
        & (F.lag("first_start").over(along) == F.col("first_start"))
        & (F.lag("first_pos").over(along) + 1 == F.col("first_pos"))
    )
    chained = deepest.withColumn("starts", (~F.coalesce(continues, F.lit(False))).cast("int")).withColumn(
        "chain", F.sum("starts").over(along)
    )
    step = F.max_by("h", "pos")
    runs = kept.stored(
        chained.groupBy("start", "chain").agg(
            F.min("pos").alias("pos"), F.min("first_start").alias("first_start"),
            F.min("first_pos").alias("first_pos"), step.alias("open"),
            (F.max("pos") - F.min("pos") + step).alias("length"),
        ).drop("chain"),
        "chains",
    )
    # A chain goes on for less than the depth of its last suffix, so only lower levels can add to it.
    deepest_end = runs.agg(F.max("open")).first()[0] or 1
    for h, table in reversed(levels):
        if h < deepest_end:
            runs = kept.stored(_extended(runs, table, h), f"extended-{h}")
    runs = stored(runs.drop("open"), "runs")
    kept.drop()
    return runs, starts


def _extended(runs: DataFrame, table: DataFrame, step: int) -> DataFrame:
    """Runs that may go on by ``step`` lines do, where both sides have the same ``step`` lines."""
    may = F.col("open") > step
    at = runs.where(may).withColumn("p", F.col("pos") + F.col("length")).withColumn(
        "q", F.col("first_pos") + F.col("length")
    )
    ranks = table.select("pos", "rank", "left")
    one = ranks.toDF("p", "rank_p", "left_p")
    two = ranks.toDF("q", "rank_q", "left_q")
    grown = F.when(F.col("rank_p") == F.col("rank_q"), F.least(F.lit(step), F.col("left_p"))).otherwise(0)
    met = at.join(one, "p", "left").join(two, "q", "left")
    return runs.where(~may).unionByName(met.select(*[
        (F.col("length") + grown).alias(c) if c == "length" else F.col(c) for c in runs.columns
    ]))


def _named(runs: DataFrame, starts: DataFrame) -> DataFrame:
    """doc, place, length, first_doc, first_place from the positions."""
    own = starts.select("start", "doc")
    first = own.toDF("first_start", "first_doc")
    return runs.join(own, "start").join(first, "first_start").select(
        "doc", (F.col("pos") - F.col("start")).cast("int").alias("place"), "length", "first_doc",
        (F.col("first_pos") - F.col("first_start")).cast("int").alias("first_place"),
    )


def repeated_runs(
    docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = MIN_CHARS
) -> DataFrame:
    """doc, place, length, first_doc, first_place: maximal later copies.

    Of ``min_lines`` lines or more; outside them single lines of ``min_chars`` characters or more.
    """
    return _named(*_runs(docs, min_lines, min_chars))


def cut_text(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """The text without the spans of lines that are not blank, their number, and how many went."""
    kept, place, gone, removing = [], 0, 0, False
    spans = sorted(spans)
    at, stop = 0, 0
    for line in text.split("\n"):
        if not _BLANK.match(line):
            while at < len(spans) and spans[at][0] <= place:
                stop = max(stop, spans[at][1])
                at += 1
            removing = place < stop
            gone += removing
            place += 1
        if not removing:
            kept.append(line)
    return "\n".join(kept), place, gone


_CUT = (
    StructType().add("text", StringType()).add("n_lines", LongType()).add("n_removed", LongType())
)


@F.pandas_udf(_CUT)
def _cut(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.DataFrame:
    rows = []
    for text, start, stop in zip(texts, starts, stops):
        if text is None:
            rows.append((None, 0, 0))
        else:
            rows.append(cut_text(text, [] if start is None else list(zip(start, stop))))
    return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])


def dedup_lines(
    docs: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = MIN_CHARS,
    doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The documents without later copies of line runs, and the runs.

    First: the columns of ``docs`` with ``text`` cut, then ``__n_lines`` and ``__n_removed`` (lines that are
    not blank: how many there were, how many went). Second: see ``repeated_runs``; doc is the id
    and a hash of the text.
    """
    key = row_key(quoted(doc_id), quoted(text))
    runs, starts = _runs(docs.select(key.alias("doc"), quoted(text).alias("text")), min_lines, min_chars)
    place = (F.col("pos") - F.col("start")).cast("int")
    span = F.struct(place.alias("place"), (place + F.col("length")).alias("stop"))
    spans = runs.groupBy("start").agg(F.collect_list(span).alias("spans"))
    told = starts.join(spans, "start", "left").select("doc", "lines", "spans")
    whole = docs.select(key.alias("doc"), F.struct(*map(quoted, docs.columns)).alias("row"))
    field = F.col("row").getField
    uncut = F.col("spans").isNull()
    # The lists grow with the corpus, so texts meet them in a shuffle at every size.
    cut = whole.join(told.hint("merge"), "doc", "left").withColumn(
        "cut", _cut(F.when(~uncut, field(text)), F.col("spans.place"), F.col("spans.stop"))
    )
    changed = F.when(uncut, field(text)).otherwise(F.col("cut.text"))
    figures = {
        "__n_lines": F.coalesce(F.col("lines").cast("long"), F.lit(0).cast("long")),
        "__n_removed": F.col("cut.n_removed"),
    }
    kept = [c for c in docs.columns if c not in figures]
    return cut.select(
        *[(changed if c == text else field(c)).alias(c) for c in kept],
        *[value.alias(c) for c, value in figures.items()],
    ), _named(runs, starts)
