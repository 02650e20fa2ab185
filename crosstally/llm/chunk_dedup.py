"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash, ``h = 2 h + gear[character]``, depends on the last 16 characters (16 bits are kept); a chunk ends where it
falls below a bound, so the same passage is cut the same way whatever stands before it, but for
its ends. Chunks have ``LEAST`` to ``MOST`` characters and about 50. Chunks of equal 128-bit digest are
copies; the first in corpus order stands. A run of neighbouring later copies is an anchor: to both sides
it grows as far as the text equals that beside the first copy of its outermost chunk, to the edge of a word. A grown
run with at least ``min_words`` words is a repeat and is deleted.

A repeated passage shows by any whole chunk inside it. Runs too short to reach ``min_words`` with ``NEAR - 1``
more characters at each end, where hashes of the ``NEAR`` characters beside them tell that they
have no more, are not grown.

Defined results: null and empty texts have no chunks and stay as they are; documents are ordered by
id and, where ids are equal, by a hash of the text; rows equal in both are cut alike, as one; a text is
cut between characters, never inside one; an empty table gives no rows; other columns stay.

Scale: one pass cuts texts into chunks; only digests are shuffled, and after the first count only
those that repeat. A frequent chunk collapses map-side; its rows meet the one row of its first place in
a join that Spark can split. Very long texts are cut in blocks. Texts are shuffled to meet their passages, and
before that once for each width of neighbourhood that runs grow into, which is four times wider each time;
a neighbourhood is read once however many runs are compared with it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from crosstally.functions.types import quoted
from crosstally.llm.frames import Scratch, stored
from crosstally.llm.shingles import mixed

LEAST, MEAN, MOST = 16, 32, 256
MIN_WORDS = 20
BLOCK = 1 << 20
NEAR = 8
WIDTH = MOST
_GEAR = (mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(codes: np.ndarray, spans: tuple[int, ...] = (1, 2, 4, 8)) -> np.ndarray:
    """The rolling hash after each character: the sum of gear[c] << age, by doubling the span."""
    total = _GEAR[codes & 0xFFFF]
    for span in spans:
        older = np.zeros_like(total)
        older[span:] = total[:-span] << np.uint16(span)
        total = total + older
    return total


def boundaries(codes: np.ndarray) -> list[int]:
    """Ends of the chunks of a text."""
    ends: list[int] = []
    for low in range(0, len(codes), BLOCK):
        from_ = max(0, low - 16)
        cut = np.flatnonzero(gear_hash(codes[from_ : low + BLOCK]) < (1 << 16) // MEAN) + from_ + 1
        ends.extend(cut[cut > low].tolist())
    out, last, n = [], 0, len(codes)
    while last < n:
        at = bisect_left(ends, last + LEAST)
        end = ends[at] if at < len(ends) else n
        last = min(end, last + MOST, n)
        out.append(last)
    return out


def _sides(codes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``NEAR`` characters before each chunk and after it; 0 where there are fewer."""
    told = np.concatenate((np.zeros(1, np.int32), gear_hash(codes, (1, 2, 4)).astype(np.int32)))
    after = np.where(ends + NEAR <= len(codes), told[np.minimum(ends + NEAR, len(codes))], 0)
    return np.where(begins >= NEAR, told[begins], 0).astype(np.int32), after.astype(np.int32)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, nth, starts, lengths, words, digests, before, after = [], [], [], [], [], [], [], []
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            if not text:
                continue
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.array(boundaries(codes))
            begins = np.concatenate(([0], ends[:-1]))
            space = (codes == 32) | ((codes >= 9) & (codes <= 13))
            first = np.concatenate(([0], np.cumsum(~space & np.concatenate(([True], space[:-1])))))
            raw = memoryview(codes.tobytes())
            digests.append(
                b"".join(
                    hashlib.blake2b(raw[4 * a : 4 * b], digest_size=16).digest() for a, b in zip(begins.tolist(), ends.tolist())
                )
            )
            owner.append(np.full(len(ends), i, np.int32))
            nth.append(np.arange(len(ends), dtype=np.int32))
            starts.append(begins)
            lengths.append(ends - begins)
            words.append(first[ends] - first[begins])
            for hashes, of_text in zip((before, after), _sides(codes, begins, ends)):
                hashes.append(of_text)
        if not owner:
            continue
        digest = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = pa.array(np.concatenate(owner))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(np.concatenate(nth)),
                pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(lengths).astype(np.int32)),
                pa.array(np.concatenate(words).astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()),
                pa.array(np.concatenate(before)), pa.array(np.concatenate(after)),
            ],
            ["doc_id", "h", "nth", "start", "length", "words", "d1", "d2", "before", "after"],
        )


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, h, nth, start, length, words, d1, d2, before, after from rows of doc_id, text; ``h`` hashes the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        _chunked, f"doc_id {kind}, h long, nth int, start int, length int, words int, d1 long, d2 long, "
        "before int, after int",
    )


def _neighbourhoods(width: int):
    """To each place asked for in a text: the character inside, then those outward, ``width`` and one more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, places, sides, nears, held = [], [], [], [], 0
            for i, (text, asked) in enumerate(zip(batch.column("text"), batch.column("asked"))):
                text = text.as_py()
                for place in asked.as_py():
                    at, side = place["pos"], place["side"]
                    near = text[at - 1 : at + width + 1] if side > 0 else text[max(0, at - width - 1) : at + 1][::-1]
                    owner.append(i)
                    places.append(at)
                    sides.append(side)
                    nears.append(near)
                    held += len(near)
                    if held >= BLOCK:
                        yield rows(batch, owner, places, sides, nears)
                        owner, places, sides, nears, held = [], [], [], [], 0
            if owner:
                yield rows(batch, owner, places, sides, nears)

    def rows(batch, owner, places, sides, nears) -> pa.RecordBatch:
        at = pa.array(owner, pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(at), batch.column("h").take(at), pa.array(places, pa.int32()),
                pa.array(sides, pa.int32()), pa.array(nears, pa.string()),
            ],
            ["doc_id", "h", "pos", "side", "near"],
        )

    return cut


_SPACE = frozenset(" \t\n\v\f\r")


def grown(own: str, other: str, width: int) -> tuple[int, bool]:
    """How many characters two neighbourhoods share, back to the edge of a word, and whether to look on.

    An edge lies between a character of a word and white space or the end of the text, in both texts. A
    run that ends within a word grows inside it as far as the texts agree.
    """
    most = min(len(own), len(other), width + 1) - 1
    shared = next((k for k in range(most) if own[k + 1] != other[k + 1]), most)
    outside = lambda text, k: k + 1 >= len(text) or text[k + 1] in _SPACE
    edge = next(
        (k for k in range(shared, -1, -1) if outside(own, k) and outside(other, k) and own[k] not in _SPACE),
        0 if own[0] in _SPACE else None,
    )
    if shared == width:
        return edge or 0, True
    return shared if edge is None else edge, False


_GROWTH = StructType().add("grown", IntegerType()).add("words", IntegerType()).add("more", BooleanType())


@F.pandas_udf(_GROWTH)
def _growth(
    own: pd.Series, other: pd.Series, side: pd.Series, pos: pd.Series, edge: pd.Series, width: pd.Series
) -> pd.DataFrame:
    rows = []
    for near, far, way, at, limit, most in zip(own, other, side, pos, edge, width):
        n, more = grown(near, far, most)
        # Words that begin beyond the run, whose own are counted.
        inside = max(0, (limit - at) * way)
        if way > 0:
            words = sum(near[k] not in _SPACE and near[k - 1] in _SPACE for k in range(inside + 1, n + 1))
        else:
            words = sum(near[k] not in _SPACE and near[k + 1 : k + 2] in ("", *_SPACE) for k in range(inside + 1, n + 1))
        rows.append((n, words, more))
    return pd.DataFrame(rows, columns=["grown", "words", "more"])


def _grown_ends(docs: DataFrame, ends: DataFrame, passing: Scratch) -> DataFrame:
    """``ends`` with ``pos`` moved outward as far as the texts agree, and ``gained`` words on the way."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc"), "text")
    going, done, width = ends, None, WIDTH
    while True:
        own = going.select("doc", "pos", "side")
        other = going.select(F.col("other").alias("doc"), (F.col("pos") + F.col("shift")).alias("pos"), "side")
        asked = own.unionByName(other).groupBy("doc").agg(F.collect_set(F.struct("pos", "side")).alias("asked"))
        near = (
            texts.join(asked.hint("merge"), "doc").select("doc.doc_id", "doc.h", "text", "asked")
            .mapInArrow(_neighbourhoods(width), f"doc_id {kind}, h long, pos int, side int, near string")
            # Rows equal in id and text are one document.
            .groupBy(F.struct("doc_id", "h").alias("doc"), "pos", "side").agg(F.first("near").alias("near"))
        )
        read = Scratch()
        near = read.stored(near, "near")
        far = near.select(F.col("doc").alias("other"), F.col("pos").alias("other_pos"), "side", F.col("near").alias("far"))
        met = (
            going.withColumn("other_pos", F.col("pos") + F.col("shift"))
            .join(near, ["doc", "pos", "side"]).join(far, ["other", "other_pos", "side"])
            .withColumn("g", _growth("near", "far", "side", "pos", "edge", F.lit(width)))
            .withColumn("pos", F.col("pos") + F.col("side") * F.col("g.grown"))
            .withColumn("gained", F.col("gained") + F.col("g.words"))
            .select(*going.columns, F.col("g.more").alias("more"))
        )
        met = passing.stored(met, "grown")
        read.drop()
        ready = met.where("not more").drop("more")
        done = ready if done is None else done.unionByName(ready)
        going, width = met.where("more").drop("more"), 4 * width
        if going.isEmpty():
            return done


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, start, length, words, first_doc_id, first_start: runs of later copies, grown."""
    whole, some, passing = Scratch(), Scratch(), Scratch()
    cut = whole.stored(chunks(docs), "chunks")
    place = F.struct("doc_id", "h", "nth", "start", "before", "after")
    # Counting moves digests alone; places follow only for the chunks that repeat.
    repeated = cut.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    copies = some.stored(cut.join(repeated, ["d1", "d2"]), "copies")
    whole.drop()
    first = copies.groupBy("d1", "d2").agg(F.min(place).alias("first"))
    # Rows equal in id and text give equal rows here; they are one document.
    later = copies.join(first, ["d1", "d2"]).where(place > F.col("first")).select(
        F.struct("doc_id", "h").alias("doc"), "nth", "start", (F.col("start") + F.col("length")).alias("stop"), "words",
        "before", "after", "first", F.struct("first.doc_id", "first.h").alias("other"),
        (F.col("first.start") - F.col("start")).alias("shift"),
    )
    in_doc, in_run = Window.partitionBy("doc").orderBy("nth"), Window.partitionBy("doc", "run")
    aligned = later.withColumn("run", F.col("nth") - F.dense_rank().over(in_doc)).groupBy("doc", "run", "other", "shift").agg(
        F.min(F.struct("start", "before", "first")).alias("head"), F.max(F.struct("stop", "after", "first")).alias("tail"),
        F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"), F.countDistinct("nth").alias("distinct"),
    ).withColumns({
        "low": F.min("head.start").over(in_run), "high": F.max("tail.stop").over(in_run),
        "left": F.col("head.before") == F.col("head.first.before"), "right": F.col("tail.after") == F.col("tail.first.after"),
        "first": F.min(F.struct("head.start", "head.first")).over(in_run)["first"],
        "words": F.expr("sum(words) over w * sum(`distinct`) over w div sum(n) over w".replace("over w", "over (partition by doc, run)")),
    })
    leads, ends_it = F.col("head.start") == F.col("low"), F.col("tail.stop") == F.col("high")
    hopeful = F.max((leads & F.col("left")) | (ends_it & F.col("right"))).over(in_run)
    aligned = aligned.withColumn("hopeful", hopeful).where(
        (leads | ends_it) & (F.col("hopeful") | (F.col("words") + 2 * (NEAR // 2) >= min_words))
    )
    # A run grows to the left beside the first copy of its first chunk, to the right beside that of its last one.
    sides = F.array(
        F.when(leads, F.struct(F.lit(-1).alias("side"), F.col("head.start").alias("pos"), F.col("low").alias("edge"))),
        F.when(ends_it, F.struct(F.lit(1).alias("side"), F.col("tail.stop").alias("pos"), F.col("high").alias("edge"))),
    )
    ends = aligned.select("doc", "low", "high", "words", "first", "other", "shift", F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("end"))
    ends = ends.select(
        "doc", "low", "high", "words", "first", "other", "shift", "end.side", "end.pos", "end.edge", F.lit(0).alias("gained")
    )
    ends = passing.stored(ends, "ends")
    some.drop()
    done = _grown_ends(docs, ends, passing)
    # Of the ends of one side the one farthest out counts.
    out = lambda side: F.max(F.when(F.col("side") == side, F.struct((F.col("pos") * side).alias("out"), "gained")))
    spans = done.groupBy("doc", "low", "high").agg(
        F.first("words").alias("words"), F.first("first").alias("first"), out(-1).alias("a"), out(1).alias("b")
    ).select(
        "doc", "first", F.least("low", -F.col("a.out")).alias("start"), F.greatest("high", "b.out").alias("stop"),
        (F.col("words") + F.when(-F.col("a.out") < F.col("low"), F.col("a.gained")).otherwise(0)
         + F.when(F.col("b.out") > F.col("high"), F.col("b.gained")).otherwise(0)).alias("words"),
    )
    # Two runs of one passage may grow into the same one.
    passages = spans.where(F.col("words") >= min_words).groupBy("doc", "start", "stop").agg(
        F.max("words").alias("words"), F.min("first").alias("first")
    ).select(
        "doc.doc_id", "doc.h", "start", (F.col("stop") - F.col("start")).alias("length"), "words",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.nth").alias("first_chunk"),
    )
    passages = stored(passages, "repeats")
    passing.drop()
    return passages


_CUT = StructType().add("text", StringType()).add("removed", LongType())


@F.pandas_udf(_CUT)
def _without(texts: pd.Series, starts: pd.Series, lengths: pd.Series) -> pd.DataFrame:
    rows = []
    for text, start, length in zip(texts, starts, lengths):
        gone = 0
        if text is not None and start is not None:
            kept, at = [], 0
            for a, n in sorted(zip(start, length)):
                kept.append(text[at : max(a, at)])
                at = max(at, a + n)
            kept = "".join([*kept, text[at:]])
            gone, text = len(text) - len(kept), kept
        rows.append((text, gone))
    return pd.DataFrame(rows, columns=["text", "removed"])


def dedup_passages(
    docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The documents with repeats cut out of ``text`` (and ``__removed`` characters), and the repeats."""
    bare = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))
    repeats = repeated_passages(bare, min_words)
    key = F.struct(quoted(doc_id).alias("doc_id"), F.xxhash64(quoted(text)).alias("h"))
    spans = repeats.groupBy(F.struct("doc_id", "h").alias("__doc")).agg(
        F.collect_list(F.struct("start", "length")).alias("__spans")
    )
    cut = docs.withColumn("__doc", key).join(spans.hint("merge"), "__doc", "left").withColumn(
        "__cut", _without(quoted(text), F.col("__spans.start"), F.col("__spans.length"))
    ).withColumns({text: F.col("__cut.text"), "__removed": F.col("__cut.removed")})
    return cut.drop("__doc", "__spans", "__cut"), repeats
