"""Phrase collocations by best-first branch-and-bound growth of phrases.

Phrases grow word by word at their end. ``f`` never rises along a prefix, so for every phrase that begins
with ``p``, whose first word is ``w``, the score is at most ``2000000 * f(p) / (f(w) + f(p))``: the admissible
bound of ``p``. Words are counted, then all pairs of frequent words. From there a wave expands the open
prefixes of the highest bounds: one pass over the texts counts what follows them. Between waves each
language's bar is the score of its ``top``-th settled survivor; prefixes whose bound is below
the bar stay closed, and growth ends when no open one reaches it. Ties with the bar are settled too.

A phrase survives if no candidate one word longer, to either side, has at least 80 % of its count: a longer
one that holds it would have such a neighbour between them. It is settled when its own extensions
are counted, and those of all prefixes that could still bring a frequent enough extension to its left;
such prefixes are expanded too, whatever their bound.

Defined results: a null language is ``und``, an empty one stays; null, empty and wordless texts hold no
words; repeated rows count again, ids play no part; languages of fewer than ``top`` survivors give all of
them; ties are ordered by count and then by the phrase's bytes; an empty table gives no rows; other columns are
ignored. Counts, products and comparisons are exact whole numbers. Words travel as 64-bit hashes of language
and word: with a billion different words the chance that any two share one is 3 %.

Scale: each wave reads the texts once and moves counts only, combined within each task. A wave expands at
most ``batch`` prefixes (twice that with the suffixes which their scores need), the bound on what is sent to the tasks;
frequent words are told by a bitmap of fixed size, whose false positives cost time but change no count.
Frontier, scores and settling are joins and aggregates on stored tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.llm.frames import Scratch, picked, stored
from crosstally.llm.shingles import mixed

TOP, LEAST = 2000, 30
#: A candidate goes if a longer one that holds it has at least this share, in percent, of its count.
COVERING = 80
FULL_SCORE = 2_000_000
BATCH = 65_536
FILTER_BITS = 1 << 25
_PER_ROW = 32_768  # bits that Spark's bitmap functions put into one row

_TOKENS, _SLICE = 1 << 20, 1 << 20
_STOP, _BLANK = 46, 32
_TABLE = bytes(
    _STOP if c in b".,;:!?\x0a\x0b\x0c\x0d" else _BLANK if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_BASE = 0x9E3779B97F4A7C15
_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


# Counting in tasks ----------------------------------------------------------------------------

class Words(NamedTuple):
    """The words of some texts, in order, as 64-bit hashes of language and word.

    ``piece`` numbers the pieces they stand in; ``data[starts:ends]`` spells them.
    """

    hashes: np.ndarray
    piece: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    lang: np.ndarray
    data: bytes


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    up = np.full(size, _BASE, np.uint64)
    down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def words_of(texts: list[tuple[str, bytes]]) -> Words:
    """All words at once: a word's hash is a difference of running sums over the bytes.

    Texts are (language, bytes) whose separators are full stops and whose blanks are spaces.
    """
    data = b".".join(text for _, text in texts)
    letters = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (letters != _STOP) & (letters != _BLANK)
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(max(_SLICE * 2, 1 << len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.take(_LETTERS, letters, out=sums[1:])
    sums[1:] *= up[: len(data)]
    np.cumsum(sums, out=sums)
    plain = (sums[ends] - sums[starts]) * down[starts]
    lang = np.searchsorted(np.cumsum([len(t) + 1 for _, t in texts]), starts, side="right")
    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in texts], np.uint64)
    hashes = mixed(mixed(plain + (ends - starts).astype(np.uint64)) + seeds[lang])
    piece = np.cumsum(letters == _STOP, dtype=np.int32)[starts]
    return Words(
        np.maximum(hashes, np.uint64(1)), piece, starts.astype(np.int32), ends.astype(np.int32), lang.astype(np.int32), data
    )


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """Texts in runs of bounded size; long ones are cut where pieces end."""
    run, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            data = text.as_buffer()
            data = data.to_pybytes().translate(_TABLE) if data is not None else b""
            at = 0
            while at < len(data):
                stop = data.find(b".", at + _SLICE)
                part = data[at:] if stop < 0 else data[at:stop]
                at += len(part) + 1
                run.append((lang, part))
                size += len(part)
                if size >= _SLICE:
                    yield run
                    run, size = [], 0
    if run:
        yield run


def _chunks(
    batches: Iterator[pa.RecordBatch], spelled: bool = False
) -> Iterator[tuple[Words, list[str]]]:
    """Words of many texts, and the languages that their ``lang`` counts.

    What spells the words is left out unless asked for.
    """
    parts, langs, size, offset = [], [], 0, 0

    def together() -> tuple[Words, list[str]]:
        columns = [np.concatenate(c) for c in list(zip(*parts))[:5]]
        return Words(*columns, b"".join(p.data for p in parts)), langs

    for run in _sliced(batches):
        found = words_of(run)
        # A run has fewer pieces than bytes, so the offset keeps pieces of different runs apart.
        moved = {"piece": found.piece + np.int32(offset)}
        if spelled:
            moved |= {c: getattr(found, c) + np.int32(offset) for c in ("starts", "ends")}
            moved["lang"] = found.lang + np.int32(len(langs))
            langs += [x for x, _ in run]
        else:
            none = found.lang[:0]
            moved |= {"starts": none, "ends": none, "lang": none, "data": b""}
        parts.append(found._replace(**moved))
        offset += len(found.data) + (0 if spelled else 1)
        size += len(found.hashes)
        if size >= _TOKENS:
            yield together()
            parts, langs, size, offset = [], [], 0, 0
    if parts:
        yield together()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, langs in _chunks(batches, spelled=True):
        names, first, counts = np.unique(words.hashes, return_index=True, return_counts=True)
        spelled = [
            words.data[i:j].decode("utf-8", "surrogatepass") for i, j in zip(words.starts[first], words.ends[first])
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs[i] for i in words.lang[first]], pa.string()), pa.array(spelled, pa.string()),
                pa.array(names.view(np.int64)), pa.array(counts, pa.int64()),
            ],
            ["lang", "word", "h", "n"],
        )


def _joined_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mixed(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def phrase_keys(*words: np.ndarray) -> np.ndarray:
    """One 64-bit name per phrase, from the hashes of its words."""
    return reduce(_joined_hash, words)


def _is_in(names: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(wanted):
        return np.zeros(len(names), bool)
    at = np.minimum(np.searchsorted(wanted, names), len(wanted) - 1)
    return wanted[at] == names


def _runs(words: Words, usable: np.ndarray, width: int) -> np.ndarray:
    """Where ``width`` usable words of one piece follow one another."""
    n = max(0, len(usable) - width + 1)
    here = words.piece[:n] == words.piece[width - 1 :]
    for i in range(width):
        here &= usable[i : i + n]
    return np.flatnonzero(here)


def _tallied(hashes: np.ndarray, at: np.ndarray, width: int) -> pa.RecordBatch:
    """The different phrases of ``width`` words that begin at ``at``, with their counts."""
    columns = [hashes[at + i] for i in range(width)]
    numbers = np.unique(np.concatenate(columns), return_inverse=True)[1].reshape(width, -1)
    name = numbers[0]
    for i in range(1, width):
        if i > 1:
            name = np.unique(name, return_inverse=True)[1]
        name = (name << 32) | numbers[i]
    _, first, counts = np.unique(name, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c[first].view(np.int64)) for c in columns], pa.array(counts, pa.int64())],
        [*[f"w{i + 1}" for i in range(width)], "n"],
    )


def _usable(hashes: np.ndarray, bits: bytes) -> np.ndarray:
    """Which words may be frequent."""
    slot = hashes % np.uint64(8 * len(bits))
    row = np.frombuffer(bits, np.uint8)[(slot >> np.uint64(3)).astype(np.int64)]
    return ((row >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _pair_counter(bits: bytes) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _chunks(batches):
            yield _tallied(words.hashes, _runs(words, _usable(words.hashes, bits), 2), 2)

    return count


def _extension_counter(bits: bytes, pairs: np.ndarray, triples: np.ndarray) -> Callable:
    """Counts the phrases of three and four words whose prefixes are wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, _ in _chunks(batches):
            hashes, usable = words.hashes, _usable(words.hashes, bits)
            for wanted, width in ((pairs, 3), (triples, 4)):
                if not len(wanted):
                    continue
                at = _runs(words, usable, width)
                names = phrase_keys(*[hashes[at + i] for i in range(width - 1)])
                found = _tallied(hashes, at[_is_in(names, wanted)], width)
                if width == 3:
                    found = found.add_column(3, "w4", pa.array(np.zeros(len(found), np.int64)))
                yield found

    return count


# Scores ---------------------------------------------------------------------------------------

def _whole(value: Column) -> Column:
    return value.cast("decimal(38,0)")


def _covers(longer: Column, a: Column) -> Column:
    return _whole(longer) * 100 >= _whole(a) * COVERING


def _with_score(phrases: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """l, r, score of the lowest-scoring cut, the first of equals, and the bound of what it begins."""
    options = [
        F.struct(
            F.expr(f"cast(a as decimal(38,0)) * {FULL_SCORE} div (cast({x} as decimal(38,0)) + {y})").alias("score"),
            F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"),
        )
        for k, (x, y) in enumerate(cuts)
    ]
    lowest = F.least(*options) if len(options) > 1 else options[0]
    bound = F.expr(f"cast(a as decimal(38,0)) * {FULL_SCORE} div (cast(f1 as decimal(38,0)) + a)")
    return (
        phrases.withColumn("cut", lowest).withColumn("bound", bound)
        .select("lang", "w1", "w2", "w3", "w4", "a", "f1", "cut.l", "cut.r", "cut.score", "bound")
    )


def _known(table: DataFrame, names: dict[str, str], value: str) -> DataFrame:
    """``table`` under the names of a join: its columns as ``names`` says, its count as ``value``."""
    return table.select(*[F.col(ours).alias(theirs) for ours, theirs in names.items()], F.col("a").alias(value))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    first = words.select(F.col("h").alias("w1"), "lang", F.col("n").alias("f1"))
    second = words.select(F.col("h").alias("w2"), F.col("n").alias("f2"))
    none = F.lit(0).cast("long")
    both = pairs.join(first, "w1").join(second, "w2").withColumns({"w3": none, "w4": none})
    return _with_score(both, [("f1", "f2")])


def _scored_triples(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    third = words.select(F.col("h").alias("w3"), F.col("n").alias("f3"))
    begin = pairs.select("lang", "w1", "w2", "f1", F.col("a").alias("f12"))
    rows = (
        found.join(begin, ["w1", "w2"]).join(third, "w3")
        .join(_known(pairs, {"w1": "w2", "w2": "w3"}, "f23"), ["w2", "w3"])
    )
    return _with_score(rows, [("f1", "f23"), ("f12", "f3")])


def _scored_fours(found: DataFrame, words: DataFrame, pairs: DataFrame, triples: DataFrame) -> DataFrame:
    fourth = words.select(F.col("h").alias("w4"), F.col("n").alias("f4"))
    begin = triples.select("lang", "w1", "w2", "w3", "f1", F.col("a").alias("f123"))
    rows = (
        found.join(begin, ["w1", "w2", "w3"]).join(fourth, "w4")
        .join(_known(pairs, {"w1": "w1", "w2": "w2"}, "f12"), ["w1", "w2"])
        .join(_known(pairs, {"w1": "w3", "w2": "w4"}, "f34"), ["w3", "w4"])
        .join(_known(triples, {"w1": "w2", "w2": "w3", "w3": "w4"}, "f234"), ["w2", "w3", "w4"])
    )
    return _with_score(rows, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")])


# The frontier ---------------------------------------------------------------------------------

def _judged(
    phrases: DataFrame, longer: DataFrame, expanded: DataFrame, key: list[str]
) -> DataFrame:
    """``phrases`` with ``open`` (not expanded yet) and ``dropped`` (covered by a known longer one)."""
    ahead = longer.groupBy(*key).agg(F.max("a").alias("most_ahead"))
    tail = [f"w{int(k[1]) + 1}" for k in key]
    behind = longer.groupBy(*[F.col(t).alias(k) for t, k in zip(tail, key)]).agg(F.max("a").alias("most_behind"))
    most = F.greatest(F.coalesce("most_ahead", F.lit(0)), F.coalesce("most_behind", F.lit(0)))
    done = expanded.select(*key).distinct().withColumn("done", F.lit(True))
    return (
        phrases.join(ahead, key, "left").join(behind, key, "left").join(done, key, "left")
        .withColumn("open", F.col("done").isNull()).withColumn("dropped", _covers(most, F.col("a")))
        .drop("most_ahead", "most_behind", "done")
    )


def _bars(survivors: DataFrame, top: int) -> DataFrame:
    """lang, bar: the score of its ``top``-th settled survivor."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"))
    return (
        survivors.select("lang", "score").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= top)
        .groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("bar")).where(F.col("n") == top).drop("n")
    )


def _above(phrases: DataFrame, bars: DataFrame, figure: str) -> DataFrame:
    """Those whose ``figure`` reaches their language's bar; all, where it has none yet."""
    barred = bars.withColumnRenamed("lang", "barred")
    reaching = phrases.join(barred, (F.col("lang") == F.col("barred")) & (F.col(figure) >= F.col("bar")))
    free = phrases.join(barred, F.col("lang") == F.col("barred"), "left_anti")
    return reaching.drop("barred", "bar").unionByName(free)


_NAME = ["lang", "w1", "w2", "w3"]


def _asked(pairs: DataFrame, triples: DataFrame, bars: DataFrame) -> DataFrame:
    """Open prefixes that must be expanded: lang, w1, w2, w3, priority."""
    open_pairs, open_triples = pairs.where("open"), triples.where("open")
    wanted = [
        _above(p, bars, "bound").select(*_NAME, F.col("bound").alias("priority")) for p in (open_pairs, open_triples)
    ]
    # Prefixes that may bring an extension to the left of a phrase which is not settled.
    least = F.min("a").alias("least"), F.max("score").alias("priority")
    unsettled = [_above(p.where("not dropped"), bars, "score") for p in (pairs, triples)]
    by_word = unsettled[0].unionByName(unsettled[1]).groupBy(F.col("w1").alias("w2")).agg(*least)
    by_pair = unsettled[1].groupBy(F.col("w1").alias("w2"), F.col("w2").alias("w3")).agg(*least)
    for rows, needs, key in ((open_pairs, by_word, ["w2"]), (open_triples, by_pair, ["w2", "w3"])):
        met = rows.join(needs, key).where(_covers(F.col("a"), F.col("least")))
        wanted.append(met.select(*_NAME, "priority"))
    together = reduce(DataFrame.unionByName, wanted)
    return together.groupBy(*_NAME).agg(F.max("priority").alias("priority"))


def _best(asked: DataFrame, pairs: DataFrame, batch: int) -> DataFrame:
    """The most promising prefixes of each language in turn, and the suffixes whose counts their scores need."""
    order = Window.partitionBy("lang").orderBy(F.desc("priority"), "w1", "w2", "w3")
    chosen = (
        asked.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= batch)
        .orderBy("nth", *_NAME).limit(batch).select("w1", "w2", "w3")
    )
    needed = chosen.where("w3 <> 0").select(F.col("w2").alias("w1"), F.col("w3").alias("w2"))
    suffixes = pairs.where("open").join(needed.distinct(), ["w1", "w2"], "left_semi").select("w1", "w2", "w3")
    return chosen.unionByName(suffixes).distinct()


def _settled(phrases: DataFrame, open_pairs: DataFrame, open_triples: DataFrame | None) -> DataFrame:
    """Phrases that survive whatever is still to be counted."""
    left = open_pairs.groupBy(F.col("w2").alias("w1")).agg(F.max("a").alias("by_word"))
    rows = phrases.where("not open and not dropped").join(left, "w1", "left")
    free = ~F.coalesce(_covers(F.col("by_word"), F.col("a")), F.lit(False))
    if open_triples is not None:
        longer = open_triples.groupBy(F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(F.max("a").alias("by_pair"))
        rows = rows.join(longer, ["w1", "w2"], "left")
        free = free & ~F.coalesce(_covers(F.col("by_pair"), F.col("a")), F.lit(False))
    return rows.where(free).select(*_NAME, "w4", "a", "l", "r", "score")


def _word_filter(words: DataFrame) -> bytes:
    """A bitmap of frequent words, of fixed size."""
    slot = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    # A negative hash counts as its unsigned value, and the size divides two to the 64th.
    rows = (
        words.select(F.shiftright(slot, 15).alias("row"), (slot % _PER_ROW).alias("bit"))
        .groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    )
    bitmap = bytearray(FILTER_BITS // 8)
    for row, bits in rows:
        bitmap[row * (_PER_ROW // 8) : (row + 1) * (_PER_ROW // 8)] = bits
    return bytes(bitmap)


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP, least: int = LEAST,
    batch: int = BATCH,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two to four words of each language.

    ``a`` is the phrase's count, ``l`` and ``r`` those of the two parts at its lowest-scoring cut, ``n`` the words of the
    language. Phrases of at least ``least`` occurrences are candidates.
    """
    texts = picked(docs, lang=lang, text=text).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text"
    )
    scratch = Scratch()
    every = scratch.stored(
        texts.mapInArrow(_count_words, "lang string, word string, h long, n long")
        .groupBy("lang", "word", "h").agg(F.sum("n").alias("n")),
        "words",
    )
    words = scratch.stored(every.where(F.col("n") >= least), "frequent-words")
    sizes = stored(every.groupBy("lang").agg(F.sum("n").alias("size")), "languages")
    bits = _word_filter(words)
    pairs = scratch.stored(
        _scored_pairs(
            texts.mapInArrow(_pair_counter(bits), "w1 long, w2 long, n long")
            .groupBy("w1", "w2").agg(F.sum("n").alias("a")).where(F.col("a") >= least),
            words,
        ),
        "pairs",
    )
    triples = fours = pairs.where("false")
    expanded = pairs.where("false").select("w1", "w2", "w3")
    while True:
        rated_pairs = _judged(pairs, triples, expanded.where("w3 = 0"), ["w1", "w2"])
        rated_triples = _judged(triples, fours, expanded.where("w3 <> 0"), ["w1", "w2", "w3"])
        judged_pairs, judged_triples = scratch.stored(rated_pairs, "judged-pairs"), scratch.stored(rated_triples, "judged-triples")
        open_pairs, open_triples = judged_pairs.where("open"), judged_triples.where("open")
        survivors = (
            _settled(judged_pairs, open_pairs, None)
            .unionByName(_settled(judged_triples, open_pairs, open_triples))
            .unionByName(fours.select(*_NAME, "w4", "a", "l", "r", "score"))
        )
        bars = scratch.stored(_bars(survivors, top), "bars")
        wave = scratch.stored(_best(_asked(judged_pairs, judged_triples, bars), judged_pairs, batch), "wave")
        prefixes = np.array(wave.collect(), np.int64).reshape(-1, 3).view(np.uint64)
        if not len(prefixes):
            break
        long = prefixes[:, 2] != 0
        two, three = prefixes[~long], prefixes[long]
        counter = _extension_counter(
            bits, np.sort(phrase_keys(two[:, 0], two[:, 1])), np.sort(phrase_keys(three[:, 0], three[:, 1], three[:, 2]))
        )
        found = scratch.stored(
            texts.mapInArrow(counter, "w1 long, w2 long, w3 long, w4 long, n long")
            .groupBy("w1", "w2", "w3", "w4").agg(F.sum("n").alias("a")).where(F.col("a") >= least),
            "extensions",
        )
        new = _scored_triples(found.where("w4 = 0"), words, pairs)
        triples = scratch.stored(triples.unionByName(new), "triples")
        fours = scratch.stored(fours.unionByName(_scored_fours(found.where("w4 <> 0"), words, pairs, triples)), "fours")
        expanded = expanded.unionByName(wave)
    best = _above(survivors, bars, "score")
    for i in (1, 2, 3, 4):
        known = words.select(F.col("h").alias(f"w{i}"), F.col("word").alias(f"word{i}"))
        best = best.join(known, f"w{i}", "left")
    phrase = F.concat_ws(" ", *[f"word{i}" for i in (1, 2, 3, 4)])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("phrase", phrase).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    told = stored(
        ranked.join(sizes, "lang").select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("size").alias("n"), "score"
        ),
        "collocations",
    )
    scratch.drop()
    return told
