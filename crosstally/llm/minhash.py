"""Near-duplicates by one-permutation MinHash with optimal densification.

1. Equal shingle sets are one *class* (by a 128-bit digest of the set).
2. A class's shingle hashes fall into bins; a bin's least hash is its signature value, and an empty
   bin borrows from bins that a fixed random sequence probes (Shrivastava 2017). Bands of bins
   are hashed into buckets.
3. In every bucket the classes are linked to one centre, the class whose buckets hold the most members in
   all (for copies of one text with different edits that is the text they come from): candidates
   grow with the members of a bucket, not with their pairs.
4. Candidates are confirmed on full shingle sets; links give components.
5. Two members of a bucket may be alike though neither is like the centre. So where a bucket's
   members still lie in several components, those outside its largest one are compared with the members
   of other components by counting shared shingles. Only links leave that step, and it is dealt
   out in groups of a bounded number of sets. After it no pair that shares a bucket is undecided.

A pair at the threshold misses all buckets with a probability of ``(1 - threshold**rows)**bands``, 2e-6
as set; above it the odds fall quickly.

Defined results: null and wordless texts have no shingles and are linked with nothing; a text of
fewer words than a shingle is one shingle of all its words; rows of equal id stand for one document
of the same text or, where their texts differ, are judged row by row; an empty table gives no rows;
other columns are ignored. A null id is kept and its text links others; it cannot name a component that has
another id.

Scale: texts are read twice (signatures; sets of the classes that share a bucket). Everything
else moves digests. Groups of copies collapse in map-side aggregates. Joins on a hot bucket, class
or component have one small side or are splittable by Spark's skew join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.functions.types import quoted
from crosstally.llm.frames import WORD, Scratch, picked, released, stored
from crosstally.llm.graph import components
from crosstally.llm.shingles import Shingler, mixed

ROWS, BANDS, PROBES = 3, 24, 64
BINS = ROWS * BANDS
THRESHOLD = 0.75
PART = 1024


def _probe_order() -> np.ndarray:
    grid = np.arange(BINS * PROBES, dtype=np.uint64).reshape(BINS, PROBES)
    return (mixed(grid + np.uint64(1)) % np.uint64(BINS)).astype(np.int64)


_PROBE_ORDER = _probe_order()


def signature(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` values from a non-empty set of shingle hashes, by one permutation."""
    hashed = np.sort(mixed(shingles + np.uint64(0x51ED270B)))
    bins = ((hashed >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(bins, np.arange(BINS))
    full = np.zeros(BINS, bool)
    full[bins] = True
    values = hashed[np.minimum(first, len(hashed) - 1)]
    lent = np.where(full, np.arange(BINS), -1)
    empty = np.flatnonzero(~full)
    for probe in range(PROBES):
        if not len(empty):
            break
        asked = _PROBE_ORDER[empty, probe]
        lent[empty] = np.where(full[asked], asked, -1)
        empty = empty[lent[empty] < 0]
    if len(empty):
        filled = np.flatnonzero(full)
        lent[empty] = filled[np.searchsorted(filled, empty) % len(filled)]
    # What is borrowed is marked with its bin, as each bin has a permutation of its own.
    return mixed(values[lent] + np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def band_keys(values: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        total = mixed(total * np.uint64(0xC2B2AE3D27D4EB4F) + column)
    return total.view(np.int64)


def digest(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        sizes, digests, keys = [], [], []
        for text in batch.column("text"):
            found = shingler(text.as_py())
            sizes.append(len(found))
            digests.append(digest(found))
            keys.append(band_keys(signature(found)) if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("h"), pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ],
            ["doc_id", "h", "n_shingles", "class", "keys"],
        )
    released()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        found = [shingler(text.as_py()) for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([digest(x) for x in found], pa.binary()),
                pa.array([x.tobytes() for x in found], pa.large_binary()),
            ],
            ["class", "shingles"],
        )
    released()


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        sides = zip(batch.column("u_set"), batch.column("v_set"))
        for u, v in ((np.frombuffer(x.as_py(), np.uint64) for x in pair) for pair in sides):
            if len(u) > len(v):
                u, v = v, u
            at = np.searchsorted(v, u)
            shared = int((v[np.minimum(at, len(v) - 1)] == u).sum())
            keep.append(100 * shared >= round(100 * THRESHOLD) * (len(u) + len(v) - shared))
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    released()


def _between(table: pa.Table) -> pa.Table:
    """Links between a group's stragglers and members of other components.

    The stragglers' shingles form an inverted list; each member's shingles are counted in it.
    """
    straggling = np.array(table.column("straggler").to_pylist(), bool)
    names, parts = table.column("u").to_pylist(), table.column("component").to_pylist()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
    few, others = np.flatnonzero(straggling), np.flatnonzero(~straggling)
    found_u, found_v = [], []
    if len(few) and len(others):
        sizes = np.array([len(sets[i]) for i in few])
        every = np.concatenate([sets[i] for i in few])
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(few)), sizes)[order]
        values, first = np.unique(every[order], return_index=True)
        counts = np.diff(np.append(first, len(every)))
        component = {c: n for n, c in enumerate(dict.fromkeys(parts))}
        part = np.array([component[c] for c in parts])
        for i in others:
            at = np.searchsorted(values, sets[i])
            at = at[values[np.minimum(at, len(values) - 1)] == sets[i]]
            n = counts[at]
            if not len(n):
                continue
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(owner[np.repeat(first[at], n) + within], minlength=len(few))
            like = 100 * shared >= round(100 * THRESHOLD) * (sizes + len(sets[i]) - shared)
            for j in np.flatnonzero(like & (part[few] != part[i])):
                found_u.append(names[few[j]])
                found_v.append(names[i])
    return pa.table([pa.array(found_u, pa.binary()), pa.array(found_v, pa.binary())], ["u", "v"])


def _similar_sizes(pairs: DataFrame) -> DataFrame:
    """Sets whose sizes differ too much cannot pass the threshold."""
    percent = round(100 * THRESHOLD)
    return pairs.where(F.least("u_n", "v_n") * 100 >= F.greatest("u_n", "v_n") * percent)


def _shingle_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """class, shingles of the given classes (class, member), from their members' texts.

    A class has no member to look up if none has an id, so texts without an id are all read.
    """
    texts = docs.join(classes.select(F.col("member").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return (
        texts.unionByName(docs.where("doc_id is null")).select("text").mapInArrow(_sets, "class binary, shingles binary")
        .join(classes.select("class"), "class", "left_semi")
        .groupBy("class").agg(F.any_value("shingles").alias("shingles"))
    )


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that pass on their full sets."""
    both = pairs.select("u", "v").join(
        sets.select(F.col("class").alias("u"), F.col("shingles").alias("u_set")), "u"
    ).join(sets.select(F.col("class").alias("v"), F.col("shingles").alias("v_set")), "v")
    return both.mapInArrow(_confirmed, "u binary, v binary")


def _missed(
    crowded: DataFrame, found: DataFrame, sets: DataFrame, scratch: Scratch
) -> DataFrame:
    """Links between members of one bucket that lie in different components.

    Of each bucket the members outside its largest component (the stragglers) meet all members. Both are
    dealt into parts of about ``PART`` by hash, and each pair of parts is one group.
    """
    nodes = found.withColumnRenamed("node", "u")
    placed = (
        crowded.select("band", "key", "u", "size").join(nodes, "u", "left")
        .withColumn("component", F.coalesce("component", "u"))
    )
    parts = placed.groupBy("band", "key", "component").agg(F.count(F.lit(1)).alias("m"))
    largest = parts.groupBy("band", "key").agg(
        F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("size"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select(
        "band", "key", F.col("top.component").alias("largest"),
        F.ceil((F.col("size") - F.col("top.m")) / PART).cast("int").alias("few"),
        F.ceil(F.col("size") / PART).cast("int").alias("lanes"),
    )
    split = scratch.stored(placed.drop("size").join(largest, ["band", "key"]), "split")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    some_of = lambda n: F.pmod(F.xxhash64("u", F.lit(n)), F.col(n)).cast("int")
    stragglers = split.where("component <> largest").select(
        "band", "key", some_of("few").alias("part"), F.explode(all_of("lanes")).alias("lane"), "u", "component",
        F.lit(True).alias("straggler"),
    )
    others = split.select(
        "band", "key", F.explode(all_of("few")).alias("part"), some_of("lanes").alias("lane"), "u", "component",
        F.lit(False).alias("straggler"),
    )
    rows = stragglers.unionByName(others).join(sets.withColumnRenamed("class", "u"), "u")
    return rows.groupBy("band", "key", "part", "lane").applyInArrow(_between, "u binary, v binary").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, n_shingles, class), classes (class, ...) and components (node, component) of docs."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(
        docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
            _signed, f"doc_id {id_type}, h long, n_shingles long, class binary, keys array<long>"
        ),
        "signed",
    )
    worded = signed.where("class is not null")
    classes = stored(
        worded.groupBy("class").agg(
            F.min("doc_id").alias("member"), F.max("n_shingles").alias("n"),
            F.any_value("keys").alias("keys"),
        ),
        "classes",
    )
    members = classes.select(F.col("class").alias("u"), F.col("n").alias("u_n"), F.posexplode("keys").alias("band", "key"))
    sizes = members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    scratch = Scratch()
    crowded = scratch.stored(members.join(sizes, ["band", "key"]), "crowded")
    crowds = crowded.groupBy("u").agg(F.sum("size").alias("crowd"))
    sets = scratch.stored(
        _shingle_sets(docs, crowds.select(F.col("u").alias("class")).join(classes.select("class", "member"), "class")),
        "sets",
    )
    rank = F.struct("crowd", F.col("u").alias("v"), F.col("u_n").alias("v_n"))
    centres = crowded.join(crowds, "u").groupBy("band", "key").agg(F.max(rank).alias("top")).select("band", "key", "top.v", "top.v_n")
    stars = crowded.join(centres, ["band", "key"]).where("u <> v").select("u", "v", "u_n", "v_n").distinct()
    links = scratch.stored(_links(_similar_sizes(stars), sets), "links")
    found = scratch.stored(components(links, "joined"), "components")
    missed = scratch.stored(_missed(crowded, found, sets, scratch), "missed")
    found = stored(components(links.union(missed), "all-joined"), "all-components")
    scratch.drop()
    return signed, classes.select("class"), found


def _component_of(classes: DataFrame, found: DataFrame) -> DataFrame:
    """class, component: a class without links is a component of its own."""
    return classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "component", F.coalesce("component", "class")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reachable), kept; one row per input row."""
    signed, classes, found = _grouped(picked(docs, doc_id=doc_id, text=text))
    worded = signed.where("class is not null")
    named = _component_of(worded.select("class", "doc_id").distinct(), found)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = _component_of(classes, found).join(least, "component").select("class", "component_id")
    with_words = worded.select("doc_id", "n_shingles", "class").join(of_class, "class").drop("class")
    without = signed.where("class is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return with_words.unionByName(without).select(
        "doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, in the columns of ``docs``; all rows without words stay.

    It is a row of the least id, of the least text hash where one id has several texts of the group;
    of rows equal in both, the one of least hash over all columns. Rows without an id come last.
    """
    signed, _, found = _grouped(picked(docs, doc_id=doc_id, text=text))
    counted = signed.where("class is not null").groupBy("class", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "n")).alias("top")
    chosen = stored(
        _component_of(counted, found).groupBy("component").agg(first).select("top.doc_id", "top.h", "top.n"), "chosen"
    )
    whole = docs.select(
        quoted(doc_id).alias("id"), F.xxhash64(quoted(text)).alias("hash"),
        (~F.coalesce(quoted(text), F.lit("")).rlike(WORD)).alias("empty"),
        F.struct(*map(quoted, docs.columns)).alias("row"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("h"))
    single = whole.join(chosen.where("n = 1"), same, "left_semi").where("not empty").select("row")
    several = (
        whole.where("not empty").join(chosen.where("n > 1"), same, "inner").groupBy("doc_id", "h")
        .agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    )
    kept = whole.where("empty").select("row").unionByName(single).unionByName(several)
    field = F.col("row").getField
    return kept.select(*[field(c).alias(c) for c in docs.columns])
