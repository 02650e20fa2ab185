"""Nearest neighbours by inner product, on several shifted Hilbert curves.

Vectors are scaled into the unit ball and lifted onto its sphere, so that the largest inner product with a
query becomes the least distance. Each curve projects them on a few random directions, shifts the grid and
orders all vectors, and all queries between them, by their Hilbert keys (a range partitioning and a
sort in Spark). A query's candidates are the vectors within ``window`` places of it on any curve; they are
reranked by their inner product on the original vectors, added up without rounding errors.

The window is fitted: for ``SAMPLE`` queries the true neighbours are found among all rows, and the window is
the ``RECALL`` quantile of how near they lie on the nearest curve. So recall holds at every size; what
the data decide is the window's width, hence the work. Every row is indexed.

Defined results: rows without id, and vectors that are null, zero or hold null or non-finite components, take no
part, nor do vectors of another length than the most common one (of equally common ones, the shortest);
equal rows count once; of rows with one id and different vectors each is a query or candidate of its own;
queries give all candidates where there are fewer than ``count``; an empty table gives no rows; other columns are
ignored.

Scale: equal vectors are one point with their ``count + 1`` least ids, which is all that a result can hold of
them, found before the shuffle. A task compares one block of points with one stretch of queries, both bounded,
and keeps only the best of each query. The driver sees the greatest norm, the sampled queries and the window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstally.llm.frames import Scratch, picked, place_in, ranged, spans_of, stored

COUNT = 20
CURVES, DIMS, BITS = 3, 8, 7
SAMPLE, RECALL = 256, 0.95
LEAST_WINDOW = 1024
BLOCK, STRETCH = 8192, 131_072
_CHUNK = 256


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places of grid cells (n, d) on the Hilbert curve (Skilling 2004); ``bits * d`` is at most 63."""
    x = [c.astype(np.int64) for c in cells.T]
    d, high = len(x), 1 << (bits - 1)
    step = high
    while step > 1:
        low = step - 1
        for i in range(d):
            turned = (x[i] & step) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        step >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip, step = np.zeros_like(x[0]), high
    while step > 1:
        flip = np.where((x[d - 1] & step) != 0, flip ^ (step - 1), flip)
        step >>= 1
    key = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ flip) >> bit) & 1)
    return key


def _curve(nth: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shift of a curve, the same in every task."""
    rng = np.random.default_rng(nth)
    directions = np.linalg.qr(rng.standard_normal((dims + 1, min(DIMS, dims + 1))))[0]
    return directions, rng.random(directions.shape[1])


def curve_keys(points: np.ndarray, nth: int) -> np.ndarray:
    """Keys on the ``nth`` curve of points on the unit sphere (n, dims + 1)."""
    directions, shift = _curve(nth, points.shape[1] - 1)
    # Three deviations of a random direction to either side; what lies beyond joins the edge.
    spread = points @ directions * (math.sqrt(points.shape[1]) / 6) + 0.5
    cells = (np.clip(spread, 0, 1) + shift) * (1 << (BITS - 1))
    return hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)


def _lifted(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors of norm up to ``largest`` as points of the unit sphere, one dimension up."""
    scaled = vectors / largest
    rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1, keepdims=True)))
    return np.hstack([scaled, rest])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _keyed(largest: float) -> Callable:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch.column("vector"))
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            unit = vectors[asked] / np.abs(vectors[asked]).max(axis=1, keepdims=True, initial=0)
            unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
            sides = ((_lifted(vectors, largest), np.arange(len(batch)), False), (_lifted(unit, 1.0), asked, True))
            names = batch.column("point").to_numpy()
            for nth in range(CURVES):
                for points, which, is_query in sides:
                    n = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(n, nth, np.int32)), pa.array(curve_keys(points, nth)),
                            pa.array(np.full(n, is_query)), pa.array(names[which]),
                        ],
                        ["curve", "key", "is_query", "point"],
                    )

    return keys


def inner_product(a: np.ndarray, b: np.ndarray) -> float:
    """Of two vectors, correctly rounded (products of 32-bit numbers are exact)."""
    return math.fsum(map(mul, a.tolist(), b.tolist()))


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Which of a query's scores may be among its ``count`` best, rounding errors allowed for."""
    if len(scores) <= count:
        return np.flatnonzero(scores > -np.inf)
    bar = np.partition(scores, len(scores) - count)[len(scores) - count]
    slack = 1e-12 * max(1.0, abs(bar)) if bar > -np.inf else 0
    return np.flatnonzero((scores >= bar - slack) & (scores > -np.inf))


def _near(table: pa.Table, window: int | None, count: int) -> pa.Table:
    """The best points of one block for each query of one stretch, within the window."""
    is_query = table.column("is_query").to_numpy()
    vectors = _matrix(table.column("vector").combine_chunks())
    at, names = table.column("pos").to_numpy(), table.column("point").to_numpy()
    ids = table.column("ids").to_pylist()
    asked, points = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    out: list[tuple] = []
    for first in range(0, len(asked) if len(points) else 0, _CHUNK):
        some = asked[first : first + _CHUNK]
        scores = vectors[some] @ vectors[points].T
        if window is not None:
            scores[np.abs(at[points][None, :] - at[some][:, None]) > window] = -np.inf
        for q, row in zip(some, scores):
            told = []
            for i in points[_best(row, count)]:
                score = inner_product(vectors[q], vectors[i])
                told += [(-score, vec_id, names[i]) for vec_id in ids[i]]
            out += [(names[q], -s, v, p) for s, v, p in sorted(told)[:count]]
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["query", "score", "vec_id", "point"])


_FOUND = "query long, score double, vec_id long, point long"


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _points(rows: DataFrame, count: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """point, vector, ids, asked of every different vector; and vec_id, point of every query."""
    name = ["h1", "h2"]
    hashed = rows.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(1), "vector")})
    least = Window.partitionBy(*name).orderBy("vec_id")
    # Equal rows count once; ``dense_rank`` is bounded before the shuffle, like ``row_number``.
    few = hashed.withColumn("nth", F.dense_rank().over(least)).where(F.col("nth") <= count + 1)
    asked = hashed.where("is_query").select("vec_id", *name).distinct()
    points = (
        few.groupBy(*name).agg(F.array_sort(F.collect_set("vec_id")).alias("ids"), F.any_value("vector").alias("vector"))
        .join(asked.select(*name).distinct().withColumn("asked", F.lit(True)), name, "left")
    )
    points = scratch.stored(
        points.select(
            *name, "ids", "vector", F.coalesce("asked", F.lit(False)).alias("asked"),
            F.monotonically_increasing_id().alias("point"),
        ),
        "points",
    )
    return points, scratch.stored(asked.join(points.select(*name, "point"), name).select("vec_id", "point"), "queries")


def _true_neighbours(points: DataFrame, sample: list, count: int) -> DataFrame:
    """query, point: the nearest points of the sampled queries among all."""
    names = np.array([r["point"] for r in sample], np.int64)
    queries = np.array([r["vector"] for r in sample], np.float64)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column("point").to_numpy()
            scores = queries @ _matrix(batch.column("vector")).T
            scores[names[:, None] == own[None, :]] = -np.inf
            kept = np.argsort(-scores, axis=1, kind="stable")[:, :count]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(names, kept.shape[1])), pa.array(own[kept].ravel()),
                    pa.array(np.take_along_axis(scores, kept, axis=1).ravel()),
                ],
                ["query", "point", "score"],
            )

    order = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    found = points.select("point", "vector").mapInArrow(nearest, "query long, point long, score double")
    return (
        found.where(F.col("score") > float("-inf")).withColumn("nth", F.row_number().over(order))
        .where(F.col("nth") <= count).select("query", "point")
    )


def _window(places: DataFrame, neighbours: DataFrame) -> int:
    """Places to either side that hold the ``RECALL`` share of true neighbours on one curve or another."""
    asked = places.where("is_query").select("curve", F.col("point").alias("query"), F.col("pos").alias("own"))
    held = places.where("not is_query").select("curve", "point", "pos")
    nearest = (
        neighbours.join(asked, "query").join(held, ["curve", "point"])
        .groupBy("query", "point").agg(F.min(F.abs(F.col("pos") - F.col("own"))).alias("away"))
    )
    found = nearest.agg(F.percentile("away", F.lit(RECALL))).first()[0]
    return max(LEAST_WINDOW, math.ceil(found or 0))


def _tiled(places: DataFrame, window: int) -> DataFrame:
    """Every point with each stretch of queries that may see it, and every query with each block in its window."""
    block, stretch = (lambda x: F.floor(x / BLOCK)), (lambda x: F.floor(x / STRETCH))
    last = F.col("size") - 1
    low, high = F.greatest(F.col("pos") - window, F.lit(0)), F.least(F.col("pos") + window, last)
    # A block meets a stretch if any two of their places may be within the window of one another.
    start = block(F.col("pos")) * BLOCK
    first, final = F.greatest(start - window, F.lit(0)), F.least(start + BLOCK - 1 + window, last)
    of_points = places.where("not is_query").withColumns(
        {"block": block(F.col("pos")), "stretch": F.explode(F.sequence(stretch(first), stretch(final)))}
    )
    of_queries = places.where("is_query").withColumns(
        {"stretch": stretch(F.col("pos")), "block": F.explode(F.sequence(block(low), block(high)))}
    )
    return of_points.unionByName(of_queries)


def nearest(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", count: int = COUNT
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``count`` rows found nearest to every row for which ``is_query`` holds.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = picked(vectors, vec_id=vec_id, vector=vector).where(F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    scratch = Scratch()
    common = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = common["dims"] if common else 1
    rows = rows.where(F.size("vector") == dims).withColumn("is_query", is_query)
    points, queries = _points(rows, count, scratch)
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    largest = math.sqrt(points.agg(F.max(square)).first()[0] or 1.0) or 1.0
    keyed = points.mapInArrow(_keyed(largest), "curve int, key long, is_query boolean, point long")
    ordered = ranged(keyed, ["curve", "key", "point"], "curves", scratch)
    spans = spans_of(ordered, ["curve"])
    sizes = spans.groupBy("curve").agg(F.sum("rows").alias("size"))
    places = scratch.stored(
        ordered.withColumn("part", F.shiftright("at", 33)).join(spans.join(sizes, "curve"), ["curve", "part"])
        .select("curve", "is_query", "point", "size", place_in().alias("pos")),
        "places",
    )
    sample = points.where("asked").orderBy("h1", "h2").limit(SAMPLE).select("point", "vector").collect()
    window = _window(places, _true_neighbours(points, sample, count)) if sample else LEAST_WINDOW
    tiles = _tiled(places, window).join(points.select("point", "vector", "ids"), "point")
    found = tiles.groupBy("curve", "stretch", "block").applyInArrow(
        lambda table: _near(table, window, count + 1), _FOUND
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "point")
    lists = (
        found.dropDuplicates(["query", "vec_id", "point"]).withColumn("nth", F.row_number().over(best))
        .where(F.col("nth") <= count + 1).drop("nth")
    )
    lists = scratch.stored(lists, "lists")
    own = queries.select(F.col("vec_id").alias("query_id"), F.col("point").alias("query"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id", "point")
    told = (
        lists.join(own, "query").where((F.col("vec_id") != F.col("query_id")) | (F.col("point") != F.col("query")))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
        .select("query_id", "rank", "vec_id", "score")
    )
    result = stored(told, "neighbours")
    scratch.drop()
    return result
