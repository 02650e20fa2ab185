"""Quality classifier: a linear support vector machine on n-gram log-count ratios (NBSVM).

Features are indicators of hashed n-grams: runs of characters, and runs of word shapes (a shape
tells case, length class, last character's kind and whether the word repeats the one before). Every
indicator is scaled by its log-count ratio between the classes; a hinge-loss linear model is fitted
to the scaled rows, of unit length, by dual coordinate descent (Hsieh et al. 2008). Margins become
probabilities by a logistic curve fitted to out-of-fold margins.

The model is fitted on at most ``per_class`` labelled rows of each class (the first by md5 of the
id, so reruns agree); that is the only bound. The curve's class weights come from the counts of all
learning rows. Scoring covers every row and whole texts.

Defined results: a null text is scored as an empty one, whose score is the curve at the bias;
several labels of one id all count; without rows of both classes every score is the share of label
1 (0.5 without any label); an empty table gives no rows; other columns are ignored.

Scale: the sample (a few thousand rows of feature numbers) goes to the driver, where the fit takes
seconds; the model is a fixed array of 2**18 numbers. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstally.llm.frames import picked, released
from crosstally.llm.sampling import labelled_sample
from crosstally.llm.shingles import mixed

FEATURE_BITS = 18
BLOCK = 1 << 20
PER_CLASS = 1500
LEAST_SCORE = 0.3
_CHAR_GRAMS = (1, 2, 3, 4)
_SHAPE_GRAMS = (1, 2, 3, 4)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(symbols: np.ndarray, lengths: tuple[int, ...], salt: int) -> list[np.ndarray]:
    """Hashes of all runs of the given lengths, rolled from one length to the next."""
    out, total = [], np.full(len(symbols), salt, np.uint64)
    for n in range(1, max(lengths) + 1):
        if n > len(symbols):
            break
        total = (total[: len(symbols) - n + 1] + symbols[n - 1 :] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
        if n in lengths:
            out.append(total * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FEATURE_BITS))
    return out


def _shapes(codes: np.ndarray) -> np.ndarray:
    """One small number per word."""
    space = (codes == 32) | ((codes >= 9) & (codes <= 13))
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    lower = codes | np.uint64(32)
    begin = np.zeros(len(codes), np.int64)
    begin[starts] = starts
    position = (np.arange(len(codes)) - np.maximum.accumulate(begin)).astype(np.uint64)
    place = mixed(lower * np.uint64(0x9E3779B97F4A7C15) + position)
    place[space] = 0
    words = np.add.reduceat(place, starts)
    upper = (codes >= 65) & (codes <= 90)
    uppers = np.add.reduceat(upper.astype(np.int64), starts)
    letter = ((codes | np.uint64(32)) >= 97) & ((codes | np.uint64(32)) <= 122) | (codes > 127)
    last = codes[ends - 1]
    kind = np.where(letter[ends - 1], 0, np.where((last >= 48) & (last <= 57), 1, np.where((last == 44) | (last == 46), 2, 3)))
    repeats = np.concatenate(([0], words[1:] == words[:-1])).astype(np.int64)
    size = np.digitize(lengths, (2, 4, 8, 16))
    case = np.where(uppers == 0, 0, np.where(uppers * 2 > lengths, 2, 1))
    return (((repeats * 4 + kind) * 3 + case) * 5 + size).astype(np.uint64)


def features(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text, ascending."""
    text = text or ""
    seen = np.zeros(1 << FEATURE_BITS, bool)
    for start in range(0, len(text), BLOCK):
        codes = _codes(text[max(0, start - 64) : start + BLOCK])
        for found in _grams(codes, _CHAR_GRAMS, 1):
            seen[found] = True
        shapes = _shapes(codes)
        if len(shapes):
            for found in _grams(shapes, _SHAPE_GRAMS, 2) + _grams(shapes // np.uint64(60), (3, 4, 5, 6), 3):
                seen[found] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / max(1.0, np.sqrt(len(found))) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    counts = np.full((2, 1 << FEATURE_BITS), smoothing)
    for found, label in zip(rows, labels):
        counts[int(label), found] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_hinge(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 1.0,
    rounds: int = 20, seed: int = 0,
) -> tuple[np.ndarray, float]:
    """Weights and bias by dual coordinate descent; each class has the same total cost."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max(1, (labels == k).sum()) for k in (0, 1)])
    limit = cost * len(labels) / (2 * share[labels.astype(int)])
    values = [ratios[found] / max(1.0, np.sqrt(len(found))) for found in rows]
    norms = np.array([v @ v + 1.0 for v in values])
    weights, bias, alpha = np.zeros(1 << FEATURE_BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), limit[i])
            if step := (new - alpha[i]) * signs[i]:
                weights[rows[i]] += step * values[i]
                bias += step
                moved = max(moved, abs(step))
            alpha[i] = new
        if moved < 1e-3:
            break
    return weights * ratios, bias


def fit_curve(margins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton's method on softened labels."""
    ones, zeros = (labels == 1).sum(), (labels == 0).sum()
    goal = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = np.stack([margins, np.ones_like(margins)])
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        gradient = x @ (weight * (p - goal))
        hessian = (x * (weight * p * (1 - p))) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(at[0], 1e-6)), float(at[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, counts: dict[int, int]) -> Model:
    """``counts``: how many learning rows each class has in all, for the curve's weights."""
    total = sum(counts.values())
    if len(set(labels.tolist())) < 2:
        share = counts.get(1, 0) / total if total else 0.5
        shift = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Model(np.zeros(1 << FEATURE_BITS), 0.0, 1.0, shift)
    margins = np.zeros(len(rows))
    for fold in (0, 1):
        learn = [i for i in range(len(rows)) if i // 2 % 2 != fold]
        if len(set(labels[learn].tolist())) < 2:
            continue
        own = [rows[i] for i in learn]
        ratios = log_count_ratios(own, labels[learn])
        part = Model(*fit_hinge(own, labels[learn], ratios), 1.0, 0.0)
        for i in range(len(rows)):
            if i // 2 % 2 == fold:
                margins[i] = part.margin(rows[i])
    weight = np.array([counts[int(k)] / max(1, (labels == k).sum()) for k in labels])
    slope, shift = fit_curve(margins, labels, weight)
    return Model(*fit_hinge(rows, labels, log_count_ratios(rows, labels)), slope, shift)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "found"])


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1).

    Takes at most ``per_class`` texts of each label, the first by md5 of the id, see ``labelled_sample``.
    """
    labels = labels.where("label in (0, 1)")
    model = _fitted(*labelled_sample(docs, labels, per_class))
    # The sample has gone, but the driver lives on.
    released()
    return model


def _fitted(texts: DataFrame | None, counts: dict[int, int]) -> Model:
    if texts is None:
        return fit([], np.empty(0), counts)
    rows = texts.mapInArrow(_featured, "label int, found binary").collect()
    rows.sort(key=lambda r: (r["found"], r["label"]))
    rng = np.random.default_rng(0)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    return fit(
        [np.frombuffer(r["found"], np.int32) for r in rows],
        np.array([r["label"] for r in rows]), counts,
    )


def score(docs: DataFrame, model: Model, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` and ``score`` of its column ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(features(t.as_py())) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(scores, pa.float64())], [*carry, "score"]
            )
        released()

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(scored, f"{kinds}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, least: float = LEAST_SCORE, per_class: int = PER_CLASS,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score, predicted. Rows whose crc32(id) mod 5 is 0 are never learned from."""
    docs = picked(docs, doc_id=doc_id, text=text)
    model = learn(
        docs.where(~held_out(F.col("doc_id"))),
        picked(labels, doc_id=doc_id, label=label).where(~held_out(F.col("doc_id")))
        .withColumn("label", F.col("label").cast("int")),
        per_class,
    )
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
