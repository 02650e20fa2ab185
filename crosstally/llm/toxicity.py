"""Toxicity severity by cumulative-link ordinal regression on sparse words.

``P(grade > k) = sigmoid(w . x - t_k)`` with one weight vector for all ordered thresholds t_0 < t_1 < ...; x has
one indicator per distinct word (runs of letters, lower-cased). Weights are fitted with an L1
penalty by accelerated proximal gradient steps, so words that say nothing weigh nothing. The output is
the expected grade, ``sum_k P(grade > k)``.

The labels say only toxic or not, so learning rows are graded first: 0 for not toxic, 1 for toxic, 2 for
toxic with at least ``severe_terms`` distinct telling words (words whose smoothed share of toxic
learning rows is at least ``telling`` times that of the others).

The model is fitted on at most ``per_class`` labelled rows of each label (the first by md5 of the id);
that is the only bound. Class weights in the likelihood come from the counts of all labelled rows.

Defined results: null and wordless texts have no words and get the score of the thresholds alone; an
unlabelled row is only scored; several labels of one id all count; without rows of both labels
every document gets that label's grade (0 without any label); an empty table gives no rows; other
columns are ignored.

Scale: a sample of a few thousand rows goes to the driver as word hashes; the model holds only the
words with a weight. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstally.llm.frames import picked
from crosstally.llm.sampling import labelled_sample
from crosstally.llm.shingles import mixed

PER_CLASS = 2500
SEVERE_TERMS = 3
TELLING = 20.0
LEAST_ROWS = 3
BLOCK = 1 << 20


def words(text: str | None) -> np.ndarray:
    """Distinct hashes of the lower-cased runs of letters, ascending."""
    text = (text or "").lower()
    found = [_words(text[low:high]) for low, high in _blocks(text)]
    if not found:
        return np.empty(0, np.uint64)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def _blocks(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of pieces of about ``BLOCK`` characters that end outside words."""
    low = 0
    while low < len(text):
        high = min(len(text), low + BLOCK)
        while high < len(text) and text[high - 1].isalpha() and text[high].isalpha():
            high += 1
        yield low, high
        low = high


def _words(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0) & (codes != 0xD7) & (codes != 0xF7)
    edge = np.diff(np.concatenate(([False], letter, [False])).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    begin = np.zeros(len(codes), np.int64)
    begin[starts] = starts
    place = (np.arange(len(codes)) - np.maximum.accumulate(begin)).astype(np.uint64)
    parts = mixed(codes * np.uint64(0x9E3779B97F4A7C15) + place)
    parts[~letter] = 0
    return np.unique(mixed(np.add.reduceat(parts, starts)))


@dataclass
class Model:
    """``vocabulary`` ascending, with a weight each; ``thresholds`` ascending."""

    vocabulary: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def exceedances(self, found: np.ndarray) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        total = 0.0
        if len(found) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, found), len(self.vocabulary) - 1)
            total = float(self.weights[at][self.vocabulary[at] == found].sum())
        return 1 / (1 + np.exp(-np.clip(total - self.thresholds, -500, 500)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grades(rows: list[np.ndarray], toxic: np.ndarray, severe_terms: int, telling: float) -> np.ndarray:
    """0, 1 or 2 for each learning row."""
    told = np.unique(np.concatenate([r for r, t in zip(rows, toxic) if t] or [np.empty(0, np.uint64)]))
    counts = np.zeros((2, len(told)))
    for r, t in zip(rows, toxic):
        hit = np.searchsorted(told, r[np.isin(r, told, assume_unique=True)])
        counts[int(t), hit] += 1
    sizes = np.array([(toxic == 0).sum(), (toxic == 1).sum()])
    share = (counts + 0.5) / (sizes[:, None] + 1)
    telling_words = told[(share[1] >= telling * share[0]) & (counts[1] >= 5)]
    severe = np.array([len(np.intersect1d(r, telling_words, assume_unique=True)) >= severe_terms for r in rows])
    return np.where(toxic == 1, 1 + severe, 0)


def fit(
    rows: list[np.ndarray], grade: np.ndarray, weight: np.ndarray, penalty: float = 2e-4, rounds: int = 400
) -> Model:
    """Weighted maximum likelihood with an L1 penalty on the words."""
    levels = int(grade.max()) if len(grade) else 0
    if levels == 0 or (grade == 0).sum() == 0:
        return Model(np.empty(0, np.uint64), np.empty(0), np.array([1.0] if levels == 0 else [-1.0]) * 20.0)
    every, counts = np.unique(np.concatenate(rows), return_counts=True)
    vocabulary = every[counts >= LEAST_ROWS]
    ids, owners = [], []
    for i, r in enumerate(rows):
        own = r[np.isin(r, vocabulary, assume_unique=True)]
        ids.append(np.searchsorted(vocabulary, own))
        owners.append(np.full(len(own), i))
    at, owner = np.concatenate(ids), np.concatenate(owners)
    share = weight / weight.sum()
    # Columns are scaled to the same curvature, which makes one step size fit rare and common words.
    scale = 1 / np.sqrt(np.bincount(at, share[owner], len(vocabulary)) + 1e-4)
    value = scale[at]
    size = np.sqrt(np.bincount(owner, value**2, len(rows)).max())
    k = np.arange(levels)
    thresholds = np.linspace(2.0, 4.0, levels) if levels > 1 else np.array([2.0])
    w, v, t, rate = np.zeros(len(vocabulary)), np.zeros(len(vocabulary)), 1.0, 4.0 / max(size, 1.0)
    for _ in range(rounds):
        margin = np.bincount(owner, v[at] * value, len(rows))[:, None] - thresholds
        # P(grade = g) is a difference of two neighbouring exceedances.
        above = np.hstack([np.ones((len(rows), 1)), _sigmoid(margin), np.zeros((len(rows), 1))])
        row = np.arange(len(rows))
        p = np.maximum(above[row, grade] - above[row, grade + 1], 1e-9)
        slope = above * (1 - above)
        d = np.zeros_like(margin)
        for j in range(levels):
            d[:, j] = np.where(grade == j + 1, slope[:, j + 1], np.where(grade == j, -slope[:, j + 1], 0)) / p
        d *= share[:, None]
        gradient = np.bincount(at, d.sum(axis=1)[owner] * value, len(vocabulary))
        new = v + rate * gradient
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty * scale, 0)
        thresholds = thresholds - 2.0 * d.sum(axis=0)
        thresholds = np.maximum.accumulate(thresholds + 1e-6 * k)
        next_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / next_t * (new - w), new, next_t
    used = w != 0
    return Model(vocabulary[used], (w * scale)[used], thresholds)


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words(t.as_py()).tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.binary())], ["label", "found"])


def learn(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, severe_terms: int = SEVERE_TERMS,
    telling: float = TELLING,
) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1)."""
    labels = labels.where("label in (0, 1)")
    texts, counts = labelled_sample(docs, labels, per_class)
    if texts is None:
        return fit([], np.empty(0, int), np.empty(0))
    got = sorted(texts.mapInArrow(_worded, "label int, found binary").collect(), key=lambda r: (r["label"], r["found"]))
    rows = [np.frombuffer(r["found"], np.uint64) for r in got]
    toxic = np.array([r["label"] for r in got])
    weight = np.array([counts[int(x)] / (toxic == x).sum() for x in toxic])
    if set(toxic.tolist()) == {1}:
        return fit([], np.ones(1, int), np.ones(1))
    return fit(rows, grades(rows, toxic, severe_terms, telling), weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, toxic_probability, grade (the likeliest), toxic (probability >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            expected, first, grade = [], [], []
            for text in batch.column("text"):
                above = own.exceedances(words(text.as_py()))
                expected.append(float(above.sum()))
                first.append(float(above[0]))
                grade.append(int(np.argmax(np.append(1.0, above) - np.append(above, 0.0))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(expected, pa.float64()), pa.array(first, pa.float64()), pa.array(grade, pa.int32())],
                ["doc_id", "expected_severity", "toxic_probability", "grade"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        scored, f"doc_id {kind}, expected_severity double, toxic_probability double, grade int"
    )
    return out.withColumn("toxic", F.col("toxic_probability") >= 0.5)


def grade_toxicity(
    docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id",
    text: str = "text", label: str = "toxic",
) -> DataFrame:
    docs = picked(docs, doc_id=doc_id, text=text)
    labels = picked(labels, doc_id=doc_id, label=label).withColumn("label", F.col("label").cast("int"))
    return score(docs, learn(docs, labels, per_class))
