"""Hilbert neighbours: the curve's own properties, exact small cases, recall against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from crosstally.llm import hilbert
from crosstally.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, point int, pos int, ids string, size int, curve int, score int"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (5, 2)])
def test_the_curve_visits_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
    keys = hilbert.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(1 << bits * dims))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def by_hand(rows, count=20):
    usable = {
        (i, tuple(np.float32(x) for x in v)) for i, v in rows
        if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    }
    lengths = [len(v) for _, v in usable]
    dims = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if lengths else 0
    usable = sorted(r for r in usable if len(r[1]) == dims)
    found = []
    for q in usable:
        if q[0] % 20 == 0:
            scored = sorted((-math.fsum(float(a) * float(b) for a, b in zip(q[1], r[1])), r[0]) for r in usable if r != q)
            found += [(q[0], rank, i, -s) for rank, (s, i) in enumerate(scored[:count], 1)]
    return sorted(found)


def searched(spark, tmp_path, rows):
    wide = [(i, v, 1, 2, 3, "x", 4, 5, 6) for i, v in rows]
    spark.createDataFrame(wide, SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    return sorted(tuple(r) for r in QUERIES["op11_nearest_neighbours"](spark, str(tmp_path)).collect())


def test_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(1, 90)]
    rows += [(0, [1.0, 2.0, 0.0, 0.0]), (-20, [3.0, 0.5, 0.0, 1.0]), (100, None), (120, []), (140, [0.0] * 4), (160, [1.0, None, 0.0, 1.0])]
    rows += [(180, [float("nan"), 1.0, 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0, 1.0]), (220, [1.0, 2.0]), (None, [9.0] * 4)]
    rows += [(240 + i, [2.0, 2.0, -1.0, 0.5]) for i in range(60)] + [(7, [5.0, 5.0, 5.0, 5.0]), (0, [1.0, 2.0, 0.0, 0.0])] * 3
    assert searched(spark, tmp_path, rows) == by_hand(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 1.0])], [(0, [1.0, 1.0]), (3, [1.0, -2.0])], [(1, [1.0])]])
def test_few_rows(spark, tmp_path, rows):
    assert searched(spark, tmp_path, rows) == by_hand(rows)


def test_recall_and_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 300)
    monkeypatch.setattr(hilbert, "STRETCH", 500)
    monkeypatch.setattr(hilbert, "LEAST_WINDOW", 16)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((25, 16)) * 3
    rows = [(i, (centres[i % 25] * (1 + i % 3) + rng.standard_normal(16)).tolist()) for i in range(2000)]
    found, true = searched(spark, tmp_path, rows), by_hand(rows)
    assert [r[:2] for r in found] == [r[:2] for r in true]
    score = {(q, i): s for q, _, i, s in true}
    hits = [(q, i) for q, _, i, s in found if (q, i) in score and score[q, i] == s]
    assert len(hits) >= 0.9 * len(true)
