"""The Merkle manifest against a tree folded by hand, and the resumable hash against hashlib."""

from __future__ import annotations

import hashlib
import zlib
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosstally.llm import merkle, sha256
from crosstally.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(nodes: list[str], at: int | None = None, shown: str | None = None):
    """The top, and for node ``at`` its siblings on the way and the top with ``shown`` in its place."""
    siblings = []
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        if at is not None:
            run, slot = runs[at // 3], at % 3
            siblings += run[:slot] + run[slot + 1 :]
            shown = digest("".join(run[:slot] + [shown] + run[slot + 1 :]))
            at //= 3
        nodes = [digest("".join(run)) for run in runs]
    return nodes[0], siblings, shown


def by_hand(rows):
    key = lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))
    sources = [list(g) for _, g in groupby(sorted(rows, key=key), key=lambda r: r[1])]
    subroots = [climbed([leaf(r) for r in source])[0] for source in sources]
    found = []
    for nth, source in enumerate(sources):
        for at, row in enumerate(source):
            other = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                other = (*row[:4], row[4].replace("\n", ""))
            subroot, low, changed = climbed([leaf(r) for r in source], at, leaf(other))
            root, high, folded = climbed(subroots, nth, changed)
            found.append((row[0], leaf(row), subroot, root, digest("".join(low + high)), folded, folded == root))
    return found


def test_states_resume_like_hashlib():
    rng = np.random.default_rng(3)
    blocks = rng.integers(0, 256, (2, 5, 64), dtype=np.uint8)
    state = sha256.resumed(sha256.begun(5), blocks[0])
    again = sha256.read_states(sha256.stored_states(state))
    state = sha256.resumed(sha256.resumed(again, blocks[1]), np.broadcast_to(sha256.last_block(128), (5, 64)))
    told = [bytes(x).decode() for x in sha256.told(state)]
    assert told == [hashlib.sha256(blocks[:, i].tobytes()).hexdigest() for i in range(5)]


@pytest.mark.parametrize("n, levels", [(1, 0), (2, 1), (3, 1), (4, 2), (9, 2), (10, 3), (2187, 7), (2188, 8)])
def test_levels(n, levels):
    assert merkle.levels_above(n) == levels


def odd_rows():
    rows = [(i, f"s{i % 4}", "en", 3, f"a\n{i}") for i in range(60)]
    rows += [(100 + i, "lone" if i == 0 else None, None, None, None) for i in range(3)]
    rows += [(None, "s1", "", 0, ""), (None, "s1", None, None, "\n\n"), (7, "s3", "en", 3, "again\n")]
    rows += [(5, "ä", "de", 2, "x\n" * 600_000), (6, "", "de", 2, "Ω\nß"), (8, "\U0001f600", "x", 1, "é"), (9, "￮", "x", 1, "é")]
    return rows + [(11, "s3", "en", 3, "same\n")] * 40


@pytest.mark.parametrize("levels", [1, 7])
def test_against_hand_folding(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "SPAN", 3**levels)
    rows = odd_rows()
    wide = SCHEMA + ", tree int, pos string, block int, level int, at string, salt int, digest string, shown int"
    spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4, "z", 5) for r in rows], wide).write.parquet(
        str(tmp_path / "documents.parquet")
    )
    found = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(by_hand(rows), key=repr)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, tmp_path, n):
    rows = [(i, None, "en", 1, "a\nb") for i in range(n)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()]
    assert sorted(found) == sorted(by_hand(rows) if rows else [])


def test_manifest_holds_the_states(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, str(i)) for i in range(11)], SCHEMA)
    made = merkle.build(docs, merkle.leaf_digest(F.col("text")))
    nodes = made.nodes().orderBy("level", "pos").collect()
    assert [(r["level"], r["pos"], len(r["states"]) // 32) for r in nodes] == [
        (1, 0, 3), (1, 1, 3), (1, 2, 3), (1, 3, 2), (2, 0, 3), (2, 1, 1), (3, 0, 2)
    ]
    assert made.root == nodes[-1]["digest"]
