"""How the tests read results."""

from __future__ import annotations


def one(df) -> dict:
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def unordered(df) -> list[tuple]:
    return sorted(rows(df), key=repr)
