"""The entry module works with and without the optional corpus part."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from crosstally.workload.oracle import ORACLE
from crosstally.workload.queries import QUERIES


@pytest.mark.parametrize("absent", entry.OPTIONAL)
def test_without_the_corpus_part(monkeypatch, absent):
    for name in [n for n in sys.modules if n.startswith("crosstally.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    assert entry.queries() == QUERIES and entry.oracle_sql() == ORACLE


def test_other_import_errors_are_errors(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("crosstally.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "crosstally.functions.types", None)
    try:
        import importlib.util

        present = importlib.util.find_spec("crosstally.llm.queries")
    except ModuleNotFoundError:
        present = None
    if present:
        with pytest.raises(ImportError):
            entry.queries()


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
