"""The driver's contract, with and without the corpus parts."""

import importlib

import pytest

import __spark_entry__ as entry_point


def test_entry_has_rows(spark):
    assert entry_point.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def _missing(monkeypatch, name):
    whole = importlib.import_module

    def load(module, *rest):
        if module in ("paddock.llm.queries", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return whole(module, *rest)

    monkeypatch.setattr(importlib, "import_module", load)


def test_corpus_parts_may_be_left_out(monkeypatch):
    _missing(monkeypatch, "paddock.llm")
    names = set(entry_point.queries())
    assert "resolve_sightings" in names and not [n for n in names if n.startswith("op") and n[2].isdigit()] and "pipeline" not in names


def test_other_missing_modules_are_errors(monkeypatch):
    _missing(monkeypatch, "numpy")
    with pytest.raises(ModuleNotFoundError):
        entry_point.queries()
