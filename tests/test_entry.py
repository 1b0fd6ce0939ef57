import builtins
import importlib
import sys

import pytest

import __spark_entry__ as contract
from stepframe.queries import QUERIES


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.columns == ["vid", "exudation"] and df.count() == 150


def test_sql_belongs_to_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("gone", ["stepframe.llm", "corpus_pipeline"])
def test_optional_parts_may_be_absent(monkeypatch, gone):
    real = builtins.__import__

    def missing(name, *args, **kwargs):
        if name.startswith(gone):
            raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)
        return real(name, *args, **kwargs)

    def missing_module(name, *args, **kwargs):
        if name.startswith(gone):
            raise ModuleNotFoundError(f"No module named {gone!r}", name=gone)
        return importlib.__import__(name, *args, **kwargs) and sys.modules[name]

    monkeypatch.setattr(builtins, "__import__", missing)
    monkeypatch.setattr(importlib, "import_module", missing_module)
    for name in [n for n in sys.modules if n.startswith(gone)]:
        monkeypatch.delitem(sys.modules, name)
    assert set(QUERIES) <= set(contract.queries())
    assert "pipeline" not in contract.queries()
