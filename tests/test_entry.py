import importlib
import sys


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_llm(monkeypatch):
    """The registry works when the llm folder is gone."""
    for name in [m for m in sys.modules if m.startswith("fieldloom.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "fieldloom.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "deposit_gas_density" in e.queries() and not any(q.startswith("op") for q in e.queries() if q[2:3].isdigit())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
