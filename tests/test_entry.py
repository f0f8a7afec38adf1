import importlib
import sys

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("touchline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "touchline.llm", None)
    again = importlib.reload(e)
    assert "absence_coefficient" in again.queries() and not any(q.startswith("op") for q in again.queries())
