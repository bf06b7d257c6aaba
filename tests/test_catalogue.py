import importlib
import sys

import pytest

from tests.conftest import DATA
from tests.oracle import assert_same, connect
from quillspan.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLE:
        assert_same(got, connect(DATA).execute(catalogue.ORACLE[name]).df())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_the_optional_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.reload(importlib.import_module("__spark_entry__"))
    assert set(entry.queries()) == set(catalogue.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
