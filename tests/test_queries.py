"""Every listing query against its DuckDB twin."""

import pytest
from gleaner.plans import QUERIES
from oracle import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    query, sql = QUERIES[name]
    if sql:
        assert compare(spark, con, query, sql, sf_dir) is None
    else:
        assert query(spark, sf_dir).count() > 0


def test_entry_imports_without_the_optional_folders(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(entry.queries())
    assert "pipeline" not in entry.queries()
    sys.modules.pop("__spark_entry__", None)
