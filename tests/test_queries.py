import importlib
import sys

import pytest
from conftest import run_oracles

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
MODULES = [importlib.import_module(m) for m in entry.CORE]


@pytest.mark.parametrize("module", MODULES, ids=lambda m: m.__name__.rsplit(".", 1)[1])
def test_queries_equal_their_sql(spark, module):
    assert run_oracles(spark, SMALL, module.QUERIES, module.ORACLES) == []


def test_no_query_proves_itself_by_an_empty_result():
    """Every SQL has rows over the small tables that the driver compares."""
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob("/root/testdata/sf0.01/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert [name for m in MODULES for name, sql in m.ORACLES.items() if not con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0]] == []


@pytest.mark.parametrize("name", ["similar_entities", "entry_duplicates", "card_duplicates", "document_entities", "graph_communities", "graph_betweenness", "graph_modularity"])
def test_queries_without_sql_have_rows(spark, name):
    assert entry.queries()[name](spark, SMALL).count() > 0


def test_entry(spark, monkeypatch):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["origin", "record_id", "utc_second"]
    # the core stands without the subpackage, but a fault inside it is not taken for its absence
    real = importlib.import_module

    def absent(name, *a):
        if name.startswith("kinweave.llm"):
            raise ModuleNotFoundError(name, name="kinweave.llm")
        return real(name, *a)

    monkeypatch.setattr(entry.importlib, "import_module", absent)
    assert {m.__name__ for m in entry._modules()} == set(entry.CORE)
    monkeypatch.setattr(entry.importlib, "import_module", lambda name, *a: sys.modules["no such thing"] if name.startswith("kinweave.llm") else real(name, *a))
    with pytest.raises(KeyError):
        entry._modules()
