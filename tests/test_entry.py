import importlib
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_imports_without_the_other_folders(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("sedimenta.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sedimenta.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    try:
        assert "chunk_dedupe" in alone.queries() and not any(n.startswith("op") for n in alone.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.catalog.QUERIES) - set(entry.catalog.ORACLES)))
def test_query_without_sql(spark, name):
    """These hold by themselves: every flag of a round trip, sizes of their columns, and what test_engine.py compares."""
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    flags = [c for c, t in df.dtypes if t == "boolean" and c not in ("is_container",)]
    assert rows and all(r[c] for r in rows for c in flags)


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in frame.values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert _rows(entry.queries()[name](spark, SF).toPandas()) == _rows(duck.sql(entry.oracle_sql()[name]).df())
