"""Every query with equivalent SQL gives what DuckDB gives on the same tables."""

import importlib
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{file}')")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)]

    def cell(value):
        if value is None or (not isinstance(value, (list, dict, bool)) and pd.isna(value)):
            return ""
        return f"{value:.9g}" if isinstance(value, float) else str(value)

    return list(frame.columns), sorted(tuple(map(cell, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, tables, name):
    assert canonical(entry.queries()[name](spark, sf).toPandas()) == canonical(tables.execute(entry.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_gives_rows(spark, sf, name):
    found = entry.queries()[name](spark, sf)
    assert len(set(found.columns)) == len(found.columns) and found.limit(1).count() == 1


def test_every_query_gives_the_sql_columns_only():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_broken_llm_is_an_error(monkeypatch):
    def broken(name, *rest):
        if name.startswith("vulnlake.llm"):
            raise ModuleNotFoundError(name="tiktoken")
        return importlib.import_module(name, *rest)

    monkeypatch.setattr(entry, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()


def test_entry(spark):
    assert entry.entry(spark).columns == ["source_code", "source_key", "snapshot_id", "change_kind"]


def test_llm_is_optional(monkeypatch):
    real = importlib.import_module

    def without(name, *rest):
        if name.startswith("vulnlake.llm"):
            raise ModuleNotFoundError(name=name)
        return real(name, *rest)

    monkeypatch.setattr(entry, "import_module", without)
    assert not any(n.startswith(("p5_", "p6_", "p7_", "p8_")) for n in entry.queries())
