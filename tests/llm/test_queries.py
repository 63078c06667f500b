"""Corpus queries with SQL give DuckDB's rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([str(r[c]) for c in columns] for r in df.collect())
    found = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted([str(r[names.index(c)]) for c in columns] for r in found.fetchall())
