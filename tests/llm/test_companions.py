"""Columns that no model decides against SQL."""

from collections import Counter
from pathlib import Path

import pytest

from weft.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, FOLDER)
    out = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(got.columns)
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(r[names.index(c)] for c in got.columns) for r in out.fetchall())
