"""Registered queries over made-up projects against their SQL."""

from collections import Counter
from pathlib import Path

import pytest

from weft.plans import project_queries, queries  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
NAMES = [n for n, f in queries.QUERIES.items() if f.__module__ == project_queries.__name__] + ["module_names", "module_resolve"]


def by_sql(sql, columns):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(names) == sorted(columns)
    return Counter(tuple(r[names.index(c)] for c in columns) for r in out.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, FOLDER)
    rows = Counter(tuple(r) for r in got.collect())
    assert rows == by_sql(queries.SQL[name], got.columns)
    assert rows or name == "connection_path"  # there each nation has one supplier at most


def test_explain_file_takes_keys_of_any_length(spark, tmp_path):
    """Keys of one to sixteen digits and below zero keep their value and their order."""
    rows = [(k, 0) for k in (-20, -3, 5, 40, 7 * 10**12, 7 * 10**12 + 1, 10**13, 2 * 10**15)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.sql("SELECT id AS o_orderkey, timestamp'1998-01-01' AS o_orderdate FROM range(9)").write.parquet(f"{tmp_path}/orders.parquet")
    items = [(o, s) for o in range(9) for s, _ in rows if o == 0 or (o + s) % 3]
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    views = {f: f"{tmp_path}/{f}.parquet/*.parquet" for f in ("supplier", "orders", "lineitem")}
    got = queries.QUERIES["explain_file"](spark, str(tmp_path))
    con = pytest.importorskip("duckdb").connect()
    for f, at in views.items():
        con.execute(f"CREATE VIEW {f} AS SELECT * FROM '{at}'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['explain_file']})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want
