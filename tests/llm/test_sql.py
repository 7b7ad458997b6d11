"""Queries of training-data operators that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from millrace.llm import registry

SMALL = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_is_its_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(SMALL))
    columns, own = sorted(df.columns), dict(df.dtypes)
    assert {c: TYPES[own[c]] for c in columns} == {r[0]: r[1] for r in duck.execute(f"DESCRIBE {registry.SQL[name]}").fetchall()}
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({registry.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
