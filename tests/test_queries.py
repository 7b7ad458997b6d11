"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import hashlib
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalogue

SMALL = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(SMALL))
    columns = sorted(df.columns)
    own = dict(df.dtypes)
    theirs = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {catalogue.SQL[name]}").fetchall()}
    assert {c: TYPES[own[c]] for c in columns} == theirs
    want = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalogue.QUERIES[name](spark, str(SMALL)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_optional_parts(monkeypatch):
    """The training-data operators can be taken away; other missing modules are errors."""

    def gone(module):
        raise ModuleNotFoundError(f"No module named {part!r}", name=part)

    monkeypatch.setattr(__spark_entry__.importlib, "import_module", gone)
    part = "millrace.llm"
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    part = "numpy"
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()


def test_slices_cover_every_segment(spark):
    """Each segment's midpoint is in a clip; the five clips of transcript_slice leave most out."""
    count = lambda name: catalogue.QUERIES[name](spark, str(SMALL)).agg({"n": "sum"}).first()[0]
    assert count("transcript_slice_all") >= spark.read.parquet(f"{SMALL}/events.parquet").count() > count("transcript_slice")


def test_every_vector_is_compared(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert catalogue.QUERIES["lag_similarity_all"](spark, str(SMALL)).count() == vectors > catalogue.QUERIES["lag_similarity"](spark, str(SMALL)).count()


def test_roundtrip_keeps_texts(spark, tmp_path):
    texts = ["plain", 'say "hi", ok', "two\nlines", "back\\slash \\\" end\\", "", None, "  spaces  ", "tab\t", "ünï"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["sink"], r["doc_id"], r["digest"]) for r in catalogue.QUERIES["roundtrip"](spark, str(tmp_path)).collect()}
    assert got == {(sink, i, hashlib.md5((t or "").encode()).hexdigest()) for sink in ("lines", "csv") for i, t in enumerate(texts)}
