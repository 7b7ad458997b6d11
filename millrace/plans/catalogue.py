"""Queries of the curation operators over the test tables, and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..sources import files, ports
from ..sources.tables import table
from . import coverage, lifecycle, queries, segmentation

MODULES = (queries, segmentation, lifecycle, coverage)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}


def model_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the model port, and the labels of its answers."""
    said = ports.ask(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", lambda: ports.stub)
    return said.select("doc_id", labels.predicted(F.col("response")).alias("label"), "response")


QUERIES["model_stub"] = model_stub
SQL["model_stub"] = """SELECT doc_id, CASE WHEN length(text) > 500 THEN 'ANSWER' ELSE 'WAIT' END AS label,
  CASE WHEN length(text) > 500 THEN '<ANSWER> ' || length(text) || ' signs' ELSE '<WAIT> more context is needed' END AS response FROM documents"""


def roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as JSON lines and as CSV and read again: the digests of their texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    root = files.scratch(spark, "roundtrip")
    files.write_lines(docs, f"{root}/lines")
    files.write_csv(docs, f"{root}/csv")
    lines = files.json_lines(spark, f"{root}/lines", docs.schema)
    csv = spark.read.schema(docs.schema).options(header=True, multiLine=True, escape='"', emptyValue="", enforceSchema=True).csv(f"{root}/csv")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    return lines.select(F.lit("lines").alias("sink"), "doc_id", digest).unionByName(csv.select(F.lit("csv").alias("sink"), "doc_id", digest))


QUERIES["roundtrip"] = roundtrip
SQL["roundtrip"] = "SELECT sink, doc_id, md5(coalesce(text, '')) AS digest FROM documents, (VALUES ('lines'), ('csv')) s(sink)"
