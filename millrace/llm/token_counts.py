"""Token counts through a digest cache.

Content digest and tokenizer digest key stored counts.  Texts are grouped by digest (copies meet before
the shuffle), joined to the cache, and only distinct misses are encoded and appended to it.  The rows of
the documents themselves travel without their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import arrow_batch, materialize, read_table, require, scratch_path

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def _counts(path: str):
    def run(batches):
        each = encoding.load(path).each
        for batch in batches:
            n = [len(ids) for ids in each(batch.column("text").to_pylist())]
            yield arrow_batch("digest binary, n_tokens long", [batch.column("digest"), n])

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    ``cache_path`` names a Parquet table in a shared folder that lives across runs; None makes a fresh
    one.  Normalised content is the text with null as empty: whatever else changed it would change counts.

    Null text counts as empty: 0 bytes, 0 tokens.  Null ids and repeated rows stay, one result a row.
    Whole texts are encoded, however long.  An empty table gives no rows.  Other columns are ignored,
    whatever their names.  A job that dies before its append leaves the cache as it was; its misses are
    encoded again.  Two jobs that append the same digest do no harm: reading takes one of equal counts.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    version = encoding.file_digest(tokenizer_path)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    distinct = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    known = read_cache(spark, cache_path, version)
    misses = distinct if known is None else distinct.join(known, "digest", "left_anti")
    fresh = misses.mapInArrow(_counts(tokenizer_path), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    # one row a digest as a table, so that the join below can split the partition of a frequent text
    stored = materialize(read_cache(spark, cache_path, version), "stored-counts")
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    """The stored counts of one tokenizer version, one row a digest; None where there is no cache yet."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), encoding.public_path("byte_bpe_50k.json"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
