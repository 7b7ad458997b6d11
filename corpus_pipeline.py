"""A training corpus from ``documents``: five stages, each on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import encoding, mixing, near_dup_wide, packing, pii, toxicity
from millrace.llm.common import drop_path, dropped_scratch, held_out, read_table, scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from the labelled rows outside the held-out fold.

    Null and empty texts get the bias alone; without labels nothing goes.  Equal rows stay or go together.
    """
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 5, 0))
    return toxicity.keep_clean(docs.select(*COLUMNS), toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4/5 of their five-word shingles): the one with the smallest id.

    Null, empty and blank texts are copies of each other; of equal rows one stays; a row without id stays only
    where its group has no id.
    """
    return near_dup_wide.keep_one(docs.select(*COLUMNS))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates for personal data; ``n_chars`` follows, null for a null text.  All rows stay, repeated ones too."""
    return pii.replace_pii(docs.select(*COLUMNS)).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights, at most three epochs each.

    A null source is one of its own; texts without words are repeated with their source.  Reruns agree.
    """
    return mixing.repeated(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences and offsets; a null or empty text is one piece of the end id."""
    return packing.pack(docs, encoding.public_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("pii", replace_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    What a stage and its operator wrote on the way is removed once the next stage's input is written.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with dropped_scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


#: Tokenizers, fingerprints and learned scores are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
