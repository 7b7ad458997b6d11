"""Test tables as tables of the domain.  Where a column has no natural meaning the query checks semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transcript segments: a user is a video, a minute a second; every third text ends a sentence."""
    e = table(spark, sf_dir, "events")
    start = F.floor(seconds(F.col("ts")) / 60).cast("double")
    rows = e.select(F.col("user_id").alias("video"), "event_id", start.alias("start"), (start + F.floor("value") % 7).alias("end"), F.concat("event_type", F.when(F.col("event_id") % 3 == 0, ".").otherwise("")).alias("text"))
    order = Window.partitionBy("video").orderBy("start", "event_id")
    return rows.withColumn("ord", F.row_number().over(order) - 1)


SEGMENTS_SQL = """seg AS (
  SELECT user_id AS video, event_id, st AS start, st + floor(value) % 7 AS "end", event_type || CASE WHEN event_id % 3 = 0 THEN '.' ELSE '' END AS text,
         row_number() OVER (PARTITION BY user_id ORDER BY st, event_id) - 1 AS ord
  FROM (SELECT *, floor(floor(epoch(ts)) / 60)::DOUBLE AS st FROM events))"""


def qa_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as question-answer rows of an order's video; a line's status says its kind."""
    li = table(spark, sf_dir, "lineitem")
    number = F.row_number().over(Window.partitionBy("l_orderkey", "l_linestatus").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    quantity = F.col("l_quantity")
    return li.select(
        F.concat(F.lit("v"), F.col("l_orderkey")).alias("video"), F.col("l_linenumber").alias("clip_idx"), F.col("l_returnflag").alias("type"), F.col("l_linestatus").alias("status"),
        F.concat(F.lit("q"), F.col("l_partkey")).alias("question"), F.concat(F.lit("a"), F.col("l_suppkey")).alias("answer"),
        F.when(F.col("l_linenumber") % 2 == 1, F.lit(5.0)).alias("clip_start"), F.when(F.col("l_linenumber") % 3 != 0, F.lit(90.0)).alias("clip_end"),
        quantity.alias("query_time"), (quantity + 5 + F.col("l_linenumber")).alias("answer_time"), number.alias("ord"),
    )


QA_SQL = """qa AS (
  SELECT 'v' || l_orderkey AS video, l_linenumber AS clip_idx, l_returnflag AS type, l_linestatus AS status, 'q' || l_partkey AS question, 'a' || l_suppkey AS answer,
         CASE WHEN l_linenumber % 2 = 1 THEN 5.0::DOUBLE END AS clip_start, CASE WHEN l_linenumber % 3 <> 0 THEN 90.0::DOUBLE END AS clip_end,
         l_quantity AS query_time, l_quantity + 5 + l_linenumber AS answer_time,
         row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord
  FROM lineitem),
clips AS (SELECT 'v' || o_orderkey AS video, k AS clip_idx, k * 10.0::DOUBLE AS start, k * 10.0::DOUBLE + 30 AS "end" FROM orders, generate_series(1, 5) t(k))"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five clips an order."""
    o = table(spark, sf_dir, "orders")
    k = F.col("clip_idx")
    rows = o.select(F.concat(F.lit("v"), F.col("o_orderkey")).alias("video"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("clip_idx"))
    return rows.select("video", "clip_idx", (k * F.lit(10.0)).alias("start"), (k * F.lit(10.0) + 30).alias("end"), k.alias("ord"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as predictions: marks and wait phrases stand where the turn and the length say."""
    from ..functions import labels

    c = table(spark, sf_dir, "conversations")
    n = F.length("text")
    target = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<WAIT> "), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<ANSWER> "), "text")).otherwise(F.col("text"))
    said = (
        F.when(n % 7 == 0, F.concat(F.lit("< wait > "), "text")).when(n % 7 == 1, F.concat(F.lit("<Answer> not enough information "), "text")).when(n % 7 == 2, F.concat(F.col("text"), F.lit(" I Need more context")))
        .when(n % 7 == 3, F.lit("  ")).when(n % 7 == 4, F.lit("ok yes")).otherwise(F.col("text"))
    )
    rows = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("role").alias("sample_type"), F.when(n % 5 > 0, (n % 5).cast("string")).alias("qa_type"), target.alias("target"), said.alias("prediction"))
    rows = rows.withColumns({"gt_label": labels.truth(F.col("target")), "pred_label": labels.predicted(F.col("prediction"))})
    return rows.withColumn("correct_answerability", F.col("gt_label") == F.col("pred_label"))


PREDICTIONS_SQL = r"""p0 AS (
  SELECT conv_id * 1000 + turn AS idx, role AS sample_type, CASE WHEN length(text) % 5 > 0 THEN (length(text) % 5)::VARCHAR END AS qa_type,
         CASE turn % 3 WHEN 0 THEN '<WAIT> ' || text WHEN 1 THEN '<ANSWER> ' || text ELSE text END AS target,
         CASE length(text) % 7 WHEN 0 THEN '< wait > ' || text WHEN 1 THEN '<Answer> not enough information ' || text WHEN 2 THEN text || ' I Need more context'
              WHEN 3 THEN '  ' WHEN 4 THEN 'ok yes' ELSE text END AS prediction
  FROM conversations),
p1 AS (
  SELECT *, CASE WHEN starts_with(upper(trim(target, ' ' || chr(9) || chr(10) || chr(13))), '<WAIT>') THEN 'WAIT' ELSE 'ANSWER' END AS gt_label,
    CASE WHEN regexp_full_match(prediction, '\s*') THEN 'OTHER'
         WHEN regexp_matches(prediction, '(?i)^\s*<\s*wait\s*>') THEN 'WAIT'
         WHEN regexp_matches(prediction, '(?i)^\s*<\s*answer\s*>') THEN 'ANSWER'
         WHEN regexp_matches(lower(prediction), 'not enough information|need more information|need more context|cannot answer yet|can''t answer yet|more video is needed|more context is needed') THEN 'WAIT'
         WHEN len(regexp_extract_all(prediction, '\S+')) >= 3 THEN 'ANSWER' ELSE 'OTHER' END AS pred_label
  FROM p0),
p AS (SELECT *, gt_label = pred_label AS correct_answerability FROM p1)"""
