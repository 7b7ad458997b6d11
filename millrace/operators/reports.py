"""Reports over runs: counts, shares, comparisons, and writing them as results come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def category_counts(rows: DataFrame, category: str = "category") -> DataFrame:
    """Records, media and thumbnails by category, in key order."""
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return rows.groupBy(category).agg(F.count("*").alias("n"), some("media_file").alias("media"), some("thumbnail_file").alias("thumbnails"), F.count_if(F.coalesce("paired", F.lit(False))).alias("paired")).orderBy(category)


def run_counters(log: DataFrame) -> DataFrame:
    """One row of an event log's outcomes: tried, kept, rejected, failed."""
    of = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return log.agg(F.count("*").alias("attempted"), of("kept"), of("rejected"), of("failed"))


def mode_comparison(runs: DataFrame) -> DataFrame:
    """Calls, time and tokens of each input mode, and how its time compares with the fastest."""
    out = runs.groupBy("mode").agg(F.count("*").alias("calls"), F.sum("seconds").alias("seconds"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"), F.avg("seconds").alias("seconds_a_call"))
    return out.crossJoin(F.broadcast(out.agg(F.min("seconds").alias("_least")))).withColumn("times_fastest", F.try_divide(F.col("seconds"), F.col("_least"))).drop("_least")


def score_counts(videos: DataFrame) -> DataFrame:
    """One row: all videos, and how many are of each class."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in ("pure", "mildly_annotated", "heavily_annotated", "rejected")]
    return videos.agg(F.count("*").alias("n"), *counts)


def score_report(videos: DataFrame) -> DataFrame:
    """All videos by falling score, a row each; written in this order they are the report's list."""
    return videos.orderBy(F.desc("score"), "video")


def as_they_come(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str, once: bool = True):
    """Results to a sink batch by batch; a restart goes on where the last batch ended."""

    def batch(rows: DataFrame, _: int) -> None:
        if not rows.isEmpty():
            write(rows)

    out = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()


def percent(x: Column, places: int = 1) -> Column:
    return F.format_string(f"%.{places}f%%", x.cast("double") * 100)


def merged_words(rows: DataFrame, low: float = 1.0, high: float = 4.0) -> DataFrame:
    """Clips whose speech has between ``low`` and ``high`` words a second."""
    rate = F.try_divide(F.col("n_words").cast("double"), F.col("duration"))
    return rows.withColumn("word_rate", rate).where((F.col("word_rate") >= low) & (F.col("word_rate") <= high))


def loss_band(rows: DataFrame, low: float = 1.5, high: float = 6.5) -> DataFrame:
    """Rows whose language-model loss (an input) lies in the band."""
    return rows.where((F.col("loss") >= low) & (F.col("loss") <= high))


def summary_lines(counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """What a console shows of counts: ``label: n (share)``, most frequent first."""
    whole = counts.agg(F.sum(n).alias("_whole"))
    line = F.concat(F.coalesce(F.col(label).cast("string"), F.lit("none")), F.lit(": "), F.col(n).cast("string"), F.lit(" ("), percent(F.try_divide(F.col(n), F.col("_whole"))), F.lit(")"))
    return counts.crossJoin(F.broadcast(whole)).select(line.alias("line"), F.col(n).alias("n")).orderBy(F.desc("n"), "line")
