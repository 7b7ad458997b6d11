"""Visual quality: frame features to video scores and decisions, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Frame types and decisions as the frame model names them.
IMAGE_TYPES, LECTURE_TYPES = ("超声画面", "医学影像"), ("讲课画面", "PPT幻灯片")
KEEP, TRIM, DISCARD, FAILED, NO_MODALITY = "保留", "需要裁剪", "丢弃", "错误", "无"


def video_means(frames: DataFrame) -> DataFrame:
    """Means of the frame features of each video (to 4 places) and its faces."""
    mean = lambda c: F.round(F.avg(c), 4)
    names = ("grayscale", "color", "text", "bright")
    return frames.groupBy("video").agg(F.count("*").alias("frames"), F.count_if("face").alias("faces"), *[mean(c).alias(c) for c in names])


def purity(gray: Column, color: Column, faces: Column, frames: Column, text: Column, bright: Column) -> Column:
    """100 less five penalties, each with its own threshold and cap, between 0 and 100."""
    penalties = (
        F.when(color > 0.15, F.least(F.lit(30.0), color * 100)),
        F.when(gray < 0.7, (F.lit(0.7) - gray) * 60),
        F.when(faces > 0, faces / F.greatest(frames, F.lit(1)) * 40),
        F.when(text > 0.02, F.least(F.lit(25.0), text * 500)),
        F.when(bright > 0.1, F.least(F.lit(35.0), bright * 100)),
    )
    score = F.lit(100.0)
    for p in penalties:
        score = score - F.coalesce(p, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def purity_class(score: Column) -> Column:
    return F.when(score >= 75, "pure").when(score >= 55, "mildly_annotated").when(score >= 35, "heavily_annotated").otherwise("rejected")


def decisions(frames: DataFrame) -> DataFrame:
    """A decision a video from its frames' ``type, modality, anatomy`` in order ``ord``.

    Shares of image and lecture frames decide.  The modality is the most frequent one, the smallest of
    equals; anatomy lists distinct parts as first seen.
    """
    named = F.coalesce("type", F.lit("其他"))
    real = F.when((F.coalesce("anatomy", F.lit("")) != "") & (F.col("anatomy") != "null"), F.col("anatomy"))
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(real.isNotNull(), F.struct("ord", real.alias("a"))))), lambda x: x["a"]))
    modality = F.mode(F.when(F.coalesce("modality", F.lit(NO_MODALITY)) != NO_MODALITY, F.col("modality")), deterministic=True)
    rows = frames.groupBy("video").agg(F.count("*").alias("n"), F.count_if(named.isin(*IMAGE_TYPES)).alias("images"), F.count_if(named.isin(*LECTURE_TYPES)).alias("lectures"), parts.alias("anatomy"), F.coalesce(modality, F.lit(NO_MODALITY)).alias("modality"))
    r, lecture = F.col("images") / F.col("n"), F.col("lectures") / F.col("n")
    decision = F.when(r >= 0.4, F.when(r >= 0.7, KEEP).otherwise(TRIM)).otherwise(DISCARD)
    quality = F.when(r >= 0.7, 70 + r * 30).when(r >= 0.4, 40 + r * 40).when(lecture >= 0.6, 20 + (1 - lecture) * 30).otherwise(30.0)
    return rows.withColumns({"decision": decision, "quality": quality.cast("int")})


def timed_out(frames: DataFrame, least: int = 3) -> DataFrame:
    """Decisions of videos whose analysis broke off: only with enough partial frames."""
    return decisions(frames).where(F.col("n") >= least)


def pivoted(rows: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts by two keys, one column a value, 0 where there are none."""
    return rows.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Equal bins over [low, high]; the highest value belongs to the last one."""
    b = F.least(F.floor((F.col(value) - low) * bins / F.lit(high - low)), F.lit(bins - 1)).cast("int")
    return rows.where((F.col(value) >= low) & (F.col(value) <= high)).groupBy(b.alias("bin")).count()


def merged_maps(rows: DataFrame, maps: str) -> DataFrame:
    """Counts of all maps by key, and each key's share of the whole."""
    total = rows.select(F.explode(maps).alias("key", "n")).groupBy("key").agg(F.sum("n").alias("n"))
    return total.crossJoin(F.broadcast(total.agg(F.sum("n").alias("whole")))).withColumn("share", F.col("n").cast("double") / F.col("whole")).drop("whole")


def frequencies(rows: DataFrame, array: str) -> DataFrame:
    """How often each element stands in the arrays, repeats included."""
    return rows.select(F.explode(array).alias("key")).groupBy("key").count()


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def latest(rows: DataFrame, *keys: str, running: Column, at: tuple[str, ...]) -> DataFrame:
    """The latest row of each group, a running one before all others."""
    w = Window.partitionBy(*keys).orderBy(running.desc(), *[F.col(c).desc() for c in at])
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def ring(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], size: int = 600) -> DataFrame:
    """The last ``size`` rows of each group."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= size).drop("_k")


def throughput(rows: DataFrame, duration: str, took: str, *keys: str) -> DataFrame:
    """Total seconds handled and taken, and their ratio, over all rows or by ``keys``."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(duration).alias("seconds"), F.sum(took).alias("took"))
    return out.withColumn("realtime_factor", F.try_divide(F.col("seconds").cast("double"), F.col("took")))


def at_least(videos: DataFrame, least: float, score: str = "score") -> DataFrame:
    """The videos that are good enough."""
    return videos.where(F.col(score) >= least)


def chosen(videos: DataFrame, *decided: str, decision: str = "decision") -> DataFrame:
    """The videos with one of the decisions."""
    return videos.where(F.col(decision).isin(*decided))


def decision_counts(videos: DataFrame, decision: str = "decision") -> DataFrame:
    """One row: all videos, and how many were kept, trimmed, discarded and failed."""
    of = lambda d, name: F.count_if(F.coalesce(F.col(decision) == d, F.lit(False))).alias(name)
    return videos.agg(F.count("*").alias("total"), of(KEEP, "keep"), of(TRIM, "trim"), of(DISCARD, "discard"), of(FAILED, "errors"))
