"""Clips out of transcript segments.

A segment table has ``video, ord, start, end, text``; ``ord`` counts from 0 in a video.  Rules that look
back a fixed way are windows; greedy ones, whose next boundary hangs on the last one kept, are folds over
a video's ordered segments (JVM-side, one array a video).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.text import ends_sentence

CLIP = "struct<start:double,end:double,n:bigint,reason:string>"


def in_video() -> WindowSpec:
    return Window.partitionBy("video").orderBy("ord")


def numbered(clips: DataFrame) -> DataFrame:
    """``clip_idx`` from 0 by start in each video."""
    return clips.withColumn("clip_idx", (F.row_number().over(Window.partitionBy("video").orderBy("start", "end")) - 1).cast("int"))


def by_gap(segments: DataFrame, gap: float, min_len: float = 0.0) -> DataFrame:
    """Sessions closed by silences of at least ``gap``; shorter ones than ``min_len`` fall out."""
    silent = F.col("start") - F.lag("end").over(in_video()) >= gap
    session = F.sum(F.when(silent, 1).otherwise(0)).over(in_video())
    clips = segments.withColumn("session", session).groupBy("video", "session").agg(F.min("start").alias("start"), F.max_by("end", "ord").alias("end"), F.count("*").alias("n"))
    return numbered(clips.where(F.col("end") - F.col("start") >= min_len).drop("session"))


def _folded(segments: DataFrame, *extra: str) -> DataFrame:
    """One row a video with its segments in order; a video's transcript is bounded by its length."""
    own = F.struct("ord", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), "text", *extra)
    return segments.groupBy("video").agg(F.array_sort(F.collect_list(own)).alias("segs"))


def _clip(start: Column, end: Column, n: Column, reason: str | Column) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.array(F.struct(start.alias("start"), end.alias("end"), n.cast("long").alias("n"), reason.alias("reason")))


def _emit(videos: DataFrame, clips: Column) -> DataFrame:
    return numbered(videos.select("video", F.inline(clips)))


def capped(segments: DataFrame, min_len: float = 30.0, max_len: float = 240.0, gap: float = 3.0) -> DataFrame:
    """Clips that begin at a sentence start and end at a silence or before a segment that starts too late.

    A sentence start is a video's first segment, one after a sentence end, or one whose text begins with a
    capital.  Segments that can't begin a clip are passed over.
    """
    none = F.array().cast(f"array<{CLIP}>")
    zero = F.struct(F.lit(None).cast("double").alias("from"), F.lit(0.0).alias("to"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("ended"), none.alias("clips"))

    def closed(s: Column) -> Column:
        return F.when(s["from"].isNotNull() & (s["to"] - s["from"] >= min_len), F.concat(s["clips"], _clip(s["from"], s["to"], s["n"], "closed"))).otherwise(s["clips"])

    def step(s: Column, e: Column) -> Column:
        goes_on = s["from"].isNotNull() & (e["start"] - s["from"] <= max_len) & (e["start"] - s["to"] < gap)
        begins = s["ended"] | F.coalesce(e["text"].rlike(r"^\p{Lu}"), F.lit(False))
        start = F.when(goes_on, s["from"]).when(begins, e["start"])
        n = F.when(goes_on, s["n"] + 1).otherwise(F.lit(1).cast("long"))
        ended = F.coalesce(ends_sentence(e["text"]), F.lit(False))
        return F.struct(start.alias("from"), e["end"].alias("to"), n.alias("n"), ended.alias("ended"), F.when(goes_on, s["clips"]).otherwise(closed(s)).alias("clips"))

    return _emit(_folded(segments), F.aggregate("segs", zero, step, closed))


def nearest_cuts(segments: DataFrame, changes: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """``(video, ord)`` of the sentence end closest to each change time, within the tolerance; the earliest wins ties.

    An equi-join on video and time bucket, so a long video spreads over tasks; a change looks into the
    buckets that its tolerance reaches.
    """
    width = max(float(tolerance), 1e-3)
    bucket = lambda x: F.floor(x / F.lit(width)).cast("long")
    ends = segments.where(ends_sentence(F.col("text"))).select("video", "ord", "end", bucket(F.col("end")).alias("b"))
    at = changes.select("video", F.col("time").alias("at")).distinct()
    asked = at.withColumn("b", F.explode(F.sequence(bucket(F.col("at") - tolerance), bucket(F.col("at") + tolerance))))
    near = asked.join(ends, ["video", "b"]).withColumn("off", F.abs(F.col("end") - F.col("at"))).where(F.col("off") <= tolerance)
    return near.groupBy("video", "at").agg(F.min_by("ord", F.struct("off", "ord")).alias("ord")).select("video", "ord").distinct()


def merged(segments: DataFrame, cuts: DataFrame, min_len: float = 30.0, max_len: float = 300.0) -> DataFrame:
    """Greedy clips over inclusive cuts: a span that is too short goes on into the next one.

    Spans above ``max_len`` are split at the last sentence end before the limit; remainders below
    ``min_len`` fall out.
    """
    marked = segments.join(cuts.select("video", "ord").distinct().withColumn("cut", F.lit(True)), ["video", "ord"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    none = F.array().cast(f"array<{CLIP}>")
    zero = F.struct(F.lit(None).cast("double").alias("from"), F.lit(0.0).alias("to"), F.lit(0).cast("long").alias("n"), none.alias("clips"))

    def step(s: Column, e: Column) -> Column:
        start, n = F.coalesce(s["from"], e["start"]), s["n"] + 1
        cut = e["cut"] & (e["end"] - start >= min_len)
        clips = F.when(cut, F.concat(s["clips"], _clip(start, e["end"], n, "scene_change"))).otherwise(s["clips"])
        return F.struct(F.when(~cut, start).alias("from"), e["end"].alias("to"), F.when(cut, 0).otherwise(n).cast("long").alias("n"), clips.alias("clips"))

    def last(s: Column) -> Column:
        tail = s["from"].isNotNull() & (s["to"] - s["from"] >= min_len)
        return F.when(tail, F.concat(s["clips"], _clip(s["from"], s["to"], s["n"], "end_of_video"))).otherwise(s["clips"])

    videos = _folded(marked, "cut").withColumn("clips", F.aggregate("segs", zero, step, last))
    split = F.flatten(F.transform("clips", lambda c: F.when(c["end"] - c["start"] <= max_len, F.array(c)).otherwise(_split(F.col("segs"), c, min_len, max_len))))
    return _emit(videos, split)


def _split(segs: Column, clip: Column, min_len: float, max_len: float) -> Column:
    own = F.filter(segs, lambda s: (s["start"] >= clip["start"]) & (s["end"] <= clip["end"]))
    none = F.array().cast(f"array<{CLIP}>")
    # i: this segment's number; first: where the part begins; back: its last sentence end after that
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("first"), F.lit(None).cast("int").alias("back"), none.alias("clips"), own.alias("own"))

    def step(s: Column, e: Column) -> Column:
        start = s["own"][s["first"]]["start"]
        cut = (e["end"] - start >= max_len) & s["back"].isNotNull()
        clips = F.when(cut, F.concat(s["clips"], _clip(start, s["own"][s["back"]]["end"], s["back"] - s["first"] + 1, "max_clip_split"))).otherwise(s["clips"])
        first = F.when(cut, s["back"] + 1).otherwise(s["first"])
        back = F.when(F.coalesce(ends_sentence(e["text"]), F.lit(False)) & (s["i"] > first), s["i"]).when(~cut, s["back"])
        return F.struct((s["i"] + 1).alias("i"), first.alias("first"), back.alias("back"), clips.alias("clips"), s["own"].alias("own"))

    def last(s: Column) -> Column:
        start, end = F.get(s["own"], s["first"])["start"], F.try_element_at(s["own"], F.lit(-1))["end"]
        rest = F.coalesce(end - start >= min_len, F.lit(False))
        return F.when(rest, F.concat(s["clips"], _clip(start, end, F.size(s["own"]) - s["first"], "max_clip_remainder"))).otherwise(s["clips"])

    return F.aggregate(own, zero, step, last)


def by_cuts(segments: DataFrame, cuts: DataFrame, last_topic: str = "", min_len: float = 30.0) -> DataFrame:
    """Clips between exclusive cuts ``(video, ord, topic, additional)``; spans that are too short fall out.

    A clip's topic is that of the cut that ends it; an additional cut's topic stands over a final one's.
    A video without cuts is one clip, however short.
    """
    inside = cuts.join(segments.select("video", "ord"), ["video", "ord"], "left_semi")
    one = inside.groupBy("video", "ord").agg(F.max_by("topic", "additional").alias("topic"))
    marked = segments.join(one.withColumn("cut", F.lit(True)), ["video", "ord"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    part = F.sum(F.when(F.col("cut") & (F.col("ord") > 0), 1).otherwise(0)).over(in_video())
    spans = marked.withColumn("part", part).groupBy("video", "part").agg(F.min_by("start", "ord").alias("start"), F.max_by("end", "ord").alias("end"), F.count("*").alias("n"), F.min_by("topic", "ord").alias("own_topic"), F.max("cut").alias("any_cut"))
    whole, following = Window.partitionBy("video"), Window.partitionBy("video").orderBy("part")
    later = F.lead("part").over(following).isNotNull()
    topic = F.when(later, F.coalesce(F.lead("own_topic").over(following), F.lit(""))).otherwise(F.lit(last_topic))
    spans = spans.withColumns({"has": F.max("any_cut").over(whole), "later": later, "topic": topic})
    kept = spans.where(~F.col("has") | (F.col("end") - F.col("start") >= min_len))
    reason = F.when(~F.col("has"), "no_cuts").when(F.col("later"), "llm_verified").otherwise("end_of_video")
    return numbered(kept.select("video", "start", "end", "n", reason.alias("reason"), F.when(F.col("has"), F.col("topic")).otherwise("full_video").alias("topic")))


def sliced(segments: DataFrame, clips: DataFrame, bucket: float = 600.0) -> DataFrame:
    """Each clip's text: segments whose midpoint lies in it, both ends included (a boundary serves two clips).

    An equi-join on video and time bucket: a clip stands in each bucket that it reaches into, a segment in one.
    """
    of = lambda x: F.floor(x / F.lit(float(bucket))).cast("long")
    said = segments.select("video", "ord", "text", ((F.col("start") + F.col("end")) / 2).alias("middle")).withColumn("b", of(F.col("middle")))
    asked = clips.select("video", "clip_idx", "start", "end").where(F.col("end") >= F.col("start")).withColumn("b", F.explode(F.sequence(of(F.col("start")), of(F.col("end")))))
    met = asked.join(said, ["video", "b"]).where((F.col("middle") >= F.col("start")) & (F.col("middle") <= F.col("end")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), " ")
    return met.groupBy("video", "clip_idx").agg(text.alias("text"), F.count("*").alias("n"))


def contained(segments: DataFrame, clips: DataFrame) -> DataFrame:
    """``(video, clip_idx, ord)`` of the segments that lie wholly in a clip."""
    inside = (F.col("c.video") == F.col("s.video")) & (F.col("s.start") >= F.col("c.start")) & (F.col("s.end") <= F.col("c.end"))
    return clips.alias("c").join(segments.alias("s"), inside).select("c.video", "c.clip_idx", "s.ord")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's correlation of two histograms; null for flat ones."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    top = n * dot(a, b) - total(a) * total(b)
    return F.try_divide(top, F.sqrt(n * dot(a, a) - total(a) * total(a)) * F.sqrt(n * dot(b, b) - total(b) * total(b)))


def lag_similarity(frames: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Similarity to the last readable frame before (``hist`` not null), 1 for the first; unreadable frames fall out."""
    before = F.last("hist", ignorenulls=True).over(in_video().rowsBetween(Window.unboundedPreceding, -1))
    rows = frames.withColumn("before", before).where("hist IS NOT NULL")
    rows = rows.withColumn("similarity", F.when(F.col("before").isNull(), F.lit(1.0)).otherwise(correlation(F.col("before"), F.col("hist"))))
    return rows.withColumn("scene_change", F.coalesce(F.col("similarity") < threshold, F.lit(False))).drop("before", "hist")


def coverage(clips: DataFrame, videos: DataFrame) -> DataFrame:
    """Per cent of each video that its clips cover, to one place."""
    total = clips.groupBy("video").agg(F.sum(F.col("end") - F.col("start")).alias("covered"))
    return videos.join(total, "video", "left").withColumn("coverage_pct", F.coalesce(F.round(F.try_divide(F.col("covered") * 100, F.col("duration")), 1), F.lit(0.0))).drop("covered")
