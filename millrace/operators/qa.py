"""Anchored question-answer rows: anchors, validation, merging and sample expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.text import strip

# Ratios of anchors, limits in seconds, targets, types.
RATIOS = (0.3, 0.6)
SEEN_SECONDS, MIN_FUTURE_SECONDS, MIN_DELAY_SECONDS, CLIP_END_SLACK = 240.0, 8.0, 5.0, 0.5
WINDOW_SECONDS = 30.0
WAIT_TARGET = "<WAIT> Not enough information yet. More video is needed."
DUAL_WAIT_TARGET = "<WAIT> Not enough information to answer yet. More video is needed."
ANSWER_PREFIX = "<ANSWER> "
STREAMING_TYPES = ("sonographer_intent", "next_action")
REQUIRED = ("question", "answer", "answer_time")


def anchors(clips: DataFrame, ratios: tuple[float, ...] = RATIOS, seen: float | None = SEEN_SECONDS, future: float | None = None) -> DataFrame:
    """A row a clip (``start, end, duration``) and ratio with its seen and future windows; too short futures are marked."""
    at = windows.anchor(F.col("start"), F.col("duration"), F.col("ratio"))
    rows = clips.withColumn("ratio", F.explode(F.array(*map(F.lit, ratios)))).withColumn("query_time", at)
    rows = rows.withColumns({"seen": windows.latter(F.col("start"), F.col("query_time"), seen), "future": windows.earlier(F.col("query_time"), F.col("end"), future)})
    return rows.withColumn("kept", F.col("future.end") - F.col("future.start") >= MIN_FUTURE_SECONDS)


def reject_reason(types: tuple[str, ...] = STREAMING_TYPES, keys: Column | None = None) -> Column:
    """Why a generated row (``entry`` struct of texts, ``skip``, ``query_time``, ``clip_end``) falls out; null if it stays.

    The first rule that fails names the reason.  A time that is NaN is rejected.  ``keys`` tells which keys the row
    had, as a missing one differs from one without a value.
    """
    e = F.col("entry")
    lacks = [F.coalesce(~F.array_contains(keys, k), F.lit(False)) if keys is not None else F.lit(False) for k in REQUIRED]
    missing = F.when(lacks[0], REQUIRED[0]).when(lacks[1], REQUIRED[1]).when(lacks[2], REQUIRED[2])
    blank = lambda x: strip(F.coalesce(x, F.lit(""))) == ""
    at = e["answer_time"].try_cast("double")
    return (
        F.when(e.isNull(), "not a dict")
        .when(F.coalesce(e["skip"], F.lit(False)), "model-skipped")
        .when(~F.coalesce(e["type"].isin(*types), F.lit(False)), "unknown type")
        .when(missing.isNotNull(), F.concat(F.lit("missing key: "), missing))
        .when(blank(e["question"]) | blank(e["answer"]), "empty question or answer")
        .when(at.isNull() | F.isnan(at), "answer_time not a float")
        .when(at <= F.col("query_time"), "not after query")
        .when(at - F.col("query_time") < MIN_DELAY_SECONDS, "too soon after query")
        .when(at > F.col("clip_end") + CLIP_END_SLACK, "beyond clip")
    )


def dual_reject(types: tuple[str, ...], low: Column, high: Column) -> Column:
    """The looser rules of dual rows: type, both times in bounds, order, texts."""
    ask, answer = windows.clamp_time(F.col("question_time"), low, high), windows.clamp_time(F.col("answer_time"), low, high)
    blank = lambda c: strip(F.coalesce(F.col(c), F.lit(""))) == ""
    return F.when(~F.coalesce(F.col("qa_type").isin(*types), F.lit(False)), "type").when(ask.isNull() | answer.isNull(), "time").when(answer < ask, "order").when(blank("question") | blank("answer"), "empty")


def bounded(offline: DataFrame, clips: DataFrame) -> DataFrame:
    """Offline rows with their clip's bounds where either of their own is missing; unknown clips give 0.

    ``clips`` has ``video, clip_idx, start, end, ord``; of a repeated index the last one counts.
    """
    one = clips.groupBy("video", "clip_idx").agg(F.max_by(F.struct("start", "end"), "ord").alias("c"))
    missing = F.col("clip_start").isNull() | F.col("clip_end").isNull()
    side = lambda own, c: F.when(missing, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.col(own))
    return offline.join(one, ["video", "clip_idx"], "left").withColumns({"clip_start": side("clip_start", "c.start"), "clip_end": side("clip_end", "c.end")}).drop("c")


def merged(offline: DataFrame, streaming: DataFrame, clips: DataFrame) -> DataFrame:
    """All rows of a video with a timestamp and their place in its record.

    Offline rows stand at their clip's middle, streaming ones at their query.  The order is by time and
    clip; ties keep offline rows first and each list's own order (``ord``).
    """
    off = bounded(offline, clips).withColumn("timestamp", (F.col("clip_start") + F.col("clip_end")) / 2).withColumn("source", F.lit("offline"))
    on = streaming.withColumn("timestamp", F.coalesce("query_time", "clip_start")).withColumn("source", F.lit("streaming"))
    rows = off.unionByName(on, allowMissingColumns=True)
    place = Window.partitionBy("video").orderBy("timestamp", "clip_idx", "source", "ord")  # offline sorts before streaming
    return rows.withColumn("place", F.row_number().over(place) - 1)


def type_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """A map from type to count for each group of ``keys``."""
    return rows.groupBy(*keys, "type").count().groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "count")))).alias("type_counts"))


def records(rows: DataFrame, clips: DataFrame, videos: DataFrame) -> DataFrame:
    """One nested record a video: clips, ordered rows, counts."""
    qa = rows.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("place", "source", "type", "clip_idx", "timestamp", "question", "answer"))).alias("qa"), F.count("*").alias("num_qa"))
    own = clips.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("ord", "clip_idx", "start", "end", (F.col("end") - F.col("start")).alias("duration")))).alias("clips"), F.count("*").alias("num_clips"))
    types = F.transform("qa", lambda q: q["type"])
    counted = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))
    out = videos.join(own, "video", "left").join(qa, "video", "left").withColumn("type_counts", counted)
    return out.withColumns({"num_clips": F.coalesce("num_clips", F.lit(0)), "num_qa": F.coalesce("num_qa", F.lit(0))})


def stream_id() -> Column:
    whole = lambda c: F.col(c).cast("long")
    return F.format_string("%s_c%d_stream_%s_tq%d_ta%d_%03d", "video", whole("clip_idx"), "type", whole("query_time"), whole("answer_time"), whole("ord"))


def offline_id() -> Column:
    return F.format_string("%s_c%d_offline_%s_%03d", "video", F.col("clip_idx").cast("long"), "type", F.col("ord").cast("long"))


def _sample(kind: str, source_id: Column, window: Column, target: Column) -> Column:
    return F.struct(F.lit(kind).alias("sample_type"), source_id.alias("source_qa_id"), window.alias("window"), target.alias("target"))


def expanded(offline: DataFrame, streaming: DataFrame, seconds: float = WINDOW_SECONDS) -> DataFrame:
    """Training samples: one a (bounded) offline row, a waiting and an answering one a streaming row."""
    answer = F.concat(F.lit(ANSWER_PREFIX), "answer")
    one = F.array(_sample("offline_answer", offline_id(), windows.window(F.col("clip_start"), F.col("clip_end")), answer))
    wait = _sample("streaming_wait", stream_id(), windows.observed(F.col("query_time"), F.col("clip_start"), seconds), F.lit(WAIT_TARGET))
    late = _sample("streaming_answer", stream_id(), windows.observed(F.col("answer_time"), F.col("clip_start"), seconds), answer)
    keys = ("video", "clip_idx", "type", "question")
    out = offline.select(*keys, F.inline(one)).unionByName(streaming.select(*keys, F.inline(F.array(wait, late))))
    return out.select(*keys, "sample_type", "source_qa_id", "window.start", "window.end", "target")


def dual_expanded(rows: DataFrame, include_wait: bool = True) -> DataFrame:
    """Dual rows (``source, question, answer, answerable_now``): a waiting sample only where the answer isn't known yet."""
    some = (F.coalesce("question", F.lit("")) != "") & (F.coalesce("answer", F.lit("")) != "")
    streaming = F.col("source") == "streaming"
    answer = F.struct(F.when(streaming, "streaming_answer").otherwise("offline_answer").alias("sample_type"), F.concat(F.lit(ANSWER_PREFIX), "answer").alias("target"))
    wait = F.struct(F.lit("streaming_wait").alias("sample_type"), F.lit(DUAL_WAIT_TARGET).alias("target"))
    waits = streaming & ~F.coalesce("answerable_now", F.lit(False)) & F.lit(include_wait)
    return rows.where(some).select("*", F.inline(F.when(waits, F.array(wait, answer)).otherwise(F.array(answer))))


def messages(video: Column, start: Column, end: Column, prompt: Column, target: Column | None) -> Column:
    """Chat messages: a user's video and text blocks, and the answer where there is one."""
    block = lambda kind, text, v, a, b: F.struct(F.lit(kind).alias("type"), text.alias("text"), v.alias("video"), a.cast("double").alias("video_start"), b.cast("double").alias("video_end"))
    no, zero = F.lit(None).cast("string"), F.lit(None).cast("double")
    text = lambda x: block("text", x, no, zero, zero)
    user = F.struct(F.lit("user").alias("role"), F.array(block("video", no, video, start, end), text(prompt)).alias("content"))
    if target is None:
        return F.array(user)
    return F.concat(F.array(user), F.when(target.isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), F.array(text(target)).alias("content")))).otherwise(F.slice(F.array(user), 1, 0)))


def last_position(seq: Column, sub: Column) -> Column:
    """Where the last occurrence of ``sub`` in ``seq`` begins, from 0; -1 if there is none or ``sub`` is empty."""
    last = F.size(seq) - F.size(sub)
    starts = F.when((F.size(sub) > 0) & (last >= 0), F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_max(F.filter(starts, lambda i: F.slice(seq, i + 1, F.size(sub)) == sub)), F.lit(-1))


def label_mask(ids: Column, start: Column, length: int, ignored: int = -100) -> Column:
    """Labels of a padded sequence: ids from ``start`` on, ignored before it and on padding."""
    own = F.transform(ids, lambda x, i: F.when(i < start, F.lit(ignored)).otherwise(x))
    return F.slice(F.concat(own, F.array_repeat(F.lit(ignored), length)), 1, length)
