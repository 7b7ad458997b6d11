"""Records around clips and candidates: overflow columns, chapters, paths, dual and timed rows, prompts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels, windows
from ..functions.text import safe_int, strip


def with_overflow(raw: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """A map of texts split into what has a column of its own and what hasn't."""
    names = F.array(*map(F.lit, known))
    return F.map_filter(raw, lambda k, _: F.array_contains(names, k)), F.map_filter(raw, lambda k, _: ~F.array_contains(names, k))


def flattened(record: Column, extra: Column) -> Column:
    """One map again; a record's own value stands over an extra one."""
    return F.map_concat(F.map_filter(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(record, k)), record)


def chapters(found: Column) -> Column:
    """Titles and whole seconds of chapters; a missing list is empty."""
    one = lambda c: F.struct(F.coalesce(c["title"], F.lit("")).alias("title"), safe_int(c["start_time"]).alias("start_time"), safe_int(c["end_time"]).alias("end_time"))
    return F.coalesce(F.transform(found, one), F.array().cast("array<struct<title:string,start_time:bigint,end_time:bigint>>"))


def search_seeds(primary: DataFrame, fallback: DataFrame, key: str = "video_id", page: str = "page", order: str = "ord") -> DataFrame:
    """Results of paged searches; a page whose search failed (no rows in ``primary``) is filled from the fallback.

    The first row of an id counts, by page and order.
    """
    missing = fallback.join(primary.select(page).distinct(), page, "left_anti")
    rows = primary.unionByName(missing)
    w = Window.partitionBy(key).orderBy(page, order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def more_seeds(seeds: DataFrame, found: DataFrame, target: int, key: str = "video_id", order: str = "ord") -> DataFrame:
    """Seeds with new ones behind them, first wins, up to ``target`` in all."""
    both = seeds.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy("_new", order)
    one = both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return one.orderBy("_new", order).limit(target).drop("_new")


def clip_of(spark: SparkSession, video: str, start: float, end: float, topic: str = "") -> DataFrame:
    """A single clip from given bounds."""
    if end <= start:
        raise ValueError("a clip ends after it starts")
    return spark.createDataFrame([(video, 0, float(start), float(end), float(end) - float(start), topic)], "video string, clip_idx int, start double, end double, duration double, topic string")


def whole_transcript(transcripts: DataFrame) -> DataFrame:
    """A transcript as its video's only clip: its full text, else its segments' texts."""
    text = F.coalesce(F.when(F.col("full_text") != "", F.col("full_text")), F.array_join(F.transform("segments", lambda s: s["text"]), " "))
    return transcripts.select("video", F.lit(0).alias("clip_idx"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), text.alias("text"))


def transcript_rows(raw: DataFrame) -> DataFrame:
    """Recognised segments with times to 2 places and texts without outer blanks."""
    return raw.select("video", "ord", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"), strip(F.col("text")).alias("text"))


def resolved_path(video: Column, given: Mapping[str, str], default: str | None, own: Column, listed: Column) -> Column:
    """The first of: a given path for the video, the default, the row's own, a listed file; an error without any."""
    pairs = [F.lit(x) for item in given.items() for x in item]
    mapped = F.try_element_at(F.create_map(*pairs), video) if pairs else F.lit(None).cast("string")
    found = F.coalesce(mapped, F.lit(default).cast("string"), F.when(own != "", own), listed)
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no file for video "), F.coalesce(video, F.lit("null")))).cast("string"))


def video_struct(path: Column, start: Column, end: Column, fps: float = 1.0, most: int = 32) -> Column:
    """What a sample shows of a video; no more frames than its seconds at ``fps`` say."""
    length = F.greatest(end - start, F.lit(0.0))
    return F.struct(path.alias("path"), start.alias("start"), end.alias("end"), length.alias("duration_sec"), F.lit(fps).alias("fps"), F.lit(most).alias("max_frames"))


def dual_rows(rows: DataFrame, types: Sequence[str], seconds: float = 30.0) -> DataFrame:
    """Dual streaming rows that pass, with clamped times and the window seen at the question."""
    from .qa import dual_reject

    kept = rows.withColumn("reject_reason", dual_reject(tuple(types), F.col("clip_start"), F.col("clip_end")))
    ask = windows.clamp_time(F.col("question_time"), F.col("clip_start"), F.col("clip_end"))
    answer = windows.clamp_time(F.col("answer_time"), F.col("clip_start"), F.col("clip_end"))
    return kept.where("reject_reason IS NULL").withColumns({"question_time": ask, "answer_time": answer}).withColumn("visual_context", windows.observed(F.col("question_time"), F.col("clip_start"), seconds)).drop("reject_reason")


def timed_rows(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """Rows asked at a time of their clip, numbered; what is outside the clip, blank or of another type falls out."""
    at = windows.clamp_time(F.col("query_time"), F.col("clip_start"), F.col("clip_end"))
    texts = (strip(F.coalesce("question", F.lit(""))) != "") & (strip(F.coalesce("answer", F.lit(""))) != "")
    kept = rows.where(F.col("qa_type").isin(*types) & texts).withColumn("query_time", at).where("query_time IS NOT NULL")
    number = F.row_number().over(Window.partitionBy("video", "clip_idx").orderBy("ord")) - 1
    kept = kept.withColumn("qa_id", F.format_string("%s_c%d_t%03d", "video", F.col("clip_idx").cast("long"), number.cast("long")))
    return kept.withColumns({"input_start": F.col("clip_start"), "input_end": F.col("query_time")})


def streaming_prompt(question: Column, now: Column, history: Column) -> Column:
    """Lines of a prompt; a missing history has no line."""
    seen = F.when(F.coalesce(history, F.lit("")) != "", F.concat(F.lit("So far: "), history))
    return F.concat_ws("\n", F.concat(F.lit("Time: "), F.format_string("%.2f", now.cast("double"))), seen, F.concat(F.lit("Question: "), question))


def predictions(samples: DataFrame, said: Column) -> DataFrame:
    """Sample rows with a model's text, its answer part, both labels and whether they agree."""
    rows = samples.withColumn("prediction", said)
    rows = rows.withColumns({"target_answer_text": labels.strip_prefix(F.col("target")), "prediction_answer_text": labels.strip_prefix(F.col("prediction")), "gt_label": labels.truth(F.col("target")), "pred_label": labels.predicted(F.col("prediction"))})
    return rows.withColumn("correct_answerability", F.col("gt_label") == F.col("pred_label"))


def first_words(text: Column, ratio: Column) -> Column:
    """The first whole part of ``ratio`` of a text's words: what was said up to a share of it."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), (F.size(words) * ratio).cast("int")), " ")


def shortened(text: Column, n: int, mark: str = "") -> Column:
    """The first ``n`` signs, and a mark where some were cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def dual_prompt(video: Column, clip_idx: Column, start: Column, end: Column, topic: Column, speech: Column, seconds: float = 30.0, fps: int = 1, frames: int = 32) -> Column:
    """What a model is told for an offline and a streaming row of one clip."""
    time = lambda x: F.format_string("%.2fs", x.cast("double"))
    said = F.when(strip(F.coalesce(speech, F.lit(""))) != "", strip(speech)).otherwise("(no speech)")
    line = lambda name, x: F.concat(F.lit(f"{name}: "), x)
    return F.concat_ws(
        "\n", line("Video", video), line("Clip", clip_idx.cast("string")), line("From", time(start)), line("To", time(end)), line("Topic", F.coalesce(topic, F.lit(""))),
        F.lit(f"Window: {seconds:g} s at {fps} frames a second, {frames} frames at most"), line("Speech", said),
        F.lit("Answer as a JSON object with offline_qa (qa_type, question, answer, evidence) and streaming_qa (qa_type, question_time, answer_time, answerable_at_question_time, question, answer, evidence)."),
    )


def words_before(words: DataFrame, asks: DataFrame) -> DataFrame:
    """For each ask ``(video, at)`` how many words of ``(video, start, text)`` came before it, and those new since the ask before.

    One pass in time order: an ask reads on where the last one stopped, as a cursor would.
    """
    none = F.lit(None).cast("string")
    said = words.select("video", F.col("start").cast("double").alias("t"), F.lit(1).alias("kind"), F.col("text"))
    asked = asks.select("video", F.col("at").cast("double").alias("t"), F.lit(0).alias("kind"), none.alias("text"))
    order = Window.partitionBy("video").orderBy("t", "kind")
    rows = said.unionByName(asked)
    cursor = F.count_if(F.col("kind") == 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turn = F.count_if(F.col("kind") == 0).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.when(F.col("kind") == 0, 1).otherwise(0)
    rows = rows.withColumns({"cursor": cursor, "turn": turn})
    new = rows.where("kind = 1").groupBy("video", "turn").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "text"))), lambda w: w["text"]), " ").alias("new_text"))
    out = rows.where("kind = 0").select("video", F.col("t").alias("at"), "cursor", "turn").join(new, ["video", "turn"], "left")
    return out.select("video", "at", "cursor", F.coalesce("new_text", F.lit("")).alias("new_text"))


def written(rows: DataFrame, *dropped: str) -> DataFrame:
    """Rows as they are written: without what only the run needed (a raw text, usage, temporary columns)."""
    return rows.drop(*dropped)


def first_rows(rows: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first rows in an explicit order; all without a number."""
    return rows.orderBy(*order) if n is None else rows.orderBy(*order).limit(n)
