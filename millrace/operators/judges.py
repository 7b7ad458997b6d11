"""Model judges as relational shells: prompt, port, parsed rows.  They verify cuts, rate clips, classify frames, find leaks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonrepair
from ..functions.text import strict_true
from ..sources import ports
from . import quality

CUTS = "struct<final_cuts:array<struct<segment_index:int,should_cut:boolean,topic:string>>,additional_cuts:array<struct<segment_index:int,topic:string>>,last_topic:string,_parse_error:boolean>"
RATINGS = "struct<overall_score:double,clip_scores:array<struct<clip_idx:int,coherence:double,boundary:double,duration:double,completeness:double,comment:string>>,issues:array<string>,_parse_error:boolean>"
FRAME = "struct<`帧类型`:string,`模态`:string,`解剖部位`:string>"


def _lines(rows: DataFrame, line, *order: str) -> DataFrame:
    """One text a video of its rows' lines; a prompt holds a video's rows, which its length bounds."""
    own = F.array_sort(F.collect_list(F.struct(*order, line.alias("line"))))
    return rows.groupBy("video").agg(F.array_join(F.transform(own, lambda x: x["line"]), "\n").alias("lines"))


def verified_cuts(segments: DataFrame, changes: DataFrame, model: Callable[[], ports.ModelPort], retries: int = 0) -> DataFrame:
    """``(video, ord, topic, additional, last_topic)`` of the cuts that a model keeps or adds, as ``segment.by_cuts`` takes them.

    ``changes`` has the candidates (``video, ord, start, similarity, scene_change``).  A text without an object gives no
    cuts.  A final cut counts unless it says that it shouldn't.
    """
    time = lambda c: F.format_string("%.1f", F.col(c).cast("double"))
    said = _lines(segments, F.concat(F.lit("["), F.col("ord").cast("string"), F.lit("] ["), time("start"), F.lit("-"), time("end"), F.lit("s] "), F.coalesce("text", F.lit(""))), "ord")
    seen = _lines(changes.where("scene_change"), F.concat(F.lit("segment "), F.col("ord").cast("string"), F.lit(" at "), time("start"), F.lit("s, similarity "), F.format_string("%.3f", F.col("similarity").cast("double"))), "ord")
    rows = said.join(seen.withColumnRenamed("lines", "candidates"), "video", "left")
    task = "Which candidate cuts are real changes of topic, and which are missing? Answer as a JSON object with final_cuts, additional_cuts and last_topic."
    prompt = F.concat_ws("\n", F.lit(task), F.col("lines"), F.lit("Candidates:"), F.coalesce("candidates", F.lit("")))
    answers = ports.ask(rows.select("video", prompt.alias("prompt")), "prompt", model, error="error", retries=retries)
    found = answers.select("video", F.from_json(jsonrepair.cuts_answer(F.col("response")), CUTS).alias("f"))
    none = F.array().cast("array<struct<ord:int,topic:string,additional:boolean>>")
    one = lambda c, more: F.struct(c["segment_index"].alias("ord"), F.coalesce(c["topic"], F.lit("")).alias("topic"), F.lit(more).alias("additional"))
    final = F.transform(F.filter("f.final_cuts", lambda c: F.coalesce(c["should_cut"], F.lit(True))), lambda c: one(c, False))
    both = F.concat(F.coalesce(final, none), F.coalesce(F.transform("f.additional_cuts", lambda c: one(c, True)), none))
    return found.select("video", F.coalesce("f.last_topic", F.lit("")).alias("last_topic"), F.inline(both)).where("ord IS NOT NULL").select("video", "ord", "topic", "additional", "last_topic")


def rated(clips: DataFrame, model: Callable[[], ports.ModelPort], retries: int = 0) -> DataFrame:
    """``(video, overall_score, clip_scores, issues, failed)`` of a video's clips (``clip_idx, start, end, topic, text``) as a model judges them."""
    seconds = lambda x: F.format_string("%.0f", x.cast("double"))
    line = F.concat(F.lit("Clip "), F.col("clip_idx").cast("string"), F.lit(": "), seconds(F.col("start")), F.lit("-"), seconds(F.col("end")), F.lit("s "), F.coalesce("topic", F.lit("")), F.lit("\n  "), F.substring(F.coalesce("text", F.lit("")), 1, 150))
    task = "Rate each clip's coherence, boundary, duration and completeness from 1 to 5. Answer as a JSON object with overall_score, clip_scores and issues."
    rows = _lines(clips, line, "clip_idx").select("video", F.concat_ws("\n", F.lit(task), "lines").alias("prompt"))
    answers = ports.ask(rows, "prompt", model, error="error", retries=retries)
    found = answers.select("video", F.from_json(jsonrepair.rating_answer(F.col("response")), RATINGS).alias("r"))
    return found.select("video", F.coalesce("r.overall_score", F.lit(0.0)).alias("overall_score"), "r.clip_scores", "r.issues", F.coalesce("r._parse_error", F.lit(False)).alias("failed"))


def classified_frames(frames: DataFrame, prompt: str, model: Callable[[], ports.ModelPort], retries: int = 0) -> DataFrame:
    """``(video, ord, type, modality, anatomy)`` of frames as a model names them; ``prompt`` is the column that shows a frame."""
    answers = ports.ask(frames.select("video", "ord", F.col(prompt).alias("prompt")), "prompt", model, error="error", retries=retries)
    found = answers.select("video", "ord", F.from_json(jsonrepair.frame_answer(F.coalesce("response", F.lit(""))), FRAME).alias("f"))
    return found.select("video", "ord", F.col("f.帧类型").alias("type"), F.col("f.模态").alias("modality"), F.col("f.解剖部位").alias("anatomy"))


def classified_videos(frames: DataFrame, prompt: str, model: Callable[[], ports.ModelPort]) -> DataFrame:
    """A decision a video from its frames' classes."""
    return quality.decisions(classified_frames(frames, prompt, model))


def leaks(rows: DataFrame, model: Callable[[], ports.ModelPort], retries: int = 0) -> DataFrame:
    """Add ``question_valid`` (null where the model doesn't say) and ``judgement`` to ``rows(question, query_time)``.

    A question is valid if what was seen before it could raise it.
    """
    task = "Could what was seen before this time alone raise the question? Answer as a JSON object with question_valid and reason."
    prompt = F.concat_ws("\n", F.lit(task), F.format_string("Time: %.0f", F.col("query_time").cast("double")), F.concat(F.lit("Question: "), F.col("question")))
    said = ports.ask(rows.withColumn("_prompt", prompt), "_prompt", model, out="_said", error="_error", retries=retries)
    found = jsonrepair.repaired(F.col("_said"), jsonrepair.CUTS)
    valid = F.when(F.get_json_object(found, "$.question_valid").isNotNull(), strict_true(found, "$.question_valid"))
    return said.withColumns({"question_valid": valid, "judgement": F.coalesce("_error", F.get_json_object(found, "$.reason"), F.lit(""))}).drop("_prompt", "_said", "_error")
