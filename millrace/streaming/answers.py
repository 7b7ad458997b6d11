"""Answers over a video's clock: when a question can be answered, and asking again until it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ask_again(rows: DataFrame, step: int = 5) -> DataFrame:
    """Per row the first tick (from ``question_time``, every ``step``, up to ``clip_end``) at or after ``answer_time``.

    ``answered_at`` is null where the clip ends first; ``waits`` counts the ticks that had to wait.
    """
    ticks = F.sequence("question_time", F.greatest("question_time", "clip_end"), F.lit(step).cast("long"))
    return rows.withColumn("_t", ticks).withColumns({"answered_at": F.array_min(F.filter("_t", lambda t: t >= F.col("answer_time"))), "waits": F.size(F.filter("_t", lambda t: t < F.col("answer_time"))).cast("long")}).drop("_t")


def sessions(events: DataFrame, gap: str, delay: str, time: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of a stream (or table) of events: closed ``gap`` after the last event, late ones dropped after ``delay``.

    An event just ``gap`` after the last one begins a session.  Spark's windows would join where they touch, so they end
    a microsecond (the least step of a timestamp) early, which ``end`` gets back.
    """
    window = F.session_window(time, f"{gap} -1 microseconds")
    end = F.col("session_window.end") + F.expr("interval 1 microsecond")
    return events.withWatermark(time, delay).groupBy(window, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), end.alias("end"), "n")


def sliding(events: DataFrame, length: str, slide: str, delay: str, time: str = "ts", *keys: str) -> DataFrame:
    """Counts over the last ``length``, every ``slide``."""
    return events.withWatermark(time, delay).groupBy(F.window(time, length, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


STATUS_ORDER = ("queued", "running", "completed", "failed")


def job_status(log: DataFrame, size: int = 600) -> DataFrame:
    """The latest status of each job in an event log (``job, at, ord, status, line``) and its last ``size`` log lines.

    Lines are ranked before they are gathered, so a job's whole log never meets.
    """
    last = log.groupBy("job").agg(F.max_by("status", F.struct("at", "ord")).alias("status"), F.max("at").alias("updated_at"))
    newest = Window.partitionBy("job").orderBy(F.desc("at"), F.desc("ord"))
    few = log.withColumn("_k", F.row_number().over(newest)).where(F.col("_k") <= size)
    lines = few.groupBy("job").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ord", "line"))), lambda x: x["line"]).alias("logs"))
    return last.join(lines, "job")


def running_accuracy(predictions: DataFrame) -> DataFrame:
    """How many predictions of each label there are so far, and the share that is right; a stream's complete result."""
    right = F.count_if(F.coalesce("correct_answerability", F.lit(False)))
    return predictions.groupBy("pred_label").agg(F.count("*").alias("n"), right.alias("correct"))


ANSWERED = "question string, answered_at double, waits long"


def first_answers(ticks: DataFrame) -> DataFrame:
    """A stream of ticks (``question, t, answer_time, clip_end``) to one row a question, when its answer is there.

    State is a count of waits and a flag a question; ticks after the answer or the clip's end are passed
    over.  Ticks of one question may come in any number of batches, in order.
    """

    def run(key, parts, state):
        import pandas as pd

        waits, done = state.get if state.exists else (0, False)
        out = []
        for part in parts:
            for t, answer, end in part.sort_values("t")[["t", "answer_time", "clip_end"]].itertuples(index=False):
                if done or t > end:
                    continue
                if t >= answer:
                    done = True
                    out.append((key[0], float(t), waits))
                else:
                    waits += 1
        state.update((waits, done))
        yield pd.DataFrame(out, columns=["question", "answered_at", "waits"])

    return ticks.groupBy("question").applyInPandasWithState(run, ANSWERED, "waits long, done boolean", "append", "NoTimeout")


def chunks(words: DataFrame, first: float = 3.0, step: float = 1.0) -> DataFrame:
    """Words of a video (``video, start, text``) in its chunks: the first is longer, the others alike.

    Silent chunks inside stay as empty ones; those behind the last word don't exist.
    """
    number = F.when(F.col("start") < first, 0).otherwise(F.floor((F.col("start") - first) / step) + 1).cast("long")
    said = words.withColumn("chunk", number).groupBy("video", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda w: w["text"]), " ").alias("text"))
    spans = said.groupBy("video").agg(F.max("chunk").alias("last")).select("video", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
    rows = spans.join(said, ["video", "chunk"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    begin = F.when(F.col("chunk") == 0, F.lit(0.0)).otherwise(first + (F.col("chunk") - 1) * step)
    return rows.withColumns({"begin": begin, "end": first + F.col("chunk") * step})
