"""Records, reports, pixels and chunks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonrepair, pixels
from millrace.functions import text as T
from millrace.operators import records, reports
from millrace.sources import files
from millrace.streaming import answers


def test_overflow(spark):
    df = spark.createDataFrame([({"a": "1", "z": "9"},), (None,)], "m map<string,string>")
    own, extra = records.with_overflow(F.col("m"), ["a", "b"])
    rows = df.select(own.alias("o"), extra.alias("e"), records.flattened(F.create_map(F.lit("z"), F.lit("0")), extra).alias("f")).collect()
    assert (rows[0]["o"], rows[0]["e"], rows[0]["f"]) == ({"a": "1"}, {"z": "9"}, {"z": "0"}) and rows[1]["o"] is None


def test_chapters_and_paths(spark):
    df = spark.createDataFrame([([("t", "1.9", None)], "v", ""), (None, "w", "own.mp4")], "c array<struct<title:string,start_time:string,end_time:string>>, video string, own string")
    assert [r[0] for r in df.select(records.chapters(F.col("c"))).collect()] == [[("t", 1, 0)], []]
    path = lambda default, listed: records.resolved_path(F.col("video"), {"v": "map.mp4"}, default, F.col("own"), F.lit(listed))
    assert [r[0] for r in df.select(path(None, "l.mp4")).collect()] == ["map.mp4", "own.mp4"]
    assert [r[0] for r in df.select(path("d.mp4", None)).collect()] == ["map.mp4", "d.mp4"]
    with pytest.raises(Exception, match="no file for video w"):
        df.where("video = 'w'").withColumn("own", F.lit("")).select(path(None, None).alias("p")).collect()


def test_seeds(spark):
    s = "page int, ord int, video_id string"
    primary = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (3, 0, "a")], s)
    fallback = spark.createDataFrame([(1, 0, "x"), (2, 0, "c"), (2, 1, "b")], s)
    assert sorted(r["video_id"] for r in records.search_seeds(primary, fallback).collect()) == ["a", "b", "c"]
    more = records.more_seeds(primary.select("video_id", "ord").limit(2), fallback.select("video_id", "ord"), 3)
    assert [r["video_id"] for r in more.collect()][:2] == ["a", "b"] and more.count() == 3


def test_clips_and_transcripts(spark):
    assert records.clip_of(spark, "v", 3, 9).first()["duration"] == 6
    with pytest.raises(ValueError):
        records.clip_of(spark, "v", 3, 3)
    t = spark.createDataFrame([("v", 9.0, "", [("a",), ("b",)]), ("w", 5.0, "full", None)], "video string, duration double, full_text string, segments array<struct<text:string>>")
    assert [r["text"] for r in records.whole_transcript(t).orderBy("video").collect()] == ["a b", "full"]
    raw = spark.createDataFrame([("v", 0, 0.126, 1.0, " x　")], "video string, ord int, start double, end double, text string")
    assert records.transcript_rows(raw).first()["text"] == "x"


def test_dual_and_timed_rows(spark):
    rows = [("v", 0, "k", 10.0, 40.0, "q", "a"), ("v", 1, "k", 50.0, 40.0, "q", "a"), ("v", 2, "k", 10.0, 400.0, "q", "a"), ("v", 3, "z", 10.0, 40.0, "q", "a"), ("v", 4, "k", 10.0, 40.0, " ", "a")]
    df = spark.createDataFrame(rows, "video string, ord int, qa_type string, question_time double, answer_time double, question string, answer string").withColumns({"clip_start": F.lit(0.0), "clip_end": F.lit(100.0), "clip_idx": F.lit(1)})
    kept = records.dual_rows(df, ["k"]).collect()
    assert [r["ord"] for r in kept] == [0] and tuple(kept[0]["visual_context"]) == (0.0, 10.0)
    timed = records.timed_rows(df.withColumn("query_time", F.col("answer_time")), ["k"]).orderBy("qa_id").collect()
    assert [(r["ord"], r["qa_id"], r["input_end"]) for r in timed] == [(0, "v_c1_t000", 40.0), (1, "v_c1_t001", 40.0)]


def test_prompts(spark):
    one = spark.range(1).select(records.streaming_prompt(F.lit("why"), F.lit(3), F.lit(None)), records.streaming_prompt(F.lit("why"), F.lit(3), F.lit("h")), records.first_words(F.lit(" a b  c d "), F.lit(0.6)), records.shortened(F.lit("abcdef"), 3, " ..."), records.shortened(F.lit("abc"), 3, " ...")).first()
    assert tuple(one) == ("Time: 3.00\nQuestion: why", "Time: 3.00\nSo far: h\nQuestion: why", "a b", "abc ...", "abc")
    p = records.predictions(spark.createDataFrame([("<ANSWER> yes",)], "target string"), F.lit("<answer> it is so")).first()
    assert (p["target_answer_text"], p["prediction_answer_text"], p["correct_answerability"]) == ("yes", "it is so", True)


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a", "m", "", True), ("b", None, "t", None), ("a", "", None, False)], "category string, media_file string, thumbnail_file string, paired boolean")
    assert [tuple(r) for r in reports.category_counts(rows).collect()] == [("a", 2, 1, 0, 1), ("b", 1, 0, 1, 0)]
    log = spark.createDataFrame([("kept",), ("failed",), ("kept",)], "outcome string")
    assert tuple(reports.run_counters(log).first()) == (3, 2, 0, 1)
    modes = spark.createDataFrame([("frames", 2.0, 5), ("video", 6.0, None)], "mode string, seconds double, tokens long")
    assert {r["mode"]: (r["tokens"], r["times_fastest"]) for r in reports.mode_comparison(modes).collect()} == {"frames": (5, 1.0), "video": (0, 3.0)}
    videos = spark.createDataFrame([("v", 80.0, "pure"), ("w", 20.0, "rejected"), ("x", 90.0, "pure")], "video string, score double, category string")
    assert [r["video"] for r in reports.score_report(videos).collect()] == ["x", "v", "w"]
    assert tuple(reports.score_counts(videos).first()) == (3, 2, 0, 0, 1)
    counts = spark.createDataFrame([("a", 1), (None, 3)], "k string, n long")
    assert [r["line"] for r in reports.summary_lines(counts, "k").collect()] == ["none: 3 (75.0%)", "a: 1 (25.0%)"]
    assert spark.range(1).select(reports.percent(F.lit(0.125))).first()[0] == "12.5%"
    words = spark.createDataFrame([(10, 5.0), (100, 5.0), (1, 0.0)], "n_words int, duration double")
    assert reports.merged_words(words).count() == 1
    files.by_category(rows, f"{tmp_path}/c", F.col("category"))
    assert {p.name for p in (tmp_path / "c").glob("category*")} == {"category_folder=a", "category_folder=b"}
    rows.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).json(f"{tmp_path}/in")
    seen = []
    for _ in range(2):  # the second run has nothing left to do
        reports.as_they_come(stream, lambda b: seen.append(b.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == 3


def test_pixels(spark):
    grey = np.full((64, 64, 3), 230, np.uint8)
    red = np.zeros((64, 64, 3), np.uint8)
    red[..., 0] = 255
    rows = [(grey.tobytes(), 64, 64), (red.tobytes(), 64, 64), (b"x", 64, 64), (None, None, None)]
    df = spark.createDataFrame(rows, "b binary, h int, w int")
    got = [tuple(r["f"]) for r in df.select(pixels.features(F.col("b"), F.col("h"), F.col("w")).alias("f")).collect()]
    assert got[0] == (1.0, 0.0, 0.0) and got[1] == (0.0, 0.0, 1.0) and got[2] == got[3] == (None,) * 3


def test_chunks(spark):
    words = spark.createDataFrame([("v", 0.5, "a"), ("v", 2.9, "b"), ("v", 3.0, "c"), ("v", 6.2, "d")], "video string, start double, text string")
    got = [(r["begin"], r["end"], r["text"]) for r in answers.chunks(words).orderBy("chunk").collect()]
    assert got == [(0.0, 3.0, "a b"), (3.0, 4.0, "c"), (4.0, 5.0, ""), (5.0, 6.0, ""), (6.0, 7.0, "d")]


def test_small_functions(spark):
    df = spark.createDataFrame([('x {"a": 1} y {"b": {}}',), ("none",)], "t string")
    assert [r[0] for r in df.select(jsonrepair.frame_answer(F.col("t"))).collect()] == ['{"a": 1}', '{"帧类型":"解析失败","原始输出":"none"}']
    one = spark.range(1).select(T.local_time(F.lit(0)), T.local_time(F.lit(86400)), T.recommendation(F.lit("mixed")), T.recommendation(F.lit("x")), T.now_tag(F.timestamp_seconds(F.lit(0)))).first()
    assert tuple(one) == ("", "1970-01-02T00:00:00", "trim", None, "19700101_000000")


def test_inputs(spark, tmp_path):
    for k in (2, 1):
        (tmp_path / f"f{k}.json").write_text('{"idx": %d}' % k)
    rows = files.inputs(spark, [f"{tmp_path}/f1.json", f"{tmp_path}/f2.json", f"{tmp_path}/f1.json"], "idx int")
    assert [r["idx"] for r in rows.collect()] == [1, 2] and files.row_at(rows, 2).first()["idx"] == 2
    with pytest.raises(ValueError):
        files.row_at(rows, 9)
