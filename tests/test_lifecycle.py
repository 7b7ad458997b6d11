"""Whole runs on hand-made rows: failing calls, broken texts, stages left out, repeated runs."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.plans import lifecycle
from millrace.sources import files, ports

CLIPS = "video string, clip_idx int, start double, end double, topic string, text string"


@pytest.fixture
def clips(spark):
    return spark.createDataFrame([("v1", 0, 0.0, 100.0, "t", "one two three four"), ("v2", 0, 0.0, 100.0, None, None), ("v3", 1, 0.0, 10.0, "", "")], CLIPS)


def entry(**more):
    return {"type": "next_action", "question": " q ", "answer": "a", "answer_time": 99} | more


def test_ask_keeps_the_rows_at_fault_apart(spark):
    def model(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [p.upper() for p in prompts]

    rows = spark.createDataFrame([("a",), ("bad",), ("c",)], "p string").coalesce(1)
    got = {r["p"]: (r["response"], r["error"]) for r in ports.ask(rows, "p", lambda: model, error="error").collect()}
    assert got == {"a": ("A", None), "bad": (None, "ValueError: no"), "c": ("C", None)}
    with pytest.raises(Exception, match="no"):
        ports.ask(rows, "p", lambda: model).collect()


def test_prompts(spark, clips):
    seen = {r["response"] for r in lifecycle.ask_streaming(clips.where("video = 'v1'"), lambda: list, lifecycle.Knobs(ratios=(0.5,), seen=20.0)).collect()}
    lines = seen.pop().splitlines()
    assert not seen and lines[2:] == ["Video v1, clip 0, t", "Seen: 30.00 to 50.00", "Now: 50.00", "Later: 50.00 to 100.00", "Speech so far: one two"]
    assert lifecycle.ask_streaming(clips.where("video = 'v3'"), lambda: list).count() == 0  # futures below 8 seconds
    first = lifecycle.ask_offline(clips.where("video = 'v2'"), lambda: list, lifecycle.Knobs(offline=40.0)).first()["response"]
    assert "Shown: 0.00 to 40.00" in first and "Speech" not in first


def test_entries_fall_out_alone(spark):
    texts = [json.dumps([entry(), 3, entry(type="x"), entry(query_time=61), entry(answer_time="soon")]), "no list", "[]", "{}", None]
    said = spark.createDataFrame([(f"v{k}", 0, 0.0, 100.0, "", 0.6, 60.0, t, None if t else "E: e") for k, t in enumerate(texts)], "video string, clip_idx int, start double, end double, topic string, ratio double, query_time double, response string, error string")
    got = [(r["video"], r["question"], r["query_time"], r["reason"]) for r in lifecycle.streaming_rows(said).orderBy("video", "pos").collect()]
    assert got == [("v0", "q", 60.0, None), ("v0", None, 60.0, "not a dict"), ("v0", "q", 60.0, "unknown type"), ("v0", "q", 61.0, None), ("v0", "q", 60.0, "answer_time not a float"), ("v1", None, 60.0, "parse_failure"), ("v3", None, 60.0, "parse_failure"), ("v4", None, 60.0, "E: e")]


def test_offline_rows(spark):
    texts = ['{"question": " q", "answer": "a"}', '{"question": "q", "answer": " "}', "[1]", "x", None]
    said = spark.createDataFrame([(f"v{k}", 0, 0.0, 400.0, "", t, None if t else "E: e") for k, t in enumerate(texts)], "video string, clip_idx int, start double, end double, topic string, response string, error string")
    got = [(r["question"], r["clip_end"], r["reason"]) for r in lifecycle.offline_rows(said).orderBy("video").collect()]
    assert got == [("q", 400.0, None), ("q", 400.0, "empty question or answer"), ("", 400.0, "parse_failure"), ("", 400.0, "parse_failure"), ("", 400.0, "E: e")]


def test_qa_run(spark, clips, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def streaming(prompts):
        (asked / str(len(list(asked.iterdir())))).touch()
        return [json.dumps([entry()]) for _ in prompts]

    def validator(prompts):
        ok = dict.fromkeys(lifecycle.jsonrepair.CHECKS, True)
        return ["?" if "Video v2" in p else json.dumps({"checks": ok, "verdict": "fail"}) for p in prompts]

    models = (lambda: lambda p: ['{"question": "w", "answer": "o"}'] * len(p)), (lambda: streaming), (lambda: validator)
    run = lifecycle.qa_run(clips, *models, f"file://{tmp_path}/run")
    assert {r["status"]: (r["n"], r["question_no_leak"]) for r in run["stats"].collect()} == {"pass": (2, 2), "error": (2, 0)}
    kinds = {(r["video"], r["sample_type"]): r["count"] for r in run["samples"].groupBy("video", "sample_type").count().collect()}
    assert kinds == {("v1", "offline_answer"): 1, ("v2", "offline_answer"): 1, ("v3", "offline_answer"): 1, ("v1", "streaming_wait"): 2, ("v1", "streaming_answer"): 2}
    assert [(r["source"], r["timestamp"]) for r in run["rows"].where("video = 'v1'").orderBy("place").collect()] == [("streaming", 30.0), ("offline", 50.0), ("streaming", 60.0)]
    assert {r["source_qa_id"] for r in run["samples"].where("sample_type = 'streaming_wait'").collect()} == {"v1_c0_stream_next_action_tq30_ta99_000", "v1_c0_stream_next_action_tq60_ta99_001"}
    n = len(list(asked.iterdir()))
    again = lifecycle.qa_run(clips, *models, f"file://{tmp_path}/run", lifecycle.Knobs(keep_failed=True))
    assert again["samples"].count() == 11 and len(list(asked.iterdir())) == n  # nothing was asked again
    part = lifecycle.qa_run(clips, None, models[1], None, f"file://{tmp_path}/part", lifecycle.Knobs(clip_idx=1))
    assert part["samples"].count() == 0 and "validated" not in part
    none = lifecycle.qa_run(clips.limit(0), *models, f"file://{tmp_path}/none")
    assert none["samples"].count() == 0 and none["drop_log"].count() == 0


def test_acquisition_run(spark):
    seeds = spark.createDataFrame([(k, k, t, "d") for k, t in enumerate(["the one two three", None, "the four five six", "a", "the seven eight nine"])], "id int, ord int, title string, description string")
    details = spark.createDataFrame([(0, "the probe at work"), (1, ""), (3, ""), (4, "")], "id int, title string")
    args = ("en", ["the"], [], [], {"probe": ("probe",)}, "other")
    run = lifecycle.acquisition_run(seeds, details, 2, *args)
    assert [(r["id"], r["title"], r["category"]) for r in run["kept"].orderBy("ord").collect()] == [(0, "the probe at work", "probe"), (4, "the seven eight nine", "other")]
    assert [r["id"] for r in run["failed"].collect()] == [2]
    assert {(r["outcome"], r["reason"]): r["n"] for r in run["counts"].collect()} == {("kept", ""): 2, ("failed", ""): 1, ("rejected", "language"): 2}
    back = lifecycle.acquisition_run(seeds, details, 2, *args, fall_back=True)
    assert [r["id"] for r in back["kept"].orderBy("ord").collect()] == [0, 2] and back["failed"].count() == 0
    assert [r["id"] for r in back["rejected"].collect()] == [1]  # behind the second kept one nothing is looked at


def test_evaluation_run(spark, tmp_path):
    def model(prompts):
        if any("fail" in p for p in prompts):
            raise ValueError("no")
        return ["<WAIT> x" if "wait" in p else "it moves left" for p in prompts]

    rows = [(0, "streaming_wait", "a", "wait", "<WAIT> w"), (1, "streaming_answer", None, "go", "<ANSWER> a"), (2, "streaming_answer", "a", "fail", "<ANSWER> a"), (3, "offline_answer", "a", "wait", "<ANSWER> a")]
    samples = spark.createDataFrame([(*r, 0.0, 10.0) for r in rows], "idx int, sample_type string, qa_type string, question string, target string, start double, end double")
    run = lifecycle.evaluation_run(samples, lambda: model, f"file://{tmp_path}/eval")
    whole = run["report"].where("level = 'overall'").first()
    assert (whole["total"], whole["correct"], whole["over_wait"], whole["answer_other"], whole["pred_error"]) == (4, 2, 1, 1, 1)
    assert [(r["idx"], r["pred_label"]) for r in run["failures"].collect()] == [(2, "ERROR"), (3, "WAIT")]


def test_stored_tables_are_made_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert files.stored(spark, path, lambda: spark.range(2)).count() == 2
    assert files.stored(spark, path, lambda: spark.range(9)).count() == 2
    (tmp_path / "t" / "_SUCCESS").unlink()  # a run that died
    assert files.stored(spark, path, lambda: spark.range(9).select(F.col("id"))).count() == 9
