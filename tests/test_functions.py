"""Column builders on crafted values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonrepair, labels, windows
from millrace.functions import text as T
from millrace.operators import acquire, evaluate, qa, quality


def each(spark, values, build, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")
    return [r[0] for r in df.orderBy("k").select(build(F.col("x")).alias("y")).collect()]


def test_text(spark):
    nbsp, wide = " ", "　"
    assert each(spark, [None, "", f" {nbsp}A  b{wide}", "x"], T.normalize) == ["", "", "a b", "x"]
    assert each(spark, ["<p>a<br/> b</p>", None], T.strip_html) == ["a b", ""]
    assert each(spark, ["1.2万", "3,456", "x", "", None, "2亿", "7.9"], T.parse_count) == [12000, 3456, 0, 0, 0, 200000000, 7]
    assert each(spark, ["1:02:03", "2:05", "a:b", "", None, "45", "1:2:3:4"], T.parse_duration) == [3723, 125, 0, 0, 0, 45, 0]
    assert each(spark, ["12.7", "", None, "abc", "-3.9", "NaN", "inf"], T.safe_int) == [12, 0, 0, 0, -3, 0, 0]
    assert each(spark, ["20240229", "2024", "20231301x", None], T.upload_date) == ["2024-02-29", "", "", ""]
    assert each(spark, ["a, b;a\n，c", " ", None], T.split_keywords) == [["a", "b", "c"], None, None]
    assert each(spark, ["超 a b", "超声", "one two three", "ab cd ef gh"], lambda x: T.looks_like(x, "zh")) == [True, True, False, False]
    assert each(spark, ["超 a b", "one two three", "ab cd ef gh"], lambda x: T.looks_like(x, "en")) == [False, False, True]
    assert each(spark, ["/a/b/c.tar.gz", "x", "/a/.env", "d/e.mp4"], T.stem) == ["c.tar", "x", ".env", "e"]
    assert each(spark, ["http://a/b.PNG?x=1", "http://a/b", "c.gif"], T.image_suffix) == [".png", ".jpg", ".jpg"]
    assert each(spark, ["Error 429", "cannot generate", "no"], T.is_rate_limit) == [True, True, False]
    assert each(spark, ["false", "", None], T.truthy) == [True, False, False]
    lexicon = {"first": ["aa", "bb"], "second": ["cc", "dd"]}
    got = each(spark, ["aa cc", "cc dd aa", "zz"], lambda x: T.classify(x, lexicon, "none"))
    assert [tuple(g) for g in got] == [("first", "aa"), ("second", "cc, dd"), ("none", "")]
    assert each(spark, ["a lecture", "a lecture image", "plain"], lambda x: T.visual_verdict(x, ["image"], ["lecture"])) == [False, True, True]
    assert each(spark, ["a. ", "b", "c?", None], T.ends_sentence) == [True, False, True, None]


def test_labels(spark):
    texts = ["<WAIT> hold", "< wait > x", "<ANSWER> Not enough information is shown", "I need more context", "The probe moves left", "ok yes", "", None]
    assert each(spark, texts, labels.predicted) == ["WAIT", "WAIT", "ANSWER", "WAIT", "ANSWER", "OTHER", "OTHER", "OTHER"]
    assert each(spark, texts, lambda x: labels.predicted(x, phrases_first=True))[2] == "WAIT"
    assert each(spark, [" <wait> x", "< wait>", None, "a"], labels.truth) == ["WAIT", "ANSWER", "ANSWER", "ANSWER"]
    assert each(spark, ["<Answer> <WAIT> a ", "<wait><answer> b"], labels.strip_prefix) == ["a", "<answer> b"]


def test_scores(spark):
    pairs = [("WAIT", "WAIT"), ("WAIT", "ANSWER"), ("ANSWER", "ANSWER"), ("ANSWER", "WAIT"), ("ANSWER", "ERROR")]
    rows = spark.createDataFrame([(k, "a", None, g, p, g == p) for k, (g, p) in enumerate(pairs)], "idx int, sample_type string, qa_type string, gt_label string, pred_label string, correct_answerability boolean")
    one = evaluate.summary(rows).first()
    assert (one["overall_accuracy"], one["wait_accuracy"], one["premature_answer_rate"]) == (0.4, 0.5, 0.5)
    assert one["answer_accuracy"] == one["over_wait_rate"] == one["answer_other_rate"] == pytest.approx(1 / 3)
    assert {(r["level"], r["key"]) for r in evaluate.report(rows).collect()} == {("overall", "all"), ("sample_type", "a"), ("qa_type", "None")}
    assert [r["idx"] for r in evaluate.failures(rows, 2).collect()] == [1, 3] and evaluate.failures(rows, 0).count() == 0
    assert evaluate.summary(rows.limit(0)).first()["overall_accuracy"] == 0.0


def test_windows(spark):
    def one(*columns):
        return tuple(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())

    n = lambda x: F.lit(float(x))
    pair = lambda w: (w["start"], w["end"])
    before, future, after, inverted = one(windows.latter(n(0), n(300), 240), windows.earlier(n(50), n(300), 30), windows.after(n(95), n(100), 10), windows.after(n(100), n(100), 10))
    assert [pair(w) for w in (before, future, after, inverted)] == [(60, 300), (50, 80), (95, 100), (100, 100)]
    assert pair(one(windows.latter(n(0), n(300), None))[0]) == (0, 300)
    tail, single = one(windows.tail_times(n(0), n(30), 8), windows.uniform_times(n(3), n(9), 1))
    assert tail == [22 + k * 8 / 7 for k in range(8)] and single == [9]
    assert one(windows.clamp_time(n(10.0005), n(0), n(10)), windows.clamp_time(n("nan"), n(0), n(10)), windows.clamp_time(n(11), n(0), n(10))) == (10.0, None, None)
    assert one(windows.frame_indices(F.lit(11), 3), windows.trimmed_indices(F.lit(100), 3)) == ([0, 5, 10], [5, 50, 95])


YES = '{"question_no_leak": true, "not_answerable_at_query_time": %s, "answerable_at_answer_time": %s}'


def test_json(spark):
    body = lambda checks, verdict: '{"checks": %s, "verdict": "%s", "reason": "r"}' % (checks, verdict)  # noqa: E731,UP031
    cases = {
        body(YES % ("true", "true"), "pass"): ("pass", False), body(YES % ("false", "true"), "pass"): ("fail", True), body(YES % ("true", "true"), "fail"): ("pass", True),
        body(YES % ("true", '"true"'), "pass"): ("fail", True), body("{}", "fail"): ("fail", False), 'cut "verdict": "pass", "chec': ("fail", True),
        "text ```json\n" + body(YES % ("true", "true"), "pass") + "\n``` more": ("pass", False),
    }
    got = each(spark, list(cases), jsonrepair.verdict)
    assert [(g["verdict"], g["overridden"]) for g in got] == list(cases.values())
    assert each(spark, ["nothing", "", None], jsonrepair.verdict) == [None] * 3
    texts = ['[{"a": 1}] tail', '{"a": 1}', 'x ```\n[1, 2]\n``` y', "no", 'a {"b": {"c": 1}} d']
    assert each(spark, texts, lambda x: jsonrepair.repaired(x, jsonrepair.STREAMING)) == ['[{"a": 1}]', None, "[1, 2]", None, None]
    assert each(spark, texts, lambda x: jsonrepair.repaired(x, jsonrepair.VALIDATOR)) == ['{"a": 1}', '{"a": 1}', None, None, '{"b": {"c": 1}}']
    assert each(spark, texts[4:], lambda x: jsonrepair.repaired(x, jsonrepair.LEGACY_VALIDATOR)) == [None]
    assert each(spark, ['{"usage": 1}', '{"prompt_tokens": 3, "prompt_tokens_details": {"video_tokens": 2}}'], lambda x: jsonrepair.usage(x)["video_tokens"]) == [0, 2]


def test_row_validator(spark):
    q, kind = 90.0, "next_action"
    cases = [
        ((kind, "q", "a", "100", False), None), ((kind, "q", "a", "95.0", False), None), ((kind, "q", "a", "94.99", False), "too soon after query"), ((kind, "q", "a", "90", False), "not after query"),
        ((kind, "q", "a", "200.5", False), None), ((kind, "q", "a", "200.51", False), "beyond clip"), ((kind, "q", "a", "soon", False), "answer_time not a float"), ((kind, "q", "a", None, False), "answer_time not a float"),
        (("x", None, None, None, True), "model-skipped"), ((kind, " ", "a", "100", False), "empty question or answer"), ((kind, "q", "a", "NaN", False), "answer_time not a float"), (("x", "q", "a", "100", False), "unknown type"), (None, "not a dict"),
    ]
    df = spark.createDataFrame([(k, e, q, 200.0) for k, (e, _) in enumerate(cases)], "k int, entry struct<type:string,question:string,answer:string,answer_time:string,skip:boolean>, query_time double, clip_end double")
    assert [r["r"] for r in df.orderBy("k").select(qa.reject_reason().alias("r")).collect()] == [w for _, w in cases]


def test_record_and_samples(spark):
    clips = spark.createDataFrame([("S", 0, 0.0, 100.0, 0)], "video string, clip_idx int, start double, end double, ord int")
    on = spark.createDataFrame([("S", 0, "intent", "q", "A.", 0.0, 100.0, 40.0, 55.0, 0)], "video string, clip_idx int, type string, question string, answer string, clip_start double, clip_end double, query_time double, answer_time double, ord int")
    off = on.select("video", "clip_idx", "type", "question", "answer", F.lit(None).cast("double").alias("clip_start"), F.lit(5.0).alias("clip_end"), "ord").where("video = 'S'")
    got = {r["sample_type"]: r for r in qa.expanded(qa.bounded(off, clips), on).collect()}
    assert (got["streaming_wait"]["start"], got["streaming_wait"]["end"]) == (10, 40) and (got["streaming_answer"]["start"], got["streaming_answer"]["end"]) == (25, 55)
    assert got["streaming_wait"]["source_qa_id"] == "S_c0_stream_intent_tq40_ta55_000" and got["streaming_answer"]["target"] == "<ANSWER> A."
    assert (got["offline_answer"]["start"], got["offline_answer"]["end"]) == (0, 100)
    videos = clips.select("video")
    r = qa.records(qa.merged(off, on, clips), clips, videos).first()
    assert (r["num_qa"], r["num_clips"], r["type_counts"]) == (2, 1, {"intent": 2})
    assert [(q["source"], q["timestamp"]) for q in r["qa"]] == [("streaming", 40.0), ("offline", 50.0)]


def test_dual(spark):
    rows = [("offline", "q", "a", None), ("streaming", "q", "a", False), ("streaming", "q", "a", None), ("streaming", "q", "a", True), ("streaming", "", "a", False)]
    df = spark.createDataFrame(rows, "source string, question string, answer string, answerable_now boolean")
    kinds = lambda d: sorted(r["sample_type"] for r in d.collect())
    assert kinds(qa.dual_expanded(df)) == ["offline_answer"] + ["streaming_answer"] * 3 + ["streaming_wait"] * 2
    assert "streaming_wait" not in kinds(qa.dual_expanded(df, include_wait=False))
    chat = df.limit(1).select(qa.messages(F.lit("v.mp4"), F.lit(0), F.lit(9), F.lit("ask"), F.col("answer")).alias("m")).first()["m"]
    assert [m["role"] for m in chat] == ["user", "assistant"] and [b["type"] for b in chat[0]["content"]] == ["video", "text"]


def test_masks(spark):
    df = spark.createDataFrame([([1, 2, 3, 2, 3], [2, 3]), ([1], [1, 2]), ([], [1]), ([1], [])], "s array<int>, p array<int>")
    assert [r[0] for r in df.select(qa.last_position(F.col("s"), F.col("p"))).collect()] == [3, -1, -1, -1]
    assert df.limit(1).select(qa.label_mask(F.col("s"), F.lit(3), 7)).first()[0] == [-100, -100, -100, 2, 3, -100, -100]


def test_quality(spark):
    s = spark.range(1).select(quality.purity(F.lit(0.6), F.lit(0.2), F.lit(2), F.lit(8), F.lit(0.03), F.lit(0.2)).alias("s")).first()["s"]
    assert s == pytest.approx(29.0)
    assert each(spark, [75.0, 74.99, 55.0, 35.0, 34.9], quality.purity_class, "double") == ["pure", "mildly_annotated", "mildly_annotated", "heavily_annotated", "rejected"]
    rows = [("v", k, ["超声画面"] * 5 + ["医学影像", "讲课画面", None], "B" if k % 2 else "A", "x" if k > 3 else None) for k in range(8)]
    frames = spark.createDataFrame([(v, k, t[k], m, a) for v, k, t, m, a in rows], "video string, ord int, type string, modality string, anatomy string")
    r = quality.decisions(frames).first()
    assert (r["decision"], r["quality"], r["modality"], r["anatomy"]) == ("保留", 92, "A", ["x"])
    assert quality.timed_out(frames.where("ord < 2")).count() == 0


def test_acquire(spark):
    docs = spark.createDataFrame([(k, "x" if k % 3 else "y") for k in range(10)], "id int, t string")
    assert [r["id"] for r in acquire.first_wins(docs, ["t"], ["id"]).orderBy("id").collect()] == [0, 1]
    assert acquire.keep_until(docs, F.col("t") == "y", "id", 2).count() == 4 and acquire.keep_until(docs, F.col("t") == "y", "id", 50).count() == 10
    done = spark.createDataFrame([(1, "ok"), (2, "error")], "id int, state string")
    assert acquire.remaining(docs, done, "id").count() == 8 and acquire.remaining(docs, done, "id", retry=F.col("state") == "error").count() == 9
    assert acquire.years_back(2026) == list(range(2026, 2016, -1)) and acquire.years_back(2018) == [2018, 2017, 2016]
    assert spark.range(1).select(acquire.target_size(1), acquire.target_size(30), acquire.target_size(500)).first()[:] == (50, 120, 300)
    seed = spark.createDataFrame([(1, "s", 5), (2, "s", 6)], "id int, title string, n int")
    detail = spark.createDataFrame([(1, "", 7)], "id int, title string, n int")
    assert sorted(tuple(r) for r in acquire.over_seed(seed, detail, "id", ["title", "n"]).collect()) == [(1, "s", 7), (2, "s", 6)]
    assert each(spark, ["病例讲解型", "?", None], acquire.folder) == ["case_reasoning", "uncategorized", "uncategorized"]
    assert acquire.signature({"a": 1, "b": 2}, spark) == acquire.signature({"b": 2, "a": 1}, spark)
