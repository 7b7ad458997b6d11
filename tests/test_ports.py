"""Retries, signed tables, judges' edge cases, pixels, and runs that are repeated with other settings."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import jsonrepair, pixels
from millrace.operators import acquire, judges, qa, records, segment
from millrace.plans import lifecycle
from millrace.sources import files, media, ports


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(prompts):
        calls.append(len(prompts))
        if len(calls) < 3:
            raise OSError("HTTP 429" if len(calls) == 1 else "broken")
        return ["ok"] * len(prompts)

    assert ports.retrying(flaky, 3, waits.append)(["a", "b"]) == ["ok", "ok"] and waits == [60.0, 8.0 * 1.6]
    waits.clear()
    with pytest.raises(ValueError, match="no answer"):
        ports.retrying(lambda prompts: [None], 2, waits.append)(["a"])
    assert waits == [8.0, 8.0 * 1.6]


def test_waits_as_columns(spark):
    df = spark.createDataFrame([(1, False), (3, False), (2, True)], "n int, limited boolean")
    assert [round(r[0], 6) for r in df.select(ports.backoff(F.col("n"), F.col("limited"))).collect()] == [8.0, 20.48, 60.0]
    assert [round(r[0], 6) for r in df.select(ports.crawl_wait(F.col("n"), F.lit(0.5))).collect()] == [2.5, 6.5, 4.5]


def test_stored_tables_know_their_settings(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    made = []

    def make(word):
        made.append(word)
        return spark.createDataFrame([(word,)], "w string")

    for word, sign, want in (("a", "1", "a"), ("b", "1", "a"), ("c", "2", "c"), ("d", "2", "c")):
        assert files.stored(spark, root, lambda: make(word), sign).first()["w"] == want  # noqa: B023
    assert made == ["a", "c"]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert files.contents(df) == files.contents(df.orderBy(F.desc("a"))) != files.contents(df.withColumn("b", F.lit("y")))


def test_a_document_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    one = spark.createDataFrame([(1,)], "a int")
    files.write_document(one, path)
    with pytest.raises(FileExistsError):
        files.write_document(one, path)
    files.write_document(one.select((F.col("a") + 1).alias("a")), path, overwrite=True)
    assert files.read_text(spark, path).replace(" ", "").replace("\n", "") == '{"a":2}'
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["d.json"]
    assert files.first_existing(spark, None, f"file://{tmp_path}/no", path) == path
    assert files.first_existing(spark, "given", path) == "given" and files.first_existing(spark, None, f"file://{tmp_path}/no") is None


def test_evaluation_asks_again_for_other_settings(spark, tmp_path):
    asked = []
    samples = spark.createDataFrame([(1, "streaming_wait", "t", "q", "<WAIT> w", 0.0, 9.0)], "idx int, sample_type string, qa_type string, question string, target string, start double, end double")
    root = f"file://{tmp_path}/eval"

    def made(text):
        model = lambda: lambda prompts: [text] * len(prompts)
        model.model = text
        asked.append(text)
        return model

    label = lambda model, rows=samples, **k: lifecycle.evaluation_run(rows, model, root, **k)["predictions"].first()["prediction"]
    assert label(made("<WAIT> one")) == "<WAIT> one"
    assert label(made("<WAIT> two")) == "<WAIT> two"  # another model
    assert label(made("<WAIT> two"), samples.withColumn("question", F.lit("other"))) == "<WAIT> two"
    model = made("<WAIT> two")
    before = files.read_text(spark, f"{root}/predictions/_signature")
    assert label(model, n_frames=4) == "<WAIT> two" and files.read_text(spark, f"{root}/predictions/_signature") != before


def test_missing_keys_have_a_reason_of_their_own(spark):
    raw = ['{"type":"next_action","answer":"a","answer_time":"50"}', '{"type":"next_action","question":null,"answer":"a","answer_time":"50"}', '{"type":"next_action","question":"q","answer":"a","answer_time":"50"}', '{"type":"next_action","question":"q","answer":"a"}']
    rows = spark.createDataFrame([(x, 1.0, 90.0) for x in raw], "raw string, query_time double, clip_end double").withColumn("entry", F.from_json("raw", lifecycle.ENTRY))
    got = [r[0] for r in rows.select(qa.reject_reason(keys=F.json_object_keys("raw"))).collect()]
    assert got == ["missing key: question", "empty question or answer", None, "missing key: answer_time"]


def test_parsers(spark):
    texts = ['{"verdict":"pass","reason":"r', "```json\n[1, 2]\n```", "x [1, {\"a\": 2}] y", "x {\"a\": {\"b\": 1}} {\"c\"", "", "```\n{\"k\": 1}\n``` {\"z\": 2}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(jsonrepair.legacy_verdict(F.col("t")).alias("v"), jsonrepair.ablation_answer(F.col("t")).alias("a"), jsonrepair.frame_answer(F.col("t")).alias("f")).collect()
    assert (out[0]["v"]["verdict"], out[0]["v"]["reason"]) == ("pass", "r [truncated]") and out[4]["v"] is None
    assert out[1]["a"] == "[1, 2]" and out[2]["a"] == '[1, {"a": 2}]' and '"_parse_error":true' in out[4]["a"] and out[5]["a"] == '{"k": 1}'
    assert out[5]["f"] == '{"k": 1}' and out[3]["f"] == '{"b": 1}' and "解析失败" in out[4]["f"]


def test_judges_without_an_answer(spark):
    segs = spark.createDataFrame([("v", 0, 0.0, 5.0, "a."), ("v", 1, 5.0, 9.0, "b")], "video string, ord int, start double, end double, text string")
    changes = spark.createDataFrame([("v", 0, 0.0, 0.1, True)], "video string, ord int, start double, similarity double, scene_change boolean")
    assert judges.verified_cuts(segs, changes, lambda: lambda p: ["no"] * len(p)).count() == 0
    cuts = judges.verified_cuts(segs, changes, lambda: lambda p: ['{"final_cuts": [{"segment_index": 1, "topic": "t"}]}'] * len(p))
    assert [tuple(r) for r in cuts.collect()] == [("v", 1, "t", False, "")]
    assert segment.by_cuts(segs, cuts.drop("last_topic"), min_len=0.0).count() == 2
    rows = spark.createDataFrame([("q", 3.0)], "question string, query_time double")
    r = judges.leaks(rows, lambda: lambda p: ['{"question_valid": "true", "reason": "x"}'] * len(p)).first()
    assert r["question_valid"] is False and r["judgement"] == "x"


def test_words_before_reads_on(spark):
    words = spark.createDataFrame([("v", 1.0, "a"), ("v", 2.0, "b"), ("v", 5.0, "c"), ("w", 0.0, "x")], "video string, start double, text string")
    asks = spark.createDataFrame([("v", 2.0), ("v", 6.0), ("v", 7.0), ("u", 1.0)], "video string, at double")
    got = sorted(tuple(r) for r in records.words_before(words, asks).collect())
    assert got == [("u", 1.0, 0, ""), ("v", 2.0, 1, "a"), ("v", 6.0, 3, "b c"), ("v", 7.0, 3, "")]


def test_frames_fall_back(spark):
    class Port:
        def frame(self, path, index):
            return None if path == "none" or index in (3, 4) else str(index).encode()

    assert media.frames_of(Port(), "p", [3, 1, 4, 2]) == [b"0", b"1", b"1", b"2"]
    with pytest.raises(ValueError, match="no frame"):
        media.frames_of(Port(), "none", [1])
    with pytest.raises(KeyError):
        media.setting(spark, "no_such_setting")


def test_seeds_stop_at_their_target(spark):
    plan = spark.createDataFrame([("a", "m", 0), ("b", "m", 1), ("c", "m", 2)], "term string, mode string, ord int")

    def search():
        def one(target):
            if ":b" in target:
                raise OSError("gone")
            return [{"id": f"{target[-1]}{k}", "title": "t"} for k in range(4)] + [{"id": "same", "title": "t"}]

        return one

    seeds, cursor = acquire.collect_seeds(plan, search, 3, 5, block=1)
    assert [r["id"] for r in seeds.orderBy("ord").collect()] == ["a0", "a1", "a2"] and cursor == 1
    seeds, cursor = acquire.collect_seeds(plan, search, 100, 5, seeds, cursor, block=1)
    assert [r["id"] for r in seeds.orderBy("ord").collect()] == ["a0", "a1", "a2", "c0", "c1", "c2", "c3", "same"] and cursor == 3


def test_pixel_features():
    grey = np.full((100, 100), 30, np.uint8)
    assert pixels.canny(grey, 50, 150).sum() == 0 and pixels.text_score(grey) == 0 and pixels.bright_blocks(grey) == 0
    grey[20:70, 30:80] = 255
    edges = pixels.canny(grey, 50, 150)
    assert 150 <= edges.sum() <= 420 and not edges[40:50, 45:60].any() and edges[18:22, 40:70].any()
    assert pixels.bright_blocks(grey) == pytest.approx(49 * 49 / 10_000, rel=1e-6)  # the outline through the outer pixels
    grey[40:44, 50:54] = 0  # a hole is filled
    assert pixels.bright_blocks(grey) == pytest.approx(49 * 49 / 10_000, rel=1e-6)
    page = np.full((200, 200), 20, np.uint8)
    for x in range(20, 180, 4):
        page[100:106, x : x + 2] = 250
    assert 0.02 < pixels.text_score(page) < 0.15 and pixels.text_score(page.T) < pixels.text_score(page)
    number, n = pixels.components(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert n == 2 and number[0, 0] == number[1, 1] == number[0, 2] != number[3, 0]
    assert pixels.components(np.array([[1, 0], [0, 1]], bool), diagonal=False)[1] == 2
    assert pixels.grown(np.eye(5, dtype=bool), 3, 1).sum() == 13


def test_frame_rows(spark):
    rgb = np.zeros((20, 20, 3), np.uint8)
    rgb[5:15, 5:15] = 255
    df = spark.createDataFrame([(bytearray(rgb.tobytes()), 20, 20), (None, 20, 20), (bytearray(b"ab"), 20, 20)], "p binary, h int, w int")
    rows = [r[0] for r in df.select(pixels.frame_row(F.col("p"), F.col("h"), F.col("w"), lambda grey: bool(grey.mean() > 10))).collect()]
    assert rows[0]["grayscale"] == 1.0 and rows[0]["bright"] == pytest.approx(81 / 400) and rows[0]["face"] is True and 0 < rows[0]["edges"] < 0.3
    assert rows[1]["bright"] is None and rows[2]["face"] is None


def drawn(height, width, seed):
    """Noise, blocks, stripes and a bright frame with a hole and a spot in it."""
    rng = np.random.default_rng(seed)
    noise = rng.integers(0, 256, (height, width, 3))
    blocks = np.kron(rng.integers(0, 2, (height // 5 + 1, width // 7 + 1, 1)) * 255, np.ones((5, 7, 3)))[:height, :width]
    stripes, ring = np.full((height, width, 3), 20), np.zeros((height, width, 3))
    stripes[height // 2 : height // 2 + 5, 4:-4:3] = 250
    ring[height // 8 : -height // 8, width // 8 : -width // 8] = 255
    ring[height // 4 : -height // 4, width // 4 : -width // 4] = 0
    ring[height // 2, width // 2] = 255
    return [x.astype(np.uint8) for x in (noise, blocks, stripes, ring)]


def test_stacks_are_their_frames(spark):
    """Frames of one size are computed together, as each is alone, whatever lies beside it."""
    for height, width in ((100, 160), (20, 20), (9, 31)):
        frames = [f for seed in range(5) for f in drawn(height, width, seed)]
        stack = list(zip(*(x.tolist() for x in pixels.all_features(np.stack(frames), lambda grey: bool(grey.mean() > 100))), strict=True))
        alone = [tuple(x.tolist()[0] for x in pixels.all_features(f[None], lambda grey: bool(grey.mean() > 100))) for f in frames]
        assert stack == alone and len(set(stack)) > 8
        greys = pixels.light(np.stack(frames))
        assert [(s, b) for _, _, _, s, _, b, _ in stack] == [(pixels.text_score(g), pixels.bright_blocks(g)) for g in greys]
    rows = [(k, bytearray(f.tobytes()), *f.shape[:2]) for k, f in enumerate([*drawn(20, 20, 1), *drawn(9, 31, 1), *drawn(20, 20, 2)])]
    rows += [(50, rows[0][1], -20, -20), (51, rows[0][1], 20, None), (52, bytearray(), 0, 0), (53, None, 20, 20)]
    df = spark.createDataFrame(rows, "k int, p binary, h int, w int").coalesce(1)
    got = {r["k"]: tuple(r["f"]) for r in df.select("k", pixels.frame_row(F.col("p"), F.col("h"), F.col("w")).alias("f")).collect()}
    for k, p, h, w in rows:
        want = [x.tolist()[0] for x in pixels.all_features(np.frombuffer(p, np.uint8).reshape(1, h, w, 3))] if k < 50 else [None] * 7
        assert got[k] == tuple(round(x, 4) if isinstance(x, float) else x for x in want)


@pytest.mark.parametrize("diagonal", [True, False])
def test_parts_are_those_of_a_flood(diagonal):
    rng = np.random.default_rng(3)
    masks = [rng.random((6, 17, 23)) < share for share in (0, 0.2, 0.45, 0.6, 1)]
    maze = np.zeros((1, 41, 41), bool)
    for k in range(0, 20, 2):  # a spiral
        maze[0, k, max(k - 1, 0) : 41 - k] = maze[0, k : 41 - k, 40 - k] = maze[0, 40 - k, k : 41 - k] = maze[0, k + 2 : 41 - k, k] = True
    for stack in (*masks, maze, maze.transpose(0, 2, 1), masks[2][:, :1], masks[2][:, :, :1]):
        want, n = np.zeros(stack.shape, int), 0
        for seed in map(tuple, np.argwhere(stack)):
            if want[seed]:
                continue
            n += 1
            want[seed], todo = n, [seed]
            while todo:
                p, r, c = todo.pop()
                for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if diagonal or not i or not j):
                    at = p, r + i, c + j
                    if 0 <= at[1] < stack.shape[1] and 0 <= at[2] < stack.shape[2] and stack[at] and not want[at]:
                        want[at] = n
                        todo.append(at)
        number, count = pixels.components(stack, diagonal)
        assert count == n and np.array_equal(number, want)


def test_frames_are_dealt_out(spark, tmp_path):
    """One file of one row group, whose frames would all be one task's."""
    from millrace.plans import coverage

    spark.range(40).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = coverage.frame_rows(spark, str(tmp_path)).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks >= spark.sparkContext.defaultParallelism
