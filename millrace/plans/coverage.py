"""Queries over the operators that no other query reaches: scalars, parsers, records, reports, jobs, shells, files."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonrepair, windows
from ..functions import text as T
from ..operators import acquire, judges, qa, quality, records, reports, segment
from ..sources import files, media, ports
from ..sources.tables import PREDICTIONS_SQL, QA_SQL, SEGMENTS_SQL, predictions, qa_rows, segments, table
from ..streaming import answers
from . import lifecycle
from .queries import counted

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counted(sql)
        return f

    return add


def _nth(k: Column, *values: str | None) -> Column:
    """A value by remainder."""
    return F.array(*[F.lit(v).cast("string") for v in values])[(k % len(values)).cast("int")]


# ---- scalars --------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_name FROM customer)
SELECT k, seg || '|a|' || (k % 3) AS keywords, CASE WHEN k % 2 = 0 THEN 'x,y' ELSE 'own' END AS terms, (2 + k % 4)::INT AS tokens, k % 3 = 2 AS truthy, k || '.tar' AS stem,
  ['.png', '.jpg', '.jpg', '.jpeg'][k % 4 + 1] AS suffix, [true, true, false, true][k % 4 + 1] AS limited, ['keep', 'trim', 'discard', NULL][k % 4 + 1] AS recommended,
  printf('%.1f%%', (k % 9) * 12.5::DOUBLE) AS share, left(c_name, 10) || '...' AS short, array_to_string(['a', 'b', 'c', 'd', 'e', 'f', 'g', 'h'][1:(2 * (k % 5))], ' ') AS first_words,
  CASE WHEN k % 2 = 0 THEN 'zh,en' ELSE 'en' END AS langs, CASE WHEN k % 3 = 0 THEN 'd' WHEN k % 3 = 1 THEN 'two' ELSE '' END AS thumbnail, k % 4 = 0 AS strictly, k % 2 = 0 AS both_tracks,
  ['scan_tutorial', 'case_reasoning', 'uncategorized'][k % 3 + 1] AS folder, 'data:video/mp4;base64,' || to_base64(encode(k::VARCHAR)) AS url FROM c""")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text and flag functions over one row a customer."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    strings = lambda x: F.array_join(x, ",")
    own = F.when(k % 2 == 0, F.create_map(F.lit("zh"), F.lit("1")))
    listed = F.when(k % 3 == 1, F.array(F.struct(F.lit("one").alias("url")), F.struct(F.lit("two").alias("url"))))
    formats = F.array(F.struct(F.lit("none").alias("acodec"), F.lit("v").alias("vcodec")), F.struct(F.lit("a").alias("acodec"), F.when(k % 2 == 0, "v").otherwise("").alias("vcodec")))
    return table(spark, sf_dir, "customer").select(
        k.alias("k"), F.array_join(T.split_keywords(F.concat(seg, F.lit(", a,"), seg, F.lit("; \n"), (k % 3).cast("string"))), "|").alias("keywords"),
        strings(T.effective_terms(F.when(k % 2 == 1, F.array(F.lit("own"))), ["x", "y"])).alias("terms"),
        T.n_tokens(F.concat(F.lit("  a b"), F.repeat(F.lit(" c"), (k % 4).cast("int")), F.lit(" "))).alias("tokens"), T.truthy(_nth(k, "", None, "false")).alias("truthy"),
        T.stem(F.concat(F.lit("/x/y/"), k.cast("string"), F.lit(".tar.mp4"))).alias("stem"), T.image_suffix(F.concat(F.lit("http://h/p"), _nth(k, ".PNG?x=1", ".gif", "", ".jpeg#f"))).alias("suffix"),
        T.is_rate_limit(_nth(k, "HTTP 429", "Rate limit", "broken", "separate")).alias("limited"), T.recommendation(_nth(k, "pure_ultrasound", "mixed", "ppt_lecture", "other")).alias("recommended"),
        reports.percent((k % 9) / F.lit(8.0)).alias("share"), records.shortened(F.col("c_name"), 10, "...").alias("short"),
        records.first_words(F.lit("a b  c d e f g h"), (k % 5) / F.lit(4.0)).alias("first_words"), strings(T.subtitle_langs(own, F.create_map(F.lit("en"), F.lit("2")))).alias("langs"),
        T.thumbnail(_nth(k, "d", " ", None), listed).alias("thumbnail"), T.strict_true(_nth(k, '{"a": true}', '{"a": "true"}', '{"a": false}', "no"), "$.a").alias("strictly"),
        acquire.has_both_tracks(formats).alias("both_tracks"), acquire.folder(_nth(k, "扫查教学型", "病例讲解型", "else")).alias("folder"), files.data_url(k.cast("string").cast("binary")).alias("url"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 130 - 10 AS x, 100 + o_custkey % 900 AS n FROM orders)
SELECT k, CASE WHEN x BETWEEN 0 AND 100 THEN x::DOUBLE END AS clamped, array_to_string(list_transform(range(5), lambda i: floor(n * 0.1::DOUBLE + i * ((n * 0.9::DOUBLE - n * 0.1::DOUBLE) / 4))::BIGINT), ',') AS preview,
  floor(n * 0.1::DOUBLE)::BIGINT AS low, floor(n * 0.9::DOUBLE)::BIGINT AS high, array_to_string(list_transform([0, 1, 2, 400], lambda t: least(t * 25, n - 1)::BIGINT), ',') AS read_at,
  least(96::DOUBLE, CASE WHEN x >= 96 THEN least(96, x + 0.5::DOUBLE) ELSE x + 10 END) AS after_end, [8.0::DOUBLE, 12.8::DOUBLE, 20.48::DOUBLE, 60.0::DOUBLE][k % 4 + 1] AS wait_seconds,
  least(300, greatest(x + 30, x * 4, 50))::BIGINT AS wanted, least(7000, x + greatest(8 * 12, 80))::BIGINT AS refill, x - 20 <= 20 AS due, 'ytsearch12:t' || k AS search, 'https://www.youtube.com/shorts/v' || k AS second_page FROM o""")
def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows, frame numbers, waits and targets over one row an order."""
    k, x, n = F.col("o_orderkey"), F.col("o_orderkey") % 130 - 10, 100 + F.col("o_custkey") % 900
    text = lambda a: F.array_join(F.transform(a, lambda i: i.cast("string")), ",")
    positions = windows.sample_positions(n)
    return table(spark, sf_dir, "orders").select(
        k.alias("k"), windows.clamp_time(x.cast("double"), F.lit(0.0), F.lit(100.0)).alias("clamped"), text(windows.preview_indices(n)).alias("preview"), positions[0].alias("low"), positions[2].alias("high"),
        text(windows.frames_at(F.array(*[F.lit(float(t)) for t in (0, 1, 2, 400)]), F.lit(25.0), n)).alias("read_at"), windows.after(x.cast("double"), F.lit(96.0), 10.0)["end"].alias("after_end"),
        F.round(ports.backoff(k % 4 + 1, k % 4 == 3), 6).alias("wait_seconds"), acquire.target_size(x).cast("long").alias("wanted"), acquire.refill_target(x, F.lit(12), F.lit(True)).cast("long").alias("refill"),
        acquire.refill_due(x, F.lit(20), F.lit(12)).alias("due"), acquire.search_query(F.lit("ytsearch"), 12, F.concat(F.lit("t"), k.cast("string"))).alias("search"), acquire.page_urls(F.concat(F.lit("v"), k.cast("string")))[1].alias("second_page"),
    )


@query("""WITH c AS (SELECT c_custkey AS k, '{"verdict":"pass","reason":"r' || c_custkey || '"}' AS b FROM customer)
SELECT k, CASE WHEN k % 5 = 4 THEN NULL ELSE 'pass' END AS verdict, CASE k % 5 WHEN 3 THEN 'cut' || k || ' [truncated]' WHEN 4 THEN NULL ELSE 'r' || k END AS reason,
  CASE WHEN k % 5 = 4 THEN '解析失败' WHEN k % 5 = 3 THEN '解析失败' ELSE 'none' END AS frame_type, CASE WHEN k % 5 IN (3, 4) THEN 'error' ELSE 'r' || k END AS ablation, CASE WHEN k % 5 IN (1, 3, 4) AND k % 5 <> 1 THEN 'error' ELSE 'ok' END AS cuts,
  k % 5 IN (3, 4) AS unrated, k % 5 <> 4 AND k % 5 <> 3 AS dual_ok, k % 5 = 2 AS legacy_list FROM c""")
def parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model texts, plain, fenced, inside prose, broken off or without JSON, through the parsers of all stages."""
    k = F.col("c_custkey")
    body = F.concat(F.lit('{"verdict":"pass","reason":"r'), k.cast("string"), F.lit('"}'))
    broken = F.concat(F.lit('{"verdict": "pass", "reason": "cut'), k.cast("string"))
    m = k % 5
    raw = F.when(m == 0, body).when(m == 1, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```\nok"))).when(m == 2, F.concat(F.lit("I say "), body, F.lit(" so"))).when(m == 3, broken).otherwise("nothing")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), raw.alias("raw")).withColumn("v", jsonrepair.legacy_verdict(F.col("raw")))
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    failed = lambda x: F.coalesce(field(x, "_parse_error") == "true", F.lit(False))
    ablation, r = jsonrepair.ablation_answer(F.col("raw")), F.col("raw")
    listed = jsonrepair.repaired(F.when(F.col("k") % 5 == 2, F.concat(F.lit("x ```json\n["), F.lit('{"a": 1}'), F.lit("]\n```"))).otherwise("{}"), jsonrepair.LEGACY_OFFLINE)
    return rows.select(
        "k", "v.verdict", "v.reason", F.coalesce(field(jsonrepair.frame_answer(r), "帧类型"), F.lit("none")).alias("frame_type"),
        F.when(failed(ablation), "error").otherwise(field(ablation, "reason")).alias("ablation"), F.when(failed(jsonrepair.cuts_answer(r)), "error").otherwise("ok").alias("cuts"),
        failed(jsonrepair.rating_answer(r)).alias("unrated"), jsonrepair.repaired(r, jsonrepair.DUAL).isNotNull().alias("dual_ok"), F.coalesce(listed.startswith("["), F.lit(False)).alias("legacy_list"),
    )


# ---- records and prompts --------------------------------------------------------------------------


@query(f"""WITH {QA_SQL}, d AS (SELECT *, 20.0::DOUBLE AS cs, 60.0::DOUBLE AS ce FROM qa WHERE type <> 'R' AND question <> 'q7')
SELECT video, clip_idx, ord::INT AS ord, query_time AS question_time, least(answer_time, 60.0::DOUBLE) AS answer_time, greatest(20.0::DOUBLE, query_time - 30) AS seen_from
FROM d WHERE query_time BETWEEN 20 AND 60 AND answer_time <= 60""")
def dual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual rows that pass, with clamped times and what was seen."""
    rows = qa_rows(spark, sf_dir).where("status IS NOT NULL").withColumns({"qa_type": F.col("type"), "question": F.when(F.col("question") == "q7", " ").otherwise(F.col("question")), "clip_start": F.lit(20.0), "clip_end": F.lit(60.0), "question_time": F.col("query_time")})
    out = records.dual_rows(rows, ["A", "N"])
    return out.select("video", "clip_idx", "ord", "question_time", "answer_time", F.col("visual_context.start").alias("seen_from"))


@query(f"""WITH {QA_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY video, clip_idx ORDER BY ord) - 1 AS n FROM qa WHERE type IN ('A', 'N') AND status = 'O' AND query_time <= 40)
SELECT video, ord::INT AS ord, printf('%s_c%d_t%03d', video, clip_idx, n) AS qa_id, 0.0::DOUBLE AS input_start, query_time AS input_end,
  'Time: ' || printf('%.2f', query_time) || CASE WHEN ord % 2 = 0 THEN chr(10) || 'So far: h' ELSE '' END || chr(10) || 'Question: ' || question AS prompt FROM t""")
def timed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows asked at a time, numbered, with the prompt of a stream."""
    rows = qa_rows(spark, sf_dir).where("status = 'O'").withColumns({"qa_type": F.col("type"), "clip_start": F.lit(0.0), "clip_end": F.lit(40.0)})
    out = records.timed_rows(rows, ["A", "N"])
    prompt = records.streaming_prompt(F.col("question"), F.col("query_time"), F.when(F.col("ord") % 2 == 0, "h").otherwise(""))
    return out.select("video", "ord", "qa_id", "input_start", "input_end", prompt.alias("prompt"))


@query("""WITH o AS (SELECT o_orderkey AS k, 'v' || o_orderkey AS video, (o_orderkey % 50)::DOUBLE AS s, (o_orderkey % 50 + 30)::DOUBLE AS e, o_orderpriority AS topic FROM orders)
SELECT k, 'user:video,text;assistant:text' AS blocks, 30.0::DOUBLE AS length, CASE k % 3 WHEN 0 THEN 'map/' || k WHEN 1 THEN 'own/' || k ELSE 'default' END AS path,
  md5(concat_ws(chr(10), 'Video: ' || video, 'Clip: 3', 'From: ' || printf('%.2fs', s), 'To: ' || printf('%.2fs', e), 'Topic: ' || topic, 'Window: 30 s at 1 frames a second, 32 frames at most', 'Speech: (no speech)',
    'Answer as a JSON object with offline_qa (qa_type, question, answer, evidence) and streaming_qa (qa_type, question_time, answer_time, answerable_at_question_time, question, answer, evidence).')) AS prompt,
  '{"a":"1"}' AS known, CASE WHEN k % 2 = 0 THEN '{"a":"1","z":"9"}' ELSE '{"a":"1"}' END AS whole, 't1-7' AS chapters FROM o""")
def record_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, video blocks, paths, prompts, overflow columns and chapters of one row an order."""
    k, s = F.col("o_orderkey"), (F.col("o_orderkey") % 50).cast("double")
    said = qa.messages(F.lit("p"), s, s + 30, F.lit("ask"), F.lit("answer"))
    blocks = F.array_join(F.transform(said, lambda m: F.concat(m["role"], F.lit(":"), F.array_join(F.transform(m["content"], lambda b: b["type"]), ","))), ";")
    raw = F.when(k % 2 == 0, F.create_map(F.lit("a"), F.lit("1"), F.lit("z"), F.lit("9"))).otherwise(F.create_map(F.lit("a"), F.lit("1")))
    own, extra = records.with_overflow(raw, ["a", "b"])
    pathed = records.resolved_path(F.when(k % 3 == 0, "m").otherwise("x"), {"m": "map/"}, None, F.when(k % 3 == 1, "own/").otherwise(""), F.lit("default"))
    found = records.chapters(F.array(F.struct(F.lit("t").alias("title"), F.lit("1.9").alias("start_time"), F.lit("7").alias("end_time"))))
    prompt = records.dual_prompt(F.concat(F.lit("v"), k.cast("string")), F.lit(3), s, s + 30, F.col("o_orderpriority"), F.lit("  "))
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), blocks.alias("blocks"), records.video_struct(F.lit("p"), s, s + 30)["duration_sec"].alias("length"), F.concat(pathed, F.when(k % 3 < 2, k.cast("string")).otherwise("")).alias("path"), F.md5(prompt.cast("binary")).alias("prompt"), own.alias("own"), extra.alias("extra"), found.alias("c"))
    ordered = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    flat = records.flattened(F.col("own"), F.col("extra"))
    return rows.select("k", "blocks", "length", "path", "prompt", ordered(F.col("own")).alias("known"), ordered(flat).alias("whole"), F.concat(F.col("c")[0]["title"], F.col("c")[0]["start_time"], F.lit("-"), F.col("c")[0]["end_time"]).alias("chapters"))


@query("""WITH w AS (SELECT user_id AS video, event_id, floor(epoch(ts))::BIGINT AS t FROM events), a AS (SELECT DISTINCT video, t AS at FROM w WHERE event_id % 10 = 0)
SELECT a.video, a.at::DOUBLE AS at, count(w.t) AS cursor, count(CASE WHEN w.t >= coalesce((SELECT max(b.at) FROM a b WHERE b.video = a.video AND b.at < a.at), -1) THEN 1 END) AS new_words
FROM a LEFT JOIN w ON w.video = a.video AND w.t < a.at GROUP BY a.video, a.at""")
def words_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words before each ask (every tenth event), read on where the last ask stopped."""
    from ..sources.tables import seconds

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "event_id", seconds(F.col("ts")).alias("start"), F.lit("w").alias("text"))
    asks = e.where("event_id % 10 = 0").select("video", F.col("start").alias("at")).distinct()
    out = records.words_before(e, asks)
    return out.select("video", "at", "cursor", T.n_tokens(F.col("new_text")).cast("long").alias("new_words"))


@query("""WITH s AS (SELECT doc_id AS id, source AS title, lang AS note FROM documents), d AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS title, CASE WHEN toxic = 1 THEN 'toxic' ELSE '0' END AS note FROM labels)
SELECT s.id, CASE WHEN d.title = 'good' THEN 'good' ELSE s.title END AS title, CASE WHEN d.note = 'toxic' THEN 'toxic' ELSE s.note END AS note FROM s LEFT JOIN d USING (id)""")
def over_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels' words over their own where those say something."""
    seeds = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("note"))
    detail = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("").alias("title"), F.when(F.col("toxic") == 1, "toxic").otherwise("0").alias("note"))
    return acquire.over_seed(seeds, detail, "id", ["title", "note"])


@query("""WITH p AS (SELECT conv_id % 7 AS page, turn AS ord, text AS video_id FROM conversations WHERE conv_id % 7 <> 3), f AS (SELECT conv_id % 7 AS page, turn AS ord, role AS video_id FROM conversations),
u AS (SELECT * FROM p UNION ALL SELECT * FROM f WHERE page = 3) SELECT video_id, min(page * 100000 + ord)::BIGINT AS place FROM u GROUP BY video_id""")
def seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged results; a page that failed is filled from the fallback, the first row of an id counts."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 7).alias("page"), F.col("turn").alias("ord"), "text", "role")
    primary = c.where("page <> 3").select("page", "ord", F.col("text").alias("video_id"))
    out = records.search_seeds(primary, c.select("page", "ord", F.col("role").alias("video_id")))
    return out.select("video_id", (F.col("page") * 100_000 + F.col("ord")).cast("long").alias("place"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM lineitem)
SELECT CASE WHEN l_partkey % 3 = 0 THEN 'missing key: answer' WHEN l_partkey % 7 = 0 THEN 'empty question or answer' ELSE 'kept' END AS reason, count(*) AS n FROM l GROUP BY 1""")
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows without a key, which differ from those with an empty value."""
    p = F.col("l_partkey")
    raw = F.when(p % 3 == 0, '{"type":"next_action","question":"q","answer_time":"99"}').when(p % 7 == 0, '{"type":"next_action","question":"q","answer":"","answer_time":"99"}').otherwise('{"type":"next_action","question":"q","answer":"a","answer_time":"99"}')
    rows = table(spark, sf_dir, "lineitem").select(raw.alias("raw"), F.lit(1.0).alias("query_time"), F.lit(100.0).alias("clip_end")).withColumn("entry", F.from_json("raw", lifecycle.ENTRY))
    return rows.groupBy(F.coalesce(qa.reject_reason(keys=F.json_object_keys("raw")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, 'ANSWER' AS gt_label, CASE WHEN length(text) % 3 = 0 THEN 'WAIT' ELSE 'ANSWER' END AS pred_label, length(text) % 3 > 0 AS correct_answerability, 'a' AS target_answer_text FROM conversations""")
def prediction_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a model's text, both labels and whether they agree."""
    c = table(spark, sf_dir, "conversations").withColumn("target", F.lit("<ANSWER> a"))
    out = records.predictions(c, F.when(F.length("text") % 3 == 0, "<WAIT> later").otherwise("<ANSWER> it moves now"))
    return out.select("conv_id", "turn", "gt_label", "pred_label", "correct_answerability", "target_answer_text")


# ---- reports --------------------------------------------------------------------------------------


@query("""SELECT source AS category, count(*) AS n, count_if(n_chars % 2 = 0) AS media, count_if(n_chars % 3 = 0) AS thumbnails, count_if(n_chars % 6 = 0) AS paired FROM documents GROUP BY 1""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, media and thumbnails by category."""
    n = F.col("n_chars")
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.when(n % 2 == 0, "m").alias("media_file"), F.when(n % 3 == 0, "t").otherwise("").alias("thumbnail_file"), F.when(n % 6 == 0, True).alias("paired"))
    return reports.category_counts(d)


@query("""WITH v AS (SELECT l_orderkey AS video, sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) AS d, sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) AS t, count(*) AS frames, count_if(l_linenumber % 4 = 0) AS faces FROM lineitem GROUP BY 1)
SELECT video, frames, faces, round(d, 4) AS grayscale, round(t, 4) AS color FROM v""")
def frame_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of frame features a video."""
    f = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video"), (F.col("l_linenumber") % 4 == 0).alias("face"), F.round(F.col("l_discount") * 100).alias("grayscale"), F.round(F.col("l_tax") * 100).alias("color"), F.lit(0.0).alias("text"), F.lit(0.0).alias("bright"))
    return quality.video_means(f).select("video", "frames", "faces", "grayscale", "color")


_DECIDED = "SELECT doc_id AS video, n_chars::DOUBLE AS score, CASE doc_id % 5 WHEN 0 THEN '保留' WHEN 1 THEN '需要裁剪' WHEN 2 THEN '丢弃' WHEN 3 THEN '错误' END AS decision, CASE doc_id % 3 WHEN 0 THEN 'pure' WHEN 1 THEN 'rejected' ELSE 'mildly_annotated' END AS category FROM documents"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("video"), F.col("n_chars").cast("double").alias("score"), _nth(i, quality.KEEP, quality.TRIM, quality.DISCARD, quality.FAILED, None).alias("decision"), _nth(i, "pure", "rejected", "mildly_annotated").alias("category"))


@query(f"""WITH v AS ({_DECIDED}) SELECT 'decisions' AS what, count(*) AS total, count_if(decision = '保留') AS a, count_if(decision = '需要裁剪') AS b, count_if(decision = '丢弃') AS c, count_if(decision = '错误') AS d FROM v
UNION ALL SELECT 'classes', count(*), count_if(category = 'pure'), count_if(category = 'mildly_annotated'), 0, count_if(category = 'rejected') FROM v
UNION ALL SELECT 'enough', count(*), 0, 0, 0, 0 FROM v WHERE score >= 500 UNION ALL SELECT 'chosen', count(*), 0, 0, 0, 0 FROM v WHERE decision IN ('保留', '需要裁剪')""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by decision and class, and the videos that a score or a decision selects."""
    v, zero = _decided(spark, sf_dir), F.lit(0).cast("long")
    name = lambda df, what, *c: df.select(F.lit(what).alias("what"), *[x.alias(n) for x, n in zip(c, ("total", "a", "b", "c", "d"), strict=True)])
    out = name(quality.decision_counts(v), "decisions", *map(F.col, ("total", "keep", "trim", "discard", "errors")))
    out = out.unionByName(name(reports.score_counts(v), "classes", F.col("n"), F.col("pure"), F.col("mildly_annotated"), F.col("heavily_annotated"), F.col("rejected")))
    for what, df in (("enough", quality.at_least(v, 500)), ("chosen", quality.chosen(v, quality.KEEP, quality.TRIM))):
        out = out.unionByName(name(df.agg(F.count("*").alias("n")), what, F.col("n"), *[zero] * 4))
    return out


@query("""WITH r AS (SELECT event_type AS mode, user_id::DOUBLE AS seconds, CASE WHEN event_id % 4 > 0 THEN event_id END AS tokens FROM events), m AS (SELECT mode, count(*) AS calls, sum(seconds) AS seconds, sum(coalesce(tokens, 0))::BIGINT AS tokens FROM r GROUP BY 1)
SELECT mode, calls, seconds, tokens, seconds / calls AS seconds_a_call, seconds / (SELECT min(seconds) FROM m) AS times_fastest FROM m""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, time and tokens by input mode."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("mode"), F.col("user_id").cast("double").alias("seconds"), F.when(F.col("event_id") % 4 > 0, F.col("event_id")).alias("tokens"))
    return reports.mode_comparison(e)


@query("""WITH c AS (SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1) SELECT type || ': ' || n || ' (' || printf('%.1f%%', n * 100.0::DOUBLE / (SELECT sum(n) FROM c)) || ')' AS line, n FROM c
UNION ALL SELECT 'attempted ' || count(*) || ', kept ' || count_if(event_type = 'click') || ', failed ' || count_if(event_type = 'error'), count(*) FROM events""")
def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a console shows: counts by type, and a run's counters."""
    e = table(spark, sf_dir, "events")
    lines = reports.summary_lines(e.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n")), "type")
    outcome = F.when(F.col("event_type") == "click", "kept").when(F.col("event_type") == "error", "failed").otherwise("other")
    run = reports.run_counters(e.select(outcome.alias("outcome")))
    return lines.unionByName(run.select(F.format_string("attempted %d, kept %d, failed %d", "attempted", "kept", "failed").alias("line"), F.col("attempted").alias("n")))


@query("""WITH d AS (SELECT doc_id, n_chars / 5 AS w, (1 + doc_id % 400)::DOUBLE AS s, (doc_id % 90) / 10.0::DOUBLE AS loss FROM documents)
SELECT doc_id, w::BIGINT AS n_words, CASE WHEN loss BETWEEN 1.5 AND 6.5 THEN true ELSE false END AS in_band FROM (SELECT *, floor(w)::BIGINT AS w2 FROM d) WHERE floor(w) / s BETWEEN 1 AND 4""".replace("w::BIGINT AS n_words", "w2 AS n_words"))
def speech_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips whose words a second lie in a band, and whether their loss does."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 5).alias("n_words"), (1 + i % 400).cast("double").alias("duration"), ((i % 90) / F.lit(10.0)).alias("loss"))
    kept = reports.merged_words(rows)
    inside = reports.loss_band(kept).select("doc_id", F.lit(True).alias("in_band"))
    return kept.join(inside, "doc_id", "left").select("doc_id", "n_words", F.coalesce("in_band", F.lit(False)).alias("in_band"))


@query(f"""WITH {SEGMENTS_SQL}, lo AS (SELECT video, min(start) AS s FROM seg GROUP BY 1), c AS (SELECT video, k AS clip_idx, s + k * 3000 AS cs, s + k * 3000 + 3000 AS ce FROM lo, range(5) t(k)),
i AS (SELECT c.video, c.clip_idx, count(*) AS inside FROM c JOIN seg ON seg.video = c.video AND seg.start >= c.cs AND seg."end" <= c.ce GROUP BY 1, 2)
SELECT c.video, count(i.inside) AS clips, coalesce(sum(i.inside), 0)::BIGINT AS inside, round(count(*) * 3000.0::DOUBLE * 100 / 20000, 1) AS coverage_pct FROM c LEFT JOIN i USING (video, clip_idx) GROUP BY c.video""")
def clip_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that lie wholly in a clip, and the share of a video that its clips cover."""
    s = segments(spark, sf_dir)
    lows = s.groupBy("video").agg(F.min("start").alias("s"))
    clips = lows.select("video", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("clip_idx"), "s").select("video", "clip_idx", (F.col("s") + F.col("clip_idx") * 3000).alias("start"), (F.col("s") + F.col("clip_idx") * 3000 + 3000).alias("end"))
    inside = segment.contained(s, clips).groupBy("video").agg(F.count_distinct("clip_idx").alias("clips"), F.count("*").alias("inside"))
    pct = segment.coverage(clips, lows.select("video", F.lit(20000.0).alias("duration")))
    return pct.join(inside, "video", "left").select("video", F.coalesce("clips", F.lit(0).cast("long")).alias("clips"), F.coalesce("inside", F.lit(0).cast("long")).alias("inside"), "coverage_pct")


# ---- jobs and streams -----------------------------------------------------------------------------


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id AS job, max(CASE WHEN k = 1 THEN event_type END) AS status, count(CASE WHEN k <= 20 THEN 1 END)::INT AS lines, sum(CASE WHEN k <= 20 THEN event_id END)::BIGINT AS line_sum FROM e GROUP BY 1""")
def job_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest status and the last twenty log lines of each job."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.col("event_type").alias("status"), F.col("event_id").alias("line"))
    out = answers.job_status(log, 20)
    return out.select("job", "status", F.size("logs").alias("lines"), F.aggregate("logs", F.lit(0).cast("long"), lambda a, x: a + x).alias("line_sum"))


@query("""WITH w AS (SELECT user_id AS video, event_id, floor(epoch(ts))::BIGINT - min(floor(epoch(ts))::BIGINT) OVER (PARTITION BY user_id) AS t FROM events), k AS (SELECT *, CASE WHEN t < 7200 THEN 0 ELSE (t - 7200) // 3600 + 1 END AS chunk FROM w),
m AS (SELECT video, max(chunk) AS most FROM k GROUP BY 1) SELECT m.video, c.chunk::BIGINT AS chunk, (SELECT count(*) FROM k WHERE k.video = m.video AND k.chunk = c.chunk) AS words, (7200 + c.chunk * 3600)::DOUBLE AS "end" FROM m, LATERAL (SELECT unnest(generate_series(0, m.most)) AS chunk) c""")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by chunk: the first is two hours, the others one; silent ones inside stay."""
    from pyspark.sql import Window

    from ..sources.tables import seconds

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), seconds(F.col("ts")).alias("at"), F.lit("w").alias("text"))
    e = e.withColumn("start", F.col("at") - F.min("at").over(Window.partitionBy("video")))
    out = answers.chunks(e, 7200.0, 3600.0)
    return out.select("video", "chunk", T.n_tokens(F.col("text")).cast("long").alias("words"), "end")


@query(f"WITH {PREDICTIONS_SQL} SELECT pred_label, count(*) AS n, count_if(correct_answerability) AS correct FROM p GROUP BY 1")
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and right ones so far, as a stream of predictions ends: batches of a file source through a complete sink."""
    root = files.scratch(spark, "running")
    rows = predictions(spark, sf_dir).select("pred_label", "correct_answerability")
    rows.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    running = answers.running_accuracy(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def as_they_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a stream written batch by batch, and what then lies in the sink."""
    root = files.scratch(spark, "as-they-come")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    e.repartition(3).write.parquet(f"{root}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    reports.as_they_come(stream, lambda rows: rows.write.mode("append").parquet(f"{root}/out"), f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# ---- shells around models and media ---------------------------------------------------------------


def cuts_stub(prompts: list[str]) -> list[str]:
    """Keeps the first candidate, refuses the second, adds a cut at segment 3; short transcripts get no object."""
    out = []
    for p in prompts:
        found = [int(x) for x in re.findall(r"^segment (\d+) at", p, re.M)]
        final = [{"segment_index": x, "should_cut": k == 0, "topic": f"t{x}"} for k, x in enumerate(found[:2])]
        body = json.dumps({"final_cuts": final, "additional_cuts": [{"segment_index": 3, "topic": "more"}], "last_topic": "end"})
        out.append("no" if "\n[5] " not in p else f"Here:\n{body}")
    return out


@query(f"""WITH {SEGMENTS_SQL}, n AS (SELECT video, count(*) AS n, min(CASE WHEN event_id % 3 = 0 THEN ord END) AS first FROM seg GROUP BY 1 HAVING count(*) > 5)
SELECT video, first::INT AS ord, 't' || first AS topic, false AS additional, 'end' AS last_topic FROM n WHERE first IS NOT NULL UNION ALL SELECT video, 3, 'more', true, 'end' FROM n""")
def verified_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts that a judge keeps of the candidates, and those that it adds."""
    s = segments(spark, sf_dir)
    changes = s.select("video", "ord", "start", F.lit(0.1).alias("similarity"), (F.col("event_id") % 3 == 0).alias("scene_change"))
    return judges.verified_cuts(s, changes, lambda: cuts_stub)


def rating_stub(prompts: list[str]) -> list[str]:
    """A score by the number of clips; every text of more than four clips breaks off."""
    n = [len(re.findall(r"^Clip \d+:", p, re.M)) for p in prompts]
    return [json.dumps({"overall_score": k / 2, "clip_scores": [], "issues": ["x"] * k}) if k <= 4 else '{"overall_score": 4' for k in n]


@query("""SELECT 'v' || l_orderkey AS video, CASE WHEN count(*) <= 4 THEN count(*) / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS overall_score, CASE WHEN count(*) <= 4 THEN count(*)::INT ELSE 0 END AS issues, count(*) > 4 AS failed FROM lineitem GROUP BY l_orderkey""")
def rated_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's score of each video's clips; 0 where its text can't be read."""
    clips = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), F.col("l_orderkey")).alias("video"), F.col("l_linenumber").alias("clip_idx"), F.lit(0.0).alias("start"), F.col("l_quantity").alias("end"), F.lit("t").alias("topic"), F.col("l_returnflag").alias("text"))
    return judges.rated(clips, lambda: rating_stub).select("video", "overall_score", F.coalesce(F.size("issues"), F.lit(0)).alias("issues"), "failed")


def frame_stub(prompts: list[str]) -> list[str]:
    """A frame's class by its number's last digit, fenced, or nothing that can be read."""
    kinds = ("超声画面", "医学影像", "讲课画面", "PPT幻灯片")
    return ["?" if int(p) % 10 == 9 else f'```json\n{{"帧类型": "{kinds[int(p) % 4]}", "模态": "B"}}\n```' for p in prompts]


@query("""WITH f AS (SELECT user_id AS video, CASE WHEN event_id % 10 <> 9 THEN event_id % 4 END AS k FROM events), g AS (SELECT video, count(*) AS n, count_if(k < 2) AS images, count_if(k >= 2) AS lectures, count_if(k IS NOT NULL) AS b FROM f GROUP BY 1)
SELECT video, n, images, lectures, CASE WHEN b > 0 THEN 'B' ELSE '无' END AS modality, CASE WHEN images::DOUBLE / n >= 0.7 THEN '保留' WHEN images::DOUBLE / n >= 0.4 THEN '需要裁剪' ELSE '丢弃' END AS decision FROM g""")
def classified_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as a model names them, and the decision on their video."""
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("frame"))
    return judges.classified_videos(f, "frame", lambda: frame_stub).select("video", "n", "images", "lectures", "modality", "decision")


def leak_stub(prompts: list[str]) -> list[str]:
    """Valid by the time's remainder; a text without an object where the question says nothing."""
    n = [int(re.search(r"^Time: (\d+)", p, re.M)[1]) for p in prompts]
    return ["no idea" if k % 3 == 0 else json.dumps({"question_valid": k % 3 == 1, "reason": f"r{k}"}) for k in n]


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS question_valid, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'r' || o_orderkey END AS judgement FROM orders""")
def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question could be raised by what was seen, as a judge says."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("double").alias("query_time"), F.lit("q").alias("question"))
    return judges.leaks(rows, lambda: leak_stub).select("o_orderkey", "question_valid", "judgement")


class FakeMedia:
    """Media that follow from their names: frame numbers as texts, every fifth unreadable; words, cuts and files likewise."""

    def search(self, target: str) -> list[dict]:
        return [{"id": f"{target}/{k}", "title": "t"} for k in range(3)]

    def detail(self, url: str) -> dict | None:
        number = int(re.search(r"v(\d+)", url)[1])
        return {"title": url} if ("shorts" in url) == (number % 2 == 0) else None

    def frame(self, path: str, index: int) -> bytes | None:
        return None if index % 5 == 0 and index else str(index).encode()

    def transcript(self, path: str) -> list[dict]:
        return [{"start": 0.004, "end": 1.2349, "text": f" {path} "}, {"start": 2.0, "end": 3.0, "text": "b"}]

    def cut(self, path: str, start: float, end: float, out: str, reencode: bool) -> bool:
        if not reencode and start % 2 == 1:
            raise OSError("no keyframe")
        return end > start

    def download(self, url: str, folder: str) -> str | None:
        return f"{folder}/{url[-1]}.mp4"


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders), i AS (SELECT k, [0, k % 7, 10, 12] AS g FROM o)
SELECT k, array_to_string(list_transform([1, 2, 3, 4], lambda j: CASE WHEN g[j] % 5 <> 0 OR g[j] = 0 THEN g[j] ELSE (CASE WHEN j = 3 THEN (CASE WHEN g[2] % 5 <> 0 THEN g[2] ELSE 0 END) ELSE 0 END) END), ',') AS frames,
  'p' || k AS said, 1.23::DOUBLE AS said_until, CASE WHEN k % 11 = 0 THEN NULL ELSE '/clips/v' || k || '/c0.mp4' END AS clip_file, '/dl/' || (k % 10) || '.mp4' AS file,
  CASE WHEN k % 2 = 0 THEN 'https://www.youtube.com/shorts/v' || k ELSE 'https://www.youtube.com/watch?v=v' || k END AS detail FROM i""")
def media_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames by time, speech, cuts, downloads and details through a media port that follows from names."""
    k = F.col("k")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("video"), F.concat(F.lit("p"), F.col("o_orderkey")).alias("path"), F.lit(1.0).alias("fps"), F.lit(13).alias("n_frames"))
    at = F.array(F.lit(0.0), (k % 7).cast("double"), F.lit(10.0), F.lit(99.0))
    frames = media.read_frames(rows, at, FakeMedia).select("k", F.array_join(F.transform("frames", lambda b: b.cast("string")), ",").alias("frames"))
    said = media.transcribed(rows, FakeMedia).where("ord = 0").select("video", F.col("text").alias("said"), F.col("end").alias("said_until"))
    clips = rows.select("k", "video", "path", F.lit("c0").alias("name"), (k % 3).cast("double").alias("start"), F.when(k % 11 == 0, 0.0).otherwise(9.0).alias("end"))
    cut = media.cut_clips(clips, "/clips", FakeMedia).select("k", "clip_file")
    got = media.downloaded(rows.select("k", F.concat(F.lit("u"), k.cast("string")).alias("url")), "/dl", FakeMedia).select("k", "file")
    detail = media.details(rows.select("k", "video"), FakeMedia, "title string", acquire.page_urls(F.col("video"))).select("k", F.col("detail.title").alias("detail"))
    return frames.join(rows.select("k", "video"), "k").join(said, "video").join(cut, "k").join(got, "k").join(detail, "k").drop("video")


@query("""WITH t AS (SELECT lower(r_name) AS w, r_regionkey AS o FROM region), s AS (SELECT 'ytsearch4:' || w || '/' || k AS id, (o * 100000 + k) AS place FROM t, range(3) x(k))
SELECT id, (row_number() OVER (ORDER BY place) - 1)::BIGINT AS ord FROM s QUALIFY ord < 10""")
def refilled_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds from searches in blocks, in the plan's order, up to ten that are kept."""
    plan = table(spark, sf_dir, "region").select(F.lower("r_name").alias("term"), F.lit("ytsearch").alias("mode"), F.col("r_regionkey").cast("int").alias("ord"))
    return acquire.until_enough(plan, lambda: FakeMedia().search, lambda seeds: seeds, 10, 4).select("id", "ord")


@query("""WITH c AS (SELECT c_custkey, [4, 10, 14][c_custkey % 3 + 1] AS s FROM customer)
SELECT c_custkey, 1.0::DOUBLE AS grayscale, round(1 - s * s / 400.0::DOUBLE, 4) AS black_border, 0.0::DOUBLE AS color, CASE WHEN (s - 1) * (s - 1) > 20 THEN round((s - 1) * (s - 1) / 400.0::DOUBLE, 4) ELSE 0.0 END AS bright, s = 14 AS face FROM c""")
def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of black frames with a bright square of three sizes."""
    from ..functions import pixels

    side = F.array(*map(F.lit, (4, 10, 14)))[(F.col("c_custkey") % 3).cast("int")]
    black, white = lambda n: F.repeat(F.lit("000000"), n), lambda n: F.repeat(F.lit("ffffff"), n)
    row = F.concat(black(F.lit(2)), white(side), black(18 - side))
    raw = F.unhex(F.concat(black(F.lit(40)), F.repeat(row, side), black((18 - side) * 20)))
    found = pixels.frame_row(F.col("raw"), F.lit(20), F.lit(20), lambda grey: bool((grey > 200).sum() > 150))
    # Keys are dealt out before frames are made of them: a small file of many keys would be one task, also after AQE
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = table(spark, sf_dir, "customer").select("c_custkey").repartition(tasks, "c_custkey").select("c_custkey", raw.alias("raw"))
    return rows.select("c_custkey", found.alias("f")).select("c_custkey", "f.grayscale", "f.black_border", "f.color", "f.bright", "f.face")


# ---- files ----------------------------------------------------------------------------------------


@query("""SELECT 'document' AS what, c_custkey AS k, c_name AS value FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION ALL SELECT 'glob', c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 1 AND 3 UNION ALL SELECT 'newest', 1, '3' UNION ALL SELECT 'row', c_custkey, c_name FROM customer WHERE c_custkey = 2
UNION ALL SELECT 'clip', 7, 'c2' UNION ALL SELECT 'lines', count(*), max(c_name) FROM customer UNION ALL SELECT 'first_lines', 5, NULL UNION ALL SELECT 'media', 2, 'a.mp4,b.mkv' UNION ALL SELECT 'folders', count(DISTINCT c_mktsegment), NULL FROM customer
UNION ALL SELECT 'none', 0, NULL UNION ALL SELECT 'header', count(*), 'c_custkey,c_name,extra' FROM customer UNION ALL SELECT 'legacy', 1, 'old' UNION ALL SELECT 'largest', 1, 'b.mkv'""")
def file_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents, lines, listings, folders and headers, written from customers and read again."""
    root = files.scratch(spark, "files")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    for k in (1, 2, 3):
        files.write_document(c.where(F.col("c_custkey") == k), f"{root}/docs/{k}.json")
    shape = c.schema
    row = lambda what, df, k, value: df.select(F.lit(what).alias("what"), k.cast("long").alias("k"), value.cast("string").alias("value"))
    name = lambda what, df: row(what, df, F.col("c_custkey"), F.col("c_name"))
    one = spark.range(1)
    out = name("document", files.documents(spark, [f"{root}/docs/{k}.json" for k in (1, 2, 3)], shape))
    out = out.unionByName(name("glob", files.inputs(spark, [f"{root}/docs/*.json", f"{root}/docs/*.json"], shape)))
    out = out.unionByName(row("newest", files.runs(spark, f"{root}/docs/*.json", shape).agg(F.count("*").alias("n")), F.lit(1), F.col("n")))
    out = out.unionByName(name("row", files.row_at(files.documents(spark, f"{root}/docs", shape), 2, "c_custkey")))
    clips = one.select(F.lit("v").alias("video"), F.array(*[F.struct(F.lit(7).alias("clip_idx"), F.lit(f"c{k}").alias("topic")) for k in range(4)]).alias("clips"))
    out = out.unionByName(row("clip", files.clip_at(clips, 2), F.col("clip_idx"), F.col("topic")))
    files.write_lines(c, f"{root}/lines")
    out = out.unionByName(row("lines", files.json_lines(spark, f"{root}/lines", shape).agg(F.count("*").alias("n"), F.max("c_name").alias("m")), F.col("n"), F.col("m")))
    out = out.unionByName(row("first_lines", files.json_lines(spark, f"{root}/lines", shape, 5).agg(F.count("*").alias("n")), F.col("n"), F.lit(None)))
    for path, text in (("a.mp4", "12"), ("b.mkv", "123"), ("c.mp4.part", "1"), ("d.txt", "1")):
        files.write_text(spark, f"{root}/media/{path}", text)
    found = files.media(spark, f"{root}/media").withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
    out = out.unionByName(row("media", found.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names")), F.col("n"), F.col("names")))
    files.by_category(c, f"{root}/by", F.col("c_mktsegment"))
    out = out.unionByName(row("folders", spark.read.json(f"{root}/by").agg(F.count_distinct("category_folder").alias("n")), F.col("n"), F.lit(None)))
    out = out.unionByName(row("none", files.optional_documents(spark, f"{root}/nothing.json", shape).agg(F.count("*").alias("n")), F.col("n"), F.lit(None)))
    both = files.union_header(c.select("c_custkey").where("c_custkey % 2 = 0"), c.select("c_custkey", "c_name").where("c_custkey % 2 = 1").withColumn("extra", F.lit(1)))
    out = out.unionByName(row("header", both.agg(F.count("*").alias("n")), F.col("n"), F.lit(",".join(both.columns))))
    legacy = files.first_existing(spark, None, f"{root}/new.json", f"{root}/docs/1.json")
    out = out.unionByName(row("legacy", one, F.lit(1), F.lit("old" if legacy == f"{root}/docs/1.json" else "?")))
    largest = files.largest_file(found.withColumn("key", F.lit(1)), "key")
    return out.unionByName(row("largest", largest, F.lit(1), F.regexp_extract("path", "[^/]+$", 0)))


@query("""SELECT conv_id, '[' || string_agg('[' || turn || '.0,' || (turn + 1) || '.0,"r' || turn || '"]', ',' ORDER BY turn) || ']' AS triples FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY conv_id""")
def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with their times as the JSON that training reads."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    own = F.struct(F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), F.concat(F.lit("r"), F.col("turn")).alias("text"))
    return c.groupBy("conv_id").agg(files.triples(F.array_sort(F.collect_list(own))).alias("triples"))


@query("""SELECT o_orderkey, 'old' AS first, CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END AS second FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'old', 'new' FROM orders WHERE o_orderkey % 2 = 0""".replace("CASE WHEN o_orderkey % 2 = 0 THEN 'new' ELSE 'old' END", "'new'"))
def signed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table is read again under its own signature and made anew under another."""
    root, keys = files.scratch(spark, "signed"), table(spark, sf_dir, "orders").select("o_orderkey")
    made = lambda word, sign: files.stored(spark, f"{root}/t", lambda: keys.withColumn("word", F.lit(word)), sign)
    first = made("old", acquire.signature({"a": 1}))
    first = made("never", acquire.signature({"a": 1})).select("o_orderkey", F.col("word").alias("first"))
    first.write.parquet(f"{root}/first")
    second = made("new", acquire.signature({"a": 2})).select("o_orderkey", F.col("word").alias("second"))
    return spark.read.parquet(f"{root}/first").join(second, "o_orderkey")
