"""Queries over the test tables with the SQL that answers them too: QA rows, evaluation, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonrepair, labels, windows
from ..functions import text as T
from ..operators import acquire, evaluate, nearest, qa, quality
from ..sources.tables import PREDICTIONS_SQL, QA_SQL, clips, predictions, qa_rows, table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = counted(sql)
        return f

    return add


def counted(sql: str) -> str:
    """``count_if(...)`` spelled so that its type is BIGINT, as it is in Spark."""
    while (at := sql.find("count_if(")) >= 0:
        depth, end = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : end - 1]} THEN 1 END){sql[end:]}"
    return sql


# ---- question-answer rows -------------------------------------------------------------------------


@query(f"""WITH {QA_SQL},
off AS (SELECT qa.*, CASE WHEN clip_start IS NULL OR clip_end IS NULL THEN coalesce(c.start, 0) ELSE clip_start END AS cs,
               CASE WHEN clip_start IS NULL OR clip_end IS NULL THEN coalesce(c."end", 0) ELSE clip_end END AS ce
        FROM qa LEFT JOIN clips c USING (video, clip_idx) WHERE status = 'F'),
s AS (SELECT *, printf('%s_c%d_stream_%s_tq%d_ta%d_%03d', video, clip_idx, type, trunc(query_time)::BIGINT, trunc(answer_time)::BIGINT, ord) AS id FROM qa WHERE status <> 'F')
SELECT video, clip_idx, type, question, 'offline_answer' AS sample_type, printf('%s_c%d_offline_%s_%03d', video, clip_idx, type, ord) AS source_qa_id, cs AS start, ce AS "end", '<ANSWER> ' || answer AS target FROM off
UNION ALL
SELECT video, clip_idx, type, question, 'streaming_wait', id, greatest(1.0::DOUBLE, query_time - 30), query_time, '<WAIT> Not enough information yet. More video is needed.' FROM s
UNION ALL
SELECT video, clip_idx, type, question, 'streaming_answer', id, greatest(1.0::DOUBLE, answer_time - 30), answer_time, '<ANSWER> ' || answer FROM s""")
def sample_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training samples with deterministic ids: one an offline row, two a streaming row."""
    rows = qa_rows(spark, sf_dir)
    offline = qa.bounded(rows.where("status = 'F'"), clips(spark, sf_dir))
    return qa.expanded(offline, rows.where("status <> 'F'").withColumn("clip_start", F.lit(1.0)))


@query(f"""WITH {QA_SQL},
off AS (SELECT video, clip_idx, type, 'offline' AS source, ord, ((CASE WHEN clip_start IS NULL OR clip_end IS NULL THEN coalesce(c.start, 0) ELSE clip_start END)
               + (CASE WHEN clip_start IS NULL OR clip_end IS NULL THEN coalesce(c."end", 0) ELSE clip_end END)) / 2 AS ts
        FROM qa LEFT JOIN clips c USING (video, clip_idx) WHERE status = 'F'),
m AS (SELECT * FROM off UNION ALL SELECT video, clip_idx, type, 'streaming', ord, query_time FROM qa WHERE status <> 'F'),
k AS (SELECT video, string_agg(type || ':' || n, ',' ORDER BY type) AS types FROM (SELECT video, type, count(*) AS n FROM m GROUP BY 1, 2) GROUP BY 1)
SELECT m.video, count(*) AS num_qa, 5::BIGINT AS num_clips, any_value(types) AS types, string_agg(source || clip_idx, ' ' ORDER BY ts, clip_idx, source, ord) AS qa_order, sum((ts * 2)::BIGINT)::BIGINT AS half_seconds
FROM m JOIN k USING (video) GROUP BY m.video""")
def merge_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of rows in one ordered record a video, flattened to scalars."""
    rows, own = qa_rows(spark, sf_dir), clips(spark, sf_dir)
    both = qa.merged(rows.where("status = 'F'"), rows.where("status <> 'F'"), own)
    records = qa.records(both, own, both.select("video").distinct())
    types = F.array_join(F.transform(F.map_entries("type_counts"), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    order = F.array_join(F.transform("qa", lambda q: F.concat(q["source"], q["clip_idx"])), " ")
    half = F.aggregate("qa", F.lit(0).cast("long"), lambda a, q: a + (q["timestamp"] * 2).cast("long"))
    return records.select("video", "num_qa", "num_clips", types.alias("types"), order.alias("qa_order"), half.alias("half_seconds"))


_ENTRIES = """e AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS query_time, 60.0::DOUBLE + l_linenumber * 5 AS clip_end, l_linenumber = 4 AND l_partkey % 3 = 0 AS skip,
         CASE l_returnflag WHEN 'A' THEN 'sonographer_intent' WHEN 'N' THEN 'next_action' ELSE 'other' END AS type,
         CASE WHEN l_partkey % 11 = 0 THEN '  ' ELSE 'q' END AS question, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'a' END AS answer,
         CASE l_suppkey % 9 WHEN 0 THEN 'soon' WHEN 1 THEN NULL WHEN 2 THEN 'NaN' WHEN 3 THEN l_quantity::INT::VARCHAR WHEN 4 THEN (l_quantity::INT + 4)::VARCHAR ELSE (l_quantity::INT + 5 + l_linenumber * 4)::VARCHAR END AS answer_time
  FROM lineitem),
r AS (
  SELECT *, CASE WHEN skip THEN 'model-skipped' WHEN type = 'other' THEN 'unknown type' WHEN trim(question) = '' OR answer IS NULL THEN 'empty question or answer'
      WHEN TRY_CAST(answer_time AS DOUBLE) IS NULL OR isnan(TRY_CAST(answer_time AS DOUBLE)) THEN 'answer_time not a float'
      WHEN TRY_CAST(answer_time AS DOUBLE) <= query_time THEN 'not after query' WHEN TRY_CAST(answer_time AS DOUBLE) - query_time < 5 THEN 'too soon after query'
      WHEN TRY_CAST(answer_time AS DOUBLE) > clip_end + 0.5 THEN 'beyond clip' END AS reason FROM e)"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    s = F.col("l_suppkey") % 9
    kind = F.when(F.col("l_returnflag") == "A", qa.STREAMING_TYPES[0]).when(F.col("l_returnflag") == "N", qa.STREAMING_TYPES[1]).otherwise("other")
    at = F.when(s == 0, "soon").when(s == 2, "NaN").when(s == 3, q.cast("string")).when(s == 4, (q + 4).cast("string")).when(s > 4, (q + 5 + F.col("l_linenumber") * 4).cast("string"))
    entry = F.struct(
        kind.alias("type"), F.when(F.col("l_partkey") % 11 == 0, "  ").otherwise("q").alias("question"), F.when(F.col("l_partkey") % 13 != 0, "a").alias("answer"),
        at.alias("answer_time"), ((F.col("l_linenumber") == 4) & (F.col("l_partkey") % 3 == 0)).alias("skip"),
    )
    rows = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("query_time"), (60.0 + F.col("l_linenumber") * 5).alias("clip_end"), entry.alias("entry"))
    return rows.withColumn("reason", qa.reject_reason())


@query(f'WITH {_ENTRIES} SELECT l_orderkey, l_linenumber, type, answer_time::DOUBLE AS answer_time, answer_time::DOUBLE - query_time >= 5 AS gap_ok FROM r WHERE reason IS NULL')
def qa_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated rows that pass all rules."""
    at = F.col("entry.answer_time").cast("double")
    return _validated(spark, sf_dir).where("reason IS NULL").select("l_orderkey", "l_linenumber", "entry.type", at.alias("answer_time"), (at - F.col("query_time") >= 5).alias("gap_ok"))


@query(f"WITH {_ENTRIES} SELECT reason, count(*) AS n, min(l_orderkey) AS first_order FROM r WHERE reason IS NOT NULL GROUP BY reason")
def qa_drop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the others fall out: the first failing rule."""
    return _validated(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))


@query("""WITH c AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS start, (20 + o_custkey % 600)::DOUBLE AS duration FROM orders),
a AS (SELECT *, start + duration AS "end", start + duration * ratio AS t FROM c, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) r(ratio))
SELECT o_orderkey, ratio, t AS query_time, CASE WHEN t - start > 240 THEN t - 240 ELSE start END AS seen_start, CASE WHEN "end" - t > 60 THEN t + 60 ELSE "end" END AS future_end,
       least("end", t + 10) AS after_end, greatest(start, t - 30) AS observed_start
FROM a WHERE (CASE WHEN "end" - t > 60 THEN t + 60 ELSE "end" END) - t >= 8""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each clip with their windows."""
    o = table(spark, sf_dir, "orders")
    own = o.select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("start"), (20 + F.col("o_custkey") % 600).cast("double").alias("duration")).withColumn("end", F.col("start") + F.col("duration"))
    a = qa.anchors(own, future=60.0).where("kept")
    return a.select("o_orderkey", "ratio", "query_time", F.col("seen.start").alias("seen_start"), F.col("future.end").alias("future_end"), windows.after(F.col("query_time"), F.col("end"), 10.0)["end"].alias("after_end"), windows.observed(F.col("query_time"), F.col("start"), 30.0)["start"].alias("observed_start"))


@query("""WITH l AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b, doc_id % 3 > 0 AS c, CASE WHEN doc_id % 2 = 0 THEN 'pass' ELSE 'fail' END AS told FROM labels),
v AS (SELECT *, CASE WHEN a AND b AND c THEN 'pass' ELSE 'fail' END AS verdict FROM l WHERE doc_id % 10 > 0)
SELECT verdict, count(*) AS n, count_if(verdict <> told) AS overridden, count_if(a) AS no_leak, count_if(b) AS not_yet, count_if(c) AS at_answer FROM v GROUP BY verdict
UNION ALL SELECT 'error', count(*), 0, 0, 0, 0 FROM l WHERE doc_id % 10 = 0 HAVING count(*) > 0""")
def verdict_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of model texts (fenced, broken or plain JSON) by their three checks; the texts "true" aren't true."""
    d = F.col("doc_id")
    yes = lambda c: F.when(c, "true").otherwise(F.when(d % 2 == 0, '"true"').otherwise("false"))
    told = F.when(d % 2 == 0, "pass").otherwise("fail")
    body = F.concat(F.lit('{"checks": {"question_no_leak": '), yes(F.col("quality") == 1), F.lit(', "not_answerable_at_query_time": '), yes(F.col("toxic") == 0), F.lit(', "answerable_at_answer_time": '), yes(d % 3 > 0), F.lit('}, "verdict": "'), told, F.lit('", "reason": "r"}'))
    raw = F.when(d % 10 == 0, "no json").when(d % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```"))).when(d % 4 == 2, F.concat(F.lit("I think "), body, F.lit(" so"))).otherwise(body)
    v = table(spark, sf_dir, "labels").select(jsonrepair.verdict(raw).alias("v"))
    n = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    checks = [n(f"v.{c}").alias(a) for c, a in zip(jsonrepair.CHECKS, ("no_leak", "not_yet", "at_answer"), strict=True)]
    return v.groupBy(F.coalesce("v.verdict", F.lit("error")).alias("verdict")).agg(F.count("*").alias("n"), n("v.overridden").alias("overridden"), *checks)


@query("""SELECT event_type, count(*) AS calls, sum((props->>'k')::BIGINT)::BIGINT AS prompt_tokens, sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE (props->>'k')::BIGINT * 2 END)::BIGINT AS video_tokens,
  sum((props->>'k')::BIGINT * 7)::BIGINT AS micro_cost FROM events GROUP BY event_type""")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and cost totals of usage documents; missing fields count 0, money is decimal."""
    k = F.get_json_object("props", "$.k").cast("long")
    details = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(', "prompt_tokens_details": {"video_tokens": '), k * 2, F.lit("}")))
    doc = F.concat(F.lit('{"prompt_tokens": '), k, details, F.lit(', "cost": '), (k * 7).cast("decimal(18,6)") / 1_000_000, F.lit("}"))
    u = table(spark, sf_dir, "events").select("event_type", jsonrepair.usage(doc).alias("u"))
    return u.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("u.prompt_tokens").alias("prompt_tokens"), F.sum("u.video_tokens").alias("video_tokens"), (F.sum("u.cost") * 1_000_000).cast("long").alias("micro_cost"))


# ---- evaluation -----------------------------------------------------------------------------------

_COUNTS = """count(*) AS total, count_if(correct_answerability) AS correct, count_if(gt_label = 'WAIT') AS wait_count, count_if(gt_label = 'WAIT' AND pred_label = 'WAIT') AS wait_correct,
  count_if(gt_label = 'WAIT' AND pred_label = 'ANSWER') AS premature_answer, count_if(gt_label = 'WAIT' AND pred_label = 'OTHER') AS wait_other, count_if(gt_label = 'ANSWER') AS answer_count,
  count_if(gt_label = 'ANSWER' AND pred_label = 'ANSWER') AS answer_correct, count_if(gt_label = 'ANSWER' AND pred_label = 'WAIT') AS over_wait, count_if(gt_label = 'ANSWER' AND pred_label = 'OTHER') AS answer_other,
  count_if(gt_label = 'WAIT') AS gt_wait, count_if(pred_label = 'WAIT') AS pred_wait, count_if(gt_label = 'ANSWER') AS gt_answer, count_if(pred_label = 'ANSWER') AS pred_answer,
  0::BIGINT AS gt_other, count_if(pred_label = 'OTHER') AS pred_other, 0::BIGINT AS gt_error, 0::BIGINT AS pred_error"""
_RATES = ", ".join(f"CASE WHEN {b} = 0 THEN 0 ELSE {a}::DOUBLE / {b} END::DOUBLE AS {n}" for n, (a, b) in evaluate.RATES.items())


@query(f"WITH {PREDICTIONS_SQL}, c AS (SELECT {_COUNTS} FROM p) SELECT *, {_RATES} FROM c")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and rates over all predictions."""
    return evaluate.summary(predictions(spark, sf_dir))


@query(f"""WITH {PREDICTIONS_SQL}, q AS (SELECT * REPLACE (coalesce(sample_type, 'None') AS sample_type, coalesce(qa_type, 'None') AS qa_type) FROM p),
c AS (SELECT CASE WHEN grouping(sample_type) = 0 THEN 'sample_type' WHEN grouping(qa_type) = 0 THEN 'qa_type' ELSE 'overall' END AS level, coalesce(sample_type, qa_type, 'all') AS key, {_COUNTS}
      FROM q GROUP BY GROUPING SETS ((sample_type), (qa_type), ())) SELECT *, {_RATES} FROM c""")
def eval_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same overall, by sample type and by question type."""
    return evaluate.report(predictions(spark, sf_dir))


@query(f"WITH {PREDICTIONS_SQL} SELECT idx, sample_type, qa_type, gt_label, pred_label FROM p WHERE NOT correct_answerability ORDER BY idx LIMIT 10")
def eval_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten wrong predictions."""
    return evaluate.failures(predictions(spark, sf_dir)).select("idx", "sample_type", "qa_type", "gt_label", "pred_label")


@query(r"""WITH t AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' <WAIT> ' WHEN 1 THEN '< Answer ><wait> ' ELSE '' END || text AS x FROM conversations)
SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)^\s*<\s*ANSWER\s*>\s*', ''), '(?i)^\s*<\s*WAIT\s*>\s*', ''), '^\s+', ''), '\s+$', '')) AS stripped FROM t""")
def strip_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets without their marks."""
    x = F.concat(F.when(F.col("turn") % 3 == 0, " <WAIT> ").when(F.col("turn") % 3 == 1, "< Answer ><wait> ").otherwise(""), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(labels.strip_prefix(x).cast("binary")).alias("stripped"))


# ---- curation -------------------------------------------------------------------------------------

LEXICON = {"licence": ["license", "cc by", "public"], "contact": ["mail", "http", "token"], "prose": ["the", "der", "les", "que"]}


@query(r"""WITH t AS (SELECT doc_id, lang, lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS x FROM documents),
c AS (SELECT *, len(regexp_extract_all(x, '[a-zA-Z]{2,}')) AS latin, len(regexp_extract_all(x, '[\x{4e00}-\x{9fff}]')) AS han FROM t)
SELECT doc_id, lang, latin::INT AS latin_words, latin >= 4 AND latin >= han AS is_en, han >= 2 OR (han >= 1 AND latin <= 10) AS is_zh FROM c""")
def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script heuristics over normalised texts."""
    t = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_count(t, F.lit("[a-zA-Z]{2,}")).alias("latin_words"), T.looks_like(t, "en").alias("is_en"), T.looks_like(t, "zh").alias("is_zh"))


_X = r"lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')))"
_HITS = {name: "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda k: contains(x, k))" for name, words in LEXICON.items()}


@query(f"""WITH t AS (SELECT doc_id, {_X} AS x FROM documents), h AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _HITS.items())} FROM t),
m AS (SELECT *, greatest(len(licence), len(contact), len(prose)) AS n FROM h)
SELECT doc_id, CASE WHEN n = 0 THEN 'none' WHEN len(licence) = n THEN 'licence' WHEN len(contact) = n THEN 'contact' ELSE 'prose' END AS category,
  CASE WHEN n = 0 THEN '' ELSE array_to_string(CASE WHEN len(licence) = n THEN licence WHEN len(contact) = n THEN contact ELSE prose END, ', ') END AS reason FROM m""")
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category with the most keyword hits; the first of equals."""
    c = T.classify(T.normalize(F.col("text")), LEXICON, "none")
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.category", "c.reason")


@query(f"""WITH t AS (SELECT doc_id, source, {_X} AS x FROM documents), r AS (
SELECT *, CASE WHEN len(regexp_extract_all(x, '[a-zA-Z]{{2,}}')) < 4 THEN 'language' WHEN NOT contains(x, 'the') THEN 'domain'
  WHEN (contains(x, 'license') OR contains(x, 'trash')) AND NOT contains(x, 'mail') THEN 'visual' END AS reason FROM t)
SELECT coalesce(reason, 'kept') AS outcome, source, count(*) AS n FROM r GROUP BY 1, 2""")
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, then domain, then looks: the first reason counts, one pass."""
    out = acquire.cascade(table(spark, sf_dir, "documents"), F.col("text"), "en", ["the"], ["mail"], ["license", "trash"])
    return out.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome"), "source").agg(F.count("*").alias("n"))


@query(r"""WITH t AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages) SELECT page_id, length(x)::INT AS n, md5(x) AS digest FROM t""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without tags."""
    x = T.strip_html(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(x).alias("n"), F.md5(x.cast("binary")).alias("digest"))


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))
    return acquire.first_wins(d, ["digest"], ["doc_id"]).drop("digest")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents still to do: unlabelled ones and those to retry."""
    return acquire.remaining(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", retry=F.col("toxic") == 1)


@query("""WITH b AS (SELECT lower(r_name) AS w, r_regionkey AS o FROM region), g AS (SELECT n_name AS w, n_nationkey AS o FROM nation), f(w, o) AS (VALUES ('scan tutorial', 0), ('how to scan', 1)), y(w, o) AS (VALUES ('2025', 0), ('2024', 1)),
t AS (SELECT w AS term, [0, o] AS place FROM b UNION ALL SELECT g.w || ' ' || b.w, [1, b.o, 0, g.o] FROM b, g UNION ALL SELECT b.w || ' ' || f.w, [1, b.o, 1, f.o] FROM b, f UNION ALL SELECT b.w || ' ' || y.w, [1, b.o, 2, y.o] FROM b, y
  UNION ALL SELECT 'POCUS ' || g.w || ' ' || f.w, [2, g.o, 0, f.o] FROM g, f UNION ALL SELECT g.w || ' ultrasound tutorial ' || y.w, [2, g.o, 1, y.o, 0] FROM g, y UNION ALL SELECT g.w || ' pocus scan ' || y.w, [2, g.o, 1, y.o, 1] FROM g, y),
u AS (SELECT trim(term) AS term, min(place) AS place FROM t GROUP BY 1)
SELECT term, mode, (row_number() OVER (ORDER BY place, m) - 1)::INT AS ord FROM u, (VALUES (0, 'ytsearch'), (1, 'ytsearchdate')) x(m, mode)""")
def query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered distinct search terms from products of small word lists."""
    words = lambda rows: spark.createDataFrame(list(zip(rows, range(len(rows)), strict=True)), "word string, ord int")
    bases = table(spark, sf_dir, "region").select(F.lower("r_name").alias("word"), F.col("r_regionkey").alias("ord"))
    organs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word"), F.col("n_nationkey").alias("ord"))
    return acquire.query_plan(bases, organs, words(["scan tutorial", "how to scan"]), words(["2025", "2024"]))


@query("""WITH k AS (SELECT *, n_chars > 2000 AS kept FROM documents), l AS (SELECT max(doc_id) AS last, count(*) AS n FROM (SELECT doc_id FROM k WHERE kept ORDER BY doc_id LIMIT 50))
SELECT doc_id, kept FROM k, l WHERE n < 50 OR doc_id <= last""")
def keep_until_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order up to the fiftieth kept one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return acquire.keep_until(d, F.col("n_chars") > 2000, "doc_id", 50).select("doc_id", "kept")


@query(r"""SELECT c_custkey, c_custkey * 1234 AS plain, CASE WHEN c_custkey % 3 = 0 THEN 10000 * c_custkey WHEN c_custkey % 3 = 1 THEN 100000000 * c_custkey ELSE 0 END AS counted,
  c_custkey % 24 * 3600 + c_custkey % 60 * 60 + c_custkey % 59 AS seconds, (c_custkey % 500) AS whole, CASE WHEN c_custkey % 2 = 0 THEN '2024-03-' || printf('%02d', c_custkey % 28 + 1) ELSE '' END AS day FROM customer""")
def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with units and commas, durations, lenient numbers, upload dates."""
    k = F.col("c_custkey")
    unit = F.when(k % 3 == 0, F.concat(k, F.lit("万"))).when(k % 3 == 1, F.concat(F.lit(" "), k, F.lit(".0亿"))).otherwise("n/a")
    clock = F.concat_ws(":", (k % 24).cast("string"), (k % 60).cast("string"), (k % 59).cast("string"))
    day = F.when(k % 2 == 0, F.concat(F.lit("202403"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).otherwise("2024")
    return table(spark, sf_dir, "customer").select("c_custkey", T.parse_count(F.format_number(k * 1234, 0)).alias("plain"), T.parse_count(unit).alias("counted"), T.parse_duration(clock).alias("seconds"), T.safe_int(F.concat((k % 500).cast("string"), F.lit(".7"))).alias("whole"), T.upload_date(day).alias("day"))


# ---- visual quality -------------------------------------------------------------------------------


@query("""WITH f AS (SELECT l_orderkey AS video, count(*) AS frames, count_if(l_linenumber % 4 = 0) AS faces, sum(round(l_discount * 100)::BIGINT)::DOUBLE / count(*) * 0.04::DOUBLE AS c, sum(round(l_tax * 100)::BIGINT)::DOUBLE / count(*) * 0.1::DOUBLE AS g FROM lineitem GROUP BY 1),
s AS (SELECT video, frames, faces, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - CASE WHEN c > 0.15::DOUBLE THEN least(30.0::DOUBLE, c * 100) ELSE 0 END - CASE WHEN g < 0.7::DOUBLE THEN (0.7::DOUBLE - g) * 60 ELSE 0 END
  - CASE WHEN faces > 0 THEN faces::DOUBLE / frames * 40 ELSE 0 END)) AS score FROM f)
SELECT video, frames, faces, floor(score)::BIGINT AS score, CASE WHEN score >= 75 THEN 'pure' WHEN score >= 55 THEN 'mildly_annotated' WHEN score >= 35 THEN 'heavily_annotated' ELSE 'rejected' END AS category FROM s""")
def purity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame features to a video's score and class."""
    mean = lambda c, by: F.sum(F.round(F.col(c) * 100).cast("long")).cast("double") / F.count("*") * F.lit(by)
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video")).agg(F.count("*").alias("frames"), F.count_if(F.col("l_linenumber") % 4 == 0).alias("faces"), mean("l_discount", 0.04).alias("c"), mean("l_tax", 0.1).alias("g"))
    f = f.withColumn("s", quality.purity(F.col("g"), F.col("c"), F.col("faces"), F.col("frames"), F.lit(0.0), F.lit(0.0)))
    return f.select("video", "frames", "faces", F.floor("s").alias("score"), quality.purity_class(F.col("s")).alias("category"))


_FRAMES = """f AS (SELECT user_id AS video, event_id AS ord, CASE event_type WHEN 'click' THEN '超声画面' WHEN 'view' THEN '医学影像' WHEN 'error' THEN '讲课画面' WHEN 'signup' THEN 'PPT幻灯片' END AS type,
  CASE event_id % 4 WHEN 0 THEN '无' WHEN 1 THEN 'B' WHEN 2 THEN 'M' ELSE NULL END AS modality, CASE event_id % 5 WHEN 0 THEN 'null' WHEN 1 THEN '' WHEN 2 THEN 'liver' WHEN 3 THEN 'lung' END AS anatomy FROM events)"""


@query(f"""WITH {_FRAMES}, g AS (SELECT video, count(*) AS n, count_if(type IN ('超声画面', '医学影像')) AS images, count_if(type IN ('讲课画面', 'PPT幻灯片')) AS lectures, min(CASE WHEN anatomy = 'liver' THEN ord END) AS liver, min(CASE WHEN anatomy = 'lung' THEN ord END) AS lung,
  count_if(modality = 'B') AS b, count_if(modality = 'M') AS m FROM f GROUP BY video), r AS (SELECT *, images::DOUBLE / n AS r, lectures::DOUBLE / n AS l FROM g)
SELECT video, n, images, lectures, CASE WHEN liver IS NULL AND lung IS NULL THEN '' WHEN lung IS NULL THEN 'liver' WHEN liver IS NULL THEN 'lung' WHEN liver < lung THEN 'liver,lung' ELSE 'lung,liver' END AS anatomy,
  CASE WHEN b = 0 AND m = 0 THEN '无' WHEN b >= m THEN 'B' ELSE 'M' END AS modality, CASE WHEN r >= 0.7 THEN '保留' WHEN r >= 0.4 THEN '需要裁剪' ELSE '丢弃' END AS decision,
  trunc(CASE WHEN r >= 0.7 THEN 70 + r * 30 WHEN r >= 0.4 THEN 40 + r * 40 WHEN l >= 0.6 THEN 20 + (1 - l) * 30 ELSE 30 END)::INT AS quality FROM r""")
def decision_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame types to a decision and score a video."""
    e, m, a = F.col("event_type"), F.col("event_id") % 4, F.col("event_id") % 5
    kinds = {"click": "超声画面", "view": "医学影像", "error": "讲课画面", "signup": "PPT幻灯片"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), e)
    f = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("ord"), kind.alias("type"), F.when(m == 0, "无").when(m == 1, "B").when(m == 2, "M").alias("modality"), F.when(a == 0, "null").when(a == 1, "").when(a == 2, "liver").when(a == 3, "lung").alias("anatomy"))
    return quality.decisions(f).withColumn("anatomy", F.array_join("anatomy", ","))


@query("""SELECT source, count_if(quality = 1 AND toxic = 0) AS keep, count_if(quality = 1 AND toxic = 1) AS trim, count_if(quality = 0) AS discard FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def decision_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions by category, a column each."""
    decision = F.when(F.col("quality") == 0, "discard").when(F.col("toxic") == 1, "trim").otherwise("keep")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id").withColumn("decision", decision)
    return quality.pivoted(rows, "source", "decision", ("keep", "trim", "discard"))


@query("""WITH t AS (SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1) SELECT key, n::BIGINT AS n, n::DOUBLE / (SELECT count(*) FROM events) AS share FROM t""")
def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count maps of all videos, merged."""
    one = table(spark, sf_dir, "events").withColumn("type", F.col("event_type"))
    return quality.merged_maps(qa.type_counts(one, "user_id"), "type_counts")


@query("SELECT event_type AS key, count(*) AS count FROM events GROUP BY 1")
def array_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each element stands in the videos' arrays."""
    arrays = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("parts"))
    return quality.frequencies(arrays, "parts")


@query("""WITH b AS (SELECT least(floor((p_size - 1) * 20 / 49.0::DOUBLE), 19)::INT AS bin FROM part WHERE p_size BETWEEN 1 AND 50) SELECT bin, count(*) AS count FROM b GROUP BY bin""")
def score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty equal bins, the maximum in the last."""
    return quality.histogram(table(spark, sf_dir, "part"), "p_size", 1, 50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best of the kept."""
    kept = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    return quality.top(kept, 20, F.desc("o_totalprice"), F.col("o_orderkey"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'click')::INT DESC, ts DESC, event_id DESC) = 1")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest job of each user, a running one first."""
    e = table(spark, sf_dir, "events")
    return quality.latest(e, "user_id", running=F.col("event_type") == "click", at=("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 30")
def log_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty log lines of each user."""
    return quality.ring(table(spark, sf_dir, "events"), ("user_id",), ("ts", "event_id"), 30).select("user_id", "event_id")


@query("SELECT event_type, count(*) AS files, sum(event_id)::BIGINT AS seconds, sum(user_id + 1)::BIGINT AS took, sum(event_id)::DOUBLE / sum(user_id + 1) AS realtime_factor FROM events GROUP BY event_type")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio of sums by type."""
    return quality.throughput(table(spark, sf_dir, "events").withColumn("took", F.col("user_id") + 1), "event_id", "took", "event_type")


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 50)::DOUBLE AS s, (o_orderkey % 50 + o_custkey % 70)::DOUBLE AS e, o_orderpriority = '1-URGENT' AS whole FROM orders),
w AS (SELECT *, CASE WHEN e <= s THEN greatest(0, e - 0.5) ELSE s END AS low FROM o), t AS (SELECT *, CASE WHEN whole THEN s ELSE greatest(low, e - 8) END AS a FROM w)
SELECT o_orderkey, a AS first_time, a + 3 * ((e - a) / 7) AS fourth_time, e AS window_end FROM t""")
def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frame times a sample: over the whole clip, or its tail."""
    o = table(spark, sf_dir, "orders")
    s, e = (F.col("o_orderkey") % 50).cast("double"), (F.col("o_orderkey") % 50 + F.col("o_custkey") % 70).cast("double")
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "offline_answer").otherwise("streaming_wait")
    t = o.select("o_orderkey", windows.policy_times(kind, s, e, 8).alias("t"), e.alias("window_end"))
    return t.select("o_orderkey", F.col("t")[0].alias("first_time"), F.col("t")[3].alias("fourth_time"), "window_end")


@query("""WITH a AS (SELECT l_orderkey, list(l_linenumber % 3 ORDER BY l_linenumber) AS ids FROM lineitem GROUP BY 1),
p AS (SELECT *, coalesce(list_max(list_filter(range(1, greatest(len(ids), 1)), lambda i: ids[i] = 1 AND ids[i + 1] = 2)) - 1, -1)::INT AS pos FROM a),
q AS (SELECT *, CASE WHEN pos < 0 THEN len(ids) ELSE pos + 2 END AS start FROM p)
SELECT l_orderkey, pos, array_to_string(list_transform(range(1, 9), lambda i: CASE WHEN i > len(ids) OR i <= start THEN -100 ELSE ids[i] END), ',') AS labels FROM q""")
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels behind the last occurrence of a prefix, padded to eight."""
    ids = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_linenumber") % 3).alias("x")))), lambda v: v["x"]).alias("ids"))
    pos = qa.last_position(F.col("ids"), F.array(F.lit(1), F.lit(2)))
    out = ids.withColumn("pos", pos).withColumn("start", F.when(F.col("pos") < 0, F.size("ids")).otherwise(F.col("pos") + 2))
    return out.select("l_orderkey", "pos", F.array_join(qa.label_mask(F.col("ids"), F.col("start"), 8), ",").alias("labels"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderkey % 40)::BIGINT AS q, (o_orderkey % 40 + o_custkey % 90)::BIGINT AS a, 100::BIGINT AS ce FROM orders),
s AS (SELECT *, unnest(generate_series(q, ce, 5)) AS t FROM o)
SELECT o_orderkey, min(CASE WHEN t >= a THEN t END) AS answered_at, count(CASE WHEN t < a THEN 1 END) AS waits FROM s GROUP BY 1""")
def progressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asking again every five seconds until the answer is there or the clip ends."""
    from ..streaming.answers import ask_again

    o = table(spark, sf_dir, "orders")
    q = (F.col("o_orderkey") % 40).cast("long")
    rows = o.select("o_orderkey", q.alias("question_time"), (q + F.col("o_custkey") % 90).alias("answer_time"), F.lit(100).cast("long").alias("clip_end"))
    return ask_again(rows).select("o_orderkey", "answered_at", "waits")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS s, l_returnflag = 'A' AS now_, CASE WHEN l_partkey % 17 = 0 THEN '' ELSE 'q' END AS q FROM lineitem)
SELECT CASE WHEN s THEN 'streaming_answer' ELSE 'offline_answer' END AS sample_type, count(*) AS n FROM d WHERE q <> '' GROUP BY 1 UNION ALL SELECT 'streaming_wait', count(*) FROM d WHERE q <> '' AND s AND NOT now_""")
def dual_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dual rows to samples; waiting ones only where the answer isn't known yet."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.when(F.col("l_linestatus") == "O", "streaming").otherwise("offline").alias("source"), F.when(F.col("l_partkey") % 17 == 0, "").otherwise("q").alias("question"), F.lit("a").alias("answer"), (F.col("l_returnflag") == "A").alias("answerable_now"))
    return qa.dual_expanded(rows).groupBy("sample_type").agg(F.count("*").alias("n"))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS cosine FROM v q JOIN v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank, vec_id, cosine FROM m QUALIFY rank <= 5""")
def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five frames most like each query vector (ids divisible by 50) of its label, by cosine to 9 places."""
    v = table(spark, sf_dir, "embeddings")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)
    unit = v.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))
    q = unit.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("qn"), "label")
    met = q.join(unit, "label").where("vec_id <> query_id").withColumn("cosine", F.round(dot(F.col("q"), F.col("embedding")) / (F.col("qn") * F.col("norm")), 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "rank", "vec_id", "cosine")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
m AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 9) AS cosine FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id)::INT AS rank, vec_id, cosine FROM m QUALIFY rank <= 5""")
def memory_topk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five frames of the whole bank most like each query vector (ids divisible by 50), whatever their labels."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)
