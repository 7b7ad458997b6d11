"""Whole runs: question rows of clips, acquisition of candidates, evaluation of samples.

A run is one plan of all its videos.  Only model calls leave the JVM; what a model said is stored as a
table below ``root``, so that a model is asked once a row, and a run that is repeated with the same
``root`` goes on behind its last whole table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonrepair, windows
from ..functions import text as T
from ..operators import acquire, evaluate, qa, records
from ..sources import files, ports
from ..sources.tables import table
from .queries import _X, counted

QUERIES = {}
SQL = {}
ENTRY = "type string, question string, answer string, query_time string, answer_time string, evidence string, skip boolean, skip_reason string"
OFFLINE_TYPE = "clip_summary"
AFTER_SECONDS, OFFLINE_SECONDS, SPEECH_CHARS = 10.0, 300.0, 3500


@dataclass(frozen=True)
class Knobs:
    """What changes a run's rows.  Caps of 0 or less, or None, are no caps; an ``after`` of those is half a second."""

    ratios: tuple[float, ...] = qa.RATIOS
    types: tuple[str, ...] = qa.STREAMING_TYPES
    seen: float | None = qa.SEEN_SECONDS
    future: float | None = None
    before: float | None = qa.SEEN_SECONDS
    evidence: float | None = None
    after: float | None = AFTER_SECONDS
    offline: float = OFFLINE_SECONDS
    window: float = qa.WINDOW_SECONDS
    clip_idx: int | None = None
    keep_failed: bool = False


def _name(model: Callable) -> str:
    """What tells models apart: a name that the maker carries, else where it was defined."""
    return str(getattr(model, "model", None) or f"{model.__module__}.{model.__qualname__}:{getattr(getattr(model, '__code__', None), 'co_names', '')}")


def _cap(seconds: float | None) -> float | None:
    return seconds if seconds and seconds > 0 else None


def _span(name: str, w: Column) -> Column:
    return F.format_string(f"{name}: %.2f to %.2f", w["start"], w["end"])


def _heading() -> Column:
    topic = F.coalesce(F.concat(F.lit(", "), F.nullif(F.col("topic"), F.lit(""))), F.lit(""))
    return F.concat(F.lit("Video "), F.col("video"), F.lit(", clip "), F.col("clip_idx").cast("string"), topic)


def _clips(clips: DataFrame, knobs: Knobs) -> DataFrame:
    rows = clips if knobs.clip_idx is None else clips.where(F.col("clip_idx") == knobs.clip_idx)
    return rows.select("video", "clip_idx", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "topic", "text")


def ask_offline(clips: DataFrame, model: Callable[[], ports.ModelPort], knobs: Knobs = Knobs()) -> DataFrame:
    """A model's text for each clip, of which it sees the first ``offline`` seconds."""
    shown = windows.earlier(F.col("start"), F.col("end"), _cap(knobs.offline))
    speech = F.concat(F.lit("Speech: "), records.shortened(F.col("text"), SPEECH_CHARS))
    prompt = F.concat_ws("\n", F.lit("Ask and answer one question about the whole clip, as a JSON object with question, answer and evidence."), _heading(), _span("Shown", shown), speech)
    return ports.ask(_clips(clips, knobs).withColumn("prompt", prompt), "prompt", model, error="error").drop("prompt")


def offline_rows(said: DataFrame) -> DataFrame:
    """Rows with ``reason``, null where a row stands: a question and an answer, with the clip's own bounds."""
    e = F.from_json(jsonrepair.repaired(F.col("response"), jsonrepair.OFFLINE), "question string, answer string, evidence string")
    rows = said.withColumn("e", e)
    some = lambda c: T.strip(F.coalesce(F.col(f"e.{c}"), F.lit("")))
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("e").isNull(), "parse_failure").when((some("question") == "") | (some("answer") == ""), "empty question or answer")
    return rows.select("video", "clip_idx", F.col("start").alias("clip_start"), F.col("end").alias("clip_end"), "topic", F.lit(OFFLINE_TYPE).alias("type"), some("question").alias("question"), some("answer").alias("answer"), some("evidence").alias("evidence"), reason.alias("reason"))


def ask_streaming(clips: DataFrame, model: Callable[[], ports.ModelPort], knobs: Knobs = Knobs()) -> DataFrame:
    """A model's text for each anchor that has enough future."""
    rows = qa.anchors(_clips(clips, knobs), knobs.ratios, _cap(knobs.seen), _cap(knobs.future)).where("kept").drop("kept")
    speech = F.concat(F.lit("Speech so far: "), records.shortened(records.first_words(F.col("text"), F.col("ratio")), SPEECH_CHARS))
    task = "List questions that someone asks now and that only the later part answers, as a JSON array of objects with type, question, answer, answer_time and evidence; an object with skip and skip_reason where there are none."
    prompt = F.concat_ws("\n", F.lit(task), F.lit("Types: " + ", ".join(knobs.types)), _heading(), _span("Seen", F.col("seen")), F.format_string("Now: %.2f", F.col("query_time").cast("double")), _span("Later", F.col("future")), speech)
    return ports.ask(rows.withColumn("prompt", prompt), "prompt", model, error="error").drop("prompt", "seen", "future")


def streaming_rows(said: DataFrame, knobs: Knobs = Knobs()) -> DataFrame:
    """An entry a row with ``reason``, null where all rules pass; a failed call or a text without a list is one row.

    An entry that is no object falls out alone.  Rules look at the anchor's time; the row keeps the
    model's own query time where it gave one.
    """
    listed = said.withColumn("list", F.from_json(jsonrepair.repaired(F.col("response"), jsonrepair.STREAMING), "array<string>"))
    each = listed.where("list IS NULL OR size(list) > 0").select("*", F.posexplode_outer("list").alias("pos", "raw"))
    each = each.withColumns({"entry": F.when(F.col("raw").rlike(r"^\s*\{"), F.from_json("raw", ENTRY)), "clip_end": F.col("end")})
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("list").isNull(), "parse_failure").otherwise(qa.reject_reason(knobs.types, F.json_object_keys("raw")))
    own = F.col("entry.query_time").try_cast("double")
    asked = F.round(F.when(F.isnan(own), None).otherwise(own), 2)
    return each.select(
        "video", "clip_idx", F.col("start").alias("clip_start"), "clip_end", "topic", "ratio", "pos", "entry.type",
        T.strip(F.col("entry.question")).alias("question"), T.strip(F.col("entry.answer")).alias("answer"), T.strip(F.coalesce("entry.evidence", F.lit(""))).alias("evidence"),
        F.coalesce(asked, F.round("query_time", 2)).alias("query_time"), F.round(F.col("entry.answer_time").try_cast("double"), 2).alias("answer_time"), reason.alias("reason"),
    )


def ask_validator(rows: DataFrame, model: Callable[[], ports.ModelPort], knobs: Knobs = Knobs()) -> DataFrame:
    """A model's text on each row by what stands before the question, up to the answer and behind it."""
    before = windows.latter(F.col("clip_start"), F.col("query_time"), _cap(knobs.before))
    evidence = windows.earlier(F.col("query_time"), F.col("answer_time"), _cap(knobs.evidence))
    after = windows.after(F.col("answer_time"), F.col("clip_end"), _cap(knobs.after))
    task = "Judge the row as a JSON object with checks (" + ", ".join(jsonrepair.CHECKS) + "), verdict and reason."
    prompt = F.concat_ws("\n", F.lit(task), _heading(), _span("Before", before), _span("Evidence", evidence), _span("After", after), F.concat(F.lit("Question: "), F.col("question")), F.concat(F.lit("Answer: "), F.col("answer")))
    return ports.ask(rows.withColumn("prompt", prompt), "prompt", model, error="error").drop("prompt")


def judged(said: DataFrame) -> DataFrame:
    """Rows with ``status`` pass, fail or error, and the three checks."""
    v = said.withColumn("v", jsonrepair.verdict(F.col("response")))
    status = F.when(F.col("error").isNotNull(), "error").otherwise(F.coalesce("v.verdict", F.lit("error")))
    return v.withColumns({"status": status, "judgement": F.coalesce("error", "v.reason")} | {c: F.col(f"v.{c}") for c in jsonrepair.CHECKS}).drop("v", "response", "error")


def status_counts(rows: DataFrame) -> DataFrame:
    """Rows a status and how many pass each check."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in jsonrepair.CHECKS])


def qa_run(clips: DataFrame, offline: Callable[[], ports.ModelPort] | None, streaming: Callable[[], ports.ModelPort] | None, validator: Callable[[], ports.ModelPort] | None, root: str, knobs: Knobs = Knobs()) -> dict[str, DataFrame]:
    """From ``clips`` (``video, clip_idx, start, end, topic, text``) to records and training samples.

    A stage without a model is skipped: no rows of that kind, or no validation.  Returns ``offline,
    streaming, drop_log, validated, stats, rows`` (merged) and ``samples``.  What models said is asked anew where
    knobs, models (by name) or input rows are others than those of the stored tables.
    """
    spark = clips.sparkSession
    inputs, settings = files.contents(clips), {k: str(v) for k, v in vars(knobs).items() if k not in ("window", "keep_failed")}

    def table_of(name: str, make: Callable[[], DataFrame], model: Callable, rows: str = inputs) -> DataFrame:
        return files.stored(spark, f"{root}/{name}", make, acquire.signature({"stage": name, "model": _name(model), "rows": rows, **settings}))

    none = clips.limit(0).withColumns({"response": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    off = offline_rows(none if offline is None else table_of("offline", lambda: ask_offline(clips, offline, knobs), offline))
    on = streaming_rows(none.withColumns({"ratio": F.lit(0.0), "query_time": F.lit(0.0)}) if streaming is None else table_of("streaming", lambda: ask_streaming(clips, streaming, knobs), streaming), knobs)
    where = ["video", "clip_idx", "reason"]
    drops = off.where("reason IS NOT NULL").select(*where, F.lit("offline").alias("kind")).unionByName(on.where("reason IS NOT NULL").select(*where, F.lit("streaming").alias("kind")))
    kept_on = on.where("reason IS NULL").drop("reason")
    out = {}
    if validator is not None:
        checked = judged(table_of("validated", lambda: ask_validator(kept_on, validator, knobs), validator, files.contents(kept_on)))
        out = {"validated": checked, "stats": status_counts(checked)}
        kept_on = checked if knobs.keep_failed else checked.where("status = 'pass'")
    number = lambda *order: F.row_number().over(Window.partitionBy("video").orderBy(*order)) - 1
    kept_off = off.where("reason IS NULL").drop("reason").withColumn("ord", number("clip_idx", "clip_start"))
    kept_on = kept_on.withColumn("ord", number("clip_idx", "clip_start", "ratio", "pos"))
    own = clips.select("video", "clip_idx", "start", "end", F.col("start").alias("ord"))
    rows = qa.merged(kept_off, kept_on, own)
    samples = qa.expanded(kept_off, kept_on, knobs.window)  # bounds are the clip's own already
    return {"offline": kept_off, "streaming": kept_on, "drop_log": drops, **out, "rows": rows, "samples": samples}


def acquisition_run(seeds: DataFrame, details: DataFrame, n: int, lang: str, domain: Sequence[str], positive: Sequence[str], negative: Sequence[str], lexicon: Mapping[str, Sequence[str]], default: str = "other", fall_back: bool = False) -> dict[str, DataFrame]:
    """Candidates (``id, ord, title, description``) in order up to the ``n``-th that passes the filters.

    Details (``id`` and any of the seed's columns) stand over the seed.  A seed without details fails, or
    with ``fall_back`` goes on by itself.  Returns ``kept`` (with category and folder), ``rejected``,
    ``failed`` and ``counts`` of outcomes; all stop at the ``n``-th kept one.
    """
    known = details.select(F.col("id").alias("_id")).distinct().withColumn("_known", F.lit(True))
    rows = acquire.over_seed(seeds, details, "id", [c for c in details.columns if c in seeds.columns and c != "id"])
    rows = rows.join(known, rows["id"] == known["_id"], "left").withColumn("failed", F.col("_known").isNull() & F.lit(not fall_back)).drop("_id", "_known")
    text = T.merge_parts(F.col("title"), F.col("description"))
    tested = acquire.cascade(rows, text, lang, domain, positive, negative).withColumn("text", T.normalize(text))
    tested = tested.withColumn("outcome", F.when(F.col("failed"), "failed").when(F.col("reject_reason").isNotNull(), "rejected").otherwise("kept"))
    seen = acquire.keep_until(tested, F.col("outcome") == "kept", "ord", n).drop("failed", "kept")
    kept = seen.where("outcome = 'kept'").drop("reject_reason", "outcome").withColumn("c", T.classify(F.col("text"), lexicon, default))
    kept = kept.withColumns({"category": F.col("c.category"), "category_reason": F.col("c.reason"), "folder": acquire.folder(F.col("c.category"))}).drop("c", "text")
    counts = seen.groupBy("outcome", F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))
    return {"kept": kept, "rejected": seen.where("outcome = 'rejected'").drop("text"), "failed": seen.where("outcome = 'failed'").drop("text", "reject_reason"), "counts": counts.withColumn("reason", F.when(F.col("outcome") == "rejected", F.col("reason")).otherwise(""))}


def evaluation_run(samples: DataFrame, model: Callable[[], ports.ModelPort], root: str, n_frames: int = 8, failures: int = 10) -> dict[str, DataFrame]:
    """A model's texts on ``samples`` (``idx, sample_type, qa_type, question, target, start, end``) and their scores.

    The model sees the question and the frame times of the sample's policy.  A failed call is a row with
    label ERROR.  Returns ``predictions``, ``report`` and ``failures``.
    """
    times = F.array_join(F.transform(windows.policy_times(F.col("sample_type"), F.col("start"), F.col("end"), n_frames), lambda t: F.format_string("%.2f", t)), " ")
    prompt = F.concat_ws("\n", F.concat(F.lit("Frames: "), times), F.concat(F.lit("Question: "), F.col("question")))
    sign = acquire.signature({"model": _name(model), "n_frames": n_frames, "rows": files.contents(samples)})
    said = files.stored(samples.sparkSession, f"{root}/predictions", lambda: ports.ask(samples.withColumn("prompt", prompt), "prompt", model, error="error").drop("prompt"), sign)
    rows = records.predictions(said, F.col("response")).drop("response")
    failed = F.col("error").isNotNull()
    rows = rows.withColumns({"pred_label": F.when(failed, "ERROR").otherwise(F.col("pred_label")), "correct_answerability": ~failed & F.col("correct_answerability")})
    return {"predictions": rows, "report": evaluate.report(rows), "failures": evaluate.failures(rows, failures)}


# ---- over the test tables -------------------------------------------------------------------------


def _of(prompt: str) -> tuple[int, float]:
    """The video's number and the time that a prompt names."""
    now = re.search(r"^Now: ([\d.]+)", prompt, re.M)
    return int(re.search(r"Video v(\d+)", prompt)[1]), float(now[1]) if now else 0.0


def offline_stub(prompts: list[str]) -> list[str]:
    """Every fifth video gets no object."""
    numbers = [_of(p)[0] for p in prompts]
    return ["nothing" if v % 5 == 0 else json.dumps({"question": f"what {v}", "answer": f"o{v}"}) for v in numbers]


def streaming_stub(prompts: list[str]) -> list[str]:
    """Lists of an entry and a stray number, bare, fenced or inside prose; some videos fail, skip or get no list."""
    out = []
    for v, now in map(_of, prompts):
        if v % 13 == 0:
            raise TimeoutError("too slow")
        entry = {"type": qa.STREAMING_TYPES[v % 2], "question": f"when {v}", "answer": f"s{v}", "answer_time": now + v % 4 * 4, "skip": v % 7 == 0}
        body = json.dumps([entry, 3])
        out.append("no list" if v % 11 == 0 else (body, f"```json\n{body}\n```", f"Here: {body} done")[v % 3])
    return out


def validator_stub(prompts: list[str]) -> list[str]:
    """Always says pass; every tenth video's question leaks, and every seventeenth gets no object."""
    body = lambda v: json.dumps({"checks": dict.fromkeys(jsonrepair.CHECKS, True) | {jsonrepair.CHECKS[0]: v % 10 != 3}, "verdict": "pass", "reason": "r"})
    return ["?" if v % 17 == 0 else body(v) for v, _ in map(_of, prompts)]


def answer_stub(prompts: list[str]) -> list[str]:
    """Waits, answers or fails by the question's length."""
    n = [len(p.split("\nQuestion: ", 1)[1]) for p in prompts]
    if any(x % 10 == 0 for x in n):
        raise TimeoutError("too slow")
    return ["<WAIT> hold" if x % 3 == 0 else "<ANSWER> it moves" for x in n]


def qa_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a whole run over one clip an order, with stub models."""
    k = F.col("o_orderkey")
    start = (k % 100).cast("double")
    clips = table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), k).alias("video"), (k % 3).cast("int").alias("clip_idx"), start.alias("start"), (start + (20 + F.col("o_custkey") % 600)).alias("end"), F.lit("").alias("topic"), F.col("o_orderpriority").alias("text"))
    run = qa_run(clips, lambda: offline_stub, lambda: streaming_stub, lambda: validator_stub, files.scratch(spark, "qa-run"))
    tenths = lambda c: F.round(F.col(c) * 10).cast("long").alias(f"{c}_tenths")
    return run["samples"].select("video", "clip_idx", "type", "question", "sample_type", "source_qa_id", "target", tenths("start"), tenths("end"))


QUERIES["qa_lifecycle"] = qa_lifecycle
SQL["qa_lifecycle"] = """WITH c AS (SELECT o_orderkey AS v, 'v' || o_orderkey AS video, (o_orderkey % 3)::INT AS clip_idx, (o_orderkey % 100)::DOUBLE AS start, (o_orderkey % 100)::DOUBLE + (20 + o_custkey % 600) AS "end" FROM orders),
a AS (SELECT *, start + ("end" - start) * ratio AS t FROM c, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) r(ratio)),
s AS (SELECT *, round(t, 2) AS q, round(t, 2) + v % 4 * 4 AS w, CASE WHEN v % 2 = 0 THEN 'sonographer_intent' ELSE 'next_action' END AS type FROM a
      WHERE "end" - t >= 8 AND v % 13 > 0 AND v % 11 > 0 AND v % 7 > 0 AND v % 4 > 1),
k AS (SELECT *, printf('%s_c%d_stream_%s_tq%d_ta%d_%03d', video, clip_idx, type, trunc(q)::BIGINT, trunc(w)::BIGINT, row_number() OVER (PARTITION BY v ORDER BY ratio) - 1) AS id
      FROM s WHERE w <= "end" + 0.5 AND v % 17 > 0 AND v % 10 <> 3)
SELECT video, clip_idx, 'clip_summary' AS type, 'what ' || v AS question, 'offline_answer' AS sample_type, printf('%s_c%d_offline_clip_summary_%03d', video, clip_idx, 0) AS source_qa_id, '<ANSWER> o' || v AS target,
       round(start * 10)::BIGINT AS start_tenths, round("end" * 10)::BIGINT AS end_tenths FROM c WHERE v % 5 > 0
UNION ALL SELECT video, clip_idx, type, 'when ' || v, 'streaming_wait', id, '<WAIT> Not enough information yet. More video is needed.', round(greatest(start, q - 30) * 10)::BIGINT, round(q * 10)::BIGINT FROM k
UNION ALL SELECT video, clip_idx, type, 'when ' || v, 'streaming_answer', id, '<ANSWER> s' || v, round(greatest(start, w - 30) * 10)::BIGINT, round(w * 10)::BIGINT FROM k"""


def acquisition_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as candidates, labelled ones as those with details, up to the hundredth kept one."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seeds = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.col("source").alias("title"), F.col("text").alias("description"))
    run = acquisition_run(seeds, labels.select(F.col("doc_id").alias("id")), 100, "en", ["the"], ["mail"], ["license", "trash"], {"licence": ("license", "copyright"), "prose": ("the", "and")}, "none")
    kept = run["kept"].select("id", F.lit("kept").alias("outcome"), "category", "folder")
    rejected = run["rejected"].select("id", F.col("reject_reason").alias("outcome"), F.lit("").alias("category"), F.lit("").alias("folder"))
    return kept.unionByName(rejected).unionByName(run["failed"].select("id", "outcome", F.lit("").alias("category"), F.lit("").alias("folder")))


QUERIES["acquisition_lifecycle"] = acquisition_lifecycle
SQL["acquisition_lifecycle"] = f"""WITH t AS (SELECT doc_id, {_X.replace("coalesce(text, '')", "source || ' ' || coalesce(text, '')")} AS x, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents),
o AS (SELECT doc_id, x, CASE WHEN NOT known THEN 'failed' WHEN len(regexp_extract_all(x, '[a-zA-Z]{{2,}}')) < 4 THEN 'language' WHEN NOT contains(x, 'the') THEN 'domain'
        WHEN (contains(x, 'license') OR contains(x, 'trash')) AND NOT contains(x, 'mail') THEN 'visual' ELSE 'kept' END AS outcome FROM t),
k AS (SELECT *, sum(CASE WHEN outcome = 'kept' THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) - CASE WHEN outcome = 'kept' THEN 1 ELSE 0 END AS before FROM o),
h AS (SELECT *, contains(x, 'license')::INT + contains(x, 'copyright')::INT AS l, contains(x, 'the')::INT + contains(x, 'and')::INT AS p FROM k WHERE before < 100)
SELECT doc_id AS id, outcome, CASE WHEN outcome <> 'kept' THEN '' WHEN l >= p THEN 'licence' ELSE 'prose' END AS category, CASE WHEN outcome = 'kept' THEN 'uncategorized' ELSE '' END AS folder FROM h"""


def evaluation_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as samples, scored overall and by type, with a stub model that fails on some."""
    c = table(spark, sf_dir, "conversations")
    wait = F.col("turn") % 2 == 0
    samples = c.select(F.col("conv_id").alias("idx"), F.when(wait, "streaming_wait").otherwise("streaming_answer").alias("sample_type"), F.col("role").alias("qa_type"), F.col("text").alias("question"), F.when(wait, "<WAIT> w").otherwise("<ANSWER> a").alias("target"), F.lit(0.0).alias("start"), (F.col("turn") + 1.0).alias("end"))
    out = evaluation_run(samples, lambda: answer_stub, files.scratch(spark, "evaluation"))["report"]
    return out.select("level", "key", "total", "correct", "wait_count", "wait_correct", "premature_answer", "wait_other", "answer_correct", "over_wait", "answer_other", "pred_error")


QUERIES["evaluation_lifecycle"] = evaluation_lifecycle
SQL["evaluation_lifecycle"] = counted("""WITH p AS (SELECT turn % 2 = 0 AS w, CASE WHEN turn % 2 = 0 THEN 'streaming_wait' ELSE 'streaming_answer' END AS sample_type, role AS qa_type,
  CASE WHEN length(text) % 10 = 0 THEN 'ERROR' WHEN length(text) % 3 = 0 THEN 'WAIT' ELSE 'ANSWER' END AS pred FROM conversations)
SELECT CASE WHEN grouping(sample_type) = 0 THEN 'sample_type' WHEN grouping(qa_type) = 0 THEN 'qa_type' ELSE 'overall' END AS level, coalesce(sample_type, qa_type, 'all') AS key, count(*) AS total,
  count_if(w AND pred = 'WAIT' OR NOT w AND pred = 'ANSWER') AS correct, count_if(w) AS wait_count, count_if(w AND pred = 'WAIT') AS wait_correct, count_if(w AND pred = 'ANSWER') AS premature_answer,
  count_if(w AND pred = 'ERROR') AS wait_other, count_if(NOT w AND pred = 'ANSWER') AS answer_correct, count_if(NOT w AND pred = 'WAIT') AS over_wait, count_if(NOT w AND pred = 'ERROR') AS answer_other, count_if(pred = 'ERROR') AS pred_error
FROM p GROUP BY GROUPING SETS ((sample_type), (qa_type), ())""")
