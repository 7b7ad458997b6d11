"""Sources, sinks, ports and streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from millrace.sources import files, ports
from millrace.streaming import answers


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    files.write_lines(df, f"{tmp_path}/l")
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_lines(df, f"{tmp_path}/l")
    files.write_lines(df, f"{tmp_path}/l", "append")
    assert files.json_lines(spark, f"{tmp_path}/l", "a int, b string").count() == 4
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "l").glob("part-*"))
    (tmp_path / "blank.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.json_lines(spark, f"{tmp_path}/blank.jsonl", "a int").count() == 2
    files.write_document(df.limit(1), f"{tmp_path}/doc.json")
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": 1}
    with pytest.raises(FileExistsError):
        files.write_document(df.limit(1), f"{tmp_path}/doc.json")
    files.write_document(df.where("a = 2"), f"{tmp_path}/doc.json", overwrite=True)
    assert files.documents(spark, f"{tmp_path}/doc.json", "a int, b string").first()["b"] == "é"
    assert files.optional_documents(spark, f"{tmp_path}/none.json", "a int").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        files.required(df.limit(0))


def test_csv(spark, tmp_path):
    a = spark.createDataFrame([(1, [1, 2])], "x int, tags array<int>")
    b = spark.createDataFrame([(2, 'say "hi", ok')], "x int, note string")
    files.write_csv(files.union_header(a, b).coalesce(1), f"{tmp_path}/c")
    (part,) = (tmp_path / "c").glob("part-*")
    lines = part.read_bytes().decode().splitlines()
    assert lines[0] == "﻿x,tags,note" and lines[1].startswith('1,"[1,2]"') and lines[2].startswith("2,")
    assert 'say ""hi"", ok' in lines[2]


def test_triples(spark):
    s = spark.createDataFrame([([(0.0, 3.0, 'he said "x"\n'), (3.0, 6.5, None)],)], "t array<struct<start:double,end:double,text:string>>")
    assert json.loads(s.select(files.triples(F.col("t"))).first()[0]) == [[0.0, 3.0, 'he said "x"\n'], [3.0, 6.5, ""]]


def test_media_listing(spark, tmp_path):
    for name in ("a/x.mp4", "y.webm", "z.mp4.part", "n.txt", "b/m.mov"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"1" * len(name))
    got = [r["path"].rpartition("/")[2] for r in files.media(spark, str(tmp_path)).collect()]
    assert got == ["x.mp4", "m.mov", "y.webm"] and files.media(spark, str(tmp_path), 1).count() == 1
    big = files.largest_file(files.media(spark, str(tmp_path)).withColumn("k", F.lit(1)), "k").first()["path"]
    assert big.endswith("x.mp4") or big.endswith("b/m.mov")


def test_clip_lookup(spark):
    df = spark.createDataFrame([("v", [(5,), (9,)])], "video string, clips array<struct<clip_idx:int>>")
    assert files.clip_at(df, 1).first()["clip_idx"] == 9
    with pytest.raises(ValueError):
        files.clip_at(df, 2)
    assert spark.range(1).select(files.data_url(F.lit("ab").cast("binary"))).first()[0] == "data:video/mp4;base64,YWI="


def test_port(spark):
    df = spark.createDataFrame([(1, "x" * 501, "old"), (2, "short", None), (3, None, None)], "id int, p string, response string")
    got = {r["id"]: r["response"] for r in ports.ask(df, "p", lambda: ports.stub).collect()}
    assert got[1] == "<ANSWER> 501 signs" and got[2] == got[3] == "<WAIT> more context is needed"
    assert spark.range(1).select(ports.backoff(F.lit(2), F.lit(False)), ports.backoff(F.lit(2), F.lit(True))).first()[:] == (8.0 * 1.6, 60.0)


def test_stream_of_sessions(spark, tmp_path):
    rows = [(u, 60 * m) for u in (1, 2) for m in (0, 5, 100, 101, 400)]
    events = spark.createDataFrame(rows, "user_id long, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = answers.sessions(stream, "30 minutes", "10 minutes").writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = {tuple(r) for r in spark.table("sessions_out").collect()}
    batch = {tuple(r) for r in answers.sessions(events, "30 minutes", "10 minutes").collect()}
    last = max(r[2] for r in batch)
    assert closed == {r for r in batch if r[2] < last} and len(batch) == 6
    assert answers.sliding(events, "10 minutes", "5 minutes", "1 minute", "ts", "user_id").count() > 6


def test_an_event_at_the_gap_begins_a_session(spark, tmp_path):
    """Half an hour after the last event and a microsecond before it, as a batch and as a stream."""
    gap, at = 1_800_000_000, 1_704_579_374_000_000
    rows = [(1, at), (1, at + gap), (2, at), (2, at + gap - 1), (3, at), (3, at + gap - 1), (3, at + 2 * gap - 1), (9, at + 100 * gap)]
    want = {(1, at, at + gap, 1), (1, at + gap, at + 2 * gap, 1), (2, at, at + 2 * gap - 1, 2), (3, at, at + 2 * gap - 1, 2), (3, at + 2 * gap - 1, at + 3 * gap - 1, 1), (9, at + 100 * gap, at + 101 * gap, 1)}
    events = spark.createDataFrame(rows, "user_id long, us long").select("user_id", F.timestamp_micros("us").alias("ts"))
    events.write.parquet(f"{tmp_path}/in")
    micros = lambda df: {tuple(r) for r in df.select("user_id", F.unix_micros("start"), F.unix_micros("end"), "n").collect()}
    assert micros(answers.sessions(events, "30 minutes", "10 minutes")) == want
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = answers.sessions(stream, "30 minutes", "10 minutes").writeStream.outputMode("append").format("memory").queryName("gap_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert micros(spark.table("gap_out")) == {r for r in want if r[0] != 9}


def test_stream_of_answers(spark, tmp_path):
    schema = "question string, t double, answer_time double, clip_end double"
    for k, ticks in enumerate([[("a", 0.0, 12.0, 60.0), ("a", 5.0, 12.0, 60.0), ("b", 0.0, 90.0, 60.0)], [("a", 10.0, 12.0, 60.0), ("a", 15.0, 12.0, 60.0), ("a", 20.0, 12.0, 60.0), ("b", 65.0, 90.0, 60.0)]]):
        spark.createDataFrame(ticks, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = answers.first_answers(stream).writeStream.outputMode("append").format("memory").queryName("answers_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("answers_out").collect()] == [("a", 15.0, 3)]


def test_progressive_and_jobs(spark):
    rows = spark.createDataFrame([(0, 12, 60), (0, 99, 60), (70, 71, 60)], "question_time long, answer_time long, clip_end long")
    assert sorted((r["answered_at"] or -1, r["waits"]) for r in answers.ask_again(rows).collect()) == [(-1, 1), (-1, 13), (15, 3)]
    log = spark.createDataFrame([("j", 1, k, "running" if k < 700 else "completed", f"l{k}") for k in range(701)], "job string, at int, ord int, status string, line string")
    r = answers.job_status(log).first()
    assert r["status"] == "completed" and len(r["logs"]) == 600 and r["logs"][-1] == "l700"
