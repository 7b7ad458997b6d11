"""What is done with media outside Spark: frames by time, speech, clips, downloads, each behind ``ports.MediaPort``."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.text import strip
from . import ports


def setting(spark: SparkSession, name: str) -> str:
    """A setting or secret of the session, else of the driver's environment; it never becomes data."""
    found = spark.conf.get(f"spark.millrace.{name}", None) or os.environ.get(name)
    if not found:
        raise KeyError(f"neither spark.millrace.{name} nor {name} is set")
    return found


def frames_of(port: ports.MediaPort, path: str, indices: list[int]) -> list[bytes]:
    """Frames by number: one that can't be read is the last readable one before it, else the first frame."""
    out: list[bytes] = []
    for i in indices:
        frame = port.frame(path, i)
        if frame is None:
            frame = out[-1] if out else port.frame(path, 0)
        if frame is None:
            raise ValueError(f"no frame of {path} can be read")
        out.append(frame)
    return out


def read_frames(rows: DataFrame, times: Column, port: Callable[[], ports.MediaPort]) -> DataFrame:
    """Add ``frames`` (binary, one a time) to rows with ``path, fps, n_frames``; ``port()`` is made once a task."""
    rows = rows.drop("frames").withColumn("_at", windows.frames_at(times, F.col("fps"), F.col("n_frames")))
    shape = rows.drop("_at").withColumn("frames", F.array().cast("array<binary>")).schema
    path, at = rows.columns.index("path"), rows.columns.index("_at")

    def run(batches: Iterator):
        import pyarrow as pa

        own = port()
        for batch in batches:
            found = [frames_of(own, p, i or []) for p, i in zip(batch.column(path).to_pylist(), batch.column(at).to_pylist(), strict=True)]
            kept = [k for k in range(batch.num_columns) if k != at]
            columns = [*(batch.column(k) for k in kept), pa.array(found, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in kept), "frames"])

    return rows.mapInArrow(run, shape)


def transcribed(videos: DataFrame, port: Callable[[], ports.MediaPort]) -> DataFrame:
    """``(video, ord, start, end, text)`` of the speech in ``videos(video, path)``: times to 2 places, no outer blanks; failures give none."""
    said = ports.each(videos.select("video", "path"), ["path"], lambda: port().transcript, "transcribe")
    rows = said.select("video", F.posexplode(F.from_json("result", "array<struct<start:double,end:double,text:string>>")).alias("ord", "s"))
    return rows.select("video", "ord", F.round("s.start", 2).alias("start"), F.round("s.end", 2).alias("end"), strip(F.col("s.text")).alias("text"))


def clip_path(root: str, video: Column, name: Column) -> Column:
    """Where a cut clip lies: the same for the same clip."""
    return F.concat(F.lit(root.rstrip("/") + "/"), video, F.lit("/"), name, F.lit(".mp4"))


def cut_clips(clips: DataFrame, root: str, port: Callable[[], ports.MediaPort]) -> DataFrame:
    """Add ``clip_file`` and ``error`` to ``clips(video, name, path, start, end)``: copied, or encoded anew where a copy fails."""

    def cutter():
        own = port()

        def cut(path: str, start: float, end: float, out: str) -> str:
            for reencode in (False, True):
                try:
                    if own.cut(path, start, end, out, reencode):
                        return out
                except Exception:
                    if reencode:
                        raise
            raise ValueError("no clip was written")

        return cut

    rows = clips.withColumn("_out", clip_path(root, F.col("video"), F.col("name")))
    done = ports.each(rows, ["path", "start", "end", "_out"], cutter, "cut")
    return done.withColumn("clip_file", F.from_json(F.concat(F.lit("["), "result", F.lit("]")), "array<string>")[0]).drop("result", "_out")


def downloaded(items: DataFrame, folder: str, port: Callable[[], ports.MediaPort]) -> DataFrame:
    """Add ``file`` (null where it failed) and ``error`` to ``items(url)``."""
    done = ports.each(items.withColumn("_folder", F.lit(folder)), ["url", "_folder"], lambda: port().download, "download")
    return done.withColumn("file", F.from_json(F.concat(F.lit("["), "result", F.lit("]")), "array<string>")[0]).drop("result", "_folder")


def details(seeds: DataFrame, port: Callable[[], ports.MediaPort], schema: str, pages: Column) -> DataFrame:
    """The first of each seed's ``pages`` that says something, as ``detail`` of ``schema``, and ``error`` where none does."""

    def first_page():
        own = port()

        def fetch(urls: list[str]) -> dict:
            last: Exception | None = None
            for url in urls:
                try:
                    if found := own.detail(url):
                        return found
                except Exception as e:
                    last = e
            raise last or ValueError("no page says anything")

        return fetch

    done = ports.each(seeds.withColumn("_pages", pages), ["_pages"], first_page, "detail")
    return done.withColumn("detail", F.from_json("result", schema)).drop("result", "_pages")
