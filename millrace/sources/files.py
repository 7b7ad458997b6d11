"""Documents and tables in files: JSON documents, JSON lines, CSV, media listings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Media suffixes, and the byte order mark that spreadsheets look for.
MEDIA_SUFFIXES = ("mp4", "webm", "mkv", "avi", "mov")
BOM = "﻿"


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names; a local one only where tests run without a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/millrace/{name}-{uuid.uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file from the driver, put in place by one overwriting rename: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    part, where = (jvm.org.apache.hadoop.fs.Path(x) for x in (f"{path}.{uuid.uuid4().hex}.tmp", path))
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), conf)
    fs = where.getFileSystem(conf)
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(part), context.makeQualified(where), options)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    if not exists(spark, path):
        return None
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def contents(rows: DataFrame) -> str:
    """What tells two inputs apart: schema, number of rows and the sum of their hashes, whatever their order."""
    digest = F.sum(F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in rows.columns] or [F.lit(0)]).cast("decimal(38,0)"))
    n, total = rows.agg(F.count("*"), digest).first()
    return f"{rows.schema.simpleString()} {n} {total}"


def stored(spark: SparkSession, path: str, make: Callable[[], DataFrame], signature: str = "") -> DataFrame:
    """The table at ``path``, made first unless it is there, whole and of this ``signature``.

    A run that is repeated goes on behind its last one; one with other settings or inputs makes its tables anew.
    """
    beside = f"{path}/_signature"
    if not exists(spark, f"{path}/_SUCCESS") or (read_text(spark, beside) or "") != signature:
        make().write.mode("overwrite").parquet(path)
        write_text(spark, beside, signature)
    return spark.read.parquet(path)


def documents(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Whole-file JSON documents, one row each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def optional_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The same, or no rows where there is no file."""
    return documents(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str, limit: int | None = None) -> DataFrame:
    """JSON lines; blank lines don't count, broken ones raise."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return rows if limit is None else rows.limit(limit)


def required(rows: DataFrame) -> DataFrame:
    if rows.isEmpty():
        raise ValueError("no rows")
    return rows


def media(spark: SparkSession, folder: str, limit: int | None = None, order: str = "path") -> DataFrame:
    """``path, length`` of media files below a folder; unfinished downloads (.part) don't match."""
    glob = "*.{" + ",".join(MEDIA_SUFFIXES) + "}"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")
    return found.orderBy(order) if limit is None else found.orderBy(order).limit(limit)


def runs(spark: SparkSession, glob: str, schema: T.StructType | str, n: int = 8) -> DataFrame:
    """The newest documents with their paths."""
    rows = spark.read.schema(schema).option("multiLine", True).json(glob)
    return rows.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at")).orderBy(F.desc("at"), "path").limit(n)


def clip_at(clips: DataFrame, position: int) -> DataFrame:
    """The clip at a list position (not an index value); out of range raises."""
    found = clips.select("video", F.posexplode("clips").alias("pos", "clip")).where(F.col("pos") == position).select("video", "clip.*")
    return required(found)


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls kept; refuses to overwrite unless told to."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def _csv_value(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    nested = isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
    return F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("")).alias(name)


def union_header(*tables: DataFrame) -> DataFrame:
    """All rows under one header, columns in first-seen order."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a byte order mark before each file's header; nested values are JSON, nulls are empty."""
    flat = rows.select(*[_csv_value(f.name, f.dataType) for f in rows.schema])
    names = flat.columns
    flat.select(*[F.col(f"`{n}`").alias(BOM + n if k == 0 else n) for k, n in enumerate(names)]).write.mode(mode).option("header", True).option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def triples(stream: Column) -> Column:
    """JSON of ``[start, end, "text"]`` arrays from an array of structs."""
    text = lambda s: F.regexp_extract(F.to_json(F.struct(F.coalesce(s["text"], F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    one = lambda s: F.concat(F.lit("["), s["start"].cast("string"), F.lit(","), s["end"].cast("string"), F.lit(","), text(s), F.lit("]"))
    return F.concat(F.lit("["), F.array_join(F.transform(stream, one), ","), F.lit("]"))


def write_document(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """One row as an indented JSON document; a reader, or a run after a crash, finds the old document or the new one."""
    import json

    (only,) = rows.limit(2).toJSON().collect()
    spark = rows.sparkSession
    if not overwrite and exists(spark, path):
        raise FileExistsError(path)
    write_text(spark, path, json.dumps(json.loads(only), ensure_ascii=False, indent=2))


def largest_file(files: DataFrame, key: str) -> DataFrame:
    """The largest of each key's files."""
    return files.groupBy(key).agg(F.max_by("path", F.struct("length", "path")).alias("path"))


def data_url(content: Column, kind: str = "video/mp4") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def inputs(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """Documents of all paths and globs, each file once, in path order."""
    rows = spark.read.schema(schema).option("multiLine", True).json(list(dict.fromkeys(paths)))
    return rows.select("*", F.col("_metadata.file_path").alias("path")).orderBy("path")


def row_at(rows: DataFrame, index: int, order: str = "idx") -> DataFrame:
    """The row with a given number; out of range raises."""
    return required(rows.where(F.col(order) == index))


def by_category(rows: DataFrame, path: str, folder: Column, mode: str = "errorifexists") -> None:
    """One folder a category."""
    rows.withColumn("category_folder", folder).write.mode(mode).partitionBy("category_folder").json(path)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first path that there is: one given, a new one, a legacy one.  A given path counts without a look."""
    if paths and paths[0] is not None:
        return paths[0]
    return next((p for p in paths[1:] if p is not None and exists(spark, p)), None)
