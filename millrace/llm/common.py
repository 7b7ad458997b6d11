"""Shared helpers of the training-data operators: scratch tables, input checks, connected components."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one is set only where none is named, as in tests."""
    root = spark.conf.get(SCRATCH_CONF, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(SCRATCH_CONF, root)
    return root.rstrip("/")


_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextlib.contextmanager
def dropped_scratch(spark: SparkSession):
    """Scratch paths that are given out inside are removed at the end: for work whose result is written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            drop_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it back.

    The written files survive the loss of any executor, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")


def free_names(df: DataFrame, n: int) -> list[str]:
    """``n`` column names that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    names = (f"_own_{k}" for k in range(n + len(taken)))
    return [name for name in names if name not in taken][:n]


def arrow_batch(ddl: str, columns):
    """A record batch of flat ``columns`` by a DDL schema, for Python workers (they have no session)."""
    import pyarrow as pa

    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


#: Bytes of a batch that an operator on texts takes at once.
PART_BYTES = 4 << 20


def parts(batch):
    """Slices of a record batch of about ``PART_BYTES`` each, without copies; all its rows, in order."""
    step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def release() -> None:
    """Give freed memory back to the system: Arrow's pool and, where the C library can, the heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run=None, *, whole: bool = False):
    """``run`` on a stream of batches, for Python workers: it gets ``parts`` (or ``whole`` batches), and at its end what it freed is released.

    Spark keeps idle workers for a minute; what they hold lies beside the next stages in the executor's memory.
    """
    if run is None:
        return functools.partial(lean, whole=whole)

    @functools.wraps(run)
    def lean_run(batches):
        try:
            yield from run(batches if whole else (part for batch in batches for part in parts(batch)))
        finally:
            release()

    return lean_run


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id, folds: int, fold: int):
    """True where crc32 of the id's decimal text leaves remainder ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected edge table ``(a, b)`` of longs.

    Every round each vertex hooks to its smallest neighbour, and the edges are rewritten between the
    hooked vertices (contraction), so the edge table shrinks geometrically.  Each round is written to
    the shared folder; only row counts reach the driver.  Returns ``(node, root)`` with the smallest
    vertex of the component as ``root``, one row for each vertex that has an edge to another vertex.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    live = materialize(live.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    hooks = []
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        hook = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root"))
        # a hook's target may itself be hooked: follow the chain inside this round by pointer doubling
        hook = materialize(hook, name)
        while True:
            far = hook.select(F.col("node").alias("root"), F.col("root").alias("far"))
            step = materialize(hook.join(far, "root").select("node", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), name)
            hook = step.select("node", "root")
            if step.where("moved").isEmpty():
                break
        hooks.append(hook)
        left = live.join(hook.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        both = left.join(hook.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        live = materialize(both.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), name)
    if not hooks:
        return spark.createDataFrame([], "node long, root long")
    out = hooks[0]
    for hook in hooks[1:]:
        later = hook.select(F.col("node").alias("root"), F.col("root").alias("far"))
        out = out.join(later, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
    return materialize(out, name)
