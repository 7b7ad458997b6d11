"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Targets: every source is clamped at ``max_epochs`` times its size, and what is above goes to the others
in proportion to their weights until none is above.  Sampling: a source's documents are taken in a seeded
order; each is repeated as often as the whole part of target / size says, and the first ones of the order
once more until the fractional part is used up, the last of them in part.  So a source's taken words are
its target rounded to words.  The order is cut into hash slices: sums of slices give where each slice
begins, and a running sum stays inside one slice, so no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_names, materialize, read_table, require

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: float, budget: float | None = None) -> DataFrame:
    """Add ``target`` to ``(source, weight, source_size)`` rows, a row a source.

    ``budget`` defaults to the sum of sizes.  Where all sources together can't hold it at ``max_epochs``,
    each gets its cap.  Each round is one aggregate over the source table; a round clamps every source
    above its cap, so there are at most as many rounds as sources.
    """
    total = F.lit(float(budget)) if budget is not None else F.sum("source_size").cast("double")
    cap = F.col("source_size") * F.lit(float(max_epochs))
    state = sources.withColumn("cap", cap).withColumn("clamped", F.col("cap") <= 0)
    whole = state.agg(total.alias("t")).first().t or 0.0
    while True:
        # what is left for the open sources, and the weight it is shared by: two numbers
        left = state.agg(
            F.lit(whole) - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~F.col("clamped"), F.col("weight"))), F.lit(0)).cast("double"),
        ).first()
        level = left[0] / left[1] if left[1] else 0.0
        state = state.withColumn("share", F.col("weight") * F.lit(level))
        over = state.where(~F.col("clamped") & (F.col("share") > F.col("cap"))).count()
        if not over:
            return state.withColumn("target", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("share"))).drop("cap", "clamped", "share")
        state = materialize(state.withColumn("clamped", F.col("clamped") | (F.col("share") > F.col("cap"))).drop("share"), "water")


def ranked_weights(sizes: DataFrame, cycle: int = 3) -> DataFrame:
    """Weight 1, 2, ... ``cycle``, repeating, by code point order of the source, null last.

    Ranks come from range partitions and the counts of those before, so the source table is never
    sorted in one task.  UTF-8 order is code point order.
    """
    parts = materialize(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    inside = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    # a row a partition, of which there are no more than shuffle partitions
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = parts.withColumn("rank", F.row_number().over(inside)).join(F.broadcast(before), "part")
    return ranked.withColumn("weight", ((F.col("before") + F.col("rank") - 1) % cycle + 1).cast("long")).drop("part", "rank", "before")


def _order(text: Column, row_id: Column, seed: int) -> Column:
    """The seeded place of a row: a hash of its id and text."""
    content = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(row_id.cast("string"), F.lit("")), content).cast("binary"))


def _dealt(docs: DataFrame, max_epochs: float, seed: int, slice_rows: int | None, size: Column | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, size, ord, source_size, target, whole, extra)``: repeats in whole, and words taken once more.

    A source's order is cut into slices, about as many as a slice has rows, so neither a slice's running sum nor the
    one over slices gathers more than the square root of a source.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), (n_words(text) if size is None else size).alias("size"), _order(text, F.col(id_col), seed).alias("ord"))
    rows = materialize(rows, "sizes")
    slices = F.ceil(F.sqrt(F.count("*"))) if slice_rows is None else F.ceil(F.count("*") / slice_rows)
    counts = rows.groupBy(F.col("source").alias("of")).agg(slices.cast("long").alias("slices"))
    rows = rows.join(materialize(counts, "counts"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    slice_of = F.floor(F.conv(F.substring("ord", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(float(1 << 32))).cast("long")
    rows = rows.withColumn("slice", slice_of).drop("slices")
    sums = materialize(rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "slices")
    targets = water_fill(ranked_weights(sums.groupBy("source").agg(F.sum("slice_size").alias("source_size"))), max_epochs)
    begins = sums.withColumn("begin", F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size"))
    plan = begins.join(targets, begins["source"].eqNullSafe(targets["source"])).select(begins["source"], "slice", "begin", "source_size", "target", "weight")
    plan = materialize(plan, "plan")
    dealt = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.slice") == F.col("p.slice"))).select("r.*", "begin", "source_size", "target")
    running = Window.partitionBy("source", "slice").orderBy("ord", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size")).cast("long")).otherwise(0)
    start = F.col("begin") + F.sum("size").over(running) - F.col("size")
    dealt = dealt.withColumns({"whole": whole, "start": start})
    extra = F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("whole") * F.col("source_size") - F.col("start")))
    return dealt.withColumn("extra", extra).drop("slice", "begin", "start")


def mix(docs: DataFrame, max_epochs: float = 3.0, seed: int = 7, slice_rows: int | None = None, size: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for each row of ``docs``.

    ``taken`` counts words with repeats, at most ``max_epochs`` times ``size``.  Reruns agree: the order is
    a seeded hash of id and text.

    Null text counts as 0 words; a document without words takes 0.  A null source is a source of its own,
    last in order.  Null ids and repeated rows stay, one result a row; equal rows are interchangeable.
    An empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    require(docs, id_col, text_col, source_col)
    dealt = _dealt(docs, max_epochs, seed, slice_rows, size, id_col, text_col, source_col)
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeated(docs: DataFrame, max_epochs: float = 3.0, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns, whatever their names.

    The one document of a source that is taken in part is repeated once more if half of it or more is.
    A document without words is repeated as often as its source is in whole.

    Texts aren't shuffled: a source's last place that is taken once more, a row a source, decides for every
    row by itself.  Only rows that share that place (equal rows, usually one) are ranked.
    """
    require(docs, id_col, text_col, source_col)
    dealt = _dealt(docs, max_epochs, seed, None, None, id_col, text_col, source_col)
    more = (F.col("size") > 0) & (2 * F.col("extra") >= F.col("size"))
    ends = dealt.groupBy("source", "ord").agg(F.max("whole").alias("whole"), F.count("*").alias("n"), F.count_if(more).alias("m"), F.max(F.when(more, F.col("ord"))).alias("end"))
    bounds = ends.groupBy(F.col("source").alias("of")).agg(F.max("whole").alias("whole"), F.max(F.struct("end", "n", "m")).alias("end"))
    source, place, row, of, whole, end, n, m, rank = free_names(docs, 9)
    bounds = materialize(bounds.select(F.col("of").alias(of), F.col("whole").cast("int").alias(whole), F.col("end.end").alias(end), F.col("end.n").alias(n), F.col("end.m").alias(m)), "bounds")
    keyed = docs.withColumns({source: F.col(source_col), place: _order(F.col(text_col), F.col(id_col), seed)})
    met = keyed.join(bounds, F.col(source).eqNullSafe(F.col(of)))
    some = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    at_end = F.coalesce(F.col(place) == F.col(end), F.lit(False))
    before = some & F.coalesce(F.col(place) <= F.col(end), F.lit(False))
    tied = at_end & (F.col(m) < F.col(n))  # some of equal rows
    times = lambda once: F.explode(F.array_repeat(F.lit(0), F.col(whole) + once.cast("int")))
    out = met.where(~tied).withColumn(row, times(before)).select(*docs.columns)
    if bounds.where(F.col(m) < F.col(n)).isEmpty():
        return out
    ranked = met.where(tied).withColumn(rank, F.row_number().over(Window.partitionBy(source).orderBy(place)))
    return out.unionByName(ranked.withColumn(row, times(some & (F.col(rank) <= F.col(m)))).select(*docs.columns))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"))


QUERIES = {"op5_mixing": op5_mixing}
SQL = {
    "op5_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS ord
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (  -- sources by how early they meet their cap
  SELECT *, source_size * 3.0::DOUBLE AS cap, (SELECT sum(source_size) FROM s)::DOUBLE AS whole,
         row_number() OVER (ORDER BY source_size * 3.0::DOUBLE / weight, source NULLS LAST) AS k
  FROM s),
c AS (
  SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
l AS (SELECT min(k) AS k FROM c WHERE weight * level <= cap),
t AS (
  SELECT source, source_size, CASE WHEN c.k < l.k THEN cap ELSE weight * (SELECT level FROM c, l WHERE c.k = l.k) END AS target
  FROM c, l),
m AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS words,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN words // source_size * size
             + greatest(0, least(size, words - words // source_size * source_size - start)) ELSE 0 END)::BIGINT AS taken
FROM m
""",
}
