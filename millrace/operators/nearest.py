"""Nearest vectors over a whole table: matrix products of a bounded block of queries with bounded slices of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries a step, and rows a matrix product.
BLOCK = 1024
SLICE = 2048
FOUND = "query_id long, vec_id long, cosine double"


def _units(vectors) -> tuple[np.ndarray, np.ndarray]:
    """The vectors at length one and whether they have a direction."""
    v = np.asarray(vectors, np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm > 0, norm, 1)[:, None], norm > 0


def _best(row: np.ndarray, ids: np.ndarray, cosine: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query, by falling cosine and then id."""
    order = np.lexsort((ids, -cosine, row))
    row, ids, cosine = row[order], ids[order], cosine[order]
    begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.array([], np.int64)
    place = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)]))
    return row[place < k], ids[place < k], cosine[place < k]


def _nearest(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def run(batches: Iterator):
        import pyarrow as pa

        best = (np.array([], np.int64), np.array([], np.int64), np.array([], np.float64))
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for at in range(0, len(ids), SLICE):
                units, ok = _units(batch.column("embedding").slice(at, SLICE).to_pylist())
                some, cosine = ids[at : at + SLICE][ok], np.round(queries @ units[ok].T, 9)
                cosine[query_ids[:, None] == some[None, :]] = -np.inf  # not with itself
                n = min(k, len(some))
                if not n:
                    continue
                least = np.partition(cosine, len(some) - n, axis=1)[:, len(some) - n]
                i, j = np.nonzero((cosine >= least[:, None]) & (cosine > -np.inf))
                best = _best(np.r_[best[0], i], np.r_[best[1], some[j]], np.r_[best[2], cosine[i, j]], k)
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], names=["query_id", "vec_id", "cosine"])

    return run


def nearest(rows: DataFrame, is_query, k: int, block: int = BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, cosine)``: the ``k`` rows of all ``rows(vec_id, embedding)`` most like each query.

    Cosines count to 9 places, equal ones by id.  Each step compares at most about ``block`` queries with all
    rows; a task keeps ``k`` rows a query.  Rows without id, vector or direction can't be named or compared.
    """
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    asked = known.where(is_query)
    blocks = -(-asked.count() // block)
    out = rows.sparkSession.createDataFrame([], FOUND)
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        if some:
            units, ok = _units([r["embedding"] for r in some])
            ids = np.array([r["vec_id"] for r in some], np.int64)
            out = out.unionByName(known.mapInArrow(_nearest(ids[ok], units[ok], k), FOUND))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "cosine")
