"""Nearest vectors against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from millrace.operators import nearest
from millrace.plans import catalogue


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    e = rng.normal(size=(260, 6)).astype(np.float32)
    e[100:140] = e[100]  # many equal ones
    # the copies of query 50 have other labels, or none
    e[[51, 52, 53, 54]] = e[50]
    labels = [None if i % 7 == 0 else i % 5 for i in range(len(e))]
    out = [(i, [float(x) for x in v], labels[i]) for i, v in enumerate(e)]
    return [*out, (None, [1.0] * 6, 1), (1000, None, 1), (1001, [0.0] * 6, 1)]


def want(rows):
    v = {i: np.asarray(e, np.float64) for i, e, _ in rows if i is not None and e is not None and any(e)}
    unit = {i: e / np.sqrt(e @ e) for i, e in v.items()}
    out = set()
    for q in (i for i in unit if i % 50 == 0):
        best = sorted((-round(float(unit[q] @ unit[i]), 9), i) for i in unit if i != q)[:5]
        out |= {(q, r + 1, i, -c + 0.0) for r, (c, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, size", [(1024, 2048), (2, 7)])
def test_all_rows_are_compared(spark, rows, monkeypatch, block, size):
    monkeypatch.setattr(nearest, "SLICE", size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = nearest.nearest(df, df["vec_id"] % 50 == 0, 5, block=block)
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["cosine"], 9) + 0.0) for r in got.collect()} == want(rows)
    assert nearest.nearest(df.limit(0), df["vec_id"] % 50 == 0, 5).count() == 0


def test_other_labels_are_found(spark, rows, tmp_path):
    spark.createDataFrame(rows[:260], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"] for r in catalogue.QUERIES["memory_topk_all"](spark, str(tmp_path)).where("query_id = 50").collect()}
    assert {51, 52, 53, 54} <= got
    assert not {51, 52, 53, 54} & {r["vec_id"] for r in catalogue.QUERIES["memory_topk"](spark, str(tmp_path)).where("query_id = 50").collect()}
