"""The pipeline's stages against their operators and brute force on a small table."""

from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as P
from millrace.llm import common, near_dup
from tests.llm.test_operators import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(240):
        words = prose(rng, rng.randint(20, 200)).split()
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vile", "nasty"]))
        rows.append([i, " ".join(words), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(i % 5 == 0)))
    for k in range(20):
        rows[221 + k % 3][1] = rows[1][1]  # copies
    rows[7][1] += " ann.lee42@mail.example.com"
    rows.append([None, "one more row", None, None, None])
    at = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = P.drop_toxic(spark, docs, folder)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    toxic = {r["doc_id"] for r in docs.collect() if re.search("vile|nasty", r["text"])}
    assert not ids & toxic and len(ids | toxic) == docs.count()
    single = P.drop_near_copies(spark, kept, folder).collect()
    prints = [near_dup.fingerprint(r["text"]) for r in single]
    assert len(set(prints)) == len(prints)
    assert {near_dup.fingerprint(r["text"]) for r in kept.collect()} >= set(prints) and 1 in {r["doc_id"] for r in single}
    clean = P.replace_private(spark, spark.createDataFrame(single, docs.schema), folder)
    assert all("ann.lee42" not in r["text"] and r["n_chars"] == len(r["text"]) for r in clean.collect())
    mixed = P.mix_sources(spark, clean, folder)
    assert mixed.columns == docs.columns
    packed = P.pack_sequences(spark, mixed, folder).collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()


def test_run_is_the_stages_in_order(spark, folder):
    assert [name for name, _ in P.STAGES] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    key = lambda rows: sorted((r["doc_id"] or -1, r["piece"], r["ids_crc32"]) for r in rows)
    assert key(P.run(spark, folder).collect()) == key(docs.collect())


def test_run_leaves_only_its_last_tables(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch_root", lambda spark: f"file://{tmp_path}")
    assert P.run(spark, folder).count() > 0
    left = {p.name.rsplit("-", 1)[0] for p in (tmp_path / "millrace").iterdir()}
    assert left == {"pipeline-mixing", "pieces"}


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0
