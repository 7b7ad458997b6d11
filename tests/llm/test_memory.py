"""Python workers of the pipeline's stages: small slices of large batches, and nothing kept once a task has ended."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

from millrace.llm import common

HELD = """
import random, re, sys
import numpy as np, pyarrow as pa, pyspark, xxhash
from pathlib import Path
from millrace.llm import encoding, near_dup_wide, packing, toxicity

class Task:
    get = staticmethod(lambda: Task())
    partitionId = lambda self: 0

class Docs:  # keeps the function that would go to the workers
    columns, schema = ["doc_id", "text", "row_key", "id", "ord", "toxic"], None
    mapInArrow = lambda self, run, schema: run

def held():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

pyspark.TaskContext, rng = Task, random.Random(5)
words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(50_000)]

def batches(n):
    for k in range(n):
        ids = pa.array(np.arange(5000) + 5000 * k)
        text = pa.array([" ".join(rng.choices(words, k=400)) for _ in range(5000)])
        yield pa.RecordBatch.from_arrays([ids, text, ids, ids, ids, ids.cast(pa.int32())], names=Docs.columns)

model = np.arange(0, 1 << 20, 40), np.ones(len(range(0, 1 << 20, 40)))
run = {
    "clean": lambda: toxicity.keep_clean(Docs(), model),
    "featurize": lambda: toxicity._featurize,
    "print": lambda: near_dup_wide._printed,
    "sets": lambda: near_dup_wide._set_rows,
    "pieces": lambda: packing._pieces(encoding.public_path("byte_bpe_50k.json"), 1024, 2),
}[sys.argv[1]]()
some = [b.slice(0, 1) for b in batches(1)]
rows = sum(b.num_rows for b in run(iter(some)))  # imports, tables and the tokenizer are there
before = held()
for b in run(batches(2)):
    rows += b.num_rows
del b
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
@pytest.mark.parametrize("stage", ["clean", "featurize", "print", "sets", "pieces"])
def test_workers_keep_little(stage):
    out = subprocess.run([sys.executable, "-c", HELD, stage], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 12


def test_parts_are_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"k": range(300), "text": ["x" * (1 << 18) if k % 7 == 0 else None for k in range(300)]})
    got = list(common.parts(batch))
    assert len(got) > 1 and pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))
    assert max(p.nbytes for p in got) < 2 * common.PART_BYTES
    one = pa.RecordBatch.from_pydict({"text": ["y" * (3 * common.PART_BYTES)]})
    assert [p.num_rows for p in common.parts(one)] == [1] and list(common.parts(one.slice(0, 0))) == []
