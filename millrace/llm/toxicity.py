"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the distinct hashes of its words, its word pairs and its pairs with one word
between them.  The learner keeps a rate for every coordinate and clips small ones to zero (L1), so the
weights that leave it are few enough to send to every task; scoring is one pass over whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, held_out, lean, materialize, read_table, require

DIMS_LOG2 = 20
#: Documented bounds: at most so many labelled rows are learned from, those first in a hash order, and no further one
#: once so many bytes of text are read.
MAX_TRAINING_ROWS, MAX_TRAINING_BYTES = 20_000, 96 << 20
# Odd multipliers of the hashes (2**64 / golden ratio, and two of the splitmix64 finaliser).
GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
STEP_BYTES = 2 << 20

#: Bytes that belong to words (letters, digits, underscore and all of non-ASCII); others become blanks.
WORD_BYTES = bytes(b if chr(b).isalnum() and b < 128 or b == 95 or b >= 128 else 32 for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, np.ndarray] = {}


def _cached_powers(n: int, base: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        _POWERS[base] = _powers(max(n, STEP_BYTES), base)
    return _POWERS[base][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word: polynomial hashes of all words from one running sum."""
    parts = [t.lower().encode() for t in texts]
    buf = np.frombuffer(b" ".join(parts).translate(WORD_BYTES) + b" ", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    word = buf != 32
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.r_[np.uint64(0), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _cached_powers(len(buf), GOLDEN), dtype=np.uint64)]
    inverse = pow(GOLDEN, -1, 1 << 64)
    hashed = (sums[stop] - sums[start]) * _cached_powers(len(buf), inverse)[start]
    return _mixed(hashed), np.searchsorted(ends, start, side="right")


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, index)`` of all features, not yet distinct."""
    h, doc = word_hashes(texts)
    rows, index = [doc], [h]
    for gap, salt in ((1, 3), (2, 5)):
        same = doc[gap:] == doc[:-gap]
        rows.append(doc[gap:][same])
        index.append(_mixed(h[:-gap][same] * np.uint64(GOLDEN) + h[gap:][same] * np.uint64(salt)))
    return np.concatenate(rows), (np.concatenate(index) >> np.uint64(64 - DIMS_LOG2)).astype(np.int64)


def steps(texts: list[str]):
    """Slices of a batch by bytes, so that memory follows the step and the longest text."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= STEP_BYTES // 2:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


class Ftrl:
    """FTRL-proximal for logistic loss with a rate for each coordinate."""

    def __init__(self, dims: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.0):
        self.z, self.n = np.zeros(dims), np.zeros(dims)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, i) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: float) -> None:
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


FEATURED = "id long, ord long, toxic int, indices binary"


@lean
def _featurize(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        found = []
        for part in steps(texts):
            doc, index = features(texts[part])
            pairs = np.unique(doc << DIMS_LOG2 | index)
            cuts = np.searchsorted(pairs, np.arange(1, part.stop - part.start) << DIMS_LOG2)
            found += [(p & ((1 << DIMS_LOG2) - 1)).astype("<i4").tobytes() for p in np.split(pairs, cuts)]
        yield arrow_batch(FEATURED, [batch.column("id"), batch.column("ord"), batch.column("toxic"), found])


def _learn(epochs: int, parameters: dict):
    def run(table):
        import pyarrow as pa

        order = np.lexsort((table.column("id").to_numpy(), table.column("ord").to_numpy()))
        toxic, chunks = table.column("toxic").to_numpy(), []
        for indices in table.column("indices").chunks:  # no copy: the sample's features are in memory once
            begin = np.frombuffer(indices.buffers()[1], np.int32)[indices.offset : indices.offset + len(indices) + 1] // 4
            flat = np.frombuffer(indices.buffers()[2] or b"", np.int32)
            chunks += [flat[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        model = Ftrl((1 << DIMS_LOG2) + 1, **parameters)
        bias = np.array([1 << DIMS_LOG2], np.int32)
        for _ in range(epochs):
            for k in order:
                model.learn(np.concatenate([chunks[k], bias]), float(toxic[k]))
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        return pa.table({"index": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    return run


def train(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_bytes: int = MAX_TRAINING_BYTES, epochs: int = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **parameters,
) -> tuple[np.ndarray, np.ndarray]:
    """Sparse weights ``(index, weight)`` learned from at most ``max_rows`` labelled rows and about ``max_bytes``.

    The learner is sequential, so its sample is bounded: the first ids of a hash order, as long as the texts
    before them have fewer than ``max_bytes``.  A label that is repeated counts as its largest value; null labels,
    null ids and null texts are left out.  Of texts with one id the one with the smallest hash is learned from.
    """
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    one = given.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
    chosen = one.select("id", "toxic", F.xxhash64("id").alias("ord")).orderBy("ord", "id").limit(max_rows)
    chosen = F.broadcast(materialize(chosen, "training-ids"))  # max_rows rows of three numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL").join(chosen, "id")
    sizes = rows.groupBy("ord", "id").agg(F.max(F.octet_length("text")).alias("bytes")).select("ord", "bytes").toArrow()  # max_rows rows at most
    order = np.argsort(sizes.column("ord").to_numpy(), kind="stable")
    before = np.cumsum(sizes.column("bytes").to_numpy()[order]) - sizes.column("bytes").to_numpy()[order]
    within = sizes.column("ord").to_numpy()[order][before < max_bytes]
    last = int(within[-1]) if len(within) else 0
    texts = rows.where(F.col("ord") <= last).groupBy("id", "ord", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    rows = texts.select("id", "ord", "toxic", "one.text").mapInArrow(_featurize, FEATURED)
    found = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_learn(epochs, parameters), "index long, weight double").collect()  # L1 leaves few
    return np.array([r["index"] for r in found], np.int64), np.array([r["weight"] for r in found])


class Scorer:
    """Scores of texts under sparse weights; 0 where nothing was learned."""

    def __init__(self, index: np.ndarray, weight: np.ndarray):
        inner = index < 1 << DIMS_LOG2
        self.table = np.zeros(1 << DIMS_LOG2, np.float32)
        self.table[index[inner]] = weight[inner]
        self.bias, self.learned = float(weight[~inner].sum()), len(index) > 0

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        texts = [t or "" for t in texts]
        out = np.zeros(len(texts))
        for part in steps(texts) if self.learned else ():
            doc, at = features(texts[part])
            hit = self.table[at] != 0
            pairs = np.unique(doc[hit] << DIMS_LOG2 | at[hit])
            total = np.bincount(pairs >> DIMS_LOG2, self.table[pairs & ((1 << DIMS_LOG2) - 1)], part.stop - part.start)
            out[part] = 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))
        return out


SCORED = "doc_id long, held_out boolean, score double"


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row of ``docs``.

    Null text counts as empty and gets the bias alone; a model learned from no rows scores 0.  Null ids
    and repeated rows stay, one result a row.  An empty table gives no rows.  Other columns are ignored,
    whatever their names; the score sees the text only.
    """
    require(docs, id_col, text_col)

    @lean
    def run(batches):
        scorer = Scorer(*model)
        for batch in batches:
            yield arrow_batch(SCORED, [batch.column("doc_id"), batch.column("held_out"), scorer(batch.column("text").to_pylist())])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, 0).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCORED).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns, in one pass over them."""
    require(docs, text_col)
    at = docs.columns.index(text_col)

    @lean
    def run(batches):
        import pyarrow as pa

        scorer = Scorer(*model)
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column(at).to_pylist()) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return score(docs, train(docs, labels.where(~held_out(F.col("doc_id"), 5, 0))))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
