"""Language ID by prediction by partial matching.

Each language has a byte context tree of variable order up to ``ORDER`` with counts frozen after
learning.  A byte's probability comes from the longest known context that has seen it, after the escape
probabilities of the longer ones (method C: escape = distinct / (count + distinct)); below order 0 all
256 bytes are alike.  The code length of a text is the exact sum over its bytes; the language with the
shortest code wins.

A tree is kept as sorted arrays of grams and contexts with their costs, 12 bytes an entry, so memory follows
what was learned and not languages times contexts times bytes.  Scoring finds the distinct grams of a
step of texts once, walks each language's tree for those only, and adds their costs up by text.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, held_out, materialize, read_table, require

ORDER = 3
#: Documented bounds: a language is learned from about so many documents and bytes at most, by a hash of the id.
MAX_DOCS, MAX_BYTES = 2_000, 3 << 20
COUNTS = "lang string, size int, gram long, n long"


def _windows(texts: list[bytes], order: int) -> np.ndarray:
    """For each byte of the texts, it and the ``order`` bytes before it as one number; a text begins after zero bytes."""
    buf = np.frombuffer(b"".join(bytes(order) + t for t in texts), np.uint8)
    kind = np.uint32 if order < 4 else np.uint64
    gram = np.zeros(max(len(buf) - order, 0), kind)
    for back in range(order, -1, -1):
        gram = (gram << kind(8)) | buf[order - back : len(buf) - back].astype(kind)
    live = np.ones(len(gram), bool)
    at = 0
    for t in texts[:-1]:  # where the next text's zero bytes are
        at += len(t)
        live[at : at + order] = False
        at += order
    return gram[live]


def _tail(gram: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` bytes of each gram."""
    return gram & gram.dtype.type((1 << 8 * size) - 1)


def count_grams(texts: list[bytes], order: int = ORDER) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct grams of 1 to ``order + 1`` bytes and how often each stands."""
    whole, n = np.unique(_windows(texts, order), return_counts=True)
    out = []
    for size in range(1, order + 2):
        grams, at = np.unique(_tail(whole, size), return_inverse=True)
        out.append((grams, np.bincount(at, n, len(grams)).astype(np.int64)))
    return out


class Tree:
    """One language's frozen context tree: for each size, sorted grams and contexts with their costs in nats."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        self.grams, self.contexts = [], []
        for grams, n in counts:
            order = np.argsort(grams)
            grams, n = grams[order], n[order]
            contexts, at = np.unique(grams >> grams.dtype.type(8), return_inverse=True)
            distinct = np.bincount(at, minlength=len(contexts))
            whole = np.bincount(at, n, len(contexts)) + distinct
            self.grams.append((grams, -np.log(n / whole[at])))
            self.contexts.append((contexts, -np.log(distinct / whole)))

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each gram after the bytes before it."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for size in range(len(self.grams), 0, -1):
            tail = _tail(gram[open_], size)
            hit, cost = _found(*self.grams[size - 1], tail)
            out[open_[hit]] += cost
            open_, tail = open_[~hit], tail[~hit]
            hit, cost = _found(*self.contexts[size - 1], tail >> tail.dtype.type(8))
            out[open_[hit]] += cost
        out[open_] += np.log(256)
        return out


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``keys``, and the values of those."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(0)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, values[at[hit]]


def lengths(trees: list[Tree], texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """Code length of each text under each tree."""
    import pandas as pd

    out = np.zeros((len(texts), len(trees)))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    at, distinct = pd.factorize(_windows(texts, order))
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    for k, tree in enumerate(trees):
        out[full, k] = np.add.reduceat(tree.costs(distinct)[at], starts)
    return out


def _count(batches):
    """Gram counts of each batch, language by language; partial sums that meet in the aggregate."""
    import pyarrow as pa

    from .toxicity import steps

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = [texts[k] for k in np.flatnonzero(langs == lang)]
            for part in steps(own):
                for size, (grams, n) in enumerate(count_grams([t.encode() for t in own[part]]), 1):
                    columns = [pa.array([lang] * len(grams)), pa.array(np.full(len(grams), size, np.int32)), pa.array(grams.astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "size", "gram", "n"])


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, text)`` to learn from: of each language the documents whose id hash is below a share of the hash range.

    The share is such that ``max_docs`` documents and ``max_bytes`` bytes are expected, so no language is ranked
    or gathered.  Rows without language, id or text are left out; of rows with one id and language
    the smallest text hash counts, so reruns agree.
    """
    require(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND id IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    share = sizes.select("of", F.least(F.lit(float(max_docs)) / F.col("n"), F.lit(float(max_bytes)) / F.greatest(F.col("bytes"), F.lit(1))).alias("share"))
    share = materialize(share, "language-shares")  # a row a language, so that the join below moves no text
    place = F.shiftrightunsigned(F.xxhash64("id"), 24) / F.lit(float(1 << 40))
    chosen = rows.join(share, F.col("lang") == F.col("of")).where(place < F.col("share"))
    return chosen.groupBy("lang", "id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("lang", "one.text")


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, Tree]:
    """A tree for each language, from the ``sample``; what reaches the driver is bounded by ``max_bytes`` a language."""
    texts = sample(docs, max_docs, max_bytes, id_col, text_col, lang_col)
    found = texts.select("lang", "text").mapInArrow(_count, COUNTS).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return {}
    names = found.column("lang").combine_chunks().dictionary_encode()
    names = names.combine_chunks() if hasattr(names, "combine_chunks") else names
    lang, size = names.indices.to_numpy(), found.column("size").to_numpy()
    gram, n = found.column("gram").to_numpy().astype(np.uint32), found.column("n").to_numpy()
    out = {}
    for k, name in enumerate(names.dictionary.to_pylist()):
        out[name] = Tree([(gram[own], n[own]) for s in range(1, ORDER + 2) for own in [np.flatnonzero((lang == k) & (size == s))]])
    return out


_MODELS: dict[str, tuple[list[str], list[Tree]]] = {}


def predict(docs: DataFrame, model: dict[str, Tree], id_col: str = "doc_id", text_col: str = "text", folds: int = 3) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for each row of ``docs``.

    ``score`` is the winner's share of all languages' probabilities.  Ties go to the first language by
    name.  A text that is null or has no letter (a code point of a category L) is ``und`` with score 0, as is
    all where nothing was learned.  Null ids and repeated rows stay, one result a row.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    require(docs, id_col, text_col)
    shape = "doc_id long, held_out boolean, lang_pred string, score double"
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex  # bounded by MAX_BYTES a language

    def run(batches):
        import regex

        from .toxicity import steps

        letter = regex.compile(r"\p{L}")
        if name not in _MODELS:  # one model a worker process
            _MODELS.clear()
            _MODELS[name] = sorted(sent.value), [sent.value[k] for k in sorted(sent.value)]
        langs, trees = _MODELS[name]
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            names, scores = [], []
            for part in steps(texts):
                raw = [t.encode() for t in texts[part]]
                cost = lengths(trees, raw) if trees else np.zeros((len(raw), 1))
                best = cost.argmin(axis=1)
                share = 1 / np.exp((cost[np.arange(len(raw)), best][:, None] - cost).clip(-700)).sum(axis=1)
                for t, b, s in zip(texts[part], best, share, strict=True):
                    known = bool(trees) and letter.search(t) is not None
                    names.append(langs[b] if known else "und")
                    scores.append(float(s) if known else 0.0)
            yield arrow_batch(shape, [batch.column("doc_id"), batch.column("held_out"), names, scores])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), folds, 1).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, shape)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"), 3, 1))))


QUERIES = {"op8_language": op8_language}
SQL: dict[str, str] = {}
