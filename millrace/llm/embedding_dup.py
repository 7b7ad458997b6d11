"""Embedding near-dedup over an inverted multi-index.

Vectors are scaled to length 1 and cut into halves; each half has its own codebook, and the two nearest
codewords name a cell of the product grid.  A query visits cells by rising lower bound on how far away a
vector of that cell must be (multi-sequence order over the two sorted half bounds) until the target recall is
reached: up to the bound that was enough for that share of trial neighbours, made from sampled vectors by moves
to exactly the threshold, in random directions and towards other vectors.  Every vector met is verified by cosine
in double precision, so only a pair across a visit that was left out is missed; a target of 1 visits all cells
that the bound allows and misses none.

Grids grow with their label: about ``OCCUPANCY`` vectors a cell, so visits are few and work a vector grows
far slower than the table.  Codebooks come from a bounded sample; every vector is indexed.  Equal vectors
fall together first.  A cell's members and visitors are matched in blocks by matrix products; a task
returns counts a vector and the edges of a spanning forest, never the pairs.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, components, materialize, read_table, require
from .near_dup import _hook, _root

#: The codebooks are fit on at most so many vectors, first in a hash order; a documented bound.
MAX_SAMPLE = 20_000
#: Vectors a cell that a grid is made for, and vectors a block of one task.
OCCUPANCY, BLOCK = 512, 2048
TARGET_RECALL = 0.9995
#: Trial neighbours of a codebook.
TRIALS = 4_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's algorithm from a seeded choice of distinct rows."""
    x = np.unique(x, axis=0)
    centers = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        for c in range(len(centers)):
            if (own := nearest == c).any():
                centers[c] = x[own].mean(0)
    return centers


class Codebook:
    """One half's codewords, and how far beyond each pair's bisector a point lies."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        gap = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
        self.gap = np.where(gap > 0, gap, np.inf)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest codeword of each row, and for every codeword a lower bound on the squared distance
        from the row to any point whose nearest codeword it is."""
        d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centers.T + (self.centers**2).sum(1), 0)
        home = d.argmin(1)
        beyond = (d - d[np.arange(len(x)), home][:, None]) / (2 * self.gap[home])
        return home, np.maximum(beyond, 0) ** 2


class Grid:
    """Two codebooks and the bound up to which a query visits cells."""

    def __init__(self, x: np.ndarray, words: int, threshold: float, target: float):
        self.half = x.shape[1] // 2
        self.books = [Codebook(kmeans(part, words)) for part in (x[:, : self.half], x[:, self.half :])]
        self.words = len(self.books[1].centers)
        self.limit = (2 - 2 * threshold) * (1 + 1e-6) + 1e-9  # nothing at the threshold is beyond it
        if target < 1:
            need = np.sort(self.needed(x, threshold))
            self.limit = min(self.limit, float(need[min(len(need) - 1, int(np.ceil(len(need) * target)))]) + 1e-12)

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [book.bounds(part) for book, part in zip(self.books, (x[:, : self.half], x[:, self.half :]), strict=True)]

    def needed(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """The bound of the cell of a neighbour at exactly ``threshold``, for ``TRIALS`` of them."""
        rng = np.random.default_rng(9)
        at = rng.integers(0, len(x), TRIALS)
        x, way = x[at], rng.normal(size=(TRIALS, x.shape[1]))
        way[::2] = x[rng.permutation(TRIALS)][::2] - x[::2]
        way -= (way * x).sum(1)[:, None] * x
        size = np.sqrt((way * way).sum(1))
        size[size < 1e-9] = np.inf  # no other direction
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * way / size[:, None]
        found = zip(self.bounds(x), self.bounds(y), strict=True)
        return sum(b[np.arange(TRIALS), home] for (_, b), (home, _) in found)

    def cells(self, x: np.ndarray):
        """For each row its home cell and the cells that it visits, home first."""
        (h1, b1), (h2, b2) = self.bounds(x)
        for k in range(len(x)):
            own = int(h1[k]) * self.words + int(h2[k])
            yield own, [c for i, j in visits(b1[k], b2[k], self.limit) if (c := i * self.words + j) != own]


def visits(b1: np.ndarray, b2: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Multi-sequence traversal: cells by rising ``b1[i] + b2[j]``, up to ``limit``."""
    o1, o2 = np.flatnonzero(b1 <= limit), np.flatnonzero(b2 <= limit)
    if not len(o1) or not len(o2):
        return []
    o1, o2 = o1[np.argsort(b1[o1], kind="stable")], o2[np.argsort(b2[o2], kind="stable")]
    s1, s2 = b1[o1].tolist(), b2[o2].tolist()
    heap, pushed, out = [(s1[0] + s2[0], 0, 0)], {(0, 0)}, []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if bound > limit:
            break
        out.append((int(o1[i]), int(o2[j])))
        for n in ((i + 1, j), (i, j + 1)):
            if n[0] < len(s1) and n[1] < len(s2) and n not in pushed:
                pushed.add(n)
                heapq.heappush(heap, (s1[n[0]] + s2[n[1]], *n))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; scaled by the largest component first, as squares can run over or under."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _rows(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _groups(batch):
    """``(label, dims, row numbers)`` of a batch."""
    label, dims = batch.column("label").to_numpy(), batch.column("dims").to_numpy()
    order = np.lexsort((dims, label))
    cut = np.flatnonzero((np.diff(label[order]) != 0) | (np.diff(dims[order]) != 0)) + 1
    for at in np.split(order, cut) if len(order) else ():
        yield int(label[at[0]]), int(dims[at[0]]), at


def _placed(grids: dict, batch):
    """``(row numbers, cells, homes)``: a home row for each vector, and a row for every other cell that it visits."""
    import pyarrow as pa

    at, cells, home = [], [], []
    for label, dims, rows in _groups(batch):
        grid = grids.get((label, dims)) or grids.get((None, dims))
        if grid is None:  # too few vectors for more than one cell
            at += rows.tolist()
            cells += [0] * len(rows)
            home += [True] * len(rows)
            continue
        x = _unit(_rows(batch.column("embedding").take(pa.array(rows))))
        for r, (own, others) in zip(rows.tolist(), grid.cells(x), strict=True):
            at += [r] * (1 + len(others))
            cells += [own, *others]
            home += [True] + [False] * len(others)
    return np.array(at, np.int64), np.array(cells, np.int64), np.array(home, bool)


COUNTED = "label long, dims int, cell long, v long, m long"
PLACED = "label long, dims int, cell long, home boolean, node long, copies long, vector binary"


def _count_cells(sent):
    """Visitors and members of each cell, summed up a batch."""

    def run(batches):
        for batch in batches:
            at, cells, home = _placed(sent.value, batch)
            keys = np.stack([batch.column("label").to_numpy()[at], batch.column("dims").to_numpy()[at], cells])
            distinct, number = np.unique(keys, axis=1, return_inverse=True)
            number = number.ravel()
            n = [np.bincount(number, minlength=distinct.shape[1]), np.bincount(number, home, distinct.shape[1]).astype(np.int64)]
            yield arrow_batch(COUNTED, [*distinct, *n])

    return run


def _place(sent):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, cells, home = _placed(sent.value, batch)
            vectors = [x.as_py() if x is None else np.asarray(x.values).tobytes() for x in batch.column("embedding")]
            take = pa.array(at)
            columns = [batch.column(c).take(take) for c in ("label", "dims")] + [pa.array(cells), pa.array(home)]
            columns += [batch.column(c).take(take) for c in ("node", "copies")] + [pa.array(vectors, pa.binary()).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "dims", "cell", "home", "node", "copies", "vector"])

    return run


MATCHED = "node long, other long, n long"


def _match(threshold: float, kind: str):
    """Counts ``(node, null, n)`` and forest edges ``(node, other, 0)`` of one block pair of one cell."""

    def run(table):
        import pyarrow as pa

        side = lambda c: table.column(c).to_numpy()
        node, copies = side("node"), side("copies")
        x = _unit(np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(len(node), -1))
        unique, number = np.unique(node, return_inverse=True)
        parent = np.arange(len(unique))
        left, right = np.flatnonzero(side("left")), np.flatnonzero(side("right"))
        count = np.zeros(len(node), np.int64)
        for k in range(0, len(left), 512):
            rows = left[k : k + 512]
            ok = (x[rows] @ x[right].T >= threshold) & (node[rows][:, None] != node[right][None])
            i, j = np.nonzero(ok)
            count[rows] += np.bincount(i, copies[right[j]], len(rows)).astype(np.int64)
            _hook(parent, number[rows[i]], number[right[j]])
        root = _root(parent, np.arange(len(unique)))
        child, some = np.flatnonzero(root != np.arange(len(unique))), np.flatnonzero(count)
        other = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(unique[root[child]], pa.int64())])
        return pa.table({"node": np.r_[node[some], unique[child]], "other": other, "n": np.r_[count[some], np.zeros(len(child), np.int64)]})

    return run


def fit(vectors: DataFrame, threshold: float, target: float = TARGET_RECALL, occupancy: int = OCCUPANCY, max_sample: int = MAX_SAMPLE) -> dict:
    """Grids by label and length, from one bounded sample; label None serves labels that are rare in it.

    A label's own number of vectors, as far as the sample tells it, decides on the words of its codebooks.
    """
    n = vectors.count()
    if n <= occupancy:
        return {}
    found = vectors.select("label", "dims", "embedding", F.xxhash64("node").alias("ord")).orderBy("ord").limit(max_sample).select("label", "dims", "embedding").toArrow()
    batch, each = found.combine_chunks().to_batches()[0], n / found.num_rows
    grids, rare = {}, {}
    for label, dims, rows in _groups(batch):
        x = _unit(_rows(batch.column("embedding").take(rows)))
        if len(rows) < 8:
            rare.setdefault(dims, []).append(x)
        elif (words := min(int(np.ceil(np.sqrt(len(rows) * each / occupancy))), len(rows) // 4)) > 1:
            grids[label, dims] = Grid(x, words, threshold, target)
    for dims, parts in rare.items():
        x = np.concatenate(parts)
        if (words := min(int(np.ceil(np.sqrt(8 * each / occupancy))), len(x) // 4)) > 1:
            grids[None, dims] = Grid(x, words, threshold, target)
    return grids


def usable(embedding):
    """All components there and finite, and not all of them zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    zero = F.forall(embedding, lambda v: v == 0)
    return F.coalesce((F.size(embedding) > 0) & ~bad & ~zero, F.lit(False))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.98, target: float = TARGET_RECALL, block: int = BLOCK, occupancy: int = OCCUPANCY, max_sample: int = MAX_SAMPLE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors``, an array of floats or doubles.

    Rows with one label and as many components link at cosine >= ``threshold``.  A null label, and a vector that is
    null, zero, empty or has null or non-finite components, links with nothing: no links, a component of its
    own, kept.  Repeated rows stay and link with each other; a row with a null id has a null component
    unless others in it have ids, and is not kept.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    require(vectors, id_col, vector_col, label_col)
    kind = "float" if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else "double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("embedding"), F.col(label_col).cast("long").alias("label"))
    ok = usable(F.col("embedding")) & F.col("label").isNotNull()
    # equal vectors of a label are one node; the digest stands for them until they are numbered
    keyed = rows.withColumn("ok", ok).withColumn("key", F.when(F.col("ok"), F.sha2(F.to_binary(F.to_json(F.struct("label", "embedding")), F.lit("utf-8")), 256)))
    distinct = keyed.where("ok").groupBy("key").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    nodes = materialize(distinct.withColumn("node", F.xxhash64("key")).withColumn("dims", F.size("embedding")), "vectors")
    sent = spark.sparkContext.broadcast(fit(nodes, threshold, target, occupancy, max_sample))  # at most max_sample vectors' size
    group = ("label", "dims", "cell")
    counted = nodes.select("label", "dims", "embedding").mapInArrow(_count_cells(sent), COUNTED).groupBy(*group).agg(F.sum("v").alias("v"), F.sum("m").alias("m"))
    hot = materialize(counted.where((F.col("v") > block) | (F.col("m") > block)), "hot-cells")
    placed = nodes.select("label", "dims", "node", "copies", "embedding").mapInArrow(_place(sent), PLACED)
    parts = lambda n: F.coalesce(F.ceil(F.col(n) / block).cast("int"), F.lit(1))
    sized = placed.join(hot, list(group), "left").withColumn("vb", parts("v")).withColumn("mb", F.greatest(parts("m"), F.lit(1)))
    i, j = F.pmod(F.xxhash64("node"), F.col("vb")).cast("int"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("mb")).cast("int")
    # every row visits with block i; home rows are also met in block j: one task row a block pair and role
    as_left = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda b: F.struct(F.col("i").alias("bi"), b.alias("bj")))
    as_right = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("vb") - 1), lambda b: F.struct(b.alias("bi"), F.col("j").alias("bj")))).otherwise(F.array().cast("array<struct<bi:int,bj:int>>"))
    dealt = sized.withColumn("i", i).withColumn("j", j).withColumn("p", F.explode(F.array_union(as_left, as_right)))
    dealt = dealt.select(*group, "p.bi", "p.bj", "node", "copies", "vector", (F.col("i") == F.col("p.bi")).alias("left"), (F.col("home") & (F.col("j") == F.col("p.bj"))).alias("right"))
    matched = materialize(dealt.groupBy(*group, "bi", "bj").applyInArrow(_match(threshold, "<f4" if kind == "float" else "<f8"), MATCHED), "matched")
    counts = matched.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("found"))
    roots = components(matched.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "vectors")
    named = nodes.select("key", "node", "first_id", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.select("key", "root", "first_id", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    answer = named.join(ids, "root").select("key", "n_links", "component_id")
    found = keyed.select("vec_id", "key").join(answer, "key", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dup": op9_embedding_dup}
SQL = {
    "op9_embedding_dup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.x AS vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(r.y) AS component_id, r.x = min(r.y) AS kept
FROM r LEFT JOIN n ON n.x = r.x GROUP BY r.x
""",
}
