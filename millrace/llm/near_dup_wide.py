"""SimHash near-dedup at 4/5 of the five-word shingles: the byte-position index over wide fingerprints.

At a similarity of 0.8 two SimHash fingerprints differ in about 15 of 100 bits, far beyond what the eight bytes of a
64-bit fingerprint can index.  So a text's fingerprint has 64 bytes here (512 majority bits over its distinct shingles),
of which such a pair shares 17 positions on average.  Posting lists are keyed by sets of positional bytes.  Texts that
meet in a list and agree in most of their first 128 bits are candidates; a list returns a spanning forest of them, so
it never becomes pairs, and what hangs together by candidates forms a group.  In a group the shared positional bytes of
each pair are tallied; pairs that reach ``LEAST_SHARED`` and differ in at most ``RADIUS`` bits are verified by the exact
Jaccard similarity of their shingle sets, so no link is ever wrong.  A link is missed only if none of the
``POSITION_SETS`` agrees; README has the recall measured.

Equal sets fall together first.  Lists and groups above a block are cut into blocks, and every two blocks meet in a
task of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near_dup
from .common import arrow_batch, components, lean, materialize, require

WIDTH = 5
WORDS, BYTES = 8, 64
#: How many bytes key a list, how many such sets there are, and up to how many nodes: lists stay short as tables grow.
POSITION_SETS = ((2, 64, 1 << 24), (3, 256, 1 << 32), (4, 1024, 1 << 62))
#: A pair at 0.8 shares 17 of 64 bytes on average (standard deviation 3.6) and differs in 78 of 512 bits (8), 19 of the first 128 (4).
LEAST_SHARED, RADIUS, FIRST_RADIUS = 4, 120, 36
#: Nodes up to which those whose sets are wanted are broadcast; beyond, they are joined.
WANTED = 1 << 20
#: One node of so many is counted to find lists that are longer than a block.
SAMPLED = 16
EDGES = near_dup.EDGES
PRINT = tuple(f"p{k}" for k in range(WORDS))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted XXH64 values of the distinct word shingles; a shorter text is one shingle, also without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    every = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, near_dup.SEED) for s in map(b" ".join, every)), np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` longs of majority bits; each shingle's hash is mixed into as many."""
    ones, step = np.zeros(64 * WORDS, np.int64), 1 << 14
    salt = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), step):
        x = hashes[at : at + step, None] + salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes)).view(np.int64)


def _node(s: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), near_dup.SEED)).view(np.int64))


PRINTED = "doc_id long, row_key long, fp long, size long, " + ", ".join(f"{p} long" for p in PRINT)


@lean
def _printed(batches):
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, WORDS)
        yield arrow_batch(PRINTED, [batch.column("doc_id"), batch.column("row_key"), [_node(s) for s in sets], [len(s) for s in sets], *prints.T])


def position_sets(size: int, n: int) -> list[tuple[int, ...]]:
    """``n`` sets of ``size`` byte positions: shuffled positions cut into sets, so each position is in equally many."""
    rng, out = np.random.default_rng(17), []
    while len(out) < n:
        for s in rng.permutation(BYTES)[: BYTES // size * size].reshape(-1, size).tolist():
            if tuple(sorted(s)) not in out:
                out.append(tuple(sorted(s)))
    return out[:n]


def _keys(size: int, n: int) -> Column:
    """One long a position set: its number above the bytes that it picks."""
    byte = lambda p: F.shiftrightunsigned(F.col(PRINT[p // 8]), 8 * (p % 8)).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for k, positions in enumerate(position_sets(size, n)):
        value = F.lit(k).cast("long")
        for p in positions:
            value = F.shiftleft(value, 8).bitwiseOR(byte(p))
        keys.append(value)
    return F.array(*keys)


#: Pairs that are compared at once, by first bits and by whole fingerprints: what a task's arrays hold.
STEP, TALLIED = 500_000, 200_000


def may_be(left: np.ndarray, right: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether pairs may be at 4/5 or more, by size and first bits."""
    a, b = size[left], size[right]
    ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    ok[ok] = np.bitwise_count(first[left[ok]] ^ first[right[ok]]).sum(axis=1, dtype=np.int64) <= FIRST_RADIUS
    return ok


def _met(begin: np.ndarray, length: np.ndarray, parent: np.ndarray):
    """Index pairs inside runs: neighbours and pairs with the first, then all pairs but those inside a run's largest part."""
    at = np.repeat(begin, length)
    here = np.arange(len(at))
    inner = here > at
    yield here[inner] - 1, here[inner]
    yield at[inner], here[inner]
    for n in np.unique(length[(length > 1) & (length <= near_dup.SMALL)]):  # runs of a length at once
        at, (i, j) = begin[length == n], np.triu_indices(n, 1)
        step = max(1, STEP // len(i))
        for k in range(0, len(at), step):
            yield (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
    for b, n in zip(begin[length > near_dup.SMALL], length[length > near_dup.SMALL], strict=True):
        own = near_dup._root(parent, np.arange(b, b + n))
        _, of, counts = np.unique(own, return_inverse=True, return_counts=True)
        inside, others = np.flatnonzero(of == counts.argmax()) + b, np.flatnonzero(of != counts.argmax()) + b
        rows = max(1, STEP // int(n))
        for r in range(0, len(others), rows):
            left, right = np.meshgrid(others[r : r + rows], others, indexing="ij")
            up = left < right
            yield left[up], right[up]
            left, right = np.meshgrid(others[r : r + rows], inside, indexing="ij")
            yield left.ravel(), right.ravel()


def _runs(batches, columns: tuple[str, ...]):
    """Whole runs of equal ``columns`` of a sorted stream, some at a time: the rows of each slice and where its runs begin."""
    import pyarrow as pa

    held = None  # the last run, which may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = np.stack([table.column(c).to_numpy() for c in columns])
        begin = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        if begin[-1]:
            yield table.slice(0, begin[-1]), begin[:-1]
        held = table.slice(begin[-1])
    if held is not None:
        yield held, np.array([0])


def _forest(parent: np.ndarray, node: np.ndarray):
    """Each tree's members with its root."""
    root = near_dup._root(parent, np.arange(len(parent)))
    child = np.flatnonzero(root != np.arange(len(parent)))
    return arrow_batch(EDGES, [node[child], node[root[child]]])


@lean(whole=True)
def _candidates(batches):
    for table, begin in _runs(batches, ("key", "i", "j")):
        node, size = (table.column(c).to_numpy() for c in ("fp", "size"))
        first = np.stack([table.column(c).to_numpy() for c in PRINT[:2]], axis=1).view(np.uint64)
        parent = np.arange(len(node))
        for left, right in _met(begin, np.diff(np.r_[begin, len(node)]), parent):
            ok = may_be(left, right, size, first)
            near_dup._hook(parent, left[ok], right[ok])
        yield _forest(parent, node)


@lean
def _set_rows(batches):
    """Sets for the verification as sorted 32-bit values: two shingles of a pair fall together once in 2^32."""
    for batch in batches:
        sets = [shingles(t) for t in batch.column("text").to_pylist()]
        short = [np.sort((s >> np.uint64(32)).astype("<u4")).tobytes() for s in sets]
        yield arrow_batch("fp long, set binary", [[_node(s) for s in sets], short])


def tallied(prints: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether pairs share ``LEAST_SHARED`` positional bytes, differ in at most ``RADIUS`` bits and have sizes that allow 4/5."""
    a, b = size[left], size[right]
    ok = 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)
    x = prints[left[ok]] ^ prints[right[ok]]
    shared = (x.view(np.uint8).reshape(len(x), BYTES) == 0).sum(axis=1)
    ok[ok] = (shared >= LEAST_SHARED) & (np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= RADIUS)
    return ok


def shared_counts(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many values each of the ``rows``' sets shares with each of the ``columns``', by products of 0/1 matrices.

    Only values that stand in two or more sets count; they are taken some at a time, so memory is bounded.
    """
    at = np.unique(np.r_[rows, columns])
    flat, home = np.concatenate([sets[k] for k in at]), np.repeat(np.arange(len(at)), [len(sets[k]) for k in at])
    order = np.argsort(flat, kind="stable")
    flat, home = flat[order], home[order]
    number = np.cumsum(np.r_[False, flat[1:] != flat[:-1]])
    often = np.bincount(number)[number] > 1
    number, home = np.unique(number[often], return_inverse=True)[1].ravel(), home[often]
    out = np.zeros((len(rows), len(columns)), np.float32)
    row_of, column_of, width = np.searchsorted(at, rows), np.searchsorted(at, columns), 2048
    for low in range(0, int(number.max(initial=-1)) + 1, width):
        x = np.zeros((len(at), width), np.float32)
        some = slice(*np.searchsorted(number, (low, low + width)))
        x[home[some], number[some] - low] = 1
        out += x[row_of] @ x[column_of].T
    return out


def similar(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` that share ``both`` are at 4/5 or more."""
    return 5 * both >= 4 * (a + b - both)


@lean(whole=True)
def _verified(batches):
    """A spanning forest of the links inside each block pair of a group."""
    for table, begin in _runs(batches, ("group", "i", "j")):
        node = table.column("fp").to_numpy()
        prints = np.stack([table.column(c).to_numpy() for c in PRINT], axis=1).view(np.uint64)
        sets = [np.unique(np.frombuffer(x, "<u4")) for x in table.column("set").to_pylist()]
        size, parent = np.array([len(x) for x in sets]), np.arange(len(node))
        for b, n in zip(begin, np.diff(np.r_[begin, len(node)]), strict=True):
            columns, step = np.arange(b, b + n), max(1, min(512, TALLIED // int(n)))
            for r in range(b, b + n, step):
                rows = np.arange(r, min(r + step, b + n))
                left, right = (x.ravel() for x in np.meshgrid(rows, columns, indexing="ij"))
                ok = left < right
                left, right = left[ok], right[ok]
                ok = tallied(prints, size, left, right)
                left, right = left[ok], right[ok]
                if not len(left):
                    continue
                if len(left) <= 16:
                    both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left, right, strict=True)])
                else:
                    some, others = np.unique(left), np.unique(right)
                    counts = shared_counts(sets, some, others)
                    both = np.rint(counts[np.searchsorted(some, left), np.searchsorted(others, right)]).astype(np.int64)
                ok = similar(both, size[left], size[right])
                near_dup._hook(parent, left[ok], right[ok])
        yield _forest(parent, node)


def _blocked(rows: DataFrame, n: Column, block: int, *keys: str) -> DataFrame:
    """Rows with the numbers ``i, j`` of the block pairs that they are in, dealt and sorted by ``keys`` and those."""
    blocks = F.coalesce(F.ceil(n / block).cast("long"), F.lit(1).cast("long"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    own = rows.withColumn("_blocks", blocks).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("_blocks"))).withColumn("_other", other)
    met = own.withColumns({"i": F.least("_own", "_other"), "j": F.greatest("_own", "_other")}).drop("_blocks", "_own", "_other")
    return met.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "fp")


def _links(texts: DataFrame, nodes: DataFrame, block: int) -> DataFrame:
    """``(a, b)``: a spanning forest of the links between the ``nodes`` that the index finds."""
    n = nodes.count()
    size, sets = next((size, sets) for size, sets, most in POSITION_SETS if n <= most)
    keys = _keys(size, sets)
    counted = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLED)) == 0).select(F.explode(keys).alias("key")).groupBy("key").agg((F.count("*") * SAMPLED).alias("n"))
    hot = materialize(counted.where(F.col("n") > block), "similar-hot")
    hot_rows = hot.count()
    listed = nodes.select(F.explode(keys).alias("key"), "fp", "size", *PRINT[:2])
    listed = listed.join(F.broadcast(hot) if hot_rows <= WANTED else hot, "key", "left") if hot_rows else listed.withColumn("n", F.lit(1))
    met = _blocked(listed, F.col("n"), block, "key").select("key", "i", "j", "fp", "size", *PRINT[:2])
    groups = components(met.mapInArrow(_candidates, EDGES), "similar-groups").select(F.col("node").alias("fp"), F.col("root").alias("group"))
    grouped = materialize(nodes.select("fp", "row_key", *PRINT).join(groups, "fp"), "similar-grouped")
    wanted = materialize(grouped.select("row_key").distinct(), "similar-wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= WANTED else wanted
    found = texts.join(wanted, "row_key", "left_semi").select("text").mapInArrow(_set_rows, "fp long, set binary")
    found = found.groupBy("fp").agg(F.first("set").alias("set"))
    large = materialize(grouped.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > block), "similar-large")
    whole = grouped.join(large, "group", "left").join(found, "fp")
    pairs = _blocked(whole, F.col("n"), block, "group").select("group", "i", "j", "fp", "set", *PRINT)
    return pairs.mapInArrow(_verified, EDGES)


def keep_one(docs: DataFrame, block: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of texts linked at 4/5 or more of their five-word shingles.

    Words are what ASCII blanks separate, in lower case; a text of fewer than five words is one shingle, and null, empty and blank texts
    are equal.  Which row stays, and repeated rows and ids, are as in ``near_dup.keep_one``.
    """
    require(docs, id_col, text_col)
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), near_dup.row_key(doc_id, F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    printed = materialize(texts.mapInArrow(_printed, PRINTED), "similar-prints")
    nodes = printed.groupBy("fp").agg(F.min("row_key").alias("row_key"), *[F.first(c).alias(c) for c in ("size", *PRINT)])
    nodes = materialize(nodes, "similar-nodes")
    linked = components(_links(texts, nodes, block), "similar").select(F.col("node").alias("fp"), "root")
    named = materialize(nodes.select("fp").join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "similar-roots")
    return near_dup.keep_first(docs, printed.select("doc_id", "row_key", "fp"), named, id_col, text_col)
