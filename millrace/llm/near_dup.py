"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two fingerprints that differ in at most ``k`` of 64 bits differ in at most ``k`` of 8 bytes, so they share
at least ``8 - k`` positional bytes: the count filter.  A posting list is keyed by several positional
bytes at once; the position sets are chosen so that every ``8 - k`` positions contain one of them, so each
pair that can pass the filter meets in some list.  In a list shared bytes are tallied, pairs below the
count fall out, and the others are verified by their differing bits.

Copies fall together first (a row a fingerprint).  A list never becomes pairs: a task returns the edges
of a spanning forest of the links that it finds, so a group of n near copies yields n - 1 rows.  Lists
longer than ``block`` are cut into blocks, and every two blocks meet in a task of their own.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, components, free_names, materialize, read_table, require

SEED = 42
SHINGLE = 4
#: Fingerprints up to which lists of three bytes stay short; above, four bytes key a list.
WIDE_ABOVE = 1 << 26
EDGES = "a long, b long"


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(width)), strict=False) if len(words) >= width else [words]
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, shingles)), np.uint64)
    ones, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(hashed), step):
        ones += np.unpackbits(hashed[at : at + step].byteswap().view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashed)).tobytes(), "big")


PRINTED = "doc_id long, row_key long, fp long"


def _fingerprints(batches):
    for batch in batches:
        fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield arrow_batch(PRINTED, [batch.column("doc_id"), batch.column("row_key"), fp])


def position_sets(shared: int, size: int) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the 8 byte positions such that any ``shared`` positions contain one of them.

    Three of four: sets inside one third of the positions, or two from a third and one from the next
    (Turan's construction: four positions put two into some third).  Otherwise all sets.
    """
    every = list(itertools.combinations(range(8), size))
    if (shared, size) != (4, 3):
        return every
    third = [0, 0, 0, 1, 1, 1, 2, 2]
    count = lambda s: tuple(sum(third[p] == t for p in s) for t in range(3))
    kept = [s for s in every if 3 in (c := count(s)) or any(c[t] == 2 and c[(t + 1) % 3] == 1 for t in range(3))]
    return kept if all(any(set(s) <= set(q) for s in kept) for q in itertools.combinations(range(8), 4)) else every


def _posting_keys(fp: Column, sets: list[tuple[int, ...]]) -> Column:
    """One long a position set: its number above the bytes that it picks."""
    byte = lambda p: F.shiftrightunsigned(fp, 8 * p).bitwiseAND(F.lit(255).cast("long"))
    keys = []
    for k, s in enumerate(sets):
        value = F.lit(k).cast("long")
        for p in s:
            value = F.shiftleft(value, 8).bitwiseOR(byte(p))
        keys.append(value)
    return F.array(*keys)


def _root(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            parent[x] = r
            return r
        r = up


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i] for all i; the smaller index is the root."""
    while len(a):
        ra, rb = _root(parent, a), _root(parent, b)
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(fp: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Whether fp[left] and fp[right] pass the count filter and the verification."""
    x = fp[left] ^ fp[right]
    shared = np.zeros(x.shape, np.int8)
    for p in range(8):
        shared += (x >> np.uint64(8 * p)) & np.uint64(255) == 0
    ok = shared >= 8 - bits
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


SMALL = 48


def forest(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each run of equal keys."""
    fp = fp.view(np.uint64)
    parent = np.arange(len(fp))
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.array([], np.int64)
    length = np.diff(np.r_[begin, len(key)])
    for n in np.unique(length[(length > 1) & (length <= SMALL)]):  # runs of a length at once
        at, (i, j) = begin[length == n], np.triu_indices(n, 1)
        step = max(1, 4_000_000 // len(i))
        for k in range(0, len(at), step):
            left, right = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
            ok = linked(fp, left, right, bits)
            _hook(parent, left[ok], right[ok])
    for b, n in zip(begin[length > SMALL], length[length > SMALL], strict=True):
        rows = max(1, 4_000_000 // int(n))
        for r in range(b, b + n, rows):
            left, right = (x.ravel() for x in np.meshgrid(np.arange(r, min(r + rows, b + n)), np.arange(b, b + n), indexing="ij"))
            up = left < right
            left, right = left[up], right[up]
            ok = linked(fp, left, right, bits)
            _hook(parent, left[ok], right[ok])
    root = _root(parent, np.arange(len(fp)))
    child = np.flatnonzero(root != np.arange(len(fp)))
    return fp[child].view(np.int64), fp[root[child]].view(np.int64)


def _edges(bits: int):
    def run(batches):
        held: list[np.ndarray] = []  # of the last key, which may go on in the next batch

        def out(key, fp):
            a, b = forest(key, fp, bits)
            return arrow_batch(EDGES, [a, b])

        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j", "fp")])
            if not rows.shape[1]:
                continue
            if held and not np.array_equal(held[0][:3, 0], rows[:3, 0]):
                done = np.concatenate(held, axis=1)
                held = []
                yield out(np.zeros(done.shape[1]), done[3])
            change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
            if not len(change):
                held.append(rows)
                continue
            first = change[0] if held else 0
            if held:
                done = np.concatenate([*held, rows[:, :first]], axis=1)
                yield out(np.zeros(done.shape[1]), done[3])
            held = [rows[:, change[-1] :]]
            run_ = np.zeros(rows.shape[1], np.int64)
            run_[change] = 1
            run_ = np.cumsum(run_)
            if change[-1] > first:
                yield out(run_[first : change[-1]], rows[3, first : change[-1]])
        if held:
            done = np.concatenate(held, axis=1)
            yield out(np.zeros(done.shape[1]), done[3])

    return run


def links(prints: DataFrame, bits: int, block: int = 4096, wide_above: int = WIDE_ABOVE) -> DataFrame:
    """Spanning edges ``(a, b)`` of all links between the distinct fingerprints ``prints(fp)``."""
    size = 3 if prints.count() <= wide_above and 8 - bits >= 3 else min(4, 8 - bits)
    posted = prints.select(F.explode(_posting_keys(F.col("fp"), position_sets(8 - bits, size))).alias("key"), "fp")
    lists = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = posted.join(lists, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    met = members.withColumn("own", own).withColumn("other", other).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(_edges(bits), EDGES)


def row_key(row_id: Column, text: Column) -> Column:
    return F.xxhash64(row_id, F.coalesce(text, F.lit("")))


def _grouped(docs: DataFrame, bits: int, block: int, wide_above: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row_key, fp)`` of all rows, and ``(fp, root, component_id)`` of all fingerprints."""
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(id_col).cast("long"), F.col(text_col)).alias("row_key"), F.col(text_col).alias("text"))
    rows = materialize(rows.mapInArrow(_fingerprints, PRINTED), "fingerprints")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "prints")
    joined = prints.join(components(links(prints.select("fp"), bits, block, wide_above), "simhash").withColumnRenamed("node", "fp"), "fp", "left")
    rooted = materialize(joined.select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "roots")
    # only fingerprints with links meet in groups; the others keep their own smallest id
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows, materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "components")


def near_duplicates(docs: DataFrame, bits: int = 4, block: int = 4096, wide_above: int = WIDE_ABOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Null text counts as empty; texts without words have fingerprint 0, which links like any other.  A
    null id never names a component unless all of its members have none (then null).  Repeated rows
    stay, one result a row.  An empty table gives no rows.  Other columns are ignored, whatever their
    names.
    """
    rows, named = _grouped(docs, bits, block, wide_above, id_col, text_col)
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bits: int = 4, block: int = 4096, wide_above: int = WIDE_ABOVE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest id (a row without id only where none has one).

    All columns of ``docs`` stay.  Rows with one id and different texts are told apart by the text; of
    equal rows one stays.
    """
    rows, named = _grouped(docs, bits, block, wide_above, id_col, text_col)
    return keep_first(docs, rows, named, id_col, text_col)


def keep_first(docs: DataFrame, rows: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``keep_one``, from ``rows(doc_id, row_key, fp)`` of ``docs`` and the groups ``named(fp, root)``."""
    first = rows.join(named, "fp").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("b"))
    own, kept_id, kept_key, more = free_names(docs, 4)
    kept = first.select(F.col("b.doc_id").alias(kept_id), F.col("b.row_key").alias(kept_key))
    repeated = rows.groupBy(F.col("row_key").alias(kept_key)).agg(F.count("*").alias("n")).where("n > 1").select(kept_key, F.lit(True).alias(more))
    kept = materialize(kept.join(repeated, kept_key, "left"), "kept")
    keyed = docs.withColumn(own, row_key(F.col(id_col).cast("long"), F.col(text_col)))

    def of(chosen: DataFrame) -> DataFrame:
        # texts are dealt by the row key alone; the id is compared beside it
        same_id = F.coalesce(keyed[id_col].cast("long") - chosen[kept_id], F.lit(0)) == 0
        return keyed.join(chosen, (keyed[own] == chosen[kept_key]) & same_id, "left_semi")

    out = of(kept.where(F.col(more).isNull()))
    again = kept.where(F.col(more).isNotNull())
    if not again.isEmpty():  # only rows that stand more than once need to be grouped
        out = out.unionByName(of(again).dropDuplicates([own, id_col]))
    return out.drop(own)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_simhash": op7_simhash}
SQL: dict[str, str] = {}
