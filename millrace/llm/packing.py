"""Best-fit packing of token pieces into sequences, refined by swap-based local search.

Pieces are dealt evenly into groups of bounded size; each group is packed on its own by one task: best
fit decreasing, then local search over its underfull bins (move one, exchange one for one, exchange two
for one), each step raising the sum of squared fills, until bins empty.  A group leaves about one bin
part empty, so groups of ``group_rows`` pieces cost about 1 / group_rows of the sequences.
Only piece headers are shuffled, never texts or ids.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import encoding
from .common import arrow_batch, lean, materialize, read_table, require

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: full ones, but for a first one with the remainder."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(path: str, capacity: int, end_id: int):
    @lean
    def run(batches):
        import zlib

        from pyspark import TaskContext

        each, row = encoding.load(path).each, TaskContext.get().partitionId()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            ids_of = each(t or "" for t in batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), ids_of, strict=True):
                raw = np.array([*ids, end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut(len(raw), capacity)):
                    for col, v in zip(out, (doc_id, k, start, length, zlib.crc32(raw[start : start + length].tobytes()), row), strict=True):
                        col.append(v)
                    row += 1
            yield arrow_batch(PIECES, out)

    return run


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit decreasing: the fullest bin that still has room takes the next longest piece."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room_left = 0  # bit r is set where some bin has room r
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = room_left >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                room_left &= ~(1 << room)
        else:
            b, room = len(bins), capacity
            bins.append([])
        bins[b].append(int(i))
        if room > n:
            by_room[room - n].append(b)
            room_left |= 1 << (room - n)
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int, passes: int = 4) -> list[list[int]]:
    """Local search over the underfull bins.

    From the emptiest bin on, a bin gives pieces away: a whole piece to the bin that it fills best, else
    one or two of its pieces for one shorter piece of a bin that has room for the difference.  A step is
    taken only if the other bin is the fuller or grows past this one, so squared fill rises and the search
    ends; a pass that empties no bin is the last.
    """
    full = [b for b in bins if sum(lengths[i] for i in b) == capacity]
    live = [list(b) for b in bins if sum(lengths[i] for i in b) < capacity]
    for _ in range(passes):
        if len(live) < 2:
            break
        before = len(live)
        fill = np.array([sum(int(lengths[i]) for i in b) for b in live])
        item = np.array([i for b in live for i in b])
        home = np.repeat(np.arange(len(live)), [len(b) for b in live])
        size = lengths[item].astype(np.int64)
        for a in np.argsort(fill, kind="stable"):
            moved = True
            while moved and fill[a] > 0:
                moved = False
                own = np.flatnonzero(home == a)
                own = own[np.argsort(-size[own], kind="stable")]
                room = np.where(fill > 0, capacity - fill, 0)
                room[a] = 0
                for k in own:  # move
                    gap = room - size[k]
                    ok = np.flatnonzero((gap >= 0) & (fill - fill[a] + size[k] > 0))
                    if len(ok):
                        to = ok[np.argmin(gap[ok])]
                        fill[a] -= size[k]
                        fill[to] += size[k]
                        home[k] = to
                        moved = True
                        break
                if moved:
                    continue
                sets = [(k,) for k in own] + [(k, m) for x, k in enumerate(own) for m in own[x + 1 :]]
                best = None
                for give in sets:  # exchange for one shorter piece elsewhere
                    more = sum(int(size[k]) for k in give) - size
                    ok = np.flatnonzero((more > 0) & (more <= room[home]) & (home != a) & (fill[home] - fill[a] + more > 0))
                    if len(ok):
                        take = ok[np.argmax(more[ok])]
                        if best is None or more[take] > best[0]:
                            best = (int(more[take]), give, take)
                if best:
                    more, give, take = best
                    to = home[take]
                    home[list(give)] = to
                    home[take] = a
                    fill[a] -= more
                    fill[to] += more
                    moved = True
        order = np.argsort(home, kind="stable")
        live = [[int(i) for i in part] for part in np.split(item[order], np.flatnonzero(np.diff(home[order])) + 1)]
        full += [b for b in live if sum(lengths[i] for i in b) == capacity]
        live = [b for b in live if sum(lengths[i] for i in b) < capacity]
        if len({*home.tolist()}) == before:
            break
    return full + live


def _pack(capacity: int, passes: int):
    def run(key, table):
        import pyarrow as pa

        ids, n = table.column("doc_id"), table.column("length").to_numpy()
        rank = [table.column(c).to_numpy() for c in ("ids_crc32", "piece")] + [ids.fill_null(0).to_numpy(), ids.is_null().to_numpy()]
        order = np.lexsort((*rank, -n))
        table, n = table.take(pa.array(order)), n[order]
        short = np.flatnonzero(n < capacity)
        bins = [[int(short[i]) for i in b] for b in improve(best_fit(n[short], capacity), n[short], capacity, passes)]
        bins += [[int(i)] for i in np.flatnonzero(n >= capacity)]
        sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for s, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = s, at
                at += n[i]
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, group_rows: int = 20_000, passes: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` ids; one row a piece.

    Every document ends with ``end_id``; only longer ones than ``capacity`` are cut.  ``sequence_id`` is
    any number; ``offset`` runs gapless from 0 in each sequence.

    Null text counts as empty (one piece of one id).  Null ids and repeated rows stay, each row with its
    own pieces.  Ties are broken by id, piece and checksum.  An empty table gives no rows.  Other columns
    are ignored, whatever their names.
    """
    require(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    dealt = pieces.withColumn("group", F.col("deal") % groups)
    return dealt.groupBy("group").applyInArrow(_pack(capacity, passes), PACKED)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), encoding.public_path("byte_bpe_50k.json"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
SQL: dict[str, str] = {}
