"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit grey PNG of 64 samples a row.  Write tasks append members
named by payload digest to tar shards in the shared folder, at most one member a digest and task, and
return ``(digest, shard, offset, length)``; the smallest location of a digest is its address.  Readers
fetch ranges: 33 bytes of a member for its metadata columns, the whole range for its samples.
Texts are never shuffled, only digests and addresses.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch, materialize, read_table, require, scratch_path

WIDTH = 64
# Fixed values of the PNG format: signature, header chunk length, and the bytes up to the header's end.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
BLOCK = 512

WRITTEN = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADERS = "digest string, shard string, offset long, length long, width int, height int, bit_depth int"
FEATURES = "digest string, width int, height int, bit_depth int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the row width."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first bytes of a stored PNG."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or struct.unpack(">I", head[29:33])[0] != zlib.crc32(head[12:29]):
        raise ValueError("not a stored payload")
    return struct.unpack(">IIB", head[16:25])


def decode_png(media: bytes) -> bytes:
    width, height, _ = read_header(media)
    at, body = HEADER_BYTES, b""
    while True:
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + data):
            raise ValueError("damaged payload")
        if kind == b"IEND":
            break
        body += data if kind == b"IDAT" else b""
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and a 16-bin histogram of the samples, as text."""
    x = np.frombuffer(payload, np.uint8)
    bins = np.bincount(x >> 4, minlength=16)
    return f"{x.mean():.6f};{x.std():.6f};" + ",".join(map(str, bins))


def _tar_header(name: str, size: int) -> bytes:
    """A plain ustar header with fixed owner and time, so equal content makes equal shards."""
    import tarfile

    info = tarfile.TarInfo(name)
    info.size = size
    return info.tobuf(tarfile.USTAR_FORMAT if size < 8 << 30 else tarfile.GNU_FORMAT)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write(root: str, shard_bytes: int):
    def run(batches):
        import uuid

        where, base = _filesystem(root)
        shard = out = None
        at = 0
        known: dict[bytes, tuple[str, int, int]] = {}  # of the shard that is open
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in known:
                        if out is None or at >= shard_bytes:
                            if out is not None:
                                out.write(bytes(2 * BLOCK))
                                out.close()
                            shard, at, known = f"{uuid.uuid4().hex}.tar", 0, {}  # a retried task writes shards of its own
                            out = where.open_output_stream(f"{base}/{shard}")
                        media = encode_png(payload)
                        head = _tar_header(f"{digest.hex()}.png", len(media))
                        out.write(head + media + bytes(-len(media) % BLOCK))
                        known[digest] = (shard, at + len(head), len(media))
                        at += len(head) + len(media) + -len(media) % BLOCK
                    rows.append((doc_id, len(raw), digest.hex(), *known[digest]))
                yield arrow_batch(WRITTEN, [[x[k] for x in rows] for k in range(6)])
        finally:
            if out is not None:
                out.write(bytes(2 * BLOCK))
                out.close()

    return run


def write_payloads(docs: DataFrame, root: str, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a payload below ``root``; one row a document with digest and address.

    The manifest is written as a table, so it names only shards of tasks that succeeded.  A copy that
    another task stored too stays unreferenced: all rows of a digest get its smallest address.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return materialize(rows.mapInArrow(_write(root, shard_bytes), WRITTEN), "manifest")


def addresses(manifest: DataFrame) -> DataFrame:
    """One address a digest."""
    return manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")


def _open_each(root: str, rows, use):
    """``use(file, row)`` for each row, with one open file a run of rows of a shard."""
    where, base = _filesystem(root)
    name = f = None
    try:
        for row in rows:
            if row["shard"] != name:
                if f is not None:
                    f.close()
                name, f = row["shard"], where.open_input_file(f"{base}/{row['shard']}")
            yield use(f, row)
    finally:
        if f is not None:
            f.close()


def _headers(root: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = list(_open_each(root, batch.to_pylist(), lambda f, r: read_header(f.read_at(HEADER_BYTES, r["offset"]))))
            more = [pa.array([x[k] for x in found], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=["digest", "shard", "offset", "length", "width", "height", "bit_depth"])

    return run


def _features(root: str):
    def one(f, r):
        media = f.read_at(r["length"], r["offset"])
        payload = decode_png(media)
        if hashlib.sha256(payload).hexdigest() != r["digest"]:
            raise ValueError(f"payload {r['digest']} is damaged")
        return r["digest"], r["width"], r["height"], r["bit_depth"], len(payload), r["digest"], zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)

    def run(batches):
        for batch in batches:
            rows = list(_open_each(root, batch.to_pylist(), one))
            yield arrow_batch(FEATURES, [[x[k] for x in rows] for k in range(10)])

    return run


def by_range(at: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Neighbouring ranges of a shard meet in one task, in file order."""
    return at.repartition("shard", F.floor(F.col("offset") / chunk_bytes)).sortWithinPartitions("shard", "offset")


def read_headers(at: DataFrame, root: str) -> DataFrame:
    """Metadata columns from header-only range reads."""
    return at.select("digest", "shard", "offset", "length").mapInArrow(_headers(root), HEADERS)


def read_features(at: DataFrame, root: str) -> DataFrame:
    """Samples read back from the store, checked against their digests, and their features."""
    return at.mapInArrow(_features(root), FEATURES)


def media_features(docs: DataFrame, root: str, shard_bytes: int = 256 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store the texts of ``docs`` and compute features from the stored bytes; one row a document.

    Null text counts as empty: one row of zero bytes.  Null ids and repeated rows stay, one result a row;
    equal texts share one address and equal values.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    manifest = write_payloads(docs, root, shard_bytes, id_col, text_col)
    at = materialize(read_features(read_headers(by_range(addresses(manifest)), root), root), "features")
    return manifest.select("doc_id", "n_bytes", "digest").join(at, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bit_depth")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_table(spark, sf_dir, "documents"), scratch_path(spark, "media"))


QUERIES = {"op2_media_columns": op2_media_columns}
SQL: dict[str, str] = {}
