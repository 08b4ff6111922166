"""Media columns: content-addressed payloads in tar shards.

A payload is stored once, as a PNG image of 64 RGB pixels a row, in a tar shard that a task writes to the shared folder.
Rows carry the payload's digest and the shard, offset and length of its media bytes. Metadata columns are filled by range
reads of the header alone; features by range reads of the whole image.
"""
from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common

ROW = 192  # bytes of a row of pixels
SHARD_BYTES = 256 << 20
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33  # the signature and the header chunk
INDEX_SCHEMA = "digest string, shard string, offset long, length long"
META_SCHEMA = INDEX_SCHEMA + ", width int, height int, depth int"
FEATURE_SCHEMA = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """The payload, a positive multiple of ROW bytes, as 8-bit RGB samples; lossless."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, depth) from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png has made; checks each chunk's sum."""
    at, data = len(SIGNATURE), []
    width, height, _ = png_header(media[:HEADER])
    while at < len(media):
        (size,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("broken chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 3 * width + 1)
    return lines[:, 1:].tobytes()


def payload_of(text: str) -> Column:
    """UTF-8 bytes of the whole text (null: empty), filled with spaces to a positive multiple of ROW."""
    body = common.whole(text)
    n = F.octet_length(body)
    full = F.greatest(F.lit(ROW), F.ceil(n / ROW) * ROW).cast("int")
    return F.encode(F.concat(body, F.repeat(F.lit(" "), full - n)), "UTF-8")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_shards(folder: str):
    """Tar shards of a task's payloads as images; a digest that the task has met lately is not stored again."""

    def run(batches):
        files, root = _open(folder)
        out = name = None
        at, seen = 0, set()
        for batch in batches:
            rows = []
            for digest, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digest in seen:
                    continue
                if len(seen) >= 500_000:
                    seen.clear()
                seen.add(digest)
                media = to_png(payload.as_buffer().to_pybytes())
                if out is None or at >= SHARD_BYTES:
                    if out is not None:
                        out.write(b"\0" * 1024)
                        out.close()
                    name, at = f"shard-{uuid.uuid4().hex}.tar", 0
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}")
                info = tarfile.TarInfo(f"{digest}.png")
                info.size = len(media)
                out.write(info.tobuf(tarfile.USTAR_FORMAT))
                out.write(media)
                out.write(b"\0" * (-len(media) % 512))
                rows.append((digest, name, at + 512, len(media)))
                at += 512 + len(media) + -len(media) % 512
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["digest", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()

    return run


def store(rows: DataFrame, folder: str, digest: str = "digest", payload: str = "payload") -> DataFrame:
    """Write payloads into tar shards below folder, and give their index (digest, shard, offset, length): one place for
    each distinct payload.

    Payloads aren't shuffled: each task writes what it reads, copies once, and of the places that several tasks have for a
    digest the index keeps the least. It is itself a table in the shared folder and names the shards of the tasks that
    succeeded, so a task that is run again leaves at most a shard that nothing points to. An empty table gives an empty
    index.
    """
    placed = common.cut(rows.select(F.col(digest).alias("digest"), F.col(payload).alias("payload")).mapInArrow(_write_shards(folder), INDEX_SCHEMA), "media-places")
    one = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return one.select("digest", "at.*").repartition(F.col("shard")).sortWithinPartitions("shard", "offset")


def _ranges(folder: str, read, schema: pa.Schema):
    def run(batches):
        files, root = _open(folder)
        name = source = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["shard"], files.open_input_file(f"{root}/{row['shard']}")
                out.append(read(source, row))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _meta(source, row: dict) -> dict:
    width, height, depth = png_header(source.read_at(HEADER, row["offset"]))
    return row | {"width": width, "height": height, "depth": depth}


def features_of(payload: bytes, width: int, height: int) -> str:
    """Size, mean and extreme samples, and a 64-bit mean hash over 64 equal slices."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(np.int64)[:-1]
    means = np.add.reduceat(x, edges, dtype=np.int64) * 64 // len(x)
    bits = np.packbits(means > int(x.sum(dtype=np.int64)) // len(x)).tobytes().hex()
    return f"{width}x{height} mean={int(x.sum(dtype=np.int64)) // len(x)} min={int(x.min())} max={int(x.max())} hash={bits}"


def _features(source, row: dict) -> dict:
    media = source.read_at(row["length"], row["offset"])
    payload = from_png(media)
    return {
        "digest": row["digest"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features_of(payload, row["width"], row["height"]),
    }


def metadata(index: DataFrame, folder: str) -> DataFrame:
    """The index with width, height and depth, from reads of the first HEADER bytes of each image."""
    schema = pa.schema([("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("depth", pa.int32())])
    return index.mapInArrow(_ranges(folder, _meta, schema), META_SCHEMA)


def features(meta: DataFrame, folder: str) -> DataFrame:
    """Sizes, digests and features of each image, from reads of its bytes."""
    text, long = pa.string(), pa.int64()
    schema = pa.schema([("digest", text), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)])
    return meta.mapInArrow(_ranges(folder, _features, schema), FEATURE_SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    """Store every text of the table, read all of it back, and give each row its payload's columns. A null text is empty and
    its payload one row of spaces; equal texts share one stored payload and have equal values; repeated rows stay; an empty
    table gives no rows; further columns of the table aren't read."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.octet_length(common.whole("text")).cast("long").alias("n_bytes"), payload_of("text").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    folder = common.scratch(spark, "media")
    index = store(keyed, folder)
    found = features(metadata(index, folder), folder)
    return keyed.select("doc_id", "n_bytes", "digest").join(found, "digest").drop("digest")
