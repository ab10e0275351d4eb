"""Media columns: content-addressed payloads in tar shards.

A payload (bytes padded with 0 to a positive multiple of 64) is stored as an 8-bit grey PNG that is 64 samples wide,
which keeps it losslessly.  Every task writes tar shards in the shared folder; a member is named by the SHA-256 of its
payload and occurs once in a shard.  A row carries digest, shard, offset and length only.  ``with_metadata`` fills
width and height from the first 33 bytes of each member (a range read); ``features`` reads members back and derives everything
else from what it has read.  Both go through the shards in order, with one read for rows that share a member, in as many tasks as
``TASK`` bytes go into the members.

Defined cases: null or empty text is a payload of 64 zero bytes; equal texts give equal values; repeated rows share
a member; an empty table writes no shard; texts of any length are one member; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, materialize, scratch_dir, slices
from .store import Folder, own_name

WIDTH = 64
SHARD = 128 << 20
HEADER = 33
TASK = 16 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    lines = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    filtered = np.zeros((len(lines), WIDTH + 1), np.uint8)
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered, 1)) + _chunk(b"IEND", b"")


def shape(header: bytes) -> tuple[int, int]:
    """Width and height from the first 33 bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">II", header[16:24])


def decode(stored: bytes) -> bytes:
    width, height = shape(stored[:HEADER])
    body, at = [], 8
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            body.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected line filter")
    return lines[:, 1:].tobytes()


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store(docs: DataFrame, uri: str) -> DataFrame:
    """Write the texts' payloads below ``uri``; the materialized index of their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, part = Folder(uri), 0
        pieces = slices(batches, most=8 << 20)
        piece = next(pieces, None)
        while piece is not None:
            name, places, rows, size = f"{own_name()}-{part:04d}.tar", {}, [], 0
            with folder.create(name) as out:
                while piece is not None and size < SHARD:
                    raw, offsets = joined_bytes(piece.column("text"))
                    data = raw.tobytes()
                    for doc_id, start, stop in zip(piece.column("doc_id").to_pylist(), offsets, offsets[1:]):
                        payload = padded(data[start:stop])
                        digest = hashlib.sha256(payload).hexdigest()
                        if digest not in places:
                            stored = encode(payload)
                            member = tarfile.TarInfo(f"{digest}.png")
                            member.size = len(stored)
                            head = member.tobuf(tarfile.GNU_FORMAT)
                            out.write(head + stored + bytes(-len(stored) % tarfile.BLOCKSIZE))
                            places[digest] = (size + len(head), len(stored))
                            size += len(head) + -(-len(stored) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
                        rows.append((doc_id, int(stop - start), digest, name, *places[digest]))
                    piece = next(pieces, None)
                out.write(bytes(2 * tarfile.BLOCKSIZE))
            part += 1
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in INDEX.split(", ")]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return materialize(docs.select("doc_id", "text").mapInArrow(run, INDEX))


def _members(index: DataFrame, uri: str, columns: str, derive) -> DataFrame:
    """``derive(file, offset, length)`` for each distinct member, beside the index rows in shard order."""
    names = [x.split()[0] for x in columns.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    types = [kinds[x.split()[1]] for x in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, file, at, got = Folder(uri), None, (None, None), ()
        for b in batches:
            found = []
            for shard, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if (shard, offset) != at:
                    if shard != at[0]:
                        if file is not None:
                            file.close()
                        file = folder.open(shard)
                    at, got = (shard, offset), derive(file, offset, length)
                found.append(got)
            if found:
                new = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                yield pa.record_batch([*b.columns, *new], names=[*b.schema.names, *names])

    kept = ", ".join(f"{c} {t}" for c, t in index.dtypes)
    return index.mapInArrow(run, f"{kept.replace('bigint', 'long')}, {columns}")


def in_order(index: DataFrame) -> DataFrame:
    """The index dealt in shard order, by the bytes that it points to."""
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    # The row number parts the rows that share a member when these are many.
    keys = ["shard", "offset", "doc_id", "_row"]
    return index.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(int(size // TASK) + 1, *keys).sortWithinPartitions(*keys).drop("_row")


def with_metadata(index: DataFrame, uri: str) -> DataFrame:
    """The index (in shard order) with width and height, from the members' headers alone."""

    def derive(file, offset: int, length: int) -> tuple:
        file.seek(offset)
        return shape(file.read(HEADER))

    return _members(index, uri, "width long, height long", derive)


def features(index: DataFrame, uri: str) -> DataFrame:
    """The index (in shard order) with payload and media columns, all computed from the bytes read back."""

    def derive(file, offset: int, length: int) -> tuple:
        file.seek(offset)
        stored = file.read(length)
        width, height = shape(stored[:HEADER])
        payload = decode(stored)
        counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
        share = counts[counts > 0] / len(payload)
        mean = float((counts * np.arange(256)).sum() / len(payload))
        spread = float(np.sqrt(max((counts * np.arange(256) ** 2).sum() / len(payload) - mean**2, 0)))
        said = f"{width}x{height} mean={mean:.4f} sd={spread:.4f} entropy={float(-(share * np.log2(share)).sum()):.4f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), said

    return _members(index, uri, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", derive)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every text, read it back and return one row per document."""
    uri = scratch_dir(docs.sparkSession, "media")
    out = features(with_metadata(in_order(store(docs, uri)), uri), uri)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", F.col("digest"), "shard", "offset", "length")
