"""Media columns: content-addressed images in tar shards.

A payload is the text's UTF-8 with bytes 255 up to a positive multiple of 576,
kept losslessly as an 8-bit grey PNG of 576 samples a row.  The SHA-256 of the
PNG is its address and its member name.  Each task appends the payloads that it
has not stored yet to tar shards in the shared folder; rows carry digest,
offset and length only, so no payload is ever shuffled.  Metadata columns come
from a range read of the 33 header bytes, features from a range read of the
member.

Nulls: a null text is an empty one (576 bytes of 255); a null doc_id stays
null.  Equal texts give equal values, whichever shard holds them.  Repeated
rows each give a row.  An empty table gives no shard and no row.  Texts of any
length are one member; PNG rows and deflate have no limit below 2 GB.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import slices
from .shared import SharedFile, new_dir, open_shared, written

ROW = 576
HEADER = 33  # signature and IHDR
SHARD_BYTES = 256 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def pad(text: bytes) -> bytes:
    return text + b"\xff" * ((-len(text)) % ROW if text else ROW)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """Grey 8-bit PNG; each row goes unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """(width, height) from the first 33 bytes."""
    if header[:8] != _SIGNATURE or header[12:16] != b"IHDR" or zlib.crc32(header[12:29]) != struct.unpack_from(">I", header, 29)[0]:
        raise ValueError("not a PNG header")
    return struct.unpack_from(">II", header, 16)


def from_png(data: bytes) -> bytes:
    width, height = png_size(data[:HEADER])
    at, packed = HEADER, []
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header with fixed owner and time, so equal content gives equal bytes."""
    big = size >= 8 << 30
    field = (b"\x80" + size.to_bytes(11, "big")) if big else b"%011o\0" % size
    head = bytearray(512)
    head[0:100] = name.encode().ljust(100, b"\0")
    head[100:156] = b"0000644\0" + b"0000000\0" * 2 + field + b"00000000000\0" + b" " * 8
    head[156:157] = b"0"
    head[257:265] = b"ustar\00000"
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


class _Shards:
    """The tar shards of one task; ``put`` gives (path, offset, length) of a member."""

    def __init__(self, folder: str):
        self.folder, self.out, self.n = folder, None, 0
        self.have: dict[bytes, int] = {}
        self.rows: list[tuple] = []

    def put(self, name: str, digest: bytes, data: bytes) -> int:
        if self.out is None:
            self.out, self.have = SharedFile(self.folder, f"shard-{self.n:04d}", ".tar"), {}
        if digest not in self.have:
            self.out.write(_tar_header(name, len(data)))
            self.have[digest] = self.out.write(data)
            self.out.write(bytes(-len(data) % 512))
        return self.have[digest]

    @property
    def full(self) -> bool:
        return self.out is not None and self.out.size >= SHARD_BYTES

    def close(self) -> str | None:
        if self.out is None:
            return None
        self.out.write(bytes(1024))
        path, self.out, self.n = self.out.close(), None, self.n + 1
        return path


_MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store the payload of each of ``docs(doc_id, text)``; returns the manifest table."""
    folder = folder or new_dir(docs.sparkSession, "media")

    def store(batches):
        shards, rows = _Shards(folder), []

        def done():
            path = shards.close()
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
                + [pa.array([path] * len(rows), pa.string())]
                + [pa.array([r[i] for r in rows], pa.int64()) for i in (3, 4)],
                ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
            )
            rows.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    raw = (text or "").encode()
                    data = to_png(pad(raw))
                    digest = hashlib.sha256(data)
                    at = shards.put(f"{digest.hexdigest()}.png", digest.digest(), data)
                    rows.append((doc, len(raw), digest.hexdigest(), at, len(data)))
                if shards.full:
                    yield done()
        if rows:
            yield done()

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(store, _MANIFEST), "media-manifest")


def media_features(samples: np.ndarray) -> str:
    """64 bits: whether the mean of each 64th of the samples is over the mean of all."""
    parts = np.add.reduceat(samples.astype(np.int64), np.arange(64) * len(samples) // 64)
    sizes = np.diff(np.append(np.arange(64) * len(samples) // 64, len(samples)))
    bits = parts * len(samples) > int(samples.sum(dtype=np.int64)) * sizes
    return np.packbits(bits).tobytes().hex()


class _Handles:
    """The last few shards that a task has open."""

    def __init__(self):
        self.open: dict[str, object] = {}

    def get(self, path: str):
        if path not in self.open:
            if len(self.open) >= 4:
                self.open.pop(next(iter(self.open))).close()
            self.open[path] = open_shared(path)
        return self.open[path]


def header_metadata(manifest: DataFrame) -> DataFrame:
    """The manifest with ``width`` and ``height``, by header-only range reads."""

    def read(batches):
        files = _Handles()
        for batch in batches:
            size = [png_size(files.get(p).read_at(HEADER, o)) for p, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[0] for s in size], pa.int64()), pa.array([s[1] for s in size], pa.int64())], [*batch.schema.names, "width", "height"])

    return manifest.mapInArrow(read, _MANIFEST + ", width long, height long")


def read_media(manifest: DataFrame) -> DataFrame:
    """Read the stored members back, each once a task; checks each against its address."""
    kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
    schema = _MANIFEST + ", width long, height long, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"

    def read(batches):
        files, seen = _Handles(), {}
        for batch in batches:
            rows = []
            for digest, path, at, n in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if (found := seen.get((path, at, n, digest))) is None:
                    data = files.get(path).read_at(n, at)
                    if hashlib.sha256(data).hexdigest() != digest:
                        raise ValueError(f"stored bytes differ from their address: {path} at {at}")
                    payload = from_png(data)
                    found = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), media_features(np.frombuffer(payload, np.uint8)))
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen[path, at, n, digest] = found
                rows.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values()))], [*batch.schema.names, *kinds])

    return header_metadata(manifest).mapInArrow(read, schema)
