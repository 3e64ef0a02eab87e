"""Token-ID output as directly addressable codes (DAC).

A file holds blocks of up to ``BLOCK`` ids.  Level 0 stores the low eight bits
of every id, a bitmap says which ids go on, level 1 stores the next eight bits
of those alone, and so on.  A directory of running one-counts per 512 bits
gives rank, so ``TokenFile.token(i)`` reads one byte a level and one directory
entry, without decoding a block.

    file   = magic "DACT1\\n\\0\\0", blocks, index, uint64 index offset, magic
    block  = uint32 levels, then a level: uint32 n, n bytes, bitmap bytes,
             uint32 directory entries (the last level has no bitmap)
    index  = uint32 n_docs, uint32 n_blocks, block offsets u64, first id of each
             block u64, first id of each document u64 (n_docs + 1), null flags u8,
             doc ids i64

Nulls: a null text is an empty one; a null doc_id sorts first and stays null.
Repeated rows each keep their ids.  Empty tables give no files and no rows.
Texts of any length are stored whole: a document may span blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import equal_spans, flat, ranges, slices, span_hashes, table
from .shared import SharedFile, new_dir, open_shared, partitions_for, written

MAGIC = b"DACT1\n\0\0"
BLOCK = 1 << 18
_RANK = 512
_NO_ID = -(1 << 63)  # where a null doc_id sorts
_CACHE_ENTRIES = 800_000

# --- codes -----------------------------------------------------------------


def pack_block(ids: np.ndarray) -> bytes:
    """Chunk levels, continuation bitmaps and rank directories of one block."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        low, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest != 0
        if not more.any():
            levels.append(struct.pack("<I", len(low)) + low.tobytes())
            break
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), _RANK), dtype=np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype(np.uint32)
        levels.append(struct.pack("<I", len(low)) + low.tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more]
    return struct.pack("<I", len(levels)) + b"".join(levels)


def _level_parts(at: int, n: int) -> tuple[int, int, int, int]:
    """Offsets of the bytes, bitmap, directory and end of a level with a bitmap."""
    bits = at + 4 + n
    ranks = bits + (n + 7) // 8
    return at + 4, bits, ranks, ranks + 4 * -(-n // _RANK)


def unpack_block(data: bytes) -> np.ndarray:
    (n_levels,) = struct.unpack_from("<I", data)
    at, parts = 4, []
    for level in range(n_levels):
        (n,) = struct.unpack_from("<I", data, at)
        low = np.frombuffer(data, np.uint8, n, at + 4)
        if level + 1 < n_levels:
            _, bits, _, end = _level_parts(at, n)
            parts.append((low, np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, bits), count=n, bitorder="little").view(bool)))
            at = end
        else:
            parts.append((low, None))
    out = parts[-1][0].astype(np.uint32)
    for low, more in reversed(parts[:-1]):
        whole = low.astype(np.uint32)
        whole[more] |= out << 8
        out = whole
    return out


class TokenFile:
    """Reader of one file: ``token(i)``, ``read(a, b)``, ``documents()``."""

    def __init__(self, path: str):
        self.file = open_shared(path)
        size = self.file.size()
        if self.file.read_at(8, 0) != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"not a token file: {path}")
        (self.index_at,) = struct.unpack("<Q", self.file.read_at(8, size - 16))
        index = self.file.read_at(size - 16 - self.index_at, self.index_at)
        n, b = struct.unpack_from("<II", index)
        at = 8
        self.block_at = np.frombuffer(index, np.uint64, b, at).astype(np.int64)
        self.block_first = np.frombuffer(index, np.uint64, b, at + 8 * b).astype(np.int64)
        at += 16 * b
        self.doc_first = np.frombuffer(index, np.uint64, n + 1, at).astype(np.int64)
        at += 8 * (n + 1)
        self.doc_null = np.frombuffer(index, np.uint8, n, at).astype(bool)
        self.doc_ids = np.frombuffer(index, np.int64, n, at + n)

    def token(self, i: int) -> int:
        """Id number ``i`` of the file, by rank alone."""
        block = int(np.searchsorted(self.block_first, i, side="right")) - 1
        at, pos = int(self.block_at[block]), i - int(self.block_first[block])
        read = self.file.read_at
        (n_levels,) = struct.unpack("<I", read(4, at))
        at, value = at + 4, 0
        for level in range(n_levels):
            (n,) = struct.unpack("<I", read(4, at))
            value |= read(1, at + 4 + pos)[0] << (8 * level)
            if level + 1 == n_levels:
                break
            _, bits, ranks, end = _level_parts(at, n)
            word = pos // _RANK
            (rank,) = struct.unpack("<I", read(4, ranks + 4 * word))
            run = int.from_bytes(read(pos // 8 - word * _RANK // 8 + 1, bits + word * _RANK // 8), "little")
            inside = pos - word * _RANK
            if not run >> inside & 1:
                break
            pos, at = rank + (run & ((1 << inside) - 1)).bit_count(), end
        return value

    def _block(self, b: int) -> np.ndarray:
        end = int(self.block_at[b + 1]) if b + 1 < len(self.block_at) else self.index_at
        return unpack_block(self.file.read_at(end - int(self.block_at[b]), int(self.block_at[b])))

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids ``a`` to ``b`` (end exclusive)."""
        if b <= a:
            return np.zeros(0, np.uint32)
        lo, hi = (int(np.searchsorted(self.block_first, x, side="right")) - 1 for x in (a, b - 1))
        out = np.concatenate([self._block(i) for i in range(lo, hi + 1)])
        return out[a - int(self.block_first[lo]) : b - int(self.block_first[lo])]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) in file order; each block is read once."""
        held, base, block = np.zeros(0, np.uint32), 0, 0
        for i, doc in enumerate(self.doc_ids):
            a, b = int(self.doc_first[i]), int(self.doc_first[i + 1])
            parts = [held[a - base :]]
            have = base + len(held)
            while have < b:
                parts.append(self._block(block))
                have += len(parts[-1])
                block += 1
            held, base = (np.concatenate(parts) if len(parts) > 1 else parts[0]), a
            yield (None if self.doc_null[i] else int(doc)), a, held[: b - a]

    def close(self) -> None:
        self.file.close()


class _Writer:
    def __init__(self, folder: str, shard: int):
        self.out = SharedFile(folder, f"part-{shard:05d}", ".dac")
        self.out.write(MAGIC)
        self.shard, self.held, self.n_held, self.n = shard, [], 0, 0
        self.block_at, self.block_first, self.first, self.ids = [], [], [0], []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc)
        self.held.append(ids)
        self.n_held += len(ids)
        self.first.append(self.first[-1] + len(ids))
        if self.n_held >= BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        while len(ids) >= BLOCK or last and len(ids):
            part, ids = ids[:BLOCK], ids[BLOCK:]
            self.block_at.append(self.out.write(pack_block(part)))
            self.block_first.append(self.n)
            self.n += len(part)
        self.held, self.n_held = [ids], len(ids)

    def close(self) -> tuple[int, str, int, int, int]:
        self._flush(True)
        at = self.out.size
        n = len(self.ids)
        index = struct.pack("<II", n, len(self.block_at))
        for x in (self.block_at, self.block_first, self.first):
            index += np.array(x, np.uint64).tobytes()
        index += bytes(x is None for x in self.ids) + np.array([x or 0 for x in self.ids], np.int64).tobytes()
        self.out.write(index + struct.pack("<Q", at) + MAGIC)
        return self.shard, self.out.close(), n, self.first[-1], self.out.size


# --- encoding with the tokenizers library ------------------------------------

# Bytes of plain Latin text: ASCII that prints, tab and line ends, and the two-byte letters
# U+00C0 to U+024F; of those only U+00D7 and U+00F7 (second bytes 97, B7) are no letters.
_PLAIN = table([*range(0x20, 0x7F), 9, 10, 13, *range(0x80, 0xC0), *range(0xC3, 0xCA)])
_SPACE = table([9, 10, 13, 0x20])
_WORDY = table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_CUT = table([0x0A, 0x20, 0x2C, 0x2E])
_STOP = table([0x2C, 0x2E])


def _plain_documents(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether white space and ``.,`` stand alone in a document, and all else is plain."""
    odd = ~_PLAIN[buf]
    before, now = buf[:-1], buf[1:]
    odd[1:] |= _SPACE[now] & _SPACE[before]
    odd[1:] |= (before == 0x3C) & (now == 0x7C)  # how a special token begins
    odd[1:] |= (before == 0xC3) & ((now == 0x97) | (now == 0xB7))
    stop = _STOP[buf]
    odd[1:] |= stop[1:] & ~_WORDY[before]
    first = off[:-1][off[:-1] < off[1:]]
    odd[first] = ~_PLAIN[buf[first]] | stop[first]
    bad = np.concatenate(([0], np.cumsum(odd)))
    return bad[off[1:]] == bad[off[:-1]]


class Encoder:
    """Ids of whole texts with the tokenizers library.

    A plain Latin text in which white space and ``.,`` stand alone falls into
    chunks that the pre-tokenizer never joins: each begins at a space, a line
    end, a stop or a comma.  The distinct chunks of a slice are looked up in a
    bounded cache of two generations; the library encodes those that are new,
    many in one text.  Other texts, and those that may hold a special token, go
    to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.leads = np.zeros(self.tok.get_vocab_size(), np.uint8)  # whether a token begins with a space or a line end
        for token, i in self.tok.get_vocab().items():
            self.leads[i] = {"\u0120": 0x20, "\u010a": 0x0A}.get(token[:1], 0)
        self.whole = any(not t.content.startswith("<|") for t in self.tok.get_added_tokens_decoder().values())

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, chunks: list[bytes]) -> None:
        alone = []
        together: dict[int, list[bytes]] = {0x20: [], 0x0A: []}
        for c in chunks:
            together.get(c[0] if len(c) > 1 and c[-1] > 0x20 else None, alone).append(c)
        for lead, found in together.items():
            if found:
                ids = self._ids(b"".join(found).decode())
                at = (4 * np.flatnonzero(self.leads[ids] == lead)).tolist()
                raw = ids.tobytes()
                for c, a, b in zip(found, at, [*at[1:], len(raw)], strict=True):
                    self.new[c] = raw[a:b]
        for c in alone:
            self.new[c] = self._ids(c.decode()).tobytes()

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        buf, off = flat(texts)
        n = len(off) - 1
        plain = np.zeros(n, bool) if self.whole else _plain_documents(buf, off) if len(buf) else np.ones(n, bool)
        cut = _CUT[buf]
        cut[off[:-1][off[:-1] < off[1:]]] = True
        cut &= np.repeat(plain, np.diff(off))
        start = np.flatnonzero(cut)
        doc = np.searchsorted(off, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(buf)), off[doc + 1]) if len(start) else start
        _, first, back = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
        if not (np.array_equal((end - start)[first][back], end - start) and equal_spans(buf, start, end - start, buf, start[first][back]).all()):
            return [self._ids(t or "") for t in texts.to_pylist()]  # two chunks have one hash
        data = buf.tobytes()
        chunks = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.new) >= _CACHE_ENTRIES:
            self.old, self.new = self.new, {}
        coded = list(map(self.new.get, chunks))
        gaps = [i for i, x in enumerate(coded) if x is None]
        lacking = []
        for i in gaps:
            if (x := self.old.get(chunks[i])) is None:
                lacking.append(chunks[i])
            else:
                self.new[chunks[i]] = x
        self._learn(lacking)
        for i in gaps:
            coded[i] = self.new[chunks[i]]
        size = np.array(list(map(len, coded)), np.int64) // 4
        ids = np.frombuffer(b"".join(coded), "<u4")
        at = np.cumsum(size) - size
        ids = ids[ranges(at[back], size[back])] if len(back) else ids
        per_doc = np.bincount(doc, weights=size[back], minlength=n).astype(np.int64) if len(back) else np.zeros(n, np.int64)
        ends = np.cumsum(per_doc).tolist()
        return [ids[e - k : e] if p else self._ids(data[a:b].decode()) for e, k, p, a, b in zip(ends, per_doc.tolist(), plain.tolist(), off[:-1].tolist(), off[1:].tolist(), strict=True)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _narrow(ids: np.ndarray) -> bytes:
    """Ids for the exchange: in two bytes each where they fit."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.uint32)


# --- the operator ----------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write token files in ascending doc_id order.

    Returns the manifest, a row per file: shard, path, n_docs, n_tokens, n_bytes;
    files in order of shard hold all documents in order of doc_id.  Only doc_ids
    are read to find the bounds of the shards, and the exchange carries ids.  The
    number of shards grows with the input.  A doc_id (or null) whose rows fill
    several shards has as many equal bounds, and a checksum of the ids deals its
    rows to those.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    n = partitions_for(docs)
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    bounds = docs.agg(F.percentile_approx(known, [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = np.array(sorted(bounds), np.int64)

    def encode(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").cast(pa.int64())
                known = ids.fill_null(_NO_ID).to_numpy()
                out = [_narrow(np.append(x, np.uint32(end_id))) for x in enc.encode_column(part.column("text"))]
                shard = np.searchsorted(bounds, known, side="left")
                many = np.searchsorted(bounds, known, side="right") - shard
                for i in np.flatnonzero(many > 1).tolist():
                    shard[i] += zlib.crc32(out[i]) % int(many[i])
                shard = shard.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), ids, pa.array(out, pa.binary())], ["shard", "doc_id", "ids"])

    def write(batches):
        writer, made = None, []
        for batch in batches:
            for shard, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if writer is None or writer.shard != shard:
                    made += [writer.close()] if writer else []
                    writer = _Writer(folder, shard)
                writer.add(doc, _wide(ids))
        made += [writer.close()] if writer else []
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64()))], ["shard", "path", "n_docs", "n_tokens", "n_bytes"])

    coded = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    return written(dealt.mapInArrow(write, "shard int, path string, n_docs int, n_tokens long, n_bytes long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Read token files back: doc_id, start, n_tokens, ids_crc32, shard, n_levels-free ids digest.

    ``files`` is a manifest; its rows (one a file, never one a document) are
    added up on the driver to number the ids over all files.
    """
    spark = files.sparkSession
    listed = sorted(tuple(r) for r in files.select("shard", "path", "n_tokens").collect())
    base, plan = 0, []
    for shard, path, n in listed:
        plan.append((shard, path, base))
        base += n

    def read(batches):
        for batch in batches:
            for shard, path, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                f = TokenFile(path)
                rows = []
                for doc, first, ids in f.documents():
                    rows.append((doc, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard, first))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                f.close()
                yield _rows(rows)

    def _rows(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "shard_start"])

    todo = spark.createDataFrame(plan, "shard int, path string, base long").repartitionById(max(1, len(plan)), F.expr("shard"))
    return todo.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, shard_start long")
