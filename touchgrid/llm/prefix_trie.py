"""Trie of shared beginnings of conversations: a global sort of turn arrays, LCPs of neighbours, one sweep with a stack.

A conversation is a key: the digests of its turns (128 bits of SHA-256 of role
and text) side by side.  All keys are range-sorted over the cluster, those of
equal conversations by conv_id, so that many copies fill many parts.  Each part
is a file; the first key of the next and the last key of the one before are
joined to its name, and one pass with a stack of open nodes gives every node:
a node opens where the LCP with the key before is below its depth and closes
where the LCP with the key after is.  What opens and closes in one part is
whole.  The open nodes that reach over a border come out once a part, with sums
that add up because each part counts an opening, a closing leaf and its own rows
only, and are stitched by their prefix in order of parts.

Only digests, counts of words and ids move; texts leave in the first scan.  A
conversation's turns (16 bytes and a count each) are one row.

Nulls: null roles and texts are empty; rows with a null conv_id belong to no
conversation and are left out.  Turns go by ``turn`` with null first; turns of
one number tie and go by their digest; repeated rows are turns of their own.  A
conversation without turns is at the root alone.  An empty table has no nodes.
Texts of any length go whole.  Columns beside conv_id, turn, role and text are
left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import SharedFile, map_written, new_dir, open_shared, partitions_for, small_batches, written

_SIZE = 16  # bytes of a turn's digest
_PART_BYTES = 16 << 20
_SLICE = 20_000
_WORDS = r"[^\x20\x09-\x0D]+"


def turn_arrays(conversations: DataFrame, family: int = 1) -> DataFrame:
    """(base, conv_id, turns): the digests and counts of words of each conversation's turns in order, dealt by the first id of its ``family`` ids."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    conv = F.col("conv_id").cast("long")
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * _SIZE)
    rows = small_batches(conversations).select(
        (conv - conv % family).alias("base"), conv.alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(_WORDS)).alias("words")).alias("turn")
    )
    dealt = rows.where("conv_id is not null").repartition(partitions_for(conversations), "base")
    return dealt.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def with_shared_heads(arrays: DataFrame, length: Column, longest: int) -> DataFrame:
    """Each conversation with its first ``length`` turns (at most ``longest``) in place of those of the conversation ``base``."""
    heads = arrays.where("conv_id = base").select("base", F.slice("turns", 1, longest).alias("head"))
    none = F.array().cast(arrays.schema["turns"].dataType)
    head, own = F.coalesce("head", none), F.slice("turns", length + 1, F.greatest(F.size("turns") - length, F.lit(0)))
    return arrays.join(heads, "base", "left").select("conv_id", F.concat(F.slice(head, F.lit(1), length), own).alias("turns"))


def _sorted_parts(arrays: DataFrame, parts: int | None) -> tuple[DataFrame, int]:
    """(part, path, before, after): files of (key, conv_id, words), sorted by key and conv_id within and across files, with the keys beside them; and the number of parts."""
    sequences = written(arrays.select("conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("key"), F.col("turns.words").alias("words")), "sequences")
    n = parts or partitions_for(sequences, _PART_BYTES)
    folder = new_dir(arrays.sparkSession, "sorted")
    schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("words", pa.list_(pa.int32()))])

    def run(batches):
        file = writer = first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                file = SharedFile(folder, "part", ".parquet")
                writer = pq.ParquetWriter(file.stream, schema, compression="zstd")
                first = batch.column("key")[0].as_py()
            last = batch.column("key")[-1].as_py()
            writer.write_table(pa.Table.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [file.close()], "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})

    dealt = sequences.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    manifest = written(dealt.mapInArrow(run, "part int, path string, first binary, last binary"), "manifest")
    near = W.orderBy("part")  # a row a file
    return manifest.select("part", "path", F.lag("last").over(near).alias("before"), F.lead("first").over(near).alias("after")).repartition(n), n


def lcp(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys begin with together; -1, below the root, if there is no other key."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // _SIZE
    if a[: high * _SIZE] == b[: high * _SIZE]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * _SIZE] == b[: mid * _SIZE] else (low, mid - 1)
    return low


def _prefix_ids(key: bytes, depth: int) -> list[bytes]:
    """Names of the beginnings of 0 to ``depth`` turns."""
    running, out = hashlib.sha256(), []
    for d in range(depth + 1):
        if d:
            running.update(key[(d - 1) * _SIZE : d * _SIZE])
        out.append(running.copy().digest())
    return out


class _Node:
    __slots__ = ("opened", "name", "words", "n", "conv", "children", "childless", "leaves", "saved", "ends", "held")

    def __init__(self, opened: bool, name: bytes | None, words: int):
        self.opened, self.name, self.words = opened, name, words  # opened in this part; a name if known to reach over a border
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.childless = None, True
        self.ends, self.held = array("q"), []  # conversations that end here; rows of children that wait for this conv_id

    def ends_text(self) -> bytes:
        return ",".join(map(str, self.ends)).encode()


def sweep(rows: Iterator[tuple[bytes, int, list[int]]], before: bytes | None, after: bytes | None) -> Iterator[tuple]:
    """Nodes of one sorted part: (name, parent, conv_id, depth, parent_conv_id, n, children, leaves, saved, digest of ends, ends).

    Whole nodes have no name, but the digest; nodes that reach over a border
    have a name and their share of the sums and ends.  A parent is named where
    it reaches over a border, else its conv_id stands.
    """
    stack: list[_Node] = []

    def close(spans: bool) -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        above = stack[-1] if stack else None
        if node.childless and not spans:
            node.leaves = 1
        node.saved += node.n * node.words - node.words * node.opened
        if above:
            above.n, above.leaves, above.saved = above.n + node.n, above.leaves + node.leaves, above.saved + node.saved
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        for name, _, *row in node.held:
            row[2] = None if spans else node.conv
            yield (name, node.name if spans else None, *row)
        sums = node.n, node.children, node.leaves, node.saved
        if spans or not node.opened:
            yield (node.name, above and above.name, node.conv, depth, None, *sums, None, node.ends_text())
        else:
            row = (None, above and above.name, node.conv, depth, None, *sums, hashlib.sha256(node.ends_text()).hexdigest(), None)
            if above is None or not above.opened:
                yield row
            else:
                above.held.append(row)

    last = before
    for key, conv, words in rows:
        shared = lcp(last, key)
        if not stack and shared >= 0:
            for d, name in enumerate(_prefix_ids(key, shared)):
                if stack:
                    stack[-1].childless = False
                stack.append(_Node(False, name, words[d - 1] if d else 0))
        while len(stack) > shared + 1:
            yield from close(False)
        for d in range(len(stack), len(key) // _SIZE + 1):
            if stack:
                stack[-1].childless = False
                stack[-1].children += 1
            stack.append(_Node(True, None, words[d - 1] if d else 0))
        top = stack[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.ends.append(conv)
        last = key
    if not stack:
        return
    reach = lcp(last, after)
    while len(stack) > reach + 1:
        yield from close(False)
    for node, name in zip(stack, _prefix_ids(last, reach) if reach >= 0 else [], strict=False):
        node.name = name
    while stack:
        yield from close(True)


_SCHEMA = pa.schema([("part", pa.int32()), ("name", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("ends", pa.binary())])
_DDL = "part int, name binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends binary"
_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _swept(batches):
    for batch in batches:
        for part, path, before, after in zip(*(batch.column(c).to_pylist() for c in ("part", "path", "before", "after")), strict=True):
            with open_shared(path) as file:
                found = pq.ParquetFile(file).iter_batches(_SLICE)
                rows = (r for b in found for r in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), b.column("words").to_pylist(), strict=True))
                held = []
                for row in sweep(rows, before, after):
                    held.append((part, *row))
                    if len(held) >= _SLICE:
                        yield _batch(held)
                        held = []
                if held:
                    yield _batch(held)


def _stitched(batches):
    """One row for each run of rows of one name: sums, the smallest conv_id, and the digest of the ends in order."""
    name = sums = hasher = None

    def row():
        return (None, name, sums[0], sums[1], sums[2], None, *sums[3:], hasher.hexdigest(), None)

    for batch in batches:
        out = []
        for r in zip(*(batch.column(f.name).to_pylist() for f in _SCHEMA), strict=True):
            _, this, parent, conv, depth, _, *more, _, ends = r
            if this != name:
                if name is not None:
                    out.append(row())
                name, sums, hasher, any_ends = this, [parent, conv, depth, *more], hashlib.sha256(ends), bool(ends)
                continue
            sums[1] = min(sums[1], conv)
            sums[3:] = [a + b for a, b in zip(sums[3:], more, strict=True)]
            if ends:
                hasher.update((b"," if any_ends else b"") + ends)
                any_ends = True
        if out:
            yield _batch(out)
    if name is not None:
        yield _batch([row()])


def prefix_trie(arrays: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of conversations(conv_id, turns): ``_COLUMNS``.  conv_id is the smallest member and, with the depth, names the node."""
    files, n = _sorted_parts(arrays, parts)
    found = map_written(files, _swept, _DDL, "nodes")
    whole, shares = found.where("name is null"), found.where("name is not null")
    spanning = written(shares.repartition(n, "name").sortWithinPartitions("name", "part").mapInArrow(_stitched, _DDL), "stitched")
    above = spanning.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    # a border node's children wait in each part that has it, so its name alone would be a hot key
    places = shares.select("part", F.col("name").alias("parent")).join(above, "parent")
    settled = whole.where("parent is null").select(*_COLUMNS)
    waiting = whole.where("parent is not null").join(places, ["part", "parent"], "left").withColumn("parent_conv_id", F.col("above")).select(*_COLUMNS)
    tops = spanning.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above")).select(*_COLUMNS)
    return settled.unionByName(waiting).unionByName(tops)
