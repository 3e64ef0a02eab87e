"""SimHash near-dedup by segment-popcount embedding.

A fingerprint has 64 bits, each set where over half of the hashes of the
document's three-word shingles have it set.  The bits fall into 32 segments of
two; the vector of their bit counts embeds the fingerprint, and the Manhattan
distance of two vectors is at most the Hamming distance of the fingerprints.

Range join in that space for distance ``REACH``: the segments are dealt to
``GROUPS`` groups, and of two vectors within the reach at least GROUPS - REACH
groups are equal.  So each distinct fingerprint goes to one grid cell for every
choice of that many groups; within a cell the Manhattan bound filters and the
XOR verifies.  A cell is split in blocks of ``BLOCK`` members, and pairs of
blocks are compared apart, so no task holds a large cell.  A comparison gives
the edges of a star per connected set, never all pairs.  Components come from
alternating large-star and small-star steps on tables in the shared folder.

Nulls: a null text has no words and fingerprint zero, linked like any other; a
null doc_id stays null and never names a component while another id is there.
A bit that exactly half of the hashes set is 0.  Repeated rows each give a row.
Texts of any length are read whole, their bits counted in parts.  An empty table
gives no row.  Other columns, whatever their names, stay with their rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .flat import LOWER, NOT_SPACE, flat, ranges, slices, spaced, words
from .shared import written

SHINGLE = 3
REACH = 2
GROUPS = 5
BLOCK = 4096
_SEED = 42
_AT_ONCE = 1 << 16  # shingles whose bits are counted at once


# --- fingerprints ------------------------------------------------------------


def fingerprints(column: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a column."""
    buf, off = flat(column)
    buf = LOWER[buf]
    w = words(buf, off, NOT_SPACE)
    n_docs, n_words = len(off) - 1, np.diff(w.first)
    data, at, to = spaced(buf, w)  # a shingle is a slice of these bytes
    count = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    first = ranges(w.first[:-1], count)
    last = np.minimum(first + shingle, np.repeat(w.first[1:], count)) - 1
    doc = np.repeat(np.arange(n_docs), count)
    starts, ends = at[first].tolist(), to[last].tolist()
    bits = np.zeros((n_docs, 64), np.int64)
    digest = xxhash.xxh64_digest
    for lo in range(0, len(starts), _AT_ONCE):
        hi = lo + _AT_ONCE
        raw = np.frombuffer(b"".join([digest(data[a:b], _SEED) for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)]), np.uint8)
        part = doc[lo:hi]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        bits[part[cut]] += np.add.reduceat(np.unpackbits(raw.reshape(-1, 8), axis=1), cut, axis=0, dtype=np.int64)
    return np.packbits(2 * bits > count[:, None], axis=1).view(">u8").astype(np.uint64).ravel()


def fingerprint_table(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) of ``docs(doc_id, text)``; fp as a signed long."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(fingerprints(part.column("text"), shingle).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- the grid range join -------------------------------------------------------


def popcounts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, packed two bits each."""
    return fp - (fp >> np.uint64(1) & np.uint64(0x5555555555555555))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed count vectors."""
    low = np.uint64(0x5555555555555555)
    # a count 0, 1, 2 in unary is 00, 01, 11: then the distance is the Hamming distance
    unary = lambda x: (x & low) | (x >> np.uint64(1) & low) * np.uint64(3)
    return np.bitwise_count(unary(a) ^ unary(b))


def _masks(groups: int, reach: int) -> list[int]:
    """For each choice of equal groups, the bits of a packed vector that lie in them."""
    cut = [round(32 * i / groups) for i in range(groups + 1)]
    mask = [sum(3 << 2 * s for s in range(cut[i], cut[i + 1])) for i in range(groups)]
    return [sum(mask[g] for g in chosen) for chosen in combinations(range(groups), groups - reach)]


def _cells(prints: DataFrame, groups: int, reach: int) -> DataFrame:
    """(fp, cell) of distinct fingerprints, by DataFrame functions."""
    low = F.lit(0x5555555555555555)
    a, b = F.shiftrightunsigned("fp", 1).bitwiseAND(low), F.col("fp").bitwiseAND(low)
    counts = a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(groups, reach)]
    keys = [F.xxhash64(F.lit(i), counts.bitwiseAND(F.lit(m))) for i, m in enumerate(signed)]
    return prints.select("fp", F.explode(F.array(*keys)).alias("cell"))


def _close(a: np.ndarray, va: np.ndarray, b, vb, reach: int) -> np.ndarray:
    ok = manhattan(va, vb) <= reach
    ok[ok] = np.bitwise_count((a ^ b)[ok]) <= reach
    return ok


def _stars(left: np.ndarray, right: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Edges that connect what links between the two blocks (or within one, if they are the same) connect."""
    same = left is right
    fps = left if same else np.concatenate([left, right])
    side = np.zeros(len(fps), bool)
    side[len(left) :] = True
    counts, todo, edges = popcounts(fps), np.ones(len(fps), bool), []
    for i in range(len(fps)):
        if not todo[i]:
            continue
        todo[i] = False
        front = [i]
        while front:
            j = front.pop()
            near = np.flatnonzero(todo if same else todo & (side != side[j]))
            near = near[_close(fps[near], counts[near], fps[j], counts[j], reach)]
            todo[near] = False
            front += near.tolist()
            edges += [(int(fps[i]), int(fps[k])) for k in near.tolist()]
    return edges


def _small_cells(fp: np.ndarray, cell: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Links within cells of a few members, for many cells at once."""
    out, counts = [], popcounts(fp)
    for d in range(1, len(fp)):
        same = np.flatnonzero(cell[d:] == cell[:-d])
        if not len(same):
            break
        same = same[_close(fp[same], counts[same], fp[same + d], counts[same + d], reach)]
        out += zip(fp[same].tolist(), fp[same + d].tolist(), strict=True)
    return out


def _join_cells(dealt: DataFrame, reach: int) -> DataFrame:
    """Edges within (cell, i, j) groups of rows sorted by them."""

    def edges(left, right, i, j):
        return _stars(left, left if i == j else right, reach)

    def run(batches):
        key, sides = None, ([], [])
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def whole():
            if key is None:
                return []
            a, b = (np.array(s, np.int64).view(np.uint64) for s in sides)
            return edges(a, b, key[1], key[2])

        for batch in batches:
            found: list[tuple[int, int]] = []
            c, i, j, s = (batch.column(n).to_numpy() for n in ("cell", "i", "j", "side"))
            fp = batch.column("fp").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))) if len(c) else np.zeros(0, np.int64)
            ends = np.append(cut[1:], len(c))
            # groups that lie whole within the batch and are small go together; the first, the last and the large ones alone
            inner = np.zeros(len(cut), bool)
            inner[1:-1] = (ends - cut)[1:-1] <= 64
            for g in np.flatnonzero(~inner).tolist():
                a, b = int(cut[g]), int(ends[g])
                k = (int(c[a]), int(i[a]), int(j[a]))
                if k != key:
                    found += whole()
                    key, sides = k, ([], [])
                sides[0].extend(fp[a:b][s[a:b] == 0].tolist())
                sides[1].extend(fp[a:b][s[a:b] == 1].tolist())
            rows = ranges(cut[inner], (ends - cut)[inner])
            if len(rows):
                plain = rows[(i[rows] == 0) & (j[rows] == 0)]
                found += _small_cells(fp[plain].view(np.uint64), c[plain], reach)
                mixed = rows[(i[rows] != 0) | (j[rows] != 0)]
                if len(mixed):
                    at = np.flatnonzero(np.concatenate(([True], (c[mixed][1:] != c[mixed][:-1]) | (i[mixed][1:] != i[mixed][:-1]) | (j[mixed][1:] != j[mixed][:-1]))))
                    for group in np.split(mixed, at[1:]):
                        u = fp[group].view(np.uint64)
                        found += edges(u[s[group] == 0], u[s[group] == 1], int(i[group[0]]), int(j[group[0]]))
            yield _edges(found)
        yield _edges(whole())
        held.clear()

    def _edges(found):
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def link_fingerprints(prints: DataFrame, groups: int = GROUPS, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """Edges (a, b), a < b, over distinct ``prints(fp)`` whose components are those of all links."""
    cells = _cells(prints, groups, reach)
    large = cells.groupBy("cell").count().filter(F.col("count") > block).select("cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = cells.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")
    dealt = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return _join_cells(dealt, reach).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# --- components -----------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component of ``edges(a, b)``, by large-star and small-star steps.

    Minima are combined before the exchange, and a node with many edges meets
    its minimum by a join that adaptive execution may split.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        small = small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b"))
        edges = written(small.filter("a <> b").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, groups: int = GROUPS, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) of each of ``docs(doc_id, text)``."""
    table = written(fingerprint_table(docs, shingle), "fingerprints")
    prints = written(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(link_fingerprints(prints.select("fp"), groups, reach, block)).withColumnRenamed("node", "fp")
    linked = prints.join(roots, "fp")
    lowest = linked.groupBy("root").agg(F.min("first").alias("lowest"))
    lowest = linked.join(lowest, "root").select("fp", "lowest")
    ids = prints.join(lowest, "fp", "left").select("fp", F.coalesce("lowest", "first").alias("component_id"))
    return table.join(ids, "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id (of rows equal in it, the least text hash)."""
    found = written(near_duplicates(docs.select("doc_id", "text"), shingle), "components")
    alone = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_id"), alone.alias("_fp")).agg(F.min("text_hash").alias("_hash"), F.count("*").alias("_n"))
    kept = written(kept, "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(docs["text"]) == kept["_hash"])
    out = docs.join(kept, same, "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if kept.filter("_n > 1").take(1) else out
