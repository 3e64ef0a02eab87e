"""Near copies by an exact join of documents on their word shingles.

A document is the set of its runs of ``SHINGLE`` words, in lower case (a shorter
one is a single run of all its words).  Two documents match if the Jaccard
similarity of their sets is at least ``SIMILARITY``; components of matches leave
one document.  Every match is found: the screen is that of ``lines`` (rarity,
prefixes, exact filters), with a document in place of a line, and what passes is
verified on the whole sets.  Members of a group that are connected already are
not compared again, and a group gives stars, never all pairs.

Nulls: documents without words, and null texts, are equal.  A null doc_id comes
after all others.  Of rows equal in doc_id the one of least text hash stays, of
rows equal in both one.  An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import LOWER, NOT_SPACE, flat, grams, mix, ranges, span_hashes, words
from .lines import _CLASS, _EDGE, COUNTERS, Seeds, _filters, _maps, fetch_sets, least_overlap, new_seeds, ordered_sets, rarity, screen
from .shared import input_bytes, written
from .simhash import components

SHINGLE = 5
SIMILARITY = 0.8
_FEW_GROUPS = 1_000_000
_BLOCK = 2048
_KEYS = 1 << 21  # shingles that are compared, or held, at once
_BUCKETS = 256
_MOST_COUNTERS = 1 << 25
_COUNTED_BYTES = 32  # of text, a counter of the rarity table
_LAST = (1 << 63) - 1  # for a null doc_id


def shingles(column: pa.Array, seeds: Seeds, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, document) of the shingles of each text, by document; every document has one at least."""
    buf, off = flat(column)
    buf = LOWER[buf]
    w = words(buf, off, NOT_SPACE, seeds[0])
    n = np.diff(w.first)
    count = np.maximum(n - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), np.maximum(count, 1))
    one = count[doc] == 0
    at, short = ranges(w.first[:-1], count), np.flatnonzero(count == 0)
    out = []
    for hashes in (w.hash, span_hashes(buf, w.start, w.end, seeds[1])):
        rest = np.zeros(len(short), np.uint64)
        for i in range(k):
            rest *= np.uint64(0xC2B2AE3D27D4EB4F)
            has = n[short] > i
            rest[has] += hashes[w.first[short[has]] + i]
        h = np.empty(len(doc), np.uint64)
        h[~one], h[one] = grams(hashes, k)[at], mix(rest)
        out.append(h)
    return *out, doc


def document_sets(column: pa.Array, codes: np.ndarray, seeds: Seeds):
    """The shingle set of each text, as line 0 of its document."""
    h, second, doc = shingles(column, seeds)
    yield from ordered_sets(h, second, doc, np.zeros(len(doc), np.int64), codes)


def document_keys(seeds: Seeds):
    """A reader of the sets of whole texts: (document, 0, sorted shingle hashes)."""

    def read(column, wanted):
        h, _, doc = shingles(column, seeds)
        cut = np.searchsorted(doc, np.arange(len(column) + 1))
        for d in range(len(column)):
            yield d, 0, np.unique(h[cut[d] : cut[d + 1]]).tobytes()

    return read


def _matching(key, first, n, i, j, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) whose sets match."""
    ok = np.zeros(len(i), bool)
    total = np.cumsum(n[i] + n[j])
    lo = 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _KEYS)))
        hi = min(hi, lo + 10_000)
        a, b = i[lo:hi], j[lo:hi]
        pair = np.arange(len(a), dtype=np.uint64) << np.uint64(32)
        both = np.concatenate([key[ranges(first[x], n[x])] | np.repeat(pair, n[x]) for x in (a, b)])
        both.sort()
        of = (both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64)
        ok[lo:hi] = np.bincount(of, minlength=len(a)) >= least_overlap(n[a], n[b], s)
        lo = hi
    return i[ok], j[ok]


def _sketches(key, n) -> np.ndarray:
    """How many shingles of each set fall in each bucket: the counts of two sets differ, in sum, by no more than the sets."""
    of = np.repeat(np.arange(len(n)) * _BUCKETS, n) + (mix(key) % np.uint64(_BUCKETS)).astype(np.int64)
    return np.minimum(np.bincount(of, minlength=len(n) * _BUCKETS), 255).astype(np.int16).reshape(-1, _BUCKETS)


def _alike(sketch, n, i, j, s: float) -> np.ndarray:
    """Which of the pairs (i, j) may match by their sketches; unlike sets of up to some thousand shingles do not, where parity bits only tell hundreds."""
    ok = np.empty(len(i), bool)
    for lo in range(0, len(i), 2048):
        a, b = i[lo : lo + 2048], j[lo : lo + 2048]
        ok[lo : lo + 2048] = np.abs(sketch[a] - sketch[b]).sum(1) <= n[a] + n[b] - 2 * least_overlap(n[a], n[b], s)
    return ok


def _merge(low: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``low`` (the least member that each is connected to) with more links."""
    i, j = low[i], low[j]
    while len(i):
        before, least = low.copy(), np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(low, before):
            break
    return low


def _linked(key, n, group, side, across, s: float) -> np.ndarray:
    """Per member of whole groups (in order) the least one it is connected to."""
    first = np.cumsum(n) - n
    maps = _maps(mix(key), first)
    passes = _filters(n, np.zeros(len(n), np.int64), np.ascontiguousarray(maps[:, 0]), np.ascontiguousarray(maps[:, 1]), s)
    sketch = _sketches(key, n)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    left = np.repeat(size, size) - (np.arange(len(n)) - np.repeat(start, size))
    low, i = np.arange(len(n)), np.arange(len(n))
    for d in range(1, int(size.max(initial=1))):
        i = i[left[i] > d]
        may = i[(low[i] != low[i + d]) & (~across[i] | (side[i] != side[i + d]))]
        if len(may):
            hit = passes(may, may + d)
            hit = hit[_alike(sketch, n, hit, hit + d, s)]
            low = _merge(low, *_matching(key, first, n, hit, hit + d, s))
    return low


def links(sets: DataFrame, groups: DataFrame, s: float = SIMILARITY, block: int = _BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all matches among ``sets``; a group of more than ``block`` is dealt to pairs of blocks."""
    many = written(groups.groupBy("root").count().filter(F.col("count") > block).select("root", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large-groups")
    few = many.count() <= _FEW_GROUPS  # a broadcast of 12 MB at most, else a join
    rows = sets.join(F.broadcast(many) if few else many, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("s1"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "s1", "data")

    def run(batches):
        held, size, last = [], 0, None

        def done():
            root, i, j, side, s1 = (np.concatenate(x) for x in zip(*[h[:5] for h in held], strict=True))
            blobs = [d for h in held for d in h[5]]
            group = np.cumsum(np.concatenate(([True], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            n = np.array([len(d) for d in blobs], np.int64) // 8
            key = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)[1].astype(np.uint64)  # shingles as numbers
            low = _linked(key, n, group, side, i != j, s)
            at = np.flatnonzero(low != np.arange(len(low)))
            return pa.RecordBatch.from_arrays([pa.array(s1[low[at]]), pa.array(s1[at])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j", "side", "s1")]
            blobs = batch.column("data").to_pylist()
            root, i, j = cols[:3]
            new = np.concatenate(([last is None or (root[0], i[0], j[0]) != last], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            at = int(np.flatnonzero(new)[-1]) if new.any() else 0
            here = sum(map(len, blobs)) // 8
            if size + here >= _KEYS and new.any() and (held or at):  # whole groups up to here
                if at:
                    held.append([x[:at] for x in cols] + [blobs[:at]])
                yield done()
                held, size = [[x[at:] for x in cols] + [blobs[at:]]], sum(map(len, blobs[at:])) // 8
            else:
                held.append([*cols, blobs])
                size += here
            last = (root[-1], i[-1], j[-1])
        if held:
            yield done()

    return rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "a long, b long")


def counters_for(size: int) -> int:
    """Counters of the rarity table for ``size`` bytes of text: a table that is full tells common shingles from rare ones no more, and groups grow."""
    return min(max(COUNTERS, 1 << max(0, size // _COUNTED_BYTES - 1).bit_length()), _MOST_COUNTERS)


def kept(docs: DataFrame, s: float = SIMILARITY, counters: int | None = None) -> DataFrame:
    """(doc, text_hash) of the one document that each component of ``docs(doc_id, text, text_hash)`` keeps."""
    seeds, counters = new_seeds(), counters or counters_for(input_bytes(docs))
    codes = docs.sparkSession.sparkContext.broadcast(rarity(docs, seeds, counters, lambda column, seeds: shingles(column, seeds)[0]))
    rows = screen(docs, codes, seeds, s, document_sets)
    classes = rows.filter(F.col("kind") == _CLASS).select("s1", "s2", "doc", "text_hash", "line")
    groups = components(rows.filter(F.col("kind") == _EDGE).select(F.col("s1").alias("a"), F.col("s2").alias("b")))
    possible = written(classes.join(groups.withColumnRenamed("node", "s1"), "s1"), "possible")
    sets = fetch_sets(docs, possible.dropDuplicates(["s1"]), document_keys(seeds)).dropDuplicates(["s1"]).select("root", "s1", "data")
    roots = components(links(sets, possible, s)).withColumnRenamed("node", "s1")
    best = classes.join(roots, "s1", "left").groupBy(F.coalesce("root", "s1").alias("root")).agg(F.min(F.struct("doc", "text_hash")).alias("p"))
    return written(best.select("p.doc", "p.text_hash"), "kept")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: the smallest doc_id (of rows equal in it, the least text hash)."""
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST))
    keyed = docs.select(key.alias("doc_id"), docs["text"].cast("string").alias("text"), F.xxhash64(docs["text"]).alias("text_hash"))
    stay = kept(keyed).select("doc", F.col("text_hash").alias("_hash"))
    out = docs.join(stay, (key == stay["doc"]) & (F.xxhash64(docs["text"]) == stay["_hash"]), "left_semi")
    twice = keyed.groupBy("doc_id", "text_hash").count().filter("count > 1").take(1)
    return out.dropDuplicates(["doc_id", "text"]) if twice else out
