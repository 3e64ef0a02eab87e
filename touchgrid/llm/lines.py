"""Line dedup by an exact set-similarity join.

A line is a set of words.  Two lines match if the Jaccard similarity of their
sets is at least ``SIMILARITY``; of matching lines the later ones (by doc_id,
then line number) go.  The matches are judged on the input: a line goes if any
earlier line matches it.

1. Rarity.  Every task counts words in one hashed table of fixed size; the sum
   orders words.  Any fixed order gives right results, rare words first make
   few candidates, and a word counted once in all cannot be shared.
2. Prefixes.  Of n words in order of rarity a match must share one of the first
   n - ceil(s n) + 1.  A task sends each distinct set once per prefix word, with
   its size and 128 parity bits of its words, and each class of equal sets once
   with its first line; equal lines after that are known to go at once.  Sets
   are equal if 128 bits of two hashes, seeded anew in each run, are.
3. Filters.  Sets that meet at a word pass by size, by position (how much can
   follow) and by parity: that differs in at most as many bits as the sets in
   words.  Stars connect what passes, never all pairs, and give groups.
4. Verification.  The words of those sets are fetched, the sets of a group meet
   (in pairs of blocks if they are many), and their exact Jaccard is computed on
   the words themselves.
   A set gets back the first line among its matches and their number, so a
   group of n like lines yields n rows.

Nulls: a null text has no lines; a null doc_id sorts before all others.  Lines
without words match nothing and stay.  Lines at the same place of rows equal in
doc_id tie and do not remove each other; rows equal in doc_id and text get
equal results.  An empty text is one empty line.  A line or a text of any length
is one set or a slice of its own and read whole.  An empty table gives no row.
Other columns, whatever their names, travel in a struct and come back as they were.
"""

from __future__ import annotations

import hashlib
import secrets
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .flat import NOT_SPACE, Words, flat, mix, ranges, slices, spaced, span_hashes, words
from .shared import carried, map_written, partitions_for, restored, written
from .simhash import components

SIMILARITY = 0.8
COUNTERS = 1 << 22
_CHUNK = 1 << 16
_PACK = "lz4_raw"  # a task has few words of a large table
_UNIT = 1 << 20  # entries that a task combines at once
_LINES = 1 << 14  # lines that are sorted at once
_BLOCK = 2048
_SMALL = 1024  # sets at one word up to which groups are compared side by side
_NO_DOC = -(1 << 63)


def least_overlap(a, b, s: float):
    """Words that sets of sizes a and b share at least if they match."""
    return np.ceil(s / (1 + s) * (a + b) - 1e-9).astype(np.int64)


def prefix_length(n: np.ndarray, s: float) -> np.ndarray:
    return n - np.ceil(s * n - 1e-9).astype(np.int64) + 1


# --- 1. rarity -----------------------------------------------------------------------


Seeds = tuple[int, int]


def new_seeds() -> Seeds:
    """Seeds of the two word hashes of a run; the results do not depend on them."""
    return secrets.randbits(62), secrets.randbits(62)


def _word_hashes(column: pa.Array, seeds: Seeds) -> np.ndarray:
    return words(*flat(column), NOT_SPACE, seeds[0]).hash


def rarity(docs: DataFrame, seeds: Seeds, counters: int = COUNTERS, hashes=_word_hashes) -> np.ndarray:
    """A code per hashed word (or what else ``hashes`` gives of a column): its count up to 127, then the logarithm; fixed size."""

    def count(batches):
        table = np.zeros(counters, np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                np.add.at(table, (hashes(part.column("text"), seeds) % np.uint64(counters)).astype(np.int64), 1)
        rows = ((i, np.minimum(p, 0xFFFF).astype("<u2")) for i, p in enumerate(table.reshape(-1, _CHUNK)) if p.any())
        while some := [(i, pa.compress(p.tobytes(), _PACK, asbytes=True)) for i, p in islice(rows, 64)]:
            yield _blobs(some)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("chunk").to_pylist(), batch.column("data").to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(pa.decompress(data, 2 * _CHUNK, _PACK, asbytes=True), "<u2").astype(np.uint32)
        out = []
        for i, x in sums.items():
            code = np.where(x < 128, x, np.minimum(255, 128 + 6 * np.log2(np.maximum(x, 128) / 128)))
            out.append((i, code.astype(np.uint8).tobytes()))
        yield _blobs(out)

    def _blobs(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "data"])

    schema = "chunk int, data binary"
    parts = docs.select("text").mapInArrow(count, schema).repartitionById(counters // _CHUNK, F.col("chunk")).mapInArrow(add, schema).collect()
    out = np.zeros(counters, np.uint8)
    for r in parts:
        out[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["data"], np.uint8)
    return out


# --- 2. prefixes -----------------------------------------------------------------------


def _maps(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    """128 parity bits of each set, a word flips one: two sets differ in at most as many bits as in words."""
    if not len(start):
        return np.zeros((0, 2), np.uint64)
    one = np.uint64(1)
    bit = one << (h & np.uint64(63))
    side = (h >> np.uint64(12) & one).astype(bool)
    return np.stack([np.bitwise_xor.reduceat(np.where(side, bit, 0), start), np.bitwise_xor.reduceat(np.where(side, 0, bit), start)], 1)


class Sets:
    """Lines as sets of word hashes in order of rarity: line i has ``key[first[i]:first[i+1]]``; ``second``: the other hash of each word."""

    __slots__ = ("code", "doc", "first", "key", "line", "maps", "n", "s1", "s2")

    def __init__(self, key, second, code, first, doc, line):
        self.key, self.code, self.first, self.doc, self.line = key, code, first, doc, line
        self.n = np.diff(first)
        start = first[:-1]
        fold = lambda x: np.add.reduceat(x, start) if len(start) else x[:0]
        h = mix(key)
        self.s1, self.s2 = fold(h), fold(mix(second))
        self.maps = _maps(h, start)


def line_sets(column: pa.Array, codes: np.ndarray, seeds: Seeds):
    """The sets of the lines of each text that have words, in pieces."""
    buf, off = flat(column)
    w = words(buf, off, NOT_SPACE, seeds[0])
    yield from ordered_sets(w.hash, span_hashes(buf, w.start, w.end, seeds[1]), w.doc, line_numbers(buf, off, w), codes)


def line_numbers(buf: np.ndarray, off: np.ndarray, w: Words) -> np.ndarray:
    """The line of its document that each word is in."""
    breaks = np.flatnonzero(buf == 0x0A)
    seen = np.searchsorted(breaks, off[:-1])  # line ends before each document
    return np.searchsorted(breaks, w.start) - seen[w.doc]


def ordered_sets(h: np.ndarray, second: np.ndarray, doc_of: np.ndarray, line_of: np.ndarray, codes: np.ndarray):
    """Sets of hashed words that are sorted by document and line, in pieces."""
    if not len(h):
        return
    new = np.concatenate(([True], (doc_of[1:] != doc_of[:-1]) | (line_of[1:] != line_of[:-1])))
    number = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    code = codes[(h % np.uint64(len(codes))).astype(np.int64)]
    rank = code.astype(np.uint64) << np.uint64(42) | h >> np.uint64(22)
    for lo in range(0, len(at), _LINES):
        hi = min(lo + _LINES, len(at))
        a, b = at[lo], at[hi] if hi < len(at) else len(h)
        key = (number[a:b] - lo).astype(np.uint64) << np.uint64(50) | rank[a:b]
        order = np.argsort(key)
        key, word = key[order], h[a:b][order]
        same = key[1:] == key[:-1]
        if (word[1:] != word[:-1])[same].any():  # the rest of the hash decides
            order = np.lexsort((h[a:b], (number[a:b] - lo).astype(np.uint64) << np.uint64(50) | rank[a:b]))
            key, word = ((number[a:b] - lo).astype(np.uint64) << np.uint64(50) | rank[a:b])[order], h[a:b][order]
            same = key[1:] == key[:-1]
        once = np.concatenate(([True], ~same | (word[1:] != word[:-1])))
        order = order[once]
        size = np.bincount((key[once] >> np.uint64(50)).astype(np.int64), minlength=hi - lo)
        yield Sets(word[once], second[a:b][order], code[a:b][order], np.concatenate(([0], np.cumsum(size))), doc_of[at[lo:hi]], line_of[at[lo:hi]])


def _prefix(sets: Sets, s: float) -> tuple[np.ndarray, np.ndarray]:
    """(set, position) of the prefix words that other sets may have."""
    length = prefix_length(sets.n, s)
    at = ranges(sets.first[:-1], length)
    of = np.repeat(np.arange(len(length)), length)
    shared = sets.code[at] > 1
    return of[shared], (at - sets.first[of])[shared]


_ENTRY = np.dtype([("word", "<u8"), ("s1", "<u8"), ("m0", "<u8"), ("m1", "<u8"), ("n", "<u4"), ("pos", "<u2")])
_FIRST = np.dtype([("s1", "<u8"), ("s2", "<u8"), ("doc", "<i8"), ("hash", "<i8"), ("line", "<i4")])
_ROW = "kind int, s1 long, s2 long, doc long, text_hash long, line int"
_EDGE, _GONE, _CLASS = 0, 1, 2


def _rows(kind: int, s1=None, s2=None, doc=None, text_hash=None, line=None) -> pa.RecordBatch:
    n = len(next(x for x in (s1, doc) if x is not None))
    fill = lambda x, t: pa.nulls(n, t) if x is None else pa.array(np.ascontiguousarray(x).view(np.int64) if t == pa.int64() else x.astype(np.int32), t)
    i8 = pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), fill(s1, i8), fill(s2, i8), fill(doc, i8), fill(text_hash, i8), fill(line, pa.int32())], ["kind", "s1", "s2", "doc", "text_hash", "line"])


def _sorted(x: np.ndarray, *by: str) -> np.ndarray:
    return x[np.lexsort([x[b] for b in reversed(by)])]


def _earliest(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the lines at the first place of each class, once each; the other lines)."""
    x = _sorted(first, "s1", "s2", "doc", "line", "hash")
    if not len(x):
        return x, x
    head = np.concatenate(([True], (x["s1"][1:] != x["s1"][:-1]) | (x["s2"][1:] != x["s2"][:-1])))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(x)), 0))
    tied = (x["doc"] == x["doc"][lead]) & (x["line"] == x["line"][lead])
    again = np.concatenate(([False], ~head[1:] & (x["hash"][1:] == x["hash"][:-1])))
    return x[tied & ~again], x[~tied]


def _filters(n, pos, m0, m1, s: float):
    """A function that gives those of the pairs (i, j) that pass by size, parity and position; cheap tests first."""
    slack = (1 - s) / (1 + s)

    def passes(i, j):
        total = n[i] + n[j]
        ok = np.minimum(n[i], n[j]) * (1 + s) >= total * s - 1e-6
        i, j, total = i[ok], j[ok], total[ok]
        far = np.bitwise_count(m0[i] ^ m0[j]).astype(np.int64) + np.bitwise_count(m1[i] ^ m1[j])
        ok = far <= total * slack + 1e-6
        i, j = i[ok], j[ok]
        return i[np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least_overlap(n[i], n[j], s)]

    return passes


def _connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each of n members is connected to."""
    low = np.arange(n)
    while len(i):
        least = np.minimum(low[i], low[j])
        before = low.copy()
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        low = low[low]
        if np.array_equal(low, before):
            break
    return low


def _candidates(x: np.ndarray, s: float) -> np.ndarray:
    """(n, 2) s1 of sets of one bucket: stars that connect all pairs that pass the filters."""
    x = _sorted(x, "word", "n", "s1")
    x = x[np.concatenate(([True], (x["word"][1:] != x["word"][:-1]) | (x["s1"][1:] != x["s1"][:-1]) | (x["n"][1:] != x["n"][:-1])))] if len(x) else x
    word, n, pos = x["word"], x["n"].astype(np.int64), x["pos"].astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(x) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(x)))
    m0, m1 = np.ascontiguousarray(x["m0"]), np.ascontiguousarray(x["m1"])
    passes = _filters(n, pos, m0, m1, s)
    left = np.repeat(size, size) - (np.arange(len(x)) - np.repeat(start, size))  # members from this one on
    i, pairs = np.flatnonzero(np.repeat(size <= _SMALL, size)), []
    for d in range(1, _SMALL):
        i = i[left[i] > d]
        i = i[n[i + d] * s <= n[i] + 1e-6]  # n ascends within a group: once too large, always
        if not len(i):
            break
        hit = passes(i, i + d)
        pairs.append(np.stack([hit, hit + d]))
    both = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.int64)
    low = _connected(len(x), both[0], both[1])
    for a, k in zip(start[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        todo = np.ones(k, bool)
        for root in range(k):  # a search from each member that is not reached yet
            if not todo[root]:
                continue
            todo[root], front = False, [root]
            while front:
                c = a + front.pop()
                lo, hi = np.searchsorted(n[a : a + k], (n[c] * s - 1e-6, n[c] / s + 1e-6))
                near = a + lo + np.flatnonzero(todo[lo:hi])
                near = passes(near, np.full(len(near), c))
                todo[near - a] = False
                low[near] = a + root
                front += (near - a).tolist()
    at = np.flatnonzero(low != np.arange(len(x)))
    return np.unique(np.stack([x["s1"][low[at]], x["s1"][at]], 1), axis=0)


def screen(docs: DataFrame, codes, seeds: Seeds, s: float = SIMILARITY, make=line_sets) -> DataFrame:
    """Rows of three kinds: edges between sets that may match, lines that go as repeats of a set, and the lines at the first place of each set.

    ``make`` gives the sets of a column of texts.
    """
    n_parts = partitions_for(docs)
    buckets = 2 * n_parts

    def send(entries: list, firsts: list):
        x = np.concatenate(entries)
        order = np.lexsort((x["s1"], x["word"]))
        x = x[order]
        x = x[np.concatenate(([True], (x["word"][1:] != x["word"][:-1]) | (x["s1"][1:] != x["s1"][:-1])))] if len(x) else x
        first, gone = _earliest(np.concatenate(firsts))
        out = []
        for kind, y, by in ((0, x, "word"), (1, first, "s1")):
            bucket = (mix(y[by]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out += [(2 * b + kind, y[order[cut[b] : cut[b + 1]]].tobytes()) for b in range(buckets) if cut[b + 1] > cut[b]]
        if len(gone):
            out.append((-1 - int(gone["doc"][0]) % n_parts, gone.tobytes()))
        for at in range(0, len(out), 256):
            part = out[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.binary())], ["part", "data"])

    def collect(batches):
        entries, firsts, n = [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                ids, hashes = part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy()
                for sets in make(part.column("text"), codes.value, seeds):
                    first = np.empty(len(sets.n), _FIRST)
                    first["s1"], first["s2"], first["line"] = sets.s1, sets.s2, sets.line
                    first["doc"], first["hash"] = ids[sets.doc], hashes[sets.doc]
                    of, pos = _prefix(sets, s)
                    entry = np.empty(len(of), _ENTRY)
                    entry["word"], entry["s1"] = sets.key[sets.first[of] + pos], sets.s1[of]
                    entry["m0"], entry["m1"] = sets.maps[of, 0], sets.maps[of, 1]
                    entry["n"], entry["pos"] = sets.n[of], np.minimum(pos, 0xFFFF)
                    entries.append(entry), firsts.append(first)
                    n += len(of) + len(first)
                if n >= _UNIT:
                    yield from send(entries, firsts)
                    entries, firsts, n = [], [], 0
        if firsts:
            yield from send(entries, firsts)

    def meet(batches):
        part, held = None, []

        def done():
            if part is None or not held:
                return
            if part % 2 == 0:
                found = _candidates(np.frombuffer(b"".join(held), _ENTRY), s)
                if len(found):
                    yield _rows(_EDGE, s1=found[:, 0], s2=found[:, 1])
            else:
                first, gone = _earliest(np.frombuffer(b"".join(held), _FIRST))
                yield _lines(_CLASS, first)
                if len(gone):
                    yield _lines(_GONE, gone)

        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if p < 0:
                    yield _lines(_GONE, np.frombuffer(data, _FIRST))
                    continue
                if p != part:
                    yield from done()
                    part, held = p, []
                held.append(data)
        yield from done()

    def _lines(kind, x):
        return _rows(kind, x["s1"], x["s2"], x["doc"], x["hash"], x["line"])

    sent = docs.select("doc_id", "text", "text_hash").mapInArrow(collect, "part int, data binary")
    dealt = sent.repartitionById(n_parts, F.pmod(F.expr("cast(if(part < 0, part, part div 2) as int)"), F.lit(n_parts))).sortWithinPartitions("part")
    return map_written(dealt, meet, _ROW, "lines")


# --- 4. verification ----------------------------------------------------------------------


def _verify_pairs(key, first, n, place, i, j, s, best, degree):
    """Exact overlap of the pairs (i, j); keeps the first place and the count of matches per member."""
    for lo in range(0, len(i), 10_000):
        a, b = i[lo : lo + 10_000], j[lo : lo + 10_000]
        pair = np.arange(len(a), dtype=np.uint64) << np.uint64(50)
        both = np.concatenate([key[ranges(first[x], n[x])] | np.repeat(pair, n[x]) for x in (a, b)])
        both.sort()
        of = (both[1:][both[1:] == both[:-1]] >> np.uint64(50)).astype(np.int64)
        ok = np.bincount(of, minlength=len(a)) >= least_overlap(n[a], n[b], s)
        a, b = a[ok], b[ok]
        np.minimum.at(best, a, place[b])
        np.minimum.at(best, b, place[a])
        np.add.at(degree, a, 1)
        np.add.at(degree, b, 1)


def _verify(key, n, group, side, across, place, s: float) -> tuple[np.ndarray, np.ndarray]:
    """Per member of whole groups: the least place of its matches (or none), and their count.

    A group that is ``across`` two blocks compares members of different sides only.
    """
    first = np.cumsum(n) - n
    maps = _maps(mix(key), first)
    passes = _filters(n, np.zeros(len(n), np.int64), np.ascontiguousarray(maps[:, 0]), np.ascontiguousarray(maps[:, 1]), s)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    best, degree = np.full(len(n), np.iinfo(np.int64).max), np.zeros(len(n), np.int64)
    left = np.repeat(size, size) - (np.arange(len(n)) - np.repeat(start, size))
    i = np.arange(len(n))
    for d in range(1, int(size.max(initial=1))):
        i = i[left[i] > d]
        if not len(i):
            break
        may = i[~across[i] | (side[i] != side[i + d])]
        hit = passes(may, may + d)
        _verify_pairs(key, first, n, place, hit, hit + d, s, best, degree)
    return best, degree


_SET = "root long, s1 long, s2 long, doc long, line int, data binary"


def matches(sets: DataFrame, s: float = SIMILARITY, block: int = _BLOCK) -> DataFrame:
    """(s1, s2, first_doc, first_line, n_links): of each of ``sets`` with matches, their first line and their number.

    The sets of a connected group meet; a group of more than ``block`` is dealt to pairs of blocks.
    """
    many = sets.groupBy("root").count().filter(F.col("count") > block).select("root", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = sets.join(many, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "s1", "s2", "doc", "line", "data")

    def run(batches):
        held, n, last = [], 0, None

        def done():
            cols = [np.concatenate(x) for x in zip(*[h[:8] for h in held], strict=True)]
            blobs = [d for h in held for d in h[8]]
            root, i, j, side, s1, s2, doc, line = cols
            group = np.cumsum(np.concatenate(([True], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
            distinct, place = np.unique(np.stack([doc, line], 1), axis=0, return_inverse=True)  # places as numbers, in order
            number: dict[bytes, int] = {}
            sets = [[number.setdefault(x, len(number)) for x in d.split(b" ")] for d in blobs]
            size = np.array(list(map(len, sets)), np.int64)
            best, degree = _verify(np.fromiter(chain.from_iterable(sets), np.uint64, int(size.sum())), size, group, side, i != j, place.ravel(), s)
            hit = best < np.iinfo(np.int64).max
            near = distinct[best[hit]]
            return pa.RecordBatch.from_arrays([pa.array(s1[hit]), pa.array(s2[hit]), pa.array(near[:, 0]), pa.array(near[:, 1]), pa.array(degree[hit])], ["s1", "s2", "first_doc", "first_line", "n_links"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy().astype(np.int64) for c in ("root", "i", "j", "side", "s1", "s2", "doc", "line")]
            blobs = batch.column("data").to_pylist()
            root, i, j = cols[:3]
            new = np.concatenate(([last is None or (root[0], i[0], j[0]) != last], (root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
            at = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if n + at >= 5_000 and new.any() and (held or at):  # whole groups up to here
                if at:
                    held.append([x[:at] for x in cols] + [blobs[:at]])
                yield done()
                held, n = [[x[at:] for x in cols] + [blobs[at:]]], len(root) - at
            else:
                held.append([*cols, blobs])
                n += len(root)
            last = (root[-1], i[-1], j[-1])
        if held:
            yield done()

    found = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(run, "s1 long, s2 long, first_doc long, first_line long, n_links long")
    found = found.groupBy("s1", "s2").agg(F.min(F.struct("first_doc", "first_line")).alias("p"), F.sum("n_links").alias("n_links"))
    return found.select("s1", "s2", F.col("p.first_doc").alias("first_doc"), F.col("p.first_line").alias("first_line"), "n_links")


def line_words(column: pa.Array, wanted: list[list[int]]):
    """(document, line, words) of the ``wanted`` line numbers of each text: each word once, a space between."""
    buf, off = flat(column)
    w = words(buf, off, NOT_SPACE)
    pair = np.sort(np.array([d << 32 | x for d, xs in enumerate(wanted) for x in xs], np.int64))
    mine = w.doc << 32 | line_numbers(buf, off, w)
    keep = np.flatnonzero(pair[np.minimum(np.searchsorted(pair, mine), len(pair) - 1)] == mine) if len(pair) else np.zeros(0, np.int64)
    if not len(keep):
        return
    data, at, to = spaced(buf, Words(w.start[keep], w.end[keep], None, None))
    mine = mine[keep]
    cut = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
    for k, a, b in zip(mine[cut].tolist(), at[cut].tolist(), to[np.append(cut[1:], len(mine)) - 1].tolist(), strict=True):
        yield k >> 32, k & 0xFFFFFFFF, b" ".join(dict.fromkeys(data[a:b].split(b" ")))


def fetch_sets(docs: DataFrame, lines: DataFrame, read=line_words) -> DataFrame:
    """The sets of ``lines(root, s1, s2, doc, text_hash, line)``, as ``read`` gives them."""
    wanted = lines.groupBy("doc", "text_hash").agg(F.sort_array(F.collect_set(F.struct("line", "root", "s1", "s2"))).alias("lines"))
    wanted = wanted.select("doc", F.col("text_hash").alias("of_hash"), *(F.col(f"lines.{c}").alias(f"{c}_of") for c in ("line", "root", "s1", "s2")))
    # rows equal in doc_id and text hold the same lines: one of them answers
    once = docs.join(wanted, (docs["doc_id"] == wanted["doc"]) & (docs["text_hash"] == wanted["of_hash"])).select("doc", "line_of", "root_of", "s1_of", "s2_of", "text")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc").to_pylist()
                lists = [part.column(c).to_pylist() for c in ("line_of", "root_of", "s1_of", "s2_of")]
                known = {(d, x): (r, a, b) for d, four in enumerate(zip(*lists, strict=True)) for x, r, a, b in zip(*four, strict=True)}
                rows = [(*known[d, x], ids[d], x, data) for d, x, data in read(part.column("text"), lists[0])]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.int64()] * 4, pa.int32(), pa.binary()))], ["root", "s1", "s2", "doc", "line", "data"])

    return once.mapInArrow(run, _SET)


# --- removal --------------------------------------------------------------------------------


def later_lines(docs: DataFrame, s: float = SIMILARITY, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(lines to remove: doc, text_hash, line) and (links: s1, s2, doc, line, n_links of the first line of each set with matches)."""
    seeds = new_seeds()
    codes = docs.sparkSession.sparkContext.broadcast(rarity(docs, seeds, counters))
    rows = screen(docs, codes, seeds, s)
    classes = rows.filter(F.col("kind") == _CLASS).select("s1", "s2", "doc", "text_hash", "line")
    edges = rows.filter(F.col("kind") == _EDGE).select(F.col("s1").alias("a"), F.col("s2").alias("b"))
    roots = components(edges).withColumnRenamed("node", "s1")
    possible = written(classes.join(roots, "s1"), "possible")
    sets = written(fetch_sets(docs, possible).dropDuplicates(["s1", "s2", "doc", "line"]), "sets")
    found = written(matches(sets, s), "matches")
    linked = possible.join(found, ["s1", "s2"])
    earlier = (F.col("first_doc") < F.col("doc")) | (F.col("first_doc") == F.col("doc")) & (F.col("first_line") < F.col("line"))
    gone = rows.filter(F.col("kind") == _GONE).select("doc", "text_hash", "line").unionByName(linked.filter(earlier).select("doc", "text_hash", "line"))
    return gone, linked


def _reduced(keyed: DataFrame, s: float, extra: list[str]) -> DataFrame:
    """``keyed`` with the counts, the digest and the kept text; ``extra`` columns pass through."""
    gone, linked = later_lines(keyed, s)
    links = linked.select("doc", "text_hash", F.lit(None).cast("int").alias("line"), "n_links")
    notes = gone.withColumn("n_links", F.lit(0).cast("long")).unionByName(links)
    notes = notes.groupBy("doc", "text_hash").agg(F.collect_set("line").alias("lines"), F.sum("n_links").alias("n_links")).withColumnRenamed("text_hash", "of_hash")
    joined = keyed.join(notes, (keyed["doc_id"] == notes["doc"]) & (keyed["text_hash"] == notes["of_hash"]), "left").select("doc_id", "text", "lines", F.coalesce("n_links", F.lit(0)).alias("n_links"), *extra)
    kinds = [("n_lines", pa.int64()), ("n_removed", pa.int64()), ("n_links", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())]
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.StringType() if t == pa.string() else T.LongType()) for c, t in kinds] + [joined.schema[c] for c in extra])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, lines, links in zip(*(part.column(c).to_pylist() for c in ("text", "lines", "n_links")), strict=True):
                    parts = [] if text is None else text.split("\n")
                    drop = set(lines or ())
                    kept = "\n".join(x for i, x in enumerate(parts) if i not in drop) if drop else text or ""
                    rows.append((len(parts), len(drop), links, hashlib.sha256(kept.encode()).hexdigest(), kept))
                ids = [None if d == _NO_DOC else d for d in part.column("doc_id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)), *(part.column(c) for c in extra)], schema.names)

    return joined.mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    return carried(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_DOC)))


def remove_lines(docs: DataFrame, s: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_links, kept_sha256) of each of ``docs(doc_id, text)``."""
    return _reduced(_keyed(docs).drop("rest"), s, []).drop("kept")


def without_later_lines(docs: DataFrame, s: float = SIMILARITY) -> DataFrame:
    """The documents without their later lines, with all their columns; n_chars follows, and what loses all its lines goes."""
    out = _reduced(_keyed(docs), s, ["rest"]).filter("n_removed < n_lines or n_lines = 0")
    out = out.withColumnRenamed("kept", "text")
    return restored(out, docs, **({"n_chars": F.length("text")} if "n_chars" in docs.columns else {}))
