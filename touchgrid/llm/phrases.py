"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words.  A word goes if a window that covers
it also starts in a document with a smaller doc_id.

1. Candidates.  Each window names the least hash of its ``GRAM``-word grams, its
   anchor; equal windows have equal anchors.  A task combines the anchors of
   many documents: those of two documents are known to recur at once, of all
   others one entry a task goes to the anchor's bucket, where entries of
   different tasks meet.  So a passage that all documents share is one entry a
   task, not one a document.
2. Segments.  Documents get their recurring anchors; runs of windows with one
   such anchor become segments, and equal segments combine before the exchange.
3. Confirmation.  Segments with one anchor meet and their windows are compared
   word for word.  Runs of windows that recur, with one first document, are the
   passages.  The windows of an anchor with more than ``HOT`` segments are
   counted by an aggregation instead, which combines before the exchange.
4. Automata.  Documents fall into shards of about ``SHARD_BYTES`` of text.  Each
   shard gets the passages of its documents, once each, compiles them to an
   Aho-Corasick automaton over word numbers, and every document streams whole
   through the automaton of its shard.  What it finds, and nothing else, says
   where passages occur; those that began in a smaller doc_id go.

Nulls: a null text has no words.  A null doc_id is neither smaller nor larger
than any: its words stay and remove none.  Rows equal in doc_id do not remove
each other's words, each gives a row.  Documents shorter than a window keep all
words.  A text of any length is read whole; it is a shard's slice of its own.
An empty table gives no row.  Only doc_id and text are read: other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import groupby, product
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .flat import NOT_SPACE, SLICE_BYTES, flat, grams, slices, sliding_min, spaced, words
from .shared import discard, input_bytes, map_written, partitions_for, release, without_collector, written

WINDOW = 13
GRAM = 5
HOT = 20_000
_UNIT = 1 << 19  # anchors that a task combines at once
SHARD_BYTES = 2 << 20  # of text that streams through one automaton
_BUCKET_BYTES = 32 << 20  # of text whose anchors meet at once
_GROUP_WORDS = 50_000  # of segments whose windows are compared at once
_KNOWN = np.uint32(0xFFFFFFFF)
_FEW_ROWS = 1 << 15
_DIGITS = 2  # letters a word in the automaton
_OTHER = "\0" * _DIGITS  # a word that no passage of the shard has
_NEVER = "\U0010ffff"  # in no text: the letters of 10^11 words come before it


def _anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor (48 bits) of the window at each word of a flat array."""
    return sliding_min(grams(hashes, gram), window - gram + 1) >> np.uint64(16)


def _whole(first: np.ndarray, window: int) -> np.ndarray:
    """Whether the window at each word lies within its document."""
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(len(last)) + window <= last


# --- 1. candidates ---------------------------------------------------------------


def _pack(h: np.ndarray, doc: np.ndarray, known: np.ndarray) -> bytes:
    """Sorted 48-bit anchors, their documents and whether they are known to recur, about ten bytes an entry."""
    real = doc[~known]
    base = int(real.min()) if len(real) else 0
    narrow = not len(real) or int(real.max()) - base < int(_KNOWN)
    ids = np.where(known, _KNOWN, np.where(known, 0, doc) - (0 if known.all() else base)).astype("<u4").tobytes() if narrow else doc.astype("<i8").tobytes() + known.tobytes()
    return struct.pack("<IqB", len(h), base, narrow) + (h >> np.uint64(32)).astype("<u2").tobytes() + h.astype("<u4").tobytes() + ids


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, base, narrow = struct.unpack_from("<IqB", data)
    h = np.frombuffer(data, "<u2", n, 13).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", n, 13 + 2 * n).astype(np.uint64)
    at = 13 + 6 * n
    if not narrow:
        return h, np.frombuffer(data, "<i8", n, at), np.frombuffer(data, bool, n, at + 8 * n)
    raw = np.frombuffer(data, "<u4", n, at)
    return h, raw.astype(np.int64) + base, raw == _KNOWN


_PART = pa.schema([("part", pa.int32()), ("doc", pa.int64()), ("data", pa.binary())])


def _by_document(h: np.ndarray, doc: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
    return [(int(doc[a]), x.tobytes()) for a, x in zip(cut, np.split(h, cut[1:]) if len(doc) else [], strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t.type) for i, t in enumerate(_PART)], schema=_PART)


def recurring_anchors(docs: DataFrame, size: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, data): anchors of a document that other documents have as well; several rows a document.  ``size``: bytes of the texts."""
    n_parts = partitions_for(docs)
    buckets = max(4 * n_parts, size // _BUCKET_BYTES)

    def combine(held: list[tuple[np.ndarray, np.ndarray]]):
        h, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[new], doc[new]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(start, len(h)))
        many = np.repeat(size > 1, size)
        known = [(-1 - d % n_parts, d, data) for d, data in _by_document(h[many], doc[many])]
        for at in range(0, len(known), 4096):
            yield _batch(known[at : at + 4096])
        one_h, one_doc, sure = h[start], doc[start], size > 1
        bucket = (one_h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
        inside = [(b, order[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut)).tolist()]
        for at in range(0, len(inside), 4096):
            yield _batch([(b, None, _pack(one_h[x], one_doc[x], sure[x])) for b, x in inside[at : at + 4096]])

    def collect(batches):
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                buf, off = flat(part.column("text"))
                w = words(buf, off, NOT_SPACE)
                low = _anchors(w.hash, window, gram)
                whole = _whole(w.first, window)[: len(low)]
                doc = w.doc[: len(low)]
                if not whole.any():
                    continue
                low, doc = low[whole], doc[whole]
                new = np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])))
                held.append((low[new], part.column("doc_id").to_numpy()[doc[new]]))
                n += int(new.sum())
                if n >= _UNIT:
                    yield from combine(held)
                    held, n = [], 0
        if held:
            yield from combine(held)
        held.clear()
        release()

    def meet(batches):
        part, held = None, []

        def recurring():
            if not held:
                return []
            h, doc, known = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h, kind="stable")
            h, doc, known = h[order], doc[order], known[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(start, len(h)))
            found = np.repeat(size > 1, size) & ~known
            return _by_document(h[found], doc[found])

        for batch in batches:
            out = []
            for p, doc, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p < 0:
                    out.append((doc, data))
                    continue
                if p != part:
                    out += recurring()
                    part, held = p, []
                held.append(_unpack(data))
            yield _found(out)
        yield _found(recurring())
        held.clear()
        release()

    def _found(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc", "data"])

    sent = docs.select("doc_id", "text").filter("doc_id is not null").mapInArrow(collect, "part int, doc long, data binary")
    dealt = sent.repartitionById(n_parts, F.pmod(F.col("part"), F.lit(n_parts))).sortWithinPartitions("part")
    return dealt.mapInArrow(meet, "doc long, data binary")


# --- 2. segments -------------------------------------------------------------------


def segments(docs: DataFrame, found: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, text_hash, k1, k2, anchor, text): runs of windows with one recurring anchor.

    Documents and their anchors take one exchange and are sorted together, so a
    document's anchors come just before it and nothing is gathered in the JVM.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("doc"), F.lit(1).alias("kind"), F.xxhash64("text").alias("text_hash"), "text", F.lit(None).cast("binary").alias("data"))
    lists = found.select("doc", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("text_hash"), F.lit(None).cast("string").alias("text"), "data")
    joined = texts.unionByName(lists).repartition("doc").sortWithinPartitions("doc", "kind")

    @without_collector
    def cut(batches):
        doc, data = None, []
        held, size = [], 0

        def done():
            ids, hashes, texts, lists = zip(*held, strict=True)
            return _segments_of(pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string()), lists)

        for batch in batches:
            for d, kind, h, text, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if d != doc:
                    doc, data = d, []
                if kind == 0:
                    data.append(blob)
                elif data and text:
                    held.append((d, h, text, data))
                    size += len(text)
                    if size >= SLICE_BYTES or len(held) >= _FEW_ROWS:
                        yield done()
                        held, size = [], 0
        if held:
            yield done()

    def _segments_of(ids, hashes, column, lists):
        buf, off = flat(column)
        w = words(buf, off, NOT_SPACE)
        low, whole, doc = _anchors(w.hash, window, gram), _whole(w.first, window), w.doc.astype(np.uint64)
        n = len(low)
        sizes = np.array([sum(len(x) for x in data) // 8 for data in lists], np.int64)
        known = np.frombuffer(b"".join(b"".join(data) for data in lists), np.uint64) | np.repeat(np.arange(len(lists), dtype=np.uint64), sizes) << np.uint64(48)
        known = np.sort(known)
        key = low | doc[:n] << np.uint64(48)
        hit = whole[:n] & (known[np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))] == key if len(known) else np.zeros(n, bool))
        begin = hit.copy()
        begin[1:] &= ~hit[:-1] | (key[1:] != key[:-1])
        start = np.flatnonzero(begin)
        stop = hit.copy()
        stop[:-1] &= ~hit[1:] | (key[1:] != key[:-1])
        end = np.flatnonzero(stop) + window - 1
        data, at, to = spaced(buf, w)
        texts = [data[a:b] for a, b in zip(at[start].tolist(), to[end].tolist(), strict=True)]
        keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for t in texts), np.int64).reshape(-1, 2)
        of = doc[start].astype(np.int64)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(of)), hashes.take(pa.array(of)), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(low[start].astype(np.int64)), pa.array(texts, pa.binary())], ["doc", "text_hash", "k1", "k2", "anchor", "text"])

    return map_written(joined, cut, "doc long, text_hash long, k1 long, k2 long, anchor long, text binary", "segments")


# --- 3. confirmation -----------------------------------------------------------------


def _distinct_windows(parts: list, window: int) -> bool:
    return len(set(parts)) == len(parts) or len({tuple(parts[i : i + window]) for i in range(len(parts) - window + 1)}) == len(parts) - window + 1


def _passages(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(k1, k2, first, passage) of segments (anchor, k1, k2, first, last, text) sorted by anchor, whole anchors.

    A passage is a run of recurring windows with one first document; where
    windows of a run repeat (a text of one word, say) each is a passage of its
    own, so that few passages can end at one word.
    """
    for _, group in groupby(rows, key=itemgetter(0)):
        group = list(group)
        if len(group) == 1:  # what only this segment holds recurs as its documents do
            _, k1, k2, first, last, text = group[0]
            if first < last:
                yield from _runs(k1, k2, text.split(b" "), [first] * (text.count(b" ") + 2 - window), window)
            continue
        number: dict[bytes, int] = {}
        span: dict[tuple, tuple[int, int]] = {}
        held = []
        for _, k1, k2, first, last, text in group:
            parts = text.split(b" ")
            seq = [number.setdefault(x, len(number)) for x in parts]
            keys = [tuple(seq[i : i + window]) for i in range(len(seq) - window + 1)]
            for key in keys:
                have = span.get(key)
                span[key] = (first, last) if have is None else (min(first, have[0]), max(last, have[1]))
            held.append((k1, k2, parts, keys))
        for k1, k2, parts, keys in held:
            spans = [span[key] for key in keys]
            yield from _runs(k1, k2, parts, [f if f < l else None for f, l in spans], window)


def _runs(k1: int, k2: int, parts: list[bytes], firsts: list[int | None], window: int) -> Iterator[tuple[int, int, int, bytes]]:
    at = 0
    for first, run in groupby(firsts):
        n = sum(1 for _ in run)
        if first is not None:
            words_ = parts[at : at + n + window - 1]
            if _distinct_windows(words_, window):
                yield k1, k2, first, b" ".join(words_)
            else:
                for one in dict.fromkeys(tuple(words_[i : i + window]) for i in range(n)):
                    yield k1, k2, first, b" ".join(one)
        at += n


_PASSAGE = "k1 long, k2 long, first long, last long, passage binary"


def _passage_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.int64()] * 4, pa.binary()))], ["k1", "k2", "first", "last", "passage"])


def confirmed(cut: DataFrame, window: int = WINDOW, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """((k1, k2, first, passage): the recurring passages of each distinct segment and their first documents; the table behind).

    Segments are sorted by anchor.  Those of an anchor are compared once all are
    there; if they are more than ``hot`` none is held: their windows go on as
    rows (with a last document), which an aggregation counts.
    """
    distinct = cut.groupBy("k1", "k2", "anchor", "text").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))

    def windows(row):
        _, k1, k2, first, last, text = row
        parts = text.split(b" ")
        return [(k1, k2, first, last, b" ".join(x)) for x in dict.fromkeys(tuple(parts[i : i + window]) for i in range(len(parts) - window + 1))]

    @without_collector
    def compare(batches):
        held, n, out = [], 0, []
        anchor, start, over = None, 0, False  # the anchor that is being read, where its rows begin, whether they are too many
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != anchor:
                    if n >= _GROUP_WORDS:
                        out += [(k1, k2, first, None, x) for k1, k2, first, x in _passages(held, window)]
                        held, n = [], 0
                    anchor, start, over = row[0], len(held), False
                if over:
                    out += windows(row)
                else:
                    held.append(row)
                    n += row[-1].count(b" ") + 1
                    if len(held) - start > hot:
                        over = True
                        for x in held[start:]:
                            out += windows(x)
                        del held[start:]
                        n = sum(x[-1].count(b" ") + 1 for x in held)
                if len(out) >= 20_000:
                    yield _passage_batch(out)
                    out = []
        out += [(k1, k2, first, None, x) for k1, k2, first, x in _passages(held, window)]
        yield _passage_batch(out)

    dealt = distinct.select("anchor", "k1", "k2", "first", "last", "text").repartition("anchor").sortWithinPartitions("anchor")
    table = map_written(dealt, compare, _PASSAGE, "passages")
    many = table.filter("last is not null")
    spans = many.groupBy("passage").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last").select("passage", "first")
    many = many.select("k1", "k2", "passage").join(spans, "passage").select("k1", "k2", "first", "passage")
    return table.filter("last is null").drop("last").unionByName(many), table


# --- 4. automata -----------------------------------------------------------------------


class _Automaton:
    """Passages of a shard over word numbers; ``find`` gives (start, length, first document) of every occurrence in a text.

    A number is written in ``_DIGITS`` digits, each place with letters of its
    own, so a passage can begin at a word only.  The automaton searches the
    children of a node one by one: a digit has few values, a word has many.
    """

    def __init__(self, patterns: dict[bytes, int]):
        self.first = list(patterns.values())
        self.length = [x.count(b" ") + 1 for x in patterns]
        known = dict.fromkeys(b" ".join(patterns).split(b" ")) if patterns else {}
        base = 1
        while base**_DIGITS < len(known):
            base += 1
        places = [[chr(1 + p * base + d) for d in range(base)] for p in range(_DIGITS)]
        self.code = dict(zip(known, map("".join, product(*places)), strict=False))
        self.trie = None
        if patterns:
            self.trie = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            self.trie.add_word(_OTHER[0] + _NEVER, 0)  # the letter of other words is the root's first child
            code = self.code.__getitem__
            for i, passage in enumerate(patterns):
                self.trie.add_word("".join(map(code, passage.split(b" "))), i)
            self.trie.make_automaton()

    def find(self, parts: list[bytes]) -> list[tuple[int, int, int]]:
        if self.trie is None or not parts:
            return []
        get, length, first = self.code.get, self.length, self.first
        return [(end // _DIGITS - length[i] + 1, length[i], first[i]) for end, i in self.trie.iter("".join([get(x, _OTHER) for x in parts]))]


def _patterns(cut: DataFrame, passages: DataFrame, shards: int) -> DataFrame:
    """(shard, first, passage): what the documents of a shard may hold from a smaller doc_id."""
    wanted = cut.groupBy(_shard("doc", "text_hash", shards), "k1", "k2").agg(F.max("doc").alias("last"))
    return wanted.join(passages, ["k1", "k2"]).filter("first < last").select("shard", "first", "passage")


def _shard(doc: str, text_hash: str, shards: int):
    return F.pmod(F.xxhash64(doc, text_hash), F.lit(shards)).alias("shard")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, with_text: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each of ``docs(doc_id, text)``; with the kept text if asked."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = input_bytes(docs)
    shards = max(1, size // shard_bytes)
    cut = segments(docs, recurring_anchors(docs, size, window, gram), window, gram)
    passages, table = confirmed(cut, window, hot)
    patterns = written(_patterns(cut, passages, shards), "patterns")
    discard(cut, table)
    none = lambda t: F.lit(None).cast(t)
    keyed = docs.withColumn("text_hash", F.xxhash64("text"))
    texts = keyed.select(_shard("doc_id", "text_hash", shards), F.lit(1).alias("kind"), "doc_id", "text", none("long").alias("first"), none("binary").alias("passage"))
    joined = texts.unionByName(patterns.select("shard", F.lit(0).alias("kind"), none("long").alias("doc_id"), none("string").alias("text"), "first", "passage"))
    kinds = [("doc_id", "long", pa.int64()), ("n_words", "long", pa.int64()), ("n_removed", "long", pa.int64()), ("kept_sha256", "string", pa.string())] + [("kept", "string", pa.string())] * with_text

    @without_collector
    def run(batches):
        of, automaton, found = None, None, {}
        held, size = [], 0
        for batch in batches:
            for shard, kind, doc, text, first, passage in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if shard != of:
                    if held:
                        yield _kept(held, automaton)
                        held, size = [], 0
                    of, automaton, found = shard, None, {}
                if kind == 0:
                    found[passage] = first
                    continue
                if automaton is None:
                    automaton, found = _Automaton(found), {}
                held.append((doc, text or ""))
                size += len(text or "")
                if size >= SLICE_BYTES or len(held) >= _FEW_ROWS:
                    yield _kept(held, automaton)
                    held, size = [], 0
        if held:
            yield _kept(held, automaton)
        release()

    def _kept(held, automaton):
        ids, texts = zip(*held, strict=True)
        buf, off = flat(pa.array(texts, pa.string()))
        w = words(buf, off, NOT_SPACE, None)
        data, begin, end = spaced(buf, w)
        parts = data.split(b" ") if data else []
        edge = np.zeros(len(parts) + 1, np.int64)
        bounds = list(zip(ids, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))
        for doc, a, b in bounds:
            if doc is not None and b - a >= window:
                for at, n, first in automaton.find(parts[a:b]):
                    if first < doc:
                        edge[a + at] += 1
                        edge[a + at + n] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        rows = []
        for doc, a, b in bounds:
            removed = int(total[b] - total[a])
            if removed:
                kept = b" ".join([parts[i] for i in (a + np.flatnonzero(~gone[a:b])).tolist()])
            else:
                kept = data[int(begin[a]) : int(end[b - 1])] if b > a else b""
            rows.append((doc, b - a, removed, hashlib.sha256(kept).hexdigest()) + (kept.decode(),) * with_text)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(kinds)], [k[0] for k in kinds])

    dealt = joined.repartition("shard").sortWithinPartitions("shard", "kind")
    return dealt.mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in kinds))
