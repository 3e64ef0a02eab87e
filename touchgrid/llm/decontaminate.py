"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits (lower-cased) and non-ASCII
characters.  On both sides every window of ``WINDOW - GRAM + 1`` word k-grams
keeps its minimum hash, so two texts that share ``WINDOW`` words share a kept
fingerprint.  Training and test fingerprints are joined, and each hit is
extended to the whole windows around it, which must be windows of an item,
word for word.
An item of fewer words than a window is one window of its own length, looked up
at every position.

The distinct windows are numbered and counted, and go to the executors in blocks
of about ``BLOCK_WINDOWS`` dealt by number; a larger benchmark takes several
passes over the documents, whose hits are merged per document.  Which items a
window belongs to is a table of its own, which goes nowhere whole: each distinct
set of hit windows meets it once, in a join, so neither a window of many items
nor a passage of many documents makes a large block or a list a document.

Nulls: a null text has no words; a null item_id counts as an item named ''; a
null doc_id stays null.  Items without words have no windows.  Repeated
documents each give a row; repeated items count once per item_id; there are no
ties.  Empty tables give no rows, or no hits.  Texts of any length are read
whole.  Columns beside doc_id, text and item_id are left out whatever their
names (``keep_clean`` hands those of the documents on).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .flat import ALNUM, LOWER, Words, equal_spans, flat, grams, mix, ranges, slices, sliding_min, spaced, words
from .shared import carried, restored, written

WINDOW = 10
GRAM = 5
BLOCK_WINDOWS = 1_000_000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def alnum_words(column: pa.Array) -> tuple[np.ndarray, Words]:
    """(lower-cased bytes, words) of a column."""
    buf, off = flat(column)
    buf = LOWER[buf]
    return buf, words(buf, off, ALNUM)


def window_texts(buf: np.ndarray, w: Words, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offset of each, size of each) of the windows of n words that begin at ``start``, a space between words."""
    at = (start[:, None] + np.arange(n)).ravel()
    data, begin, end = spaced(buf, Words(w.start[at], w.end[at], None, None))
    return np.frombuffer(data, np.uint8), begin[::n], end[n - 1 :: n] - begin[::n]


def winnowed(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the k-grams that are the minimum of some ``span`` consecutive ones (ties all count)."""
    low = sliding_min(hashes, span)
    if not len(low):
        return np.zeros(0, np.int64)
    pad = np.zeros(span - 1, np.uint64)
    high = ~sliding_min(~np.concatenate([pad, low, pad]), span)  # the largest minimum of the windows over a position
    return np.flatnonzero(high == hashes)


def gram_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``grams(h, k)[at]`` without the others."""
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = out * _STEP + h[at + i]
    return mix(out)


def item_windows(items: DataFrame) -> DataFrame:
    """(n, window, print, item, text): a row per window of an item, with its fingerprint (0 for short items) and words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                buf, w = alnum_words(part.column("text"))
                ids = part.column("item").to_pylist()
                n, window, prints, item, texts = [], [], [], [], []
                for d in range(part.num_rows):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    if a == b:
                        continue
                    h, k = w.hash[a:b], min(WINDOW, b - a)
                    whole = grams(h, k)
                    low = sliding_min(grams(h, GRAM), WINDOW - GRAM + 1) if k == WINDOW else np.zeros(1, np.uint64)
                    data, at, size = window_texts(buf, w, a + np.arange(len(whole)), k)
                    raw = data.tobytes()
                    n += [k] * len(whole)
                    window.append(whole), prints.append(low), item.extend([ids[d]] * len(whole))
                    texts += [raw[x : x + y] for x, y in zip(at.tolist(), size.tolist(), strict=True)]
                join = lambda x: pa.array((np.concatenate(x) if x else np.zeros(0, np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), join(window), join(prints), pa.array(item, pa.string()), pa.array(texts, pa.binary())], ["n", "window", "print", "item", "text"])

    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(run, "n int, window long, print long, item string, text binary")


class Benchmark:
    """The windows of a benchmark: ``windows`` (number, n, window, print, text) without repeats, ``members`` (number, item), and the number of blocks."""

    def __init__(self, items: DataFrame, block_windows: int = BLOCK_WINDOWS):
        rows = written(item_windows(items.select("item_id", "text")), "item-windows")
        key = ["n", "text"]
        self.windows = written(rows.groupBy(*key).agg(F.min("window").alias("window"), F.min("print").alias("print")).withColumn("number", F.monotonically_increasing_id()), "windows")
        self.members = rows.select(*key, "item").distinct().join(self.windows.select(*key, "number"), key).select("number", "item")
        self.blocks = max(1, -(-self.windows.count() // block_windows))

    def block(self, i: int) -> DataFrame:
        """Every ``blocks``-th window: numbers run on within the parts of the table, so blocks differ by a row a part at most."""
        return self.windows if self.blocks == 1 else self.windows.filter(F.pmod("number", F.lit(self.blocks)) == i)


class _Index:
    """Windows of one block, sorted by hash, with their words and numbers, and the fingerprints that lead to them."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).combine_chunks()
        self.buf, off = flat(column("text"))
        length, number = column("n").to_numpy(), column("number").to_numpy()
        window, prints = (np.ascontiguousarray(column(c).to_numpy()).view(np.uint64) for c in ("window", "print"))
        self.windows: dict[int, tuple] = {}
        for n in np.unique(length).tolist():
            mine = np.flatnonzero(length == n)
            mine = mine[np.argsort(window[mine], kind="stable")]
            self.windows[n] = (window[mine], number[mine], off[mine], off[mine + 1] - off[mine])
        self.prints = np.unique(prints[length == WINDOW])

    def hits(self, buf: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, number) of the windows in a flat run of documents, their words compared."""
        last = np.repeat(w.first[1:], np.diff(w.first))  # the end of the document of each word
        found = []
        for n, (keys, number, at, size) in self.windows.items():
            if n == WINDOW:
                gram = grams(w.hash, GRAM)
                place = winnowed(gram, WINDOW - GRAM + 1)
                place = place[_in(self.prints, gram[place])]
                start = np.unique((place[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                start = start[(start >= 0)]
                start = start[start + n <= last[start]]
                value = gram_at(w.hash, start, n)
            else:
                value = grams(w.hash, n)
                start = np.arange(len(value))
                keep = start + n <= last[: len(start)]
                start, value = start[keep], value[keep]
            low = np.searchsorted(keys, value)
            many = np.searchsorted(keys, value, side="right") - low  # windows of one hash are compared one by one
            start, row = np.repeat(start, many), ranges(low, many)
            if len(start):
                data, begin, length = window_texts(buf, w, start, n)
                ok = length == size[row]
                ok[ok] = equal_spans(data, begin[ok], length[ok], self.buf, at[row[ok]])
                start, row = start[ok], row[ok]
            found.append((start, np.full(len(start), n), number[row]))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _in(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def _scan(docs: DataFrame, windows: DataFrame, extra: tuple[str, ...] = (), places: bool = False) -> DataFrame:
    """One pass over ``docs(doc_id, text, ...)`` against one block: n_words, n_hit, the numbers of the hit windows, the hit words' ``places`` if asked; ``extra`` columns pass through."""
    held = docs.sparkSession.sparkContext.broadcast(_Index(windows.toArrow()))
    schema = T.StructType.fromDDL("n_words long, n_hit long, numbers array<long>" + ", at array<int>" * places)
    schema = T.StructType([*schema.fields, *(docs.schema[c] for c in extra)])

    def run(batches):
        index = held.value
        for batch in batches:
            for part in slices(batch, "text"):
                buf, w = alnum_words(part.column("text"))
                start, length, number = index.hits(buf, w)
                doc = np.searchsorted(w.first, start, side="right") - 1
                edge = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + length, -1)
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                pairs = np.unique(np.stack([doc, number], 1), axis=0)
                n_hit = total[w.first[1:]] - total[w.first[:-1]]
                off = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                out = [pa.array(np.diff(w.first)), pa.array(n_hit), pa.ListArray.from_arrays(off, pa.array(pairs[:, 1]))]
                if places:
                    at = np.flatnonzero(hit)
                    off = np.concatenate(([0], np.cumsum(n_hit))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(off, pa.array((at - np.repeat(w.first[:-1], n_hit)).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out + [part.column(c) for c in extra], ["n_words", "n_hit", "numbers", *["at"] * places, *extra])

    return docs.mapInArrow(run, schema)


def _hits(docs: DataFrame, bench: Benchmark, places: bool) -> DataFrame:
    """(id, text_hash, n_words, numbers, at) of what is hit in any block; rows that repeat in a block leave one."""
    key = ["doc_id", "text_hash"]
    for i in range(bench.blocks):
        part = _scan(docs, bench.block(i), tuple(key), places).filter("n_hit > 0")
        part = part.dropDuplicates(key)  # equal texts have equal hits
        found = part if i == 0 else found.unionByName(part)
    return found


def find_contamination(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted names of the items with a window here) of each of ``docs(doc_id, text)``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    bench = Benchmark(items, block_windows)
    if bench.blocks == 1:
        found = _scan(docs, bench.block(0), ("doc_id",))
    else:
        merged = _hits(docs, bench, True).groupBy("doc_id", "text_hash").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_hit"), F.array_sort(F.flatten(F.collect_list("numbers"))).alias("numbers"))
        none = bench.block(0).limit(0)
        rows = _scan(docs, none, ("doc_id", "text_hash")).select("doc_id", "text_hash", "n_words")
        merged = merged.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash"), "n_hit", "numbers")
        found = rows.join(merged, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("of_hash")), "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("numbers", F.array().cast("array<long>")).alias("numbers"))
    found = written(found.withColumn("set", F.when(F.size("numbers") > 0, F.sha2(F.array_join("numbers", ","), 256))), "hit-windows")
    sets = found.where("set is not null").groupBy("set").agg(F.first("numbers").alias("numbers"))
    names = sets.select("set", F.explode("numbers").alias("number")).join(bench.members, "number").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = found.where("set is null").withColumn("items", F.array().cast("array<string>"))  # not a key that most rows share
    columns = ["doc_id", "n_words", "n_hit", "items"]
    return found.where("set is not null").join(names, "set").select(*columns).unionByName(none.select(*columns))


def contamination_report(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The digest columns of ``find_contamination``."""
    found = find_contamination(docs, items, block_windows)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents without a window of an item, with all their columns."""
    whole, bench = carried(docs), Benchmark(items, block_windows)
    if bench.blocks == 1:
        found = _scan(whole, bench.block(0), ("doc_id", "text", "rest")).filter("n_hit = 0")
        return restored(found, docs)
    hit = _hits(whole, bench, False).select(F.col("doc_id").alias("of"), F.col("text_hash").alias("of_hash")).distinct()
    return restored(whole.join(hit, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("of_hash")), "left_anti"), docs)
