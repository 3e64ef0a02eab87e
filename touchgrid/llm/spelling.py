"""Spelling variants of a vocabulary: words one letter apart, found in groups and without pairs.

Two words differ by one replaced letter if they are equal but for one position:
each word stands once in each of its groups (position, prefix, suffix).  A group
keeps its size and its two best words; a member has size - 1 neighbours there,
and the best is the first, or the second for the first itself.  Two words differ
by an inserted or deleted letter if one is the other without a letter: the
deletions of all words meet the vocabulary in groups of the same kind.  As every
pair of neighbours meets in exactly one group, counts add up and no pair is made.

Words are numbered by a global sort (most frequent first, then in order of code
points), so the best of a group is its smallest number.  A group's key is a sum
of 128 random bits per place and letter, drawn anew in each run: the word with a
letter of its own at the open place, or without the deleted letter.  Keys cost
the same for a word of any length, and a group has at most as many members as
the alphabet has letters (times the places, for insertions).

Nulls: a null text has no words; a null doc_id counts as empty text in the
checksum.  Ties go to the smaller word in order of code points.  Repeated rows
count each time.  Empty tables give no rows.  Texts of any length are read
whole, words of any length too.  Only doc_id and text are read: other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import re
import secrets
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .flat import mix, slices
from .shared import discard, partitions_for, small_batches, written

_RUN = re.compile(rb"[a-z\xc0-\xff]+")  # of Latin-1 bytes in which only A-Z are lower-cased
_HELD = 200_000  # words that a task counts before it hands them on
_PIECE = 1 << 20  # characters of a text whose runs are taken at once
_KEYS = 1 << 18  # letters whose keys are made at once
_OPEN = 0x110000  # the letter of an open place
_SELF, _DELETED, _WILD = 1, 2, 0


def _pieces(text: str):
    """The text as Latin-1 bytes, one a character, in pieces that cut no run; other characters are in no run."""
    data = text.encode("latin-1", "replace").lower()
    at = 0
    while at < len(data):
        end = at + _PIECE
        while end < len(data) and _RUN.match(data, end, end + 1):
            end += 1
        yield data[at:end]
        at = end


def document_words(docs: DataFrame, spoil: int = 97, least_length: int = 1) -> DataFrame:
    """(word, n): partial counts of the letter runs of ``docs(doc_id, text)``; a run whose checksum ``spoil`` divides loses a letter."""

    def run(batches):
        counts: Counter = Counter()

        def emit():
            words = sorted(counts)
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if not text:
                        continue
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for piece in _pieces(text):
                        for word, n in Counter(_RUN.findall(piece)).items():
                            if len(word) < least_length:
                                continue
                            h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                            if h % spoil == 0:
                                i = h % len(word)
                                word = word[:i] + word[i + 1 :]
                                if len(word) < least_length:
                                    continue
                            counts[word] += n
                    if len(counts) >= _HELD:
                        yield emit()
        if counts:
            yield emit()

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")


def vocabulary(counts: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words with so many code points and occurrences."""
    return counts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def word_keys(words: list[str], seeds: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which word, kind, 2 x 64 bits of key): every word itself, with each place open, and without each letter.

    Of equal letters in a row one is deleted only, as the results are equal.
    """
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    place = (np.arange(len(letters)) - first[word]).astype(np.uint64)
    anew = np.ones(len(letters), bool)  # differs from the letter before in its word
    anew[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    keys = []
    for seed in seeds:
        number = lambda place, letter, seed=seed: mix((place << np.uint64(21) | letter) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        here, back = number(place, letters), number(place - np.uint64(1), letters)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(here)))
        moved = np.concatenate(([np.uint64(0)], np.cumsum(back)))
        ends = first + size
        whole = sums[ends] - sums[first]
        opened = whole[word] - here + number(place, np.uint64(_OPEN))
        without = sums[:-1] - sums[first][word] + moved[ends][word] - moved[1:]
        keys.append(np.concatenate((whole, opened, without[anew])).view(np.int64))
    kinds = np.repeat(np.array([_SELF, _WILD, _DELETED], np.int8), [len(words), len(word), int(anew.sum())])
    return np.concatenate((np.arange(len(words)), word, word[anew])), kinds, np.stack(keys)


def _keyed(ranked: DataFrame, seeds: tuple[int, int]) -> DataFrame:
    """(k1, k2, kind, rank): a row for each word and each of its groups."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "word", _KEYS):
                ranks = part.column("rank").to_numpy()
                which, kinds, keys = word_keys(part.column("word").to_pylist(), seeds)
                for i in range(0, len(which), _KEYS):
                    s = slice(i, i + _KEYS)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[0][s], keys[1][s], kinds[s], ranks[which[s]])], ["k1", "k2", "kind", "rank"])

    return ranked.select("rank", "word").mapInArrow(run, "k1 long, k2 long, kind tinyint, rank long")


def neighbours(ranked: DataFrame, seeds: tuple[int, int] | None = None) -> DataFrame:
    """(rank, n_near, best) of the words of ``ranked(rank, word)`` that have a neighbour: their number, and the smallest rank among them."""
    rows = _keyed(ranked, seeds or (secrets.randbits(64), secrets.randbits(64)))
    group = W.partitionBy("k1", "k2").orderBy("rank")
    every = group.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    found = rows.select(
        "rank",
        "kind",
        F.count(F.lit(1)).over(every).alias("size"),
        F.first("rank").over(every).alias("best"),
        F.lead("rank").over(group).alias("second"),
        F.max(F.when(F.col("kind") == _SELF, F.col("rank"))).over(every).alias("itself"),
    ).where("size > 1")
    deleted = F.col("kind") == _DELETED
    near = F.when(deleted, F.col("itself").isNotNull().cast("long")).otherwise(F.col("size") - 1)
    best = F.when(deleted, F.col("itself")).otherwise(F.when(F.col("rank") == F.col("best"), F.col("second")).otherwise(F.col("best")))
    return found.select("rank", near.alias("near"), best.alias("best")).where("near > 0").groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(links: DataFrame) -> DataFrame:
    """(rank, root): the ends of chains ``links(rank, root)``, by doubling.

    A form is at least twice as frequent as its word, so a chain has at most 62
    links and six rounds are enough.
    """
    now = written(links, "links")
    while True:
        on = now.select(F.col("rank").alias("root"), F.col("root").alias("further"))
        following = written(now.select("rank", "root").join(on, "root", "left").select("rank", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links")
        discard(now)
        now = following
        if now.where("moved").isEmpty():
            return now.select("rank", "root")


def group_variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``vocab(word, n)``.

    The form of a word is its most frequent neighbour if that is at least
    ``factor`` (2 or more) times as frequent; the root is the end of the chain of forms.
    """
    if factor < 2:
        raise ValueError("a form must be at least twice as frequent, or chains have no bound")
    vocab = written(vocab.select("word", "n"), "words")
    by = F.desc("n"), F.col("word")
    ranked = written(vocab.repartitionByRange(partitions_for(vocab), *by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()), "vocabulary")
    names = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = ranked.join(neighbours(ranked), "rank", "left").join(names, "best", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    forms = written(near.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *(F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n"))), "forms")
    roots = _roots(forms.where("best is not null").select("rank", F.col("best").alias("root")))
    words = ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    out = forms.join(roots, "rank", "left").join(words, "root", "left")
    return out.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
