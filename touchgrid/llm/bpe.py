"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of all new words of a batch lie in one flat array.  A round looks
up every adjacent pair by binary search over the sorted pair keys, takes the
lowest rank of each word, and merges all its occurrences from left to right;
words without a known pair leave.  Rounds end when no word is left.

Encodes as the tokenizers library does for a word-level-suffix BPE file (NFC,
white space, lower case; split; byte-level symbols; ``</w>``) and decodes as a
file without a decoder does: tokens joined by one space.

Nulls: a null text is an empty one (no ids, empty decoded text); a null doc_id
stays null.  Special tokens in a text become their ids.  Of pairs of one rank in
a word the first from the left merges first.  Repeated rows each give a row, an
empty table none.  Texts of any length go whole.  A word over ``_LONG`` bytes
would keep the rounds of all others waiting and is merged on its own with a heap
of its pairs, to the same ids.  Only doc_id and text are read: other columns,
whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from .flat import slices

_CACHE_ENTRIES = 500_000
_NO_RANK = np.int64(1) << 40

# Letters and numbers of U+0000 to U+024F, the characters that the fast pattern may meet,
# and the white space of the vocabulary file's patterns.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBERS = "0-9²³¹¼-¾"
_OTHER = re.compile("[^\n\r\t -~¡-ɏ‐-‧‰-‾]")
_SPACE = r"\t-\r \x85\xa0  -     　"
_PIECES = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")

_ANY_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _unassigned() -> re.Pattern:
    """Characters that ``unicodedata`` does not know: tables of different age take them for different things."""
    ranges: list[list[int]] = []
    for i in range(0x110000):
        if unicodedata.category(chr(i)) == "Cn":
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return re.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]")


_YOUNG = _unassigned()
_LONG = 512  # bytes of a word that is merged on its own


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself if it prints, else the next free one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, bytes] = {}
        self.path, self.library = path, None

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of pairs of symbols; the rank of an unknown pair is ``_NO_RANK``."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank = np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)
        return rank, self.merged[np.where(rank == _NO_RANK, 0, rank)]

    def merge_long(self, word: bytes) -> bytes:
        """Ids of one long word: pairs in a heap by rank and place, so a merge costs the logarithm of its length."""
        data = np.frombuffer(word, np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        rank, merged = self._pairs(symbols[:-1], symbols[1:])
        sym, n = symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], tuple[int, int]] = {}
        heap = [(r, i, a, b, m) for i, (r, a, b, m) in enumerate(zip(rank.tolist(), sym[:-1], sym[1:], merged.tolist(), strict=True)) if r != _NO_RANK]
        heapify(heap)

        def add(i: int, j: int) -> None:
            pair = sym[i], sym[j]
            if pair not in known:
                r, m = self._pairs(*(np.array([x], np.int64) for x in pair))
                known[pair] = int(r[0]), int(m[0])
            r, m = known[pair]
            if r != _NO_RANK:
                heappush(heap, (r, i, *pair, m))

        while heap:
            _, i, a, b, m = heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                add(i, after[j])
            if before[i] >= 0:
                add(before[i], i)
        return np.array([x for x in sym if x >= 0], "<u4").tobytes()

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (little-endian uint32), by merge rounds over all of them; words over ``_LONG`` bytes go alone."""
        out: list[bytes] = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > _LONG:
                out[i] = self.merge_long(w)
        which = np.array([i for i, w in enumerate(words) if len(w) <= _LONG], np.int64)
        words = [words[i] for i in which.tolist()]
        if not words:
            return out
        size = np.array([len(w) for w in words], np.int64)
        sym_bytes = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[sym_bytes]
        ends = np.cumsum(size)
        sym[ends - 1] = self.last[sym_bytes[ends - 1]]
        while len(which):
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            rank = np.full(len(sym), _NO_RANK)
            rank[:-1] = self._pairs(sym[:-1], sym[1:])[0]
            rank[first + size - 1] = _NO_RANK  # the last symbol of a word has no right partner
            best = np.minimum.reduceat(rank, first)
            done = best == _NO_RANK
            if done.any():
                for i, a, n in zip(which[done].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[i] = sym[a : a + n].astype("<u4").tobytes()
                stay = np.repeat(~done, size)
                sym, rank = sym[stay], rank[stay]
                which, size, best = which[~done], size[~done], best[~done]
                if not len(which):
                    break
            hit = rank == np.repeat(best, size)
            # of a run of overlapping hits every second one counts, from the left
            at = np.flatnonzero(hit)
            head = np.concatenate(([True], np.diff(at) > 1))
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            word = np.repeat(np.arange(len(size)), size)
            size = size - np.bincount(word[at], minlength=len(size))
            sym = sym[keep]
        return out

    def pieces(self, text: str) -> list[str]:
        """Normalized, split text without special tokens; characters too young for ``unicodedata`` are left to the library."""
        if _OTHER.search(text) and _YOUNG.search(text):
            if self.library is None:
                self.library = Tokenizer.from_file(self.path)
            text = self.library.normalizer.normalize_str(text)
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()
        return (_ANY_PIECES if _OTHER.search(text) else _PIECES).findall(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        split, new = [], {}
        have = self.cache
        if len(have) >= _CACHE_ENTRIES:
            have.clear()
        for text in texts:
            parts = self._split.split(text) if self._split and "<" in text else [text]
            row = [self.special[p] if p in self.special else self.pieces(p) for p in parts if p]
            split.append(row)
            for p in row:
                if isinstance(p, list):
                    for w in p:
                        if w not in have:
                            new[w] = None
        if new:
            for w, ids in zip(new, self.merge_words([w.encode() for w in new]), strict=True):
                have[w] = ids
        get = have.__getitem__
        return [np.frombuffer(b"".join(b"".join(map(get, p)) if isinstance(p, list) else p.to_bytes(4, "little") for p in row), "<u4") for row in split]

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_MODELS: dict[str, WordBPE] = {}


def model(path: str) -> WordBPE:
    """One per Python worker and vocabulary file."""
    if path not in _MODELS:
        _MODELS[path] = WordBPE(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of ``docs(doc_id, text)``; with the ids and the text if asked."""
    kinds = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    kinds += [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())] * with_ids

    def run(batches):
        bpe = model(tokenizer)
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                found = bpe.encode([t or "" for t in part.column("text").to_pylist()])
                for doc, ids in zip(part.column("doc_id").to_pylist(), found, strict=True):
                    text = bpe.decode(ids)
                    row = (doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                    rows.append(row + (ids.tolist(), text) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(kinds)], [k[0] for k in kinds])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in kinds))
