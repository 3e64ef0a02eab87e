"""SentencePiece encoding and decoding: merge-type models, encoded exactly by backtracking.

The merge process of such a model (best score first, leftmost of equals) is not
run over a text.  Its result is the one sequence of pieces in which each piece,
merged alone, comes out whole, and each two neighbours, merged together, come
out as these two: a first merge across a border would be a merge of two
neighbours already.  So an Aho-Corasick automaton over the reversed pieces gives
the longest piece at each place, a sequence grows from the left by the longest
piece that goes with the one before, and where none does it steps back and tries
the next shorter; a bitfield marks places from which no way leads on, so the
work is linear.  Which pieces go together is found by merging them anew, once.

Texts are cut between characters that stand side by side in no piece, and what
lies between is remembered.

Nulls: a null text is an empty one (no ids, empty decoded text); a null doc_id
stays null.  Characters without a piece become their bytes, or the unknown id in
a model without byte pieces.  Repeated rows each give a row, an empty table
none; there are no ties beyond those of the merges.  Texts of any length go
whole.  Only doc_id and text are read: other columns, whatever their names, are
left out.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from .flat import slices

_CACHE_ENTRIES = 1_000_000
_PAIR_ENTRIES = 2_000_000
SPACE = "▁"  # what the model writes for a blank
_NO = float("-inf")  # the score of a pair that is no piece
_UNKNOWN_TEXT = " ⁇ "  # what it decodes the unknown id to


class PieceModel:
    """Encoder and decoder of one model file without a normalizer, as the library's ``encode`` and ``decode``."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        if model.normalize(" a  béé ") != f"{SPACE * 2}a{SPACE * 2}béé{SPACE}":
            raise ValueError(f"{path}: models that normalize texts or add no blank before them are not supported")
        ids = range(model.get_piece_size())
        self.unknown, self.control = model.unk_id(), {i for i in ids if model.is_control(i)}
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): i for i in normal}
        self.score = {p: model.get_score(i) for p, i in self.pieces.items()}
        longer = [p for p in self.pieces if len(p) > 1]
        self.inner = {p[k : k + 2] for p in longer for k in range(len(p) - 1)}
        chars = sorted({c for p in longer for c in p})
        self.kind = np.zeros(0x110000, np.uint16)  # of a character; 0 for those in no longer piece
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)  # kinds that stand side by side in a piece
        for two in self.inner:
            self.joined[self.kind[ord(two[0])], self.kind[ord(two[1])]] = True
        self._automaton(longer)
        self.bytes = [b""] * len(ids)
        for p, i in self.pieces.items():
            self.bytes[i] = p.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])
        self.bytes[self.unknown] = _UNKNOWN_TEXT.encode()
        self.decimal = [str(i) for i in ids]
        self.byte_set = set(self.byte_ids.values())
        self.cache: dict[str, bytes] = {}
        self.histories: dict[str, tuple[list, list, list] | None] = {}  # one a piece
        self.pairs: dict[tuple[str, str], bool] = {}

    def _automaton(self, longer: list[str]) -> None:
        """The pieces of two characters or more, read backwards, and the next shorter beginning of each."""
        self.longest = ahocorasick.Automaton()
        for p in longer:
            self.longest.add_word(p[::-1], p)  # frequent ones first, as the library searches the children of a node one by one
        if longer:
            self.longest.make_automaton()
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.pieces), p[0]) for p in longer}

    def history(self, piece: str) -> tuple[list, list, list] | None:
        """The merge process on a piece alone: the score of each merge, and the last and first symbol before each and at the end.

        The best pair of neighbours joins, of equal ones the leftmost, until none is a piece.  None if the piece does not come out whole.
        """
        parts, score = list(piece), self.score.get
        worth = [score(a + b, _NO) for a, b in zip(parts, parts[1:], strict=False)]
        scores, lasts, firsts = [], [parts[-1]], [parts[0]]
        while worth:
            best = max(worth)
            if best == _NO:
                return None
            i = worth.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del worth[i]
            if i < len(worth):
                worth[i] = score(parts[i] + parts[i + 1], _NO)
            if i:
                worth[i - 1] = score(parts[i - 1] + parts[i], _NO)
            scores.append(best)
            lasts.append(parts[-1])
            firsts.append(parts[0])
        return [*scores, _NO], lasts, firsts

    def alone(self, piece: str):
        """``history`` of a piece, made once."""
        if piece not in self.histories:
            self.histories[piece] = self.history(piece)
        return self.histories[piece]

    def fits(self, before: str, piece: str) -> bool:
        """Whether two neighbours (the first may be empty), merged together, come out as these two.

        Until a merge crosses the border each goes its own way, so both
        histories are run side by side, the better next merge first, and at
        each step the pair at the border is held against them.
        """
        own = self.alone(piece)
        if own is None or not before:
            return own is not None
        if before[-1] + piece[0] not in self.inner:
            return True  # no merge can cross
        (left, lasts, _), (right, _, firsts) = self.alone(before), own
        score = self.score.get
        i = j = 0
        while True:
            a, b = left[i], right[j]
            across = score(lasts[i] + firsts[j], _NO)
            if across > a and across >= b and across != _NO:
                return False
            if a >= b:
                if a == _NO:
                    return True
                i += 1
            else:
                j += 1

    def stretches(self, text: str) -> list[str]:
        """A text cut between each two characters that stand side by side in no piece: no merge crosses there."""
        kinds = self.kind[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        at = [0, *(np.flatnonzero(~self.joined[kinds[:-1], kinds[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def split(self, text: str) -> list[str]:
        """The pieces and single characters of a text that is all one stretch."""
        n = len(text)
        if n == 1:
            return [text]
        best: list[str] = list(text)  # the longest candidate at each place
        last = n - 1
        for end, piece in self.longest.iter(text[::-1]):
            at = last - end
            if len(piece) > len(best[at]):
                best[at] = piece
        out: list[str] = []
        failed = bytearray(n // 8 + 1)
        at, piece, before = 0, best[0], ""
        known, shorter = self.pairs, self.shorter
        if len(known) >= _PAIR_ENTRIES:
            known.clear()
        while True:
            end = at + len(piece)
            fits = known.get((before, piece))
            if fits is None:
                fits = known[before, piece] = self.fits(before, piece)
            if fits and not failed[end >> 3] >> (end & 7) & 1:
                out.append(piece)
                if end == n:
                    return out
                at, before, piece = end, piece, best[end]
                continue
            while len(piece) == 1:  # nothing shorter here: no way leads on from this place
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("a text without an encoding")
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
            piece = shorter[piece]

    def _ids(self, stretch: str) -> bytes:
        ids: list[int] = []
        for p in self.split(stretch):
            if p in self.pieces:
                ids.append(self.pieces[p])
            elif self.byte_ids:
                ids += map(self.byte_ids.__getitem__, p.encode())
            else:
                ids.append(self.unknown)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, "<u4")
        have, stretches = self.cache, self.stretches(SPACE + text.replace(" ", SPACE))
        if len(have) >= _CACHE_ENTRIES:
            have.clear()
        for s in set(stretches).difference(have):
            have[s] = self._ids(s)
        return np.frombuffer(b"".join(map(have.__getitem__, stretches)), "<u4")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the blank before it goes, bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.bytes.__getitem__, ids))
        head = next((i for i in ids if self.bytes[i]), self.unknown)  # control ids have no text
        if head != self.unknown and data[:1] == b" " and head not in self.byte_set:
            data = data[1:]
        if not self.control.isdisjoint(ids):  # bytes on its two sides make no character together
            cuts = [k for k, i in enumerate(ids) if i in self.control]
            runs = [ids[a + 1 : b] for a, b in zip([-1, *cuts], [*cuts, len(ids)], strict=True)]
            text = "".join(_lenient(b"".join(map(self.bytes.__getitem__, r))) for r in runs)
            return text[len(b"".join(map(self.bytes.__getitem__, ids))) - len(data) :]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return _lenient(data)


def _lenient(data: bytes) -> str:
    """UTF-8 with U+FFFD for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode() + "\ufffd")
            at += e.start + 1
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One per Python worker and model file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of ``docs(doc_id, text)``; with the ids and the text if asked."""
    kinds = [("doc_id", "long", pa.int64()), ("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    kinds += [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())] * with_ids

    def run(batches):
        pieces = model(path)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = pieces.encode(text or "").tolist()
                    back = pieces.decode(ids)
                    row = (doc, len(ids), digest(",".join(map(pieces.decimal.__getitem__, ids))), digest(back))
                    rows.append(row + (ids, back) * with_ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(kinds)], [k[0] for k in kinds])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t, _ in kinds))
