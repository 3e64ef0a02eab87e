import hashlib
import random

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor

from touchgrid.llm.pieces import PieceModel, encode_decode

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return PieceModel(PATH)


def texts(own, seed=5, n=3000):
    rng = random.Random(seed)
    longer, single = [p for p in own.pieces if len(p) > 1], [p for p in own.pieces if len(p) == 1]
    yield from ("", " ", "\n", "\x00a", "日本語\U0001f600 x", "a　b", "é é", "<s></s><unk> <0x41>", "▁▁ a", " ⁇ ", "�﻿", "x" * 5000, "ab" * 3000, "the" * 2000)
    yield from (a + " " * k + b for k in range(40) for a in ("", "a", "\n") for b in ("", "the", "\t"))
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield "".join(rng.choices(longer, k=rng.randrange(1, 9)))
        elif kind < 0.5:
            yield "".join(rng.choices(single, k=rng.randrange(1, 30)))
        elif kind < 0.9:
            yield "".join(rng.choices("aeinorst lheTHE\n.,▁ ", k=rng.randrange(1, 60)))
        else:
            yield "".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x11000)])) for _ in range(rng.randrange(1, 20)))


def test_ids_and_text_equal_the_library(own, library):
    for text in texts(own):
        ids = library.encode(text)
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.randrange(3)]) for _ in range(rng.randrange(8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_neighbours_fit_where_merging_both_gives_both(own, library):
    rng = random.Random(4)
    pieces = [p for p in own.pieces if len(p) > 1 and "▁" not in p]
    for _ in range(3000):
        a, b = rng.choices(pieces, k=2)
        if own.alone(a) and own.alone(b):
            whole = [library.id_to_piece(i) for i in library.encode("\n" + a + b)][2:]  # after the blank and the byte of the line feed
            assert own.fits(a, b) == (whole == [a, b])


def test_a_text_longer_than_a_slice(own, library):
    rng = random.Random(1)
    for text in ("".join(rng.choices("aeinorst \n", k=1_300_000)), "a" * 1_200_000, " " * 1_200_000):
        assert own.encode(text).tolist() == library.encode(text)


def test_rows(spark, docs, rows, no_docs, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "")
        want.append((doc, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, encode_decode(docs, PATH).collect()), key=key) == sorted(want, key=key)
    assert encode_decode(no_docs, PATH).count() == 0
    clash = spark.createDataFrame([(1, "a b", 9, "x")], "doc_id int, text string, n_tokens int, ids_sha256 string")
    [r] = encode_decode(clash, PATH, with_ids=True).collect()
    assert (r.n_tokens, r.ids, r.decoded) == (2, library.encode("a b"), "a b")
