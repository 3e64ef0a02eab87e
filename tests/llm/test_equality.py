"""Words that a polynomial hash modulo 2^64 cannot tell apart are different words everywhere."""

import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from touchgrid.llm import decontaminate as D, flat, lines, near_copies, resample, token_store as T

BYTE = P.path("byte_bpe_50k.json")


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def pair(n):
    word = thue_morse(n)
    return word, word.translate(str.maketrans("ab", "ba"))


SIZES = [1024, 2048, 4096]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_and_counts_differ(n):
    column = pa.array([" ".join(pair(n))])
    assert len(set(flat.words(*flat.flat(column), flat.NOT_SPACE).hash.tolist())) == 2
    bucket, _, bare, _ = resample._features(column)
    assert len(set(bucket.tolist())) == 3 and len(set(bare.tolist())) == 2
    assert len(set(near_copies.shingles(pa.array(list(pair(n))), (1, 2))[0].tolist())) == 2


def test_hashes_depend_on_the_seed_and_not_on_the_place():
    column = pa.array(["one two " + "x" * 100, "two " + "x" * 100 + " one"])
    for seed in (0, 5):
        w = flat.words(*flat.flat(column), flat.NOT_SPACE, seed)
        assert w.hash[[0, 1, 2]].tolist() == w.hash[[5, 3, 4]].tolist()
    assert flat.words(*flat.flat(column), flat.NOT_SPACE, 5).hash[0] != flat.words(*flat.flat(column), flat.NOT_SPACE).hash[0]


def test_ids_of_such_words_are_the_librarys(spark):
    texts = ["x " + a + " " + b for a, b in map(pair, SIZES)]
    tok = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in T.read_tokens(T.write_tokens(df, BYTE)).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


def test_chunks_of_one_hash_are_encoded_apart(monkeypatch):
    texts = ["ab cd ef", "xy zw uv"]
    monkeypatch.setattr(T, "span_hashes", lambda buf, start, end: (end - start).astype(np.uint64))
    tok = Tokenizer.from_file(BYTE)
    assert [x.tolist() for x in T.Encoder(BYTE).encode_column(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_are_compared_word_for_word(spark):
    nine = "one two three four five six seven eight nine "
    items, docs = [], []
    for n in SIZES:
        a, b = pair(n)
        items.append((n, nine + a))
        docs += [(n, nine + b), (n + 1, nine + a)]
    got = {r["doc_id"]: r["n_hit"] for r in D.contamination_report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {d: 10 if d % 2 else 0 for d, _ in docs}


def test_windows_of_one_hash():
    table = pa.table({"number": [4, 9], "n": pa.array([2, 2], pa.int32()), "window": [7, 7], "print": [0, 0], "text": pa.array([b"a b", b"c d"])})
    index = D._Index(table)
    buf, w = D.alnum_words(pa.array(["a b e", "c d"]))
    index.windows[2] = (np.sort(D.grams(w.hash, 2)[[0, 0]]), *index.windows[2][1:])  # both windows under the hash of "a b"
    start, length, number = index.hits(buf, w)
    assert (start.tolist(), length.tolist(), number.tolist()) == ([0], [2], [4])


def test_lines_of_such_words_stay(spark):
    rows = [(i, " ".join(("w", x))) for n in SIZES for i, x in zip((n, n + 1), pair(n))]
    got = lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and not any(r["n_removed"] or r["n_links"] for r in got)


def test_tied_lines_leave_together(spark):
    rows = [(5, "one two three\nfour five six"), (5, "one two three\nseven eight"), (1, "three two one"), (None, "null first"), (None, "null first two"), (2, "first null")]
    got = sorted((r["doc_id"] or 0, r["n_lines"], r["n_removed"]) for r in lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 1, 0), (0, 1, 0), (1, 1, 0), (2, 1, 1), (5, 2, 1), (5, 2, 1)]
