import hashlib
import io
import tarfile
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from touchgrid.llm import bpe, media, token_store as T
from touchgrid.llm.shared import MOST_PARTITIONS, input_bytes, open_shared, partitions_for

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


def key(r):
    return tuple((x is not None, x if x is not None else 0) if not isinstance(x, str) else (True, x) for x in r)


@pytest.mark.parametrize("ids", [[0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(3000)), [7] * 600])
def test_block_round_trip(ids):
    assert T.unpack_block(T.pack_block(np.array(ids, np.uint32))).tolist() == ids


def test_token_files(spark, docs, rows):
    files = T.write_tokens(docs, BYTE, end_id=0)
    got = sorted((tuple(r) for r in T.read_tokens(files).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    tok = Tokenizer.from_file(BYTE)
    want = []
    for doc, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((g[1:] for g in got), key=key) == sorted(want, key=key)
    assert [g[1] for g in got if g[1] is not None] == sorted(w[0] for w in want if w[0] is not None)  # ascending, nulls first
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n


def test_a_doc_id_that_fills_several_shards_is_dealt_to_them(spark):
    rows = [(i if i % 3 else None if i % 2 else 7, f"text {i} {i * i}") for i in range(300)]
    files = T.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), BYTE)
    got = sorted(tuple(r) for r in T.read_tokens(files).select("start", "doc_id", "n_tokens", "shard").collect())
    key = lambda d: -(1 << 63) if d is None else d
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=key)
    assert [g[0] for g in got] == [0, *np.cumsum([g[2] for g in got])[:-1].tolist()]
    per = {d: len({g[3] for g in got if g[1] == d}) for d in (None, 7)}
    if int(spark.conf.get("spark.sql.shuffle.partitions")) >= 8:
        assert min(per.values()) > 1


def test_partitions_grow_with_the_input(spark, docs, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions_for(docs) == least  # no statistics: measured
    docs.write.parquet(str(tmp_path / "t"))
    assert partitions_for(spark.read.parquet(str(tmp_path / "t"))) == least
    assert partitions_for(docs, 1) == min(max(least, input_bytes(docs)), MOST_PARTITIONS)


def test_random_access(spark, docs):
    path = T.write_tokens(docs, BYTE).orderBy("shard").first()["path"]
    f = T.TokenFile(path)
    n = int(f.doc_first[-1])
    whole = f.read(0, n)
    for i in (0, 1, n // 3, n // 2, n - 1):
        assert f.token(i) == whole[i]
    assert f.read(5, 5).tolist() == []


def test_special_and_odd_texts_encode_as_the_library_does():
    import pyarrow as pa

    tok, texts = Tokenizer.from_file(BYTE), ["", "a<|endoftext|>b", "a  b", "x ,y", ".a", "é×ß", "tab\tx\r\n", "İ\u0085", " lead", "trail ", "a.b,c\nd"]
    assert [x.tolist() for x in T.Encoder(BYTE).encode_column(pa.array([*texts, None]))] == [tok.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]


def test_no_documents(no_docs):
    assert T.read_tokens(T.write_tokens(no_docs, BYTE)).count() == 0
    assert media.read_media(media.store_media(no_docs)).count() == 0
    assert bpe.encode_decode(no_docs, WORD).count() == 0


# --- media ---


def test_media(docs, rows):
    manifest = media.store_media(docs)
    got = media.read_media(manifest).collect()
    assert len(got) == len(rows)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append((text or "").encode())
    for r in got:
        payloads = [t + b"\xff" * ((-len(t)) % 576 if t else 576) for t in texts[r["doc_id"]]]
        hit = [p for p in payloads if hashlib.sha256(p).hexdigest() == r["payload_sha256"]]
        assert hit and r["payload_bytes"] == len(hit[0]) == r["width"] * r["height"] and r["tail_crc32"] == zlib.crc32(hit[0][-32:])
        assert r["n_bytes"] <= r["payload_bytes"] and len(r["feature"]) == 16


def test_each_stored_copy_is_read_back(spark):
    docs = spark.createDataFrame([(i, "the same payload") for i in range(40)], "doc_id long, text string").repartition(2)
    manifest = media.store_media(docs).coalesce(1).sortWithinPartitions("shard")
    rows = manifest.collect()
    assert len({r["shard"] for r in rows}) == 2 and len({r["digest"] for r in rows}) == 1
    last = rows[-1]
    path = "/" + last["shard"].removeprefix("file:").lstrip("/")
    with open(path, "r+b") as f:
        f.seek(last["offset"] + last["length"] - 20)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="stored bytes differ"):
        media.read_media(manifest).collect()


def test_shards_are_tar_files(docs):
    r = media.store_media(docs).first()
    data = open_shared(r["shard"]).readall()
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        members = {m.name: m for m in t.getmembers()}
        m = members[r["digest"] + ".png"]
        assert m.offset_data == r["offset"] and m.size == r["length"]
        assert hashlib.sha256(t.extractfile(m).read()).hexdigest() == r["digest"]


def test_png_round_trip():
    for payload in (b"\xff" * 576, bytes(range(256)) * 9):
        assert media.from_png(media.to_png(payload)) == payload
    with pytest.raises(ValueError):
        media.png_size(b"x" * 33)


# --- BPE ---


def test_bpe_equals_the_library(docs, rows):
    tok = Tokenizer.from_file(WORD)
    want = []
    for doc, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encode_decode(docs, WORD).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_bpe_cases():
    tok, b = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    texts = ["aaaaaaaa zzzz", "I'll DON'T 'S", "<|startoftext|>a<|endoftext|>", "ΑΣ Σ", "Á", "!!!???", "12 345", "x" * 3000, "a b", "ǅ İstanbul"]
    assert [x.tolist() for x in b.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for t, ids in zip(texts, b.encode(texts), strict=True):
        assert b.decode(ids) == tok.decode(ids.tolist(), skip_special_tokens=False), t


def test_bpe_of_every_kind_of_character():
    """Every character that unicodedata does not know up to U+31FFF, and every fifth of all others."""
    import unicodedata

    tok, b = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and (c % 5 == 0 or c < 0x32000 and unicodedata.category(chr(c)) == "Cn")]
    texts = [f"Ab{chr(c)}cd 9{chr(c)}" for c in points]
    for lo in range(0, len(texts), 20_000):
        want = [e.ids for e in tok.encode_batch(texts[lo : lo + 20_000], add_special_tokens=False)]
        assert [x.tolist() for x in b.encode(texts[lo : lo + 20_000])] == want


@pytest.mark.parametrize("n", [510, 512, 513, 10_000, 80_000])
def test_bpe_of_long_words(n):
    import random
    import time

    rng = random.Random(n)
    tok, b = Tokenizer.from_file(WORD), bpe.WordBPE(WORD)
    for word in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)), "x" * n, "the" * (n // 3), "é" * (n // 2)):
        began = time.perf_counter()
        ids = b.encode([f"a {word} b"])[0].tolist()
        assert time.perf_counter() - began < 5
        assert ids == tok.encode(f"a {word} b", add_special_tokens=False).ids


def test_media_columns_equal_brute_force(spark, docs, rows):
    """Every column, from the rows that the query returns; equal texts give equal values."""
    rows = [*rows, (4000, "twin"), (4001, "twin")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = media.read_media(media.store_media(df)).collect()
    want = []
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        lines = b"".join(b"\0" + payload[i : i + 576] for i in range(0, len(payload), 576))
        png = media._SIGNATURE
        for kind, data in ((b"IHDR", (576).to_bytes(4, "big") + (len(payload) // 576).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])), (b"IDAT", zlib.compress(lines, 6)), (b"IEND", b"")):
            png += len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
        n = len(payload)
        cuts = [64 * 0 + i * n // 64 for i in range(65)]
        bits = "".join(str(int(sum(payload[a:b]) * n > sum(payload) * (b - a))) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        want.append((doc, len(raw), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), f"{int(bits, 2):016x}"))
    have = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["length"], r["digest"], r["feature"]) for r in got]
    assert sorted(have, key=key) == sorted(want, key=key)
    assert len({(r["digest"], r["feature"]) for r in got if r["doc_id"] in (4000, 4001)}) == 1
