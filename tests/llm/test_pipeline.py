import random
import re
import zlib
from collections import Counter

import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from touchgrid.llm import near_copies, queries


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "encode"]
    have = docs
    for name, stage in C.STAGES:
        out = stage(spark, have, sf).cache()
        if name != "encode":
            assert out.columns == docs.columns and out.schema == docs.schema
            assert out.join(have, "doc_id", "left_anti").count() == 0
        have = out
    ids = sorted(r["doc_id"] for r in have.collect())
    assert 0 < len(ids) < docs.count() and ids == sorted(r["doc_id"] for r in C.run(spark, sf).collect())


def test_every_query_runs_on_whole_tables(spark, sf):
    pages, docs = spark.read.parquet(f"{sf}/pages.parquet").count(), spark.read.parquet(f"{sf}/documents.parquet").count()
    words = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            words[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    for name, q in queries.queries().items():
        found = q(spark, sf)
        if name.startswith("op12_"):  # a row a node: the root holds all conversations, the ends of all nodes are all of them
            convs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
            assert [r.n_convs for r in found.where("depth = 0").collect()] == [convs]
        elif name.startswith("op13_"):  # a row a word
            assert {r.word: r.n for r in found.collect()} == {w: n for w, n in words.items() if len(w) >= 5 and n >= 3}
        else:
            assert found.count() == (pages if name.startswith("op6_") else docs), name


CLASHES = {"rest": "'r'", "text_hash": "7L", "doc": "doc_id", "line": "1", "kept": "true", "component_id": "3L", "items": "array(1)", "_id": "doc_id", "n_hit": "0"}


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_pass_all_stages(spark, sf, rows, empty):
    """Nulls, empty and long texts, ties, repeats and clashing names go through the stages in turn; an empty table does, too."""
    docs = spark.createDataFrame([] if empty else [*rows, (1, "x y " * 100_000)], "doc_id long, text string").selectExpr("doc_id", "text", *(f"{v} as `{k}`" for k, v in CLASHES.items()))
    have = docs
    for name, stage in C.STAGES:
        out = stage(spark, have, sf).cache()
        if name != "encode":
            assert out.columns == docs.columns and out.count() <= have.count()
            for r in out.select("doc_id", "doc", "rest", "kept").collect():
                assert r["doc_id"] == r["doc"] and r["rest"] == "r" and r["kept"]
        else:
            assert out.count() == have.count()
        have = out
    assert empty == (have.count() == 0)


def test_near_dedup_catches_near_copies(spark, sf):
    """Of planted near copies (Jaccard of five-word shingles 0.8 or more) at least nine in ten leave; clean documents stay."""
    rng = random.Random(2)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows, planted, clean = [], set(), set()
    for g in range(60):
        base = words(rng.choice([60, 150, 400]))
        rows.append((g * 10, " ".join(base)))
        clean.add(g * 10)
        for c in range(1, 4):
            copy = list(base)
            for _ in range(max(1, len(copy) // 70)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, copy))
            rows.append((g * 10 + c, " ".join(copy)))
            if len(a & b) >= 0.8 * len(a | b):
                planted.add(g * 10 + c)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    kept = {r["doc_id"] for r in C.near_dedup(spark, docs, sf).collect()}
    assert len(planted) > 100 and len(planted - kept) >= 0.9 * len(planted) and clean <= kept
    assert near_copies.SHINGLE == 5 and near_copies.SIMILARITY == 0.8
