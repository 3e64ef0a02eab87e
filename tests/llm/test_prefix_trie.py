import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from touchgrid.llm import prefix_trie as P, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]), (role, text)))
    convs = {c: [t for _, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, held in members.items():
        below = [x for x in members if x[: len(node)] == node]
        child = lambda x: [y for y in members if len(y) == len(x) + 1 and y[: len(x)] == x]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(node))))
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(child(node)), sum(not child(x) for x in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([*range(60), 1000, 1001, -7, -40])
        rows.append((c, rng.choice([None, 0, 1, 2, 3, 3, 9]), rng.choice(["user", "assistant", None]), rng.choice(["a b", "a  b c", "", None, "x\ty\n", "ü  z"])))
    return rows + [(None, 1, "user", "no conversation"), *rows[:5]]


def key(r):
    return tuple((x is not None, x if x is not None else 0) for x in r)


def answer(spark, rows, tmp_path, monkeypatch, parts):
    spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("words", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    trie = P.prefix_trie
    monkeypatch.setattr(P, "prefix_trie", lambda arrays: trie(arrays, parts))
    found = queries.op12_prefix_trie(spark, str(tmp_path))
    assert found.columns == list(P._COLUMNS)
    return sorted(map(tuple, found.collect()), key=key)


@pytest.mark.parametrize(("seed", "n", "parts"), [(1, 150, 1), (2, 150, 7), (3, 300, 40), (4, 40, 3)])
def test_nodes_against_brute_force(spark, tmp_path, monkeypatch, seed, n, parts):
    rows = made(seed, n)
    assert answer(spark, rows, tmp_path, monkeypatch, parts) == sorted(nodes(rebuilt(rows)), key=key)


def test_copies_and_one_first_turn_over_many_parts(spark, tmp_path, monkeypatch):
    rows = [(c, t, "user", "the same" if t == 0 or c % 3 else f"own {c % 5}") for c in range(0, 4000, 20) for t in range(3)]
    assert answer(spark, rows, tmp_path, monkeypatch, 25) == sorted(nodes(rebuilt(rows)), key=key)


def test_no_conversations_and_null_ids(spark, tmp_path, monkeypatch):
    assert answer(spark, [(None, 1, "user", "x")], tmp_path, monkeypatch, None) == []


def test_sums_add_up_however_the_parts_are_cut(tmp_path):
    rng = random.Random(9)
    rows = sorted((b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(6))), c) for c in range(120))
    rows = [(k, c, [3] * (len(k) // 16)) for k, c in rows]
    whole = list(P.sweep(iter(rows), None, None))
    assert all(r[0] is None for r in whole)
    for _ in range(20):
        cuts = sorted(rng.sample(range(1, 120), rng.randrange(1, 30)))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, 120], strict=True)]
        got = defaultdict(lambda: [0, 0, 0, 0])
        for i, part in enumerate(parts):
            before, after = parts[i - 1][-1][0] if i else None, parts[i + 1][0][0] if i + 1 < len(parts) else None
            for name, _, conv, depth, _, *sums, sha, _ in P.sweep(iter(part), before, after):
                at = (name,) if name else (conv, depth, sha)
                got[at] = [a + b for a, b in zip(got[at], sums, strict=True)]
        assert sorted(got.values()) == sorted(list(r[5:9]) for r in whole)


def test_lcp():
    a = bytes(range(64))
    assert [P.lcp(a, a), P.lcp(a, a[:32]), P.lcp(a, a[:17] + b"?" * 20), P.lcp(b"", a), P.lcp(None, a), P.lcp(a, None)] == [4, 2, 1, 0, -1, -1]
