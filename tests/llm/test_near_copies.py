import random

import numpy as np
import xxhash

from touchgrid.llm import near_copies as N, simhash


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def one_of_each(rows):
    """The rows that brute force keeps, by components of Jaccard 0.8 on five-word shingles."""
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    best = {}
    for i, (d, t) in enumerate(rows):
        best.setdefault(find(i), []).append(((d is None, d or 0), t))
    return best


def near_rows():
    rng, rows = random.Random(5), []
    for g in range(40):
        base = prose(rng, rng.choice([20, 60, 200, 700])).split()
        for c in range(4):
            w = list(base)
            for _ in range(c * rng.choice([1, len(w) // 60 + 1])):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((g * 10 + c, " ".join(w)))
    return rows


def check(spark, rows):
    got = N.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = one_of_each(rows)
    assert len(got) == len(want)
    first = [min(m)[0] for m in map(lambda m: [(x,) for x, _ in m], want.values())]
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(None if null else d) for null, d in first)
    return got


def test_near_copies_leave(spark):
    rows = near_rows()
    stay = len(check(spark, rows))
    # two bits of three-word shingles leave more
    assert stay < simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).count() <= len(rows)


def test_odd_texts(spark, rows):
    check(spark, rows)


def test_large_groups_meet_in_blocks(spark):
    rows = near_rows()
    keys = [np.unique(np.array([xxhash.xxh64_intdigest(" ".join(x)) >> 14 for x in shingle_set(t)], np.uint64)) for _, t in rows]
    df = spark.createDataFrame([(0, i, k.tobytes()) for i, k in enumerate(keys)], "root long, s1 long, data binary")
    count = lambda edges: len(rows) - N.components(edges).select("root").distinct().count()
    small, whole = N.links(df, df, block=16), N.links(df, df)
    key = lambda e: sorted((r["node"], r["root"]) for r in N.components(e).collect())
    assert key(small) == key(whole) and count(whole) > 0


def test_no_documents(spark, no_docs):
    assert N.keep_one(no_docs).count() == 0


def test_few_unlike_pairs_are_compared_whole(monkeypatch):
    """Of long unlike sets in one group parity bits tell none apart; their sketches do."""
    rng = np.random.default_rng(5)
    n = np.full(41, 900)
    key = rng.permutation(n.sum()).astype(np.uint64)
    key[40 * 900 : 40 * 900 + 890] = key[:890]  # the last set matches the first
    whole, match = [], N._matching
    monkeypatch.setattr(N, "_matching", lambda key, first, n, i, j, s: whole.append(len(i)) or match(key, first, n, i, j, s))
    group = np.zeros(41, np.int64)
    low = N._linked(key, n, group, group, group.astype(bool), 0.8)
    assert low.tolist() == [*range(40), 0] and sum(whole) <= 5


def test_counters_follow_the_input():
    assert N.counters_for(0) == N.counters_for(1 << 20) == N.COUNTERS
    assert N.counters_for(800 << 20) == 1 << 25 == N.counters_for(1 << 40)
