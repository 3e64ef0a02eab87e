import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from touchgrid.llm import decontaminate as D, lines, phrases, simhash

WS = re.compile("[^\x20\x09-\x0d]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}
NULL = -(1 << 63)


def key(r):
    return str(r)


# --- lines ---


def brute_lines(rows, s=0.8):
    """(doc_id, n_lines, n_removed, n_links, kept) by comparing all pairs of distinct sets."""
    places = []
    for doc, text in dict.fromkeys(rows):
        for i, line in enumerate((text or "").split("\n")):
            if w := frozenset(WS.findall(line)):
                places.append(((NULL if doc is None else doc, i), text, w))
    first = {}
    for at, _, w in places:
        first[w] = min(at, first.get(w, at))
    sets, links, near = list(first), defaultdict(int), {}
    for i, a in enumerate(sets):
        for b in sets[i + 1 :]:
            if len(a & b) / len(a | b) >= s - 1e-9:
                for x, y in ((a, b), (b, a)):
                    links[x] += 1
                    near[x] = min(first[y], near.get(x, first[y]))
    gone, linked = defaultdict(set), defaultdict(int)
    counted = set()  # lines that tie for the first place all count
    for at, text, w in places:
        if at != first[w] or near.get(w, at) < at:
            gone[at[0], text].add(at[1])
        if at == first[w] and (w, text) not in counted:
            counted.add((w, text))
            linked[at[0], text] += links[w]
    out = []
    for doc, text in rows:
        k = (NULL if doc is None else doc, text)
        parts = [] if text is None else text.split("\n")
        out.append((doc, len(parts), len(gone[k]), linked[k], "\n".join(x for i, x in enumerate(parts) if i not in gone[k])))
    return out


def test_lines_equal_all_pairs(docs, rows):
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["n_links"], r["kept_sha256"]) for r in lines.remove_lines(docs).collect()]
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest()) for r in brute_lines(rows)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_line_groups_over_a_block(spark):
    base = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(base[:28] + [f"u{i}", f"v{i}"])) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = lines._keyed(df).drop("rest")
    seeds = lines.new_seeds()
    codes = spark.sparkContext.broadcast(lines.rarity(keyed, seeds))
    out = lines.screen(keyed, codes, seeds)
    edges = out.filter("kind = 0").selectExpr("s1 as a", "s2 as b")
    roots = simhash.components(edges).withColumnRenamed("node", "s1")
    possible = out.filter("kind = 2").select("s1", "s2", "doc", "text_hash", "line").join(roots, "s1")
    sets = lines.fetch_sets(keyed, possible)
    small, large = (sorted(map(tuple, lines.matches(sets, block=b).collect())) for b in (16, 2048))
    assert small == large and len(small) == 90 and {r[4] for r in small} == {89}


def test_lines_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b c\nd e", "x", 9, "h"), (2, "a b c", "y", 5, "h"), (3, None, "z", 0, "h")], "doc_id long, text string, line string, n_chars long, text_hash string")
    got = {r["doc_id"]: r for r in lines.without_later_lines(df).collect()}
    assert set(got) == {1, 3} and got[1]["line"] == "x" and got[1]["text_hash"] == "h" and lines.without_later_lines(df).columns == df.columns


def test_no_lines(no_docs):
    assert lines.remove_lines(no_docs).count() == 0


# --- phrases ---


def brute_phrases(rows, k=13):
    firsts = {}
    for doc, text in rows:
        w = WS.findall(text or "")
        for i in range(len(w) - k + 1):
            if doc is not None:
                firsts[tuple(w[i : i + k])] = min(doc, firsts.get(tuple(w[i : i + k]), doc))
    out = []
    for doc, text in rows:
        w, gone = WS.findall(text or ""), set()
        for i in range(len(w) - k + 1):
            if doc is not None and firsts[tuple(w[i : i + k])] < doc:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "shard_bytes"), [(phrases.HOT, phrases.SHARD_BYTES), (2, 3000)])
def test_phrases_equal_brute_force(spark, rows, hot, shard_bytes):
    # negative doc_ids, a text of one word, and its parts in many documents
    rows = [*rows, (-5, rows[5][1]), (-7, "x " * 90), *((2000 + i, "y " * i + rows[1008 % len(rows)][1] if i % 3 else "x " * (20 + i)) for i in range(40)), (2100, "q r " * 60), (2101, "r q " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in phrases.remove_repeats(docs, hot=hot, shard_bytes=shard_bytes).collect()]
    want = brute_phrases(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[2] for r in want) > 300


def test_positions_come_from_the_automaton(docs):
    assert sum(r["n_removed"] for r in phrases.remove_repeats(docs).collect()) > 300
    found = phrases._Automaton({b"a b c": 7, b"b c d": 3, b"b c": 9})
    assert sorted(found.find(b"x a b c d b c".split())) == [(1, 3, 7), (2, 2, 9), (2, 3, 3), (5, 2, 9)]
    assert phrases._Automaton({}).find([b"a"]) == []


def test_phrase_text(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "  a  " + "\t".join(words[2:18]) + " b")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in phrases.remove_repeats(df, with_text=True).collect()} == {1: " ".join(words), 2: "a b"}


def test_no_phrases(no_docs):
    assert phrases.remove_repeats(no_docs).count() == 0


def test_packed_anchors():
    h = np.sort(np.random.default_rng(0).integers(0, 1 << 48, 50).astype(np.uint64))
    for doc in (np.arange(50), np.arange(50) - 25, np.arange(50) << 40, -np.arange(50) << 40):
        for known in (np.zeros(50, bool), np.arange(50) % 3 == 0, np.ones(50, bool)):
            a, b, k = phrases._unpack(phrases._pack(h, doc.astype(np.int64), known))
            assert (a == h).all() and (k == known).all() and (b[~known] == doc[~known]).all()


# --- simhash ---


def fingerprint(text):
    w = WS.findall((text or "").translate(LOWER))
    parts = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, reach=2):
    """The least index of each component by all pairs."""
    low = list(range(len(prints)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= reach:
                x, y = sorted((root(i), root(j)))
                low[y] = x
    return [root(i) for i in range(len(prints))]


def test_simhash(docs, rows):
    prints = [fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    names = {}
    for (doc, _), g in zip(rows, root, strict=True):
        if doc is not None:
            names[g] = min(doc, names.get(g, doc))
    want = [(d, p - (p >> 63 << 64), names.get(g)) for (d, _), p, g in zip(rows, prints, root, strict=True)]
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("block", [4096, 8])
@pytest.mark.parametrize("groups", [4, 5])
def test_links_of_planted_fingerprints(spark, block, groups):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for _ in range(500):
        p = int(rng.choice(base))
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            p ^= 1 << int(b)
        prints.add(p)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (p >> 63 << 64),) for p in prints], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.link_fingerprints(df, groups, 2, block)).collect()}
    signed = [p - (p >> 63 << 64) for p in prints]
    root = brute_components(prints)
    groups_of = defaultdict(set)
    for s, g in zip(signed, root, strict=True):
        groups_of[g].add(s)
    want = {s: min(g) for g in groups_of.values() if len(g) > 1 for s in g}
    assert got == want and len(want) > 250


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    c = a ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    for x, y in ((a, b), (a, c)):
        m = simhash.manhattan(simhash.popcounts(x), simhash.popcounts(y))
        assert (m <= np.bitwise_count(x ^ y)).all()
        plain = sum(np.abs(np.bitwise_count(x >> np.uint64(2 * s) & np.uint64(3)).astype(int) - np.bitwise_count(y >> np.uint64(2 * s) & np.uint64(3)).astype(int)) for s in range(32))
        assert (m == plain).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(spark):
    t = "some words that are quite the same in both of these texts here"
    df = spark.createDataFrame([(5, t, "p"), (3, t, "q"), (9, "another text altogether, with its own words", "r"), (3, t, "q"), (None, t, "s"), (None, "no id at all but words", "t")], "doc_id long, text string, rest string")
    assert sorted((r["doc_id"] or 0, r["rest"]) for r in simhash.keep_one(df).collect()) == [(0, "t"), (3, "q"), (9, "r")]


def test_no_fingerprints(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


# --- decontamination ---


def brute_hits(rows, items, k=10):
    index = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(len(w) - min(k, len(w)) + 1) if w else ():
            index[tuple(w[i : i + min(k, len(w))])].add("" if name is None else str(name))
    out = []
    for doc, text in rows:
        w, hit, names = ALNUM.findall((text or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in index}:
            for i in range(len(w) - n + 1):
                if found := index.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.fixture(scope="module")
def items(rows):
    parts = ALNUM.findall(rows[5][1])
    return [(1, " ".join(parts[5:30])), (2, " ".join(parts[10:22]).upper()), (11, "nowhere to be found at all in any of those texts here"), (3, "a b"), (4, None), (5, "..."), (6, "x"), (None, " ".join(parts[8:19])), (2, " ".join(parts[10:22]))]


@pytest.mark.parametrize("block", [D.BLOCK_WINDOWS, 7])
def test_decontamination(spark, docs, rows, items, block):
    df = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in D.contamination_report(docs, df, block).collect()]
    want = brute_hits(rows, items)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(r[5] for r in want) > 5


@pytest.mark.parametrize("block", [D.BLOCK_WINDOWS, 7])
def test_clean_documents_stay_whole(spark, rows, items, block):
    df = spark.createDataFrame([(d, t, i, "k") for i, (d, t) in enumerate(rows)], "doc_id long, text string, at long, items string")
    its = spark.createDataFrame(items, "item_id long, text string")
    clean = [r[5] for r in brute_hits(rows, items)]
    out = D.keep_clean(df, its, block)
    assert out.columns == df.columns and sorted(r["at"] for r in out.collect()) == [i for i, bad in enumerate(clean) if not bad]


def test_a_window_of_many_items_fills_no_block(spark):
    shared = "ten words that stand in all of the many items"
    rows = [(i, f"{shared} own{i} end{i % 7}") for i in range(4000)]
    bench = D.Benchmark(spark.createDataFrame(rows, "item_id long, text string").repartition(5), 1000)
    sizes = [bench.block(i).count() for i in range(bench.blocks)]
    parts = bench.windows.select(F.spark_partition_id()).distinct().count()
    assert sum(sizes) == 1 + 2 * 4000 and max(sizes) <= 1000 + parts
    docs = [(1, f"a {shared} b"), (1, f"a {shared} b"), (2, f"{shared} own5 end5"), (None, "nothing"), (3, f"{shared} own6 end5")]
    for block in (1000, D.BLOCK_WINDOWS):
        got = D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "item_id long, text string"), block).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, len(r["items"])) for r in got) == [(0, 1, 0, 0), (1, 12, 10, 4000), (1, 12, 10, 4000), (2, 12, 12, 4000), (3, 12, 11, 4000)]


def test_contamination_of_a_text_over_a_slice_beside_clashing_columns(spark):
    item = "these are the ten words of the one benchmark item"
    text = "filler words " * 60_000 + item + " more" * 100_000
    df = spark.createDataFrame([(1, text, "x", 2, 3), (1, "clean", "x", 2, 3)], "doc_id int, text string, items string, n_hit int, number long")
    its = spark.createDataFrame([(7, item, "y")], "item_id int, text string, number string")
    assert sorted((r.n_words, r.n_hit, r["items"]) for r in D.find_contamination(df, its).collect()) == [(1, 0, []), (220_010, 10, ["7"])]
    assert [tuple(r) for r in D.keep_clean(df, its).collect()] == [(1, "clean", "x", 2, 3)]


def test_nothing_to_compare(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination_report(docs, none).filter("contaminated").count() == 0
    assert D.contamination_report(no_docs, none).count() == 0


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    g = D.grams(h, 5)
    at = set(D.winnowed(g, 6).tolist())
    assert all(any(i + j in at for j in range(6)) for i in range(len(g) - 5)) and len(at) < 0.45 * len(g)


def test_automaton_finds_every_place_and_begins_at_words_only():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 3000):  # of distinct words
        vocabulary = [f"w{i}".encode() for i in range(n)]
        text = [vocabulary[i] for i in rng.integers(0, n, 400)]
        at = {(int(a), int(k)) for a, k in zip(rng.integers(0, 380, 30), rng.integers(1, 20, 30), strict=True)}
        passages = {b" ".join(text[a : a + k]): a for a, k in sorted(at)}
        got = phrases._Automaton(passages).find([b"other", *text, b"other"])
        want = []
        for p, first in passages.items():
            seq = p.split(b" ")
            want += [(i + 1, len(seq), first) for i in range(len(text) - len(seq) + 1) if text[i : i + len(seq)] == seq]
        assert sorted(got) == sorted(want)
    assert phrases._Automaton({}).find([b"a"]) == []
