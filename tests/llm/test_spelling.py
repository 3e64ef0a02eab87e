import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from touchgrid.llm import queries, spelling as S


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(vocab, factor=2):
    near = defaultdict(list)
    words = sorted(vocab)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and one_apart(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= factor * vocab[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, vocab[w], len(near[w]), vocab[form[w]] if form[w] else None))
    return out


def counted(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def noise(rng, n):
    stems = ["other", "ering", "à×÷ÿa", "aaaaa", "abcde", "mmnnoo", "straße"]
    out = []
    for _ in range(n):
        w = list(rng.choice(stems))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
            i = rng.randrange(len(w) + 1)
            kind = rng.random()
            if kind < 0.4:
                w.insert(i, rng.choice("abemnoÀ"))
            elif kind < 0.7 and i < len(w):
                w[i] = rng.choice("abemnoÿ")
            elif i < len(w) and len(w) > 3:
                del w[i]
        out.append("".join(w))
    return out


def test_query_against_brute_force(spark, tmp_path, rows):
    rng = random.Random(3)
    texts = [(i, rng.choice([" ", "\n", "-", "ｘ", "Ā"]).join(noise(rng, 60)).replace("o", rng.choice("oO"))) for i in range(120)]
    texts += [*rows, (None, "Hello HELLO hello"), (5, None), (7, "w" * 50)] + [texts[0]] * 2
    spark.createDataFrame([(d, t, 1, "x") for d, t in texts], "doc_id long, text string, n int, word string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_spelling_variants(spark, str(tmp_path)).collect()))
    want = brute(counted(texts))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want)  # chains occur


@pytest.mark.parametrize("seed", range(3))
def test_groups_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = {w: rng.choice([3, 3, 5, 6, 6, 12, 24, 50, 100, 200]) for w in noise(rng, 900)}
    got = sorted(map(tuple, S.group_variants(spark.createDataFrame(list(vocab.items()), "word string, n long")).collect()))
    assert got == brute(vocab)


def test_keys_are_equal_for_equal_words_only():
    rng = random.Random(8)
    words = sorted(set(noise(rng, 400)) | {"a", "aa", "日本語", "\U0001f600b"})
    which, kinds, keys = S.word_keys(words, (17, 23))
    meaning = defaultdict(set)
    rows = defaultdict(list)
    for w, k, a, b in zip(which.tolist(), kinds.tolist(), *keys.tolist(), strict=True):
        rows[w, k].append((a, b))
    for i, w in enumerate(words):
        assert len(rows[i, S._SELF]) == 1
        assert len(rows[i, S._WILD]) == len(w)
        cuts = list(dict.fromkeys(w[:j] + w[j + 1 :] for j in range(len(w))))
        assert len(rows[i, S._DELETED]) == len(cuts)
        for j, k in enumerate(rows[i, S._WILD]):
            meaning[k].add(w[:j] + "\0" + w[j + 1 :])
        for k, s in zip(rows[i, S._DELETED], cuts, strict=True):
            meaning[k].add(s)
        meaning[rows[i, S._SELF][0]].add(w)
    assert all(len(m) == 1 for m in meaning.values())
    assert len(meaning) == len({next(iter(m)) for m in meaning.values()})


def test_long_words_and_long_texts(spark):
    long = "ab" * 150_000
    rows = [(i, long + (" pre " if i else "x pre ")) for i in range(4)] + [(9, ("alpha beta-" * 120_000)[:-1]), (10, "z" * 1_500_000)]
    counts = S.document_words(spark.createDataFrame(rows, "doc_id long, text string"), spoil=1 << 40)
    vocab = {r.word: r.n for r in S.vocabulary(counts, least_count=1).collect()}
    assert vocab == {long: 3, long + "x": 1, "alpha": 120_000, "z" * 1_500_000: 1}
    got = {r.word: (r.form, r.n_near) for r in S.group_variants(S.vocabulary(counts, least_count=1)).collect()}
    assert got == {long: (None, 1), long + "x": (long, 1), "alpha": (None, 0), "z" * 1_500_000: (None, 0)}


def test_empty_tables(spark, no_docs):
    assert S.group_variants(S.vocabulary(S.document_words(no_docs))).count() == 0
    with pytest.raises(ValueError, match="twice"):
        S.group_variants(spark.createDataFrame([], "word string, n long"), factor=1)
