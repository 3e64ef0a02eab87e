import random

import pytest

WORDS = [w + s for w in ("tha", "ero", "ing", "sch", "él", "ño", "ber", "ond", "ati", "que") for s in ("", "ne", "rt", "lé", "so", "ß", "x", "ti", "ka", "mo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empty and odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    rows = []
    for i in range(n):
        kind = i % 10
        if kind == 3 and rows:
            text = rng.choice(rows)[1]
        elif kind == 4 and rows:
            base = (rng.choice(rows)[1] or "a b c d e f g h i j k").split(" ")
            base[rng.randrange(len(base))] = "changed"
            text = " ".join(base)
        elif kind == 5:
            text = prose(rng, rng.randrange(30)) + " " + passage + "\n" + prose(rng, rng.randrange(30))
        else:
            text = "\n".join(prose(rng, rng.randrange(1, 25)) for _ in range(rng.randrange(1, 6)))
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "a b"), (1005, "x " * 400), (1006, "İΣ ﬁ 日本語 \U0001f600 Á   it's 12½"), (1007, "\n\n\nword\n\n"), (1008, prose(rng, 5000))]
    rows += [rows[0], (rows[1][0], rows[2][1]), (None, rows[5][1]), (None, "lonely text without an id")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
