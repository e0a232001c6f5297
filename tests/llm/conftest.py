import random

import pytest


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose, exact and near copies, shared passages, and the odd cases."""
    rows = [(i, prose(i, 40 + i * 7)) for i in range(20)]
    base = prose(99, 300, 5000)
    rows += [(30 + i, base) for i in range(3)]
    for i in range(8):
        words = base.split()
        for k in range(i):
            words[(k * 37 + i) % 300] = f"new{i}x{k}"
        rows.append((40 + i, " ".join(words)))
    passage = prose(7, 90, 9000)
    rows += [(60 + i, prose(200 + i, 30) + " " + passage + " " + prose(300 + i, 20)) for i in range(4)]
    rows += [(70, ""), (71, None), (72, " \n\t "), (73, "one"), (74, "one two"), (75, "ONE two"), (76, "é ß 漢字 \U0001f600 naïve"), (77, "a" * 3000), (78, "a b " * 2000), (79, prose(5, 9000, 100_000)), (80, "%%% 123 ...")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, and columns named as operators name theirs."""
    names = "shard slot score predicted kept n_words lang_pred sequence_id offset ids row block root sid n".split()
    rows = [(None, None), (None, "some words here"), (1, "same text"), (1, "same text"), (2, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, t, None, None, None, *["x"] * len(names)) for i, t in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
