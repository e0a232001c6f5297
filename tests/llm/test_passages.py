import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rulewright.llm import inducedsort, passages


def brute_marks(segments, width):
    count = Counter(s[i : i + width] for s in segments for i in range(len(s) - width + 1))
    return [[i + width <= len(s) and count[s[i : i + width]] > 1 for i in range(len(s))] for s in segments]


@pytest.mark.parametrize("memory", [0, 1 << 14, 1 << 20])
def test_sorter_gives_suffixes_and_common_prefixes(memory):
    r = random.Random(3)
    for t in range(60):
        kinds, size = r.choice([1, 2, 4, 200]), r.choice([10, 150, 900])
        text = [r.randrange(kinds) + 2 for _ in range(r.randint(1, size))] + [0]
        if t % 3 == 0:
            text = text[:-1] * 3 + [0]
        array = np.array(text + [0] * 4, np.int16)
        runs = list(inducedsort.Sorter(array, len(text), 5000, inducedsort.Scratch(memory)).descending())
        order = np.concatenate([p for p, _ in runs]).tolist()
        assert order == sorted(range(len(text)), key=lambda i: text[i:])[:0:-1]
        prefixes = np.concatenate([x for _, x in runs]).tolist()
        for k in range(1, len(order)):
            a, b, n = order[k - 1], order[k], 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            assert prefixes[k] == n


def test_shards_far_larger_than_memory():
    """128 KB in memory, 250 KB of text: names are sorted by recursion, and tuples and arrays go to disk."""
    import tracemalloc

    r = np.random.default_rng(5)
    base = r.integers(97, 101, 90_000, dtype=np.uint8)
    segments = [base.tobytes(), base[20_000:70_000].tobytes() + b"!" + base[:30_000].tobytes(), r.integers(97, 99, 40_000, dtype=np.uint8).tobytes(), b"ab" * 20_000]
    width = 60
    expected = brute_marks(segments, width)
    tracemalloc.start()
    got = inducedsort.repeated(segments, width, memory=128 << 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x.tolist() for x in got] == expected
    assert peak < 3 << 20  # in memory, positions and prefixes of 250 KB alone take more


def test_repeated_in_memory_and_on_disk():
    r = random.Random(1)
    for _ in range(120):
        sigma = r.choice([1, 2, 3, 256])
        segments = [bytes(r.randrange(sigma) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 6))]
        segments += [segments[0][3:20] * 2] if segments else []
        width = r.choice([1, 3, 8])
        for memory in (0, 1 << 20):
            assert [x.tolist() for x in inducedsort.repeated(segments, width, memory)] == brute_marks(segments, width)


def expected(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc, _), text, mark in zip(rows, texts, brute_marks(texts, width), strict=True):
        covered = np.zeros(len(text) + 1, bool)
        for i in np.flatnonzero(mark):
            covered[i : i + width] = True
        edges = np.diff(np.concatenate([[0], covered[:-1].astype(int)]))
        out.append((doc, len(text), int(covered.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(text, np.uint8)[~covered[:-1]].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def result(df, width):
    from pyspark.sql import functions as F

    cut = {(r.k1, r.k2): r for r in passages.cut_texts(df.select(F.coalesce("text", F.lit("")).alias("text")), width).collect()}
    out = []
    for r in df.select("doc_id", "text", *passages.keys(F.coalesce("text", F.lit("")))).collect():
        data, c = (r.text or "").encode(), cut.get((r.k1, r.k2))
        out.append((r.doc_id, len(data), c.n_removed if c else 0, c.n_spans if c else 0, hashlib.sha256(c.kept if c else data).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_cuts_are_exact(spark, corpus, hot, monkeypatch):
    monkeypatch.setattr(passages, "HOT", 1 if hot else 5000)
    r = random.Random(6)
    shared = "".join(r.choice("abcdefgh ") for _ in range(700))
    rows = corpus + [(300 + i, "".join(r.choice("xyz ") for _ in range(150)) + shared[i * 20 : 700 - i * 13] + "é" * i) for i in range(12)]
    rows += [(400, "q" * 399), (401, "q" * 399), (402, shared[:399]), (403, shared[100:500]), (404, "é漢" * 300 + "!"), (405, "é漢" * 290)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(df, 400) == expected(rows, 400)
    if not hot:
        assert result(df, 100) == expected(rows, 100)


def test_rows_keep_their_columns(odd, none, spark):
    assert sorted(map(repr, passages.remove_repeats(odd).collect())) == sorted(map(repr, odd.collect()))
    assert passages.remove_repeats(none).collect() == []
    rows = [(1, "x" + "ab" * 300, "k"), (1, "x" + "ab" * 300, "k"), (2, "short", None)]
    got = passages.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, k1 string")).collect()
    assert sorted((r.doc_id, r.text, r.k1) for r in got if r.k1) == [(1, "", "k"), (1, "", "k")] and len(got) == 3
