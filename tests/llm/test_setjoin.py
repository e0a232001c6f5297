import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rulewright.llm import setjoin
from rulewright.llm.graph import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i), doc)) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(seed, members, words, most, chain=False):
    """Copies of a text with up to ``most`` words changed, of the original or of the copy before."""
    r = random.Random(seed)
    base = [f"b{seed}x{r.randrange(10**6)}" for _ in range(words)]
    out, last = [], base
    for _ in range(members):
        w = list(last if chain else base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        if r.random() < 0.2:
            w = w[: len(w) - r.randint(1, 1 + words // 15)]
        out.append(" ".join(w))
        last = w
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_are_exact(spark, corpus, width, percent):
    texts = [t for _, t in corpus]
    for seed, (members, words, most, chain) in enumerate([(40, 60, 3, False), (40, 150, 9, False), (30, 100, 2, True), (25, 400, 20, False), (20, 25, 2, False), (30, 12, 1, False)]):
        texts += family(seed, members, words, most, chain)
    random.Random(0).shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in setjoin.join_documents(df, width, percent).collect()), key=repr)
    assert got == brute(rows, width, percent)


def test_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in setjoin.join_documents(odd, 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)
    assert setjoin.join_documents(none, 3, 90).collect() == []
    kept = setjoin.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 5


def test_one_document_of_each_component_stays(spark):
    """Repeated ids: a unique text of an id whose other row is a near copy; near copies of one id, and of null ids."""
    words = [[f"{c}{i}" for i in range(200)] for c in "abcde"]
    copy = lambda k: " ".join([*words[k][:-1], "changed"])
    a, b, c, d, unique = (" ".join(w) for w in words)
    rows = [(1, a), (2, copy(0)), (2, unique), (3, b), (3, copy(1)), (None, c), (None, copy(2)), (None, d), (9, copy(3))]
    left = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(1, a), (2, unique), (9, copy(3))} <= {tuple(r) for r in left} and len(left) == 5
    assert sum(r.doc_id == 3 for r in left) == 1 and sum(r.doc_id is None for r in left) == 1


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(0, 14), st.sampled_from([80, 90]))
def test_linked_sets_share_a_block(seed, size, changes, percent):
    r = np.random.default_rng(seed)
    x = np.unique(r.integers(0, 2**64, size, dtype=np.uint64))
    y = np.unique(np.concatenate([x[changes // 2 :], r.integers(0, 2**64, changes - changes // 2, dtype=np.uint64)]))
    d = len(np.setxor1d(x, y))
    ranks = r.integers(0, 4, 1 << 10).astype(np.uint8)
    first, bounds = setjoin.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), percent, ranks)
    starts, blocks = setjoin.scale(percent), []
    for own, a, b in zip((x, y), bounds[:-1], bounds[1:], strict=True):
        nth = np.searchsorted(starts, len(own) - np.arange(b - a), "right")
        blocks.append({(e, n + k) for e, n in zip(first[a:b].tolist(), nth.tolist(), strict=True) for k in (0, 1)})
    if len(x) and len(y) and d <= setjoin.allowance(len(x) + len(y), percent):
        assert blocks[0] & blocks[1]


def doubled(times):
    """A word of a and b and its complement, which agree in every polynomial hash modulo a power of two."""
    x, y = "a", "b"
    for _ in range(times):
        x, y = x + y, y + x
    return x, y


def test_words_of_no_common_hash(spark):
    x, y = doubled(10)
    rows = [(i, f"one two three {w} five six seven") for i, w in ((1, x), (2, y), (3, "four"))] + [(4, x), (5, y), (6, y)]
    got = sorted(tuple(r) for r in setjoin.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == brute(rows, 3, 90) and [r[2] for r in got] == [1, 2, 3, 4, 5, 5]


@pytest.mark.parametrize("with_base", [False, True])
def test_stars(spark, with_base):
    """Copies of one text that link to it but not to each other, with and without it, beside a chain."""
    base = [f"b{i}" for i in range(80)]
    rows = [(1000, " ".join(base))] * with_base
    for i in range(70):
        w = list(base)
        w[i] = f"own{i}"
        w[(i * 7 + 9) % 80] = f"too{i}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, t) for i, t in enumerate(family(5, 30, 90, 2, True))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in setjoin.join_documents(df, 3, 90).collect()), key=repr)
    assert got == brute(rows, 3, 90)


def test_graph(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert {x.id: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_pairs_in_slices(spark, corpus, monkeypatch):
    """Pairs compared slice by slice give the same components, and the shuffles of a written table don't outlive its write."""
    monkeypatch.setattr(setjoin, "RELATED", 2)
    names, left, write = [], [], setjoin.materialize
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffles():
        blocks = manager.getAllBlocks()
        return {x for x in (blocks.apply(i).toString() for i in range(blocks.size())) if x.startswith("shuffle")}

    def watched(df, name):
        before = shuffles()
        out = write(df, name)
        names.append(name)
        for _ in range(50):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        else:
            left.append(name)
        return out

    monkeypatch.setattr(setjoin, "materialize", watched)
    rows = list(enumerate([t for _, t in corpus] + family(0, 20, 60, 3)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in setjoin.join_documents(df, 3, 90).collect()), key=repr) == brute(rows, 3, 90)
    assert ("relations", "relations") in zip(names, names[1:], strict=False) and not left


@pytest.mark.parametrize("few", [True, False])
def test_ends_of_few_pairs_take_no_python_worker(spark, monkeypatch, few):
    """Sets of few pairs may share a stage with the Python step that compares them; of many pairs all wanted sets come through."""
    monkeypatch.setattr(setjoin, "SMALL", 40 if few else 39)
    df = spark.createDataFrame([(i, i % 1000, "x" * (i % 7)) for i in range(3000)], "block long, sid long, text string")
    found = setjoin._described(df, df.where("block < 40").select(F.col("sid").alias("a")), "a")
    assert ("MapInArrow" in found._jdf.queryExecution().toString()) != few
    assert found.dtypes == df.dtypes
    rows = sorted(map(tuple, found.collect()))
    wanted = sorted(tuple(x) for x in df.collect() if x.sid < 40)
    assert rows == wanted if few else set(wanted) <= set(rows)
