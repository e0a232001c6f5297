import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rulewright.llm import sharding
from rulewright.llm.sharding import communication_matrix, hypergeometric, shuffle_to_shards


def test_draws_follow_the_distribution(spark):
    n = 20_000
    for draws, good, total in ((10, 7, 30), (400, 300, 1000), (5, 5, 5), (0, 3, 9), (7, 0, 9)):
        long = lambda x: F.lit(x).cast("long")
        u = (F.xxhash64(F.lit(1), "id").bitwiseAND(F.lit(2**40 - 1))) / F.lit(2.0**40)
        got = [r.x for r in spark.range(n).select(hypergeometric(long(draws), long(good), long(total), u).alias("x")).collect()]
        mean = draws * good / total
        variance = mean * (1 - good / total) * (total - draws) / max(1, total - 1)
        assert abs(sum(got) / n - mean) <= 5 * (variance / n) ** 0.5 + 1e-12
        assert abs(sum((x - mean) ** 2 for x in got) / n - variance) <= 0.1 * variance + 1e-12
        assert max(0, draws + good - total) <= min(got) and max(got) <= min(draws, good)


def test_matrix_has_its_margins(spark):
    sizes = [random.Random(3).randrange(50) for _ in range(13)]
    counts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes) if n], "block int, n long")
    rows = communication_matrix(counts, 5, 4, 13).collect()
    cells = [[b - a for a, b in zip([0, *r.ends], r.ends)] for r in rows]
    assert {r.block: r.ends[-1] for r in rows} == {r.block: r.n for r in rows} == {i: n for i, n in enumerate(sizes) if n}
    per_shard = [sum(c) for c in zip(*cells)]
    assert sum(per_shard) == sum(sizes) and max(per_shard) - min(per_shard) <= 1 and min(min(c) for c in cells) >= 0


def test_shards_are_exact_and_lose_nothing(docs, corpus):
    for cell_bytes in (8 << 20, 1000):
        rows = shuffle_to_shards(docs, 6, cell_bytes=cell_bytes, stable=False).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter(corpus)
        sizes = Counter(r.shard for r in rows)
        assert set(sizes) <= set(range(6)) and max(sizes.values()) - min(sizes[s] for s in range(6)) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_is_a_shuffle(spark):
    df = spark.range(4000).repartition(7)
    rows = shuffle_to_shards(df, 4, stable=False).collect()
    place = {r.id: r.shard * 1000 + r.slot for r in rows}
    mean = sum(abs(place[i] - place[i + 1]) for i in range(3999)) / 3999
    assert 1250 < mean < 1420  # a third of 4000 for a uniform permutation
    again = {r.id: r.shard * 1000 + r.slot for r in shuffle_to_shards(df, 4, seed=2, stable=False).collect()}
    assert again != place


def test_equal_rows_are_shuffled(spark):
    """40 equal rows among 4040: as spread over shards and slots as 40 others."""
    df = spark.range(4040).select(F.when(F.col("id") % 101 == 50, -1).otherwise(F.col("id")).alias("id")).coalesce(1)
    shards, near = Counter(), []
    for seed in range(3):
        rows = [r for r in shuffle_to_shards(df, 8, seed=seed, cell_bytes=500, stable=False).collect() if r.id == -1]
        assert len(rows) == 40
        shards.update(r.shard for r in rows)
        slots = sorted((r.shard, r.slot) for r in rows)
        near.append(sum(a[0] == b[0] and b[1] - a[1] == 1 for a, b in zip(slots, slots[1:])))
    assert len(shards) == 8 and max(shards.values()) <= 30  # 15 of each expected
    assert sum(near) <= 6  # 1.2 expected


def test_a_split_that_changed_is_noticed(spark, tmp_path, monkeypatch):
    spark.range(1000).repartition(4).write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    real = sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *rest: real(counts.where("block > 0"), *rest))
    with pytest.raises(Exception, match="split in another way"):
        shuffle_to_shards(df, 3).collect()


def test_odd_rows(odd, none):
    rows = shuffle_to_shards(odd, 3, stable=False).collect()
    assert len(rows) == 5 and Counter(r.shard for r in rows) == {0: 2, 1: 2, 2: 1}
    assert shuffle_to_shards(none, 3, stable=False).collect() == []
