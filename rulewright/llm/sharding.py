"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Source partition p holds n_p rows and cell t must get exactly m_t. How many of p's rows go to each cell, in a
uniformly random permutation of all rows, is a row of a random matrix with those margins; it is drawn exactly,
before any row moves. Each partition permutes its rows locally and deals them out by its matrix row, one exchange
moves them, and each cell permutes what it got. Everything is DataFrame and SQL expressions.

The matrix is drawn by halving the list of partitions: a node has a list of partitions and the room left to it in each
shard, the left half's share is multivariate hypergeometric, and the right half gets the rest. Nodes of one level are
independent rows. The permutations order rows by hashes of (seed, partition, place in the partition): a recomputed task
gives the same answer, and rows of equal values are told apart by their places.

A shard is permuted in cells, ranges of the second hash of about ``cell_bytes``, so that no task holds a whole shard. Which
rows a cell gets follows from places and the matrix alone, so cells are counted without reading a row, and the counts give
each cell its first slot.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Entries of a table up to which it is broadcast (32 MB); a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 4_000_000
#: Places that are counted from one row.
CHUNK = 1 << 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + x)


def hypergeometric(draws: Column, good: Column, total: Column, uniform: Column) -> Column:
    """How many of ``draws`` rows drawn from ``total`` are among ``good`` ones, by inverting the distribution function.

    Weights relative to the mode's follow from each other by ratios; beyond 12 standard deviations from the mode
    they are below the resolution of a double.
    """
    none = F.array().cast("array<long>")

    def ratio_up(k: Column) -> Column:  # weight of k over that of k - 1
        return ((good - k + 1) * (draws - k + 1.0)) / (k * (total - good - draws + k).cast("double"))

    def ratio_down(k: Column) -> Column:  # weight of k over that of k + 1
        return ((k + 1.0) * (total - good - draws + k + 1)) / ((good - k) * (draws - k).cast("double"))

    def weigh(ks: Column, ratio: Callable) -> Column:
        def step(s: Column, k: Column) -> Column:
            return _let(s.w * ratio(k), lambda w: F.struct(w.alias("w"), (s.sum + w).alias("sum")))

        return F.aggregate(ks, F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")), step, lambda s: s.sum)

    def find(ks: Column, ratio: Callable, target: Column, last: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            return _let(
                s.w * ratio(k),
                lambda w: F.struct(w.alias("w"), (s.left - w).alias("left"), F.when(s.k.isNull() & (s.left - w < 0), k).otherwise(s.k).alias("k")),
            )

        zero = F.struct(F.lit(1.0).alias("w"), target.alias("left"), F.lit(None).cast("long").alias("k"))
        return F.aggregate(ks, zero, step, lambda s: F.coalesce(s.k, last))

    low, high = F.greatest(F.lit(0), draws + good - total), F.least(draws, good)
    mode = F.floor((draws + 1.0) * (good + 1.0) / (total + 2.0)).cast("long")
    share = F.when(total > 1, good / total.cast("double")).otherwise(F.lit(0.0))
    spread = F.ceil(12 * F.sqrt(draws * share * (1 - share))).cast("long") + 24

    def choose(q: Column) -> Column:
        above = F.when(q.b > q.m, F.sequence(q.m + 1, q.b)).otherwise(none)
        below = F.when(q.m > q.a, F.sequence(q.m - 1, q.a, F.lit(-1).cast("long"))).otherwise(none)
        sums = F.struct(weigh(above, ratio_up).alias("up"), weigh(below, ratio_down).alias("down"))
        return _let(
            sums,
            lambda s: _let(
                uniform * (1 + s.up + s.down),
                lambda t: F.when(t < 1, q.m).when(t < 1 + s.up, find(above, ratio_up, t - 1, q.b)).otherwise(find(below, ratio_down, t - 1 - s.up, q.a)),
            ),
        )

    bounds = _let(
        F.least(F.greatest(mode, low), high),
        lambda m: F.struct(m.alias("m"), F.greatest(low, m - spread).alias("a"), F.least(high, m + spread).alias("b")),
    )
    return _let(bounds, choose)


def communication_matrix(counts: DataFrame, n_shards: int, seed: int, n_blocks: int) -> DataFrame:
    """(block, n, ends): for each source partition its rows and their running totals by shard, exact margins.

    counts: (block int, n long), one row per source partition, n_blocks of them. The list of counts is one row per
    partition, never one per record; a node has an entry per shard.
    """
    parts = F.sort_array(F.collect_list(F.struct("block", "n")))
    nodes = counts.groupBy().agg(parts.alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows")).where("rows > 0")
    in_shard = lambda s: (F.floor(F.col("rows") / n_shards) + (s < F.col("rows") % n_shards).cast("long")).cast("long")
    nodes = nodes.select("parts", F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), in_shard).alias("room"))
    for level in range(max(0, math.ceil(math.log2(max(1, n_blocks))))):
        half = F.floor(F.size("parts") / 2).cast("int")
        left = F.slice("parts", 1, half)

        def deal(s: Column, t: Column) -> Column:
            noise = F.xxhash64(F.lit(seed), F.element_at(F.col("parts"), 1)["block"], F.size("parts"), t.i)
            uniform = F.shiftrightunsigned(noise, 11) / F.lit(float(2**53))
            got = hypergeometric(s.draws, t.room, s.total, uniform)
            return _let(got, lambda x: F.struct((s.draws - x).alias("draws"), (s.total - t.room).alias("total"), F.concat(s.out, F.array(x)).alias("out")))

        start = F.struct(
            F.aggregate(left, F.lit(0).cast("long"), lambda a, x: a + x.n).alias("draws"),
            _total(F.col("room")).alias("total"),
            F.array().cast("array<long>").alias("out"),
        )
        numbered = F.transform("room", lambda r, i: F.struct(r.alias("room"), i.alias("i")))
        nodes = nodes.withColumn("got", F.when(F.size("parts") > 1, F.aggregate(numbered, start, deal, lambda s: s.out)).otherwise(F.col("room")))
        rest = F.zip_with("room", "got", lambda a, b: a - b)
        halves = F.array(
            F.struct(left.alias("parts"), F.col("got").alias("room")),
            F.struct(F.expr("slice(parts, CAST(floor(size(parts) / 2) AS INT) + 1, size(parts))").alias("parts"), rest.alias("room")),
        )
        whole = F.array(F.struct("parts", "room"))
        nodes = nodes.select(F.explode(F.when(F.size("parts") > 1, halves).otherwise(whole)).alias("node")).select("node.*")
        if level == 8:  # up to 512 nodes are drawn in one task, the rest side by side
            nodes = nodes.repartition(F.element_at("parts", 1)["block"])
    running = F.aggregate("room", F.array().cast("array<long>"), lambda a, x: F.concat(a, F.array(x + F.when(F.size(a) > 0, F.element_at(a, -1)).otherwise(F.lit(0)))))
    one = F.element_at("parts", 1)
    return nodes.select(one["block"].alias("block"), one["n"].alias("n"), running.alias("ends"))


def _target(place: Column, ends: Column) -> Column:
    """The shard of the row at a place of its partition's permutation."""
    return F.size(F.filter(ends, lambda e: e <= place))


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), "block", "place")


def _cell(key: Column, cells: int) -> Column:
    """The cell of a key: cells are equal ranges of the key's upper bits."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * F.lit(cells), 32).cast("int")


def first_slots(matrix: DataFrame, seed: int, cells: int) -> DataFrame:
    """(shard, cell, base long): the slot that a cell begins with, counted from the matrix: every place of every partition has its shard and its key."""
    last = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))
    chunks = matrix.where("n > 0").select("block", "n", "ends", F.explode(last).alias("from")).repartition("block", "from")
    places = chunks.select("block", "ends", F.explode(F.sequence("from", F.least(F.col("from") + CHUNK, F.col("n")) - 1)).alias("place"))
    sizes = places.groupBy(_target(F.col("place"), F.col("ends")).alias("shard"), _cell(_key(seed), cells).alias("cell")).agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", "cell", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("base"))


def shuffle_to_shards(df: DataFrame, n_shards: int = 24, seed: int = 1, cell_bytes: int = 8 << 20, stable: bool = True) -> DataFrame:
    """All rows of df with shard int and slot long: a uniform shuffle whose shards differ by a row at most.

    Slots are gapless from 0 in each shard. Columns of df that are called shard or slot are replaced. Nulls, empty
    or long texts and repeated rows are rows like any other; an empty df gives no rows; fewer rows than shards leave
    the last shards empty. df is planned twice, to count and to deal, and must be split alike both times: true
    of files while the cluster's size stays, and a partition with more rows than were counted raises an error; pass stable=False
    for anything else and it is written in the shared folder first.
    """
    if not stable:
        df = materialize(df, "shard-input")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    counts = materialize(df.groupBy(F.spark_partition_id().alias("block")).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "shard-counts")
    n_blocks, rows = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cells = min(-(-size // (n_shards * cell_bytes)), rows // n_shards) or 1
    matrix = materialize(communication_matrix(counts, n_shards, seed, n_blocks), "shard-matrix")
    bases = first_slots(matrix, seed, cells)
    if n_blocks * n_shards <= BROADCAST_ENTRIES:
        matrix = F.broadcast(matrix)
    if n_shards * cells <= BROADCAST_ENTRIES // 2:
        bases = F.broadcast(bases)

    row, at = F.struct(*[F.col(f"`{c}`") for c in kept]), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    local = df.select(row.alias("row"), F.spark_partition_id().alias("block"), at.alias("at"))
    local = local.select("row", "block", F.xxhash64(F.lit(seed), "block", "at").alias("order"), "at").sortWithinPartitions("order", "at")
    local = local.select("row", "block", at.alias("place"))
    dealt = local.join(matrix, "block", "left")
    moved = F.raise_error(F.lit("the input was split in another way than when it was counted; pass stable=False")).cast("int")
    shard = F.when(F.col("place") < F.col("n"), _target(F.col("place"), F.col("ends"))).otherwise(moved)
    dealt = dealt.select("row", shard.alias("shard"), _key(seed).alias("key"), "block", "place")
    dealt = dealt.select("row", "shard", _cell(F.col("key"), cells).alias("cell"), "key", "block", "place")
    within = Window.partitionBy("shard", "cell").orderBy("key", "block", "place")
    dealt = dealt.join(bases, ["shard", "cell"]).select("row", "shard", (F.col("base") + F.row_number().over(within) - 1).cast("long").alias("slot"))
    return dealt.select("row.*", "shard", "slot")


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``; digests come from the texts that the shards got."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    placed = shuffle_to_shards(docs, n_shards=24)
    utf8 = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return placed.select(
        "doc_id", (F.octet_length(utf8) + 8).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"), F.lit("rows").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
