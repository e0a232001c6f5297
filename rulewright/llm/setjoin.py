"""Exact Jaccard join of shingle sets, with skipping by set relations.

Elements have one order for the whole corpus, rare ones first. Two sets of sizes s and s' reach ``percent`` Jaccard
similarity if and only if at most D = (100 - percent) (s + s') / (100 + percent) elements are in one of them only;
they then share an element in both their prefixes, the first s - ceil(percent s / 100) + 1 elements. So:

1. Index lists: a set is listed under each element of its prefix, with the element's position. The order is by
   a sketch of all shingles' counts, a fixed number of counters on a logarithmic scale, then by hash; any order
   is exact, a good one makes lists short. Lists of one set end here.
2. Block skipping: lists are cut into blocks by the number of elements from the position on, on a scale of
   100 / percent. Where a linked pair meets first, these numbers differ by that factor at most, so a set is in
   two neighbouring blocks, and sets that are farther apart meet in none.
   Blocks in which nothing is in reach of a hub, by a bitmap of each set, lose the hub unseen.
3. Answers from a relation: a block's hub is the set with the fewest elements before the position. Every other set x of the
   block is compared with it, which gives its difference from the hub, d(x). Whatever is linked to an x near the hub is
   in the hub's reach, too. Pairs in reach of one hub are found from their differences alone: |x - y| = d(x) + d(y) -
   2 |common differences|, so a prefix of the differences, rarest first, is indexed, and only sets that
   meet there, early enough in both, are compared. The hub's own peculiarities would be common to all differences; so they
   are taken again from the group's centre, the set nearest to what most of the group have.
4. Hubs and the sets near them leave their blocks. While a block still has sets of several components, it gets new hubs,
   sixteen times as many each time. Blocks of one component are closed, and pairs already connected are not compared.

Equal sets count as one set. 64-bit hashes of the words stand for shingles, and for sets the sum of their mixed elements.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, discard, map_batches, materialize, mix, prepare_workers, settle, shingles, sorted_by, sweep, text_buffers
from .graph import SMALL, components, small
from .passages import bloom, hits

#: Counters of the sketch: 4 MB where it is sent, whatever the input. With more shingles counters are shared by more of them:
#: common ones still stand out, rare ones are told apart less, and lists get longer.
COUNTERS = 1 << 22
#: Sets that a task remembers so as not to list them twice.
SEEN = 1 << 16
#: Pairs from which on sets are compared in several slices, one after the other, and the most slices: only one slice's shuffles are on disk at a time.
RELATED, SLICES = 100_000, 4


def allowance(total: int, percent: int) -> int:
    """Elements in one set only that sets of ``total`` elements together may have."""
    return (100 - percent) * total // (100 + percent)


def count_ranks(docs: DataFrame, width: int, counters: int = COUNTERS) -> np.ndarray:
    """The rank of each counter, eight times the binary logarithm of the shingles of all docs (text) that it counts.

    Tasks count all they have and send counters that aren't 0; these are added up in parts, and only ranks, a byte each, reach the driver.
    """
    prepare_workers(docs.sparkSession)
    part = counters // 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(counters, np.uint32)
        for batch in batches:
            elements, _ = shingles(*text_buffers(batch.column(0)), width)
            at, n = np.unique(elements & U64(counters - 1), return_counts=True)
            seen[at.astype(np.int64)] += n.astype(np.uint32)
        data = []
        for i in range(32):
            at = np.flatnonzero(seen[i * part : (i + 1) * part]).astype(np.int32)
            data.append((i, zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes(), 1), zlib.compress(seen[i * part + at].tobytes(), 1)))
        names = ["part", "at", "counts"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*data, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, at, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums = total.setdefault(i, np.zeros(part, np.int64))
                sums[np.cumsum(np.frombuffer(zlib.decompress(at), np.int32))] += np.frombuffer(zlib.decompress(data), np.uint32)
        ranks = [np.minimum(255, np.round(8 * np.log2(1 + x))).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int32()), pa.array(ranks, pa.binary())], ["part", "ranks"])

    counted = map_batches(docs.select("text"), count, "part int, at binary, counts binary").repartition(32, "part")
    out = np.zeros(counters, np.uint8)
    for i, ranks in map_batches(counted, add, "part int, ranks binary").collect():
        out[i * part : (i + 1) * part] = np.frombuffer(ranks, np.uint8)
    return out


def prefixes(elements: np.ndarray, offsets: np.ndarray, percent: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of each set in the corpus's order, concatenated, and its offsets."""
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    key = ranks[(elements & U64(len(ranks) - 1)).astype(np.int64)].astype(U64) << U64(56) | elements >> U64(8)
    order = sorted_by(text, len(size), key)
    # keys without the hash's last byte may tie; such elements are put in the order of their hashes
    tie = (text[1:] == text[:-1]) & (key[order[1:]] == key[order[:-1]])
    if tie.any():
        order = np.lexsort((elements, key, text))
    length = np.where(size > 0, size + percent * size // -100 + 1, 0)  # size - ceil(percent size / 100) + 1
    nth = np.arange(len(elements)) - offsets[:-1][text]
    return elements[order][nth < length[text]], np.concatenate([[0], np.cumsum(length)])


def scale(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Starts of the blocks: numbers that differ by a factor of 100 / percent at most are in one block or in neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out)


def set_ids(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(elements))])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(U64)).view(np.int64)


def mark_factor(percent: int) -> int:
    """Bits of a mark for each element, at least: enough that two sets that have nothing in common don't look as if they were in reach."""
    in_reach = 3 * (100 - percent) / percent * 100 / percent
    return next((f for f in (1, 2) if f / 2 * (1 - np.exp(-4 / f)) > 1.15 * in_reach), 4)


def marks_of(elements: np.ndarray, offsets: np.ndarray, factor: int) -> list[bytes]:
    """A bitmap for each set: bit by bit, whether an odd number of its elements falls there. A power of two of bits, ``factor`` for each element or more.

    Where two bitmaps differ an element is in one of the sets only.
    """
    size = np.diff(offsets)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(size * factor, 1))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    text = np.repeat(np.arange(len(size)), size)
    place, n = np.unique(start[:-1][text] + (elements >> U64(20)).astype(np.int64) % bits[text], return_counts=True)
    flat = np.zeros(start[-1], np.uint8)
    flat[place[n & 1 == 1]] = 1
    packed, at = np.packbits(flat), (start // 8).tolist()
    return [packed[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)]


def difference_at_least(x: bytes, y: bytes) -> int:
    """Elements that are in one only of the sets of two marks, at least."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):  # a larger bitmap folds to one of half its size
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class _Seen:
    """Remembers the last of the sets that fall on each of SEEN places; a set that was forgotten counts as new."""

    def __init__(self):
        self.table = np.zeros(SEEN, np.int64)

    def fresh(self, sid: np.ndarray) -> np.ndarray:
        place = sid & (SEEN - 1)
        new = self.table[place] != sid
        first = np.zeros(len(sid), bool)
        first[np.unique(sid, return_index=True)[1]] = True
        self.table[place] = sid
        return new & first


def describe_sets(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, size long, sid long, prefix array<long>, mark binary): each text's set, its prefix and its mark, empty for a set that the task has just listed."""
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(count_ranks(docs.select("text"), width))
    settle(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, factor = _Seen(), mark_factor(percent)
        for batch in batches:
            elements, offsets = shingles(*text_buffers(batch.column(1)), width)
            sid = set_ids(elements, offsets)
            fresh = seen.fresh(sid)
            first, bounds = prefixes(elements, offsets, percent, sent.value)
            first = first[np.repeat(fresh, np.diff(bounds))]
            bounds = np.concatenate([[0], np.cumsum(np.diff(bounds) * fresh)])
            listed = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(first.view(np.int64)))
            marks = [m if f else b"" for m, f in zip(marks_of(elements, offsets, factor), fresh.tolist(), strict=True)]
            columns = [batch.column(0), pa.array(np.diff(offsets)), pa.array(sid), listed, pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "size", "sid", "prefix", "mark"])

    return map_batches(docs.select(F.col(id_col), F.col("text")), run, f"doc_id {kind}, size long, sid long, prefix array<long>, mark binary")


def _listings(sets: DataFrame, filter_bits: np.ndarray, percent: int) -> DataFrame:
    """(e, sid, size, place, nth): the listings of elements that the filter lets through, with positions and numbers of blocks."""
    sent = sets.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = scale(percent)
        for batch in batches:
            lists = batch.column(2)
            row, e = lists.value_parent_indices().to_numpy(), lists.flatten().to_numpy()
            place = np.arange(len(e)) - np.searchsorted(row, row)
            ok = hits(sent.value, e)
            row, e, place = row[ok], e[ok], place[ok]
            sid, size = (batch.column(i).to_numpy()[row] for i in (0, 1))
            nth = np.searchsorted(starts, size - place, "right")
            columns = [e, sid, size.astype(np.int32), place.astype(np.int32), nth.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["e", "sid", "size", "place", "nth"])

    return map_batches(sets.select("sid", "size", "prefix"), run, "e long, sid long, size int, place int, nth int")


def _passing(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows of df whose column is the one of wanted, and a few more: by a Bloom filter, without a shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col(wanted.columns[0]).alias("k1"))))
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(sent.value, batch.column(at).to_numpy())))

    return map_batches(df, run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes))


def _described(sets: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    """The rows of sets (sid) that stand at one end of pairs, and a few more.

    Ends of few pairs are broadcast as they are: the Python step that compares them may share a stage with this, and a task would hold
    two Python workers, which live on beside each other.
    """
    wanted = pairs.select(F.col(end).alias("k1"))
    if wanted.count() <= SMALL:
        return sets.join(F.broadcast(wanted), F.col("sid") == F.col("k1"), "left_semi")
    return _passing(sets, "sid", wanted)


def _elements(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """(sid, elements binary) of the wanted sets, one row each; texts are read again, and none is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted.select(F.col("sid").alias("k1"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            elements, offsets = shingles(*text_buffers(batch.column(0)), width)
            sid = set_ids(elements, offsets)
            some = np.flatnonzero(hits(sent.value, sid) & (np.diff(offsets) > 0) & seen.fresh(sid))
            data = [elements[offsets[i] : offsets[i + 1]].tobytes() for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(sid[some]), pa.array(data, pa.binary())], ["sid", "elements"])

    return map_batches(docs.select("text"), run, "sid long, elements binary").groupBy("sid").agg(F.first("elements").alias("elements"))


def slack(size: Column, percent: int) -> Column:
    """Elements by which a set of this size may differ from any that it links to."""
    return F.floor((100 - percent) * size / percent)


def near(size: Column, percent: int) -> Column:
    """Differences from a hub up to which a set is near it."""
    return 2 * slack(size, percent)


def reach(size: Column, percent: int) -> Column:
    """Differences from a hub beyond which a set can't link to a set near the hub."""
    return F.floor(3 * (100 - percent) * F.floor(size * 100 / percent) / percent)


def _relate(pairs: DataFrame, elements: DataFrame, percent: int, with_differences: str = "none") -> DataFrame:
    """pairs (a, b) with sa, sb, d (elements in one only), linked, and the elements of the difference: of none, of all, or of each a in ``reach`` of b; written.

    Only the elements of sets that are in pairs are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lists = [], []
            for x, y, most in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([x, y]))
                twice = both[1:] == both[:-1]
                d = len(both) - 2 * int(np.count_nonzero(twice))
                out.append((len(x), len(y), d, d <= allowance(len(both), percent)))
                if with_differences != "none":
                    one = np.ones(len(both), bool)
                    one[1:] &= ~twice
                    one[:-1] &= ~twice
                    lists.append(both[one].view(np.int64) if with_differences == "all" or d <= most else None)
            made = zip(*out, strict=True) if out else [[]] * 4
            arrays = [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
            extra = [pa.array(lists, pa.list_(pa.int64()))] if with_differences != "none" else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, *extra], names)

    names = ["a", "b", "sa", "sb", "d", "linked", *["difference"] * (with_differences != "none")]
    types = "a long, b long, sa long, sb long, d long, linked boolean" + ", difference array<long>" * (with_differences != "none")
    pairs = materialize(pairs.select("a", "b"), "pairs")
    n = min(SLICES, max(1, -(-pairs.count() // RELATED)))
    done = []
    for k in range(n):
        mine = pairs.where(F.pmod(F.xxhash64("a"), F.lit(n)) == k) if n > 1 else pairs
        a, b = (_described(elements, mine, x).select(F.col("sid").alias(x), F.col("elements").alias(f"e{x}")) for x in "ab")
        joined = mine.join(a, "a").join(b, "b").select("a", "b", "ea", "eb", reach(F.octet_length("ea") / 8, percent).cast("long"))
        done.append(materialize(map_batches(joined, run, types), "relations"))
    out = _union(done)
    out._rulewright_paths = [path for x in done for path in x._rulewright_paths]
    discard(pairs)
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.union(x)
    return out


def _rooted(df: DataFrame, key: str, roots: DataFrame, name: str) -> DataFrame:
    """df with the component of its key column, itself where it has no links."""
    named = roots.select(F.col("id").alias(key), F.col("root").alias("__root"))
    named.__dict__["_rulewright_small"] = roots.__dict__.get("_rulewright_small")
    out = df.join(small(named), key, "left")
    return out.withColumn(name, F.coalesce("__root", key)).drop("__root")


def _centres(related: DataFrame) -> DataFrame:
    """(b, centre): of each hub's group the set, or the hub, that differs least from what more than half of the group have."""
    size = related.groupBy("b").agg(F.count(F.lit(1)).alias("m"))
    parts = related.select("b", "a", F.explode("difference").alias("e"))
    common = parts.groupBy("b", "e").agg(F.count(F.lit(1)).alias("n")).join(size, "b").where("2 * n > m + 1").select("b", "e")
    own = parts.join(common, ["b", "e"]).groupBy("b", "a").agg(F.count(F.lit(1)).alias("flipped"))
    score = related.join(own, ["b", "a"], "left").select("b", "a", (F.col("d") - 2 * F.coalesce("flipped", F.lit(0))).alias("score"))
    best = score.groupBy("b").agg(F.min(F.struct("score", "a")).alias("x"))
    return best.select("b", F.when(F.col("x.score") < 0, F.col("x.a")).otherwise(F.col("b")).alias("centre"))


def _blocks(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(block, sid, size, place): the listings of elements of two sets or more, and a few others, in their blocks, written."""
    often = sets.select(F.explode("prefix").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("e")
    often = materialize(often, "lists")
    settle(docs.sparkSession)
    listed = _listings(sets, bloom(often.select(F.col("e").alias("k1"))), percent)
    keys = F.array(F.xxhash64("e", "nth"), F.xxhash64("e", F.col("nth") + 1))
    blocks = materialize(listed.select(F.explode(keys).alias("block"), "sid", "size", "place"), "blocks")
    discard(often)
    settle(docs.sparkSession)
    return blocks


def _hubs(members: DataFrame, number: int, seed: int) -> DataFrame:
    """(block, hub, hub_size, hub_place): up to ``number`` hubs of each block of two rows or more."""
    best = F.min(F.struct((F.shiftleft(F.col("place").cast("long"), 32) + F.col("size")).alias("at"), "sid")).alias("h")
    group = [F.pmod(F.xxhash64(F.lit(seed), "sid"), F.lit(number)).alias("group")] if number > 1 else []
    hubs = members.groupBy("block", *group).agg(best, F.count(F.lit(1)).alias("n"))
    hubs = hubs.where("n > 1") if number == 1 else hubs  # copies of a set count, too: then its block has nothing to compare
    at = F.col("h.at")
    return hubs.select("block", F.col("h.sid").alias("hub"), at.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("hub_size"), F.shiftright(at, 32).cast("int").alias("hub_place"))


def _apart() -> Column:
    """Elements in one only of a set and a hub, at least: as their places and the numbers of elements from there on differ."""
    return F.abs(F.col("place") - F.col("hub_place")) + F.abs(F.col("size") - F.col("place") - F.col("hub_size") + F.col("hub_place"))


def _screen(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which a may be in the reach of b, by their marks (sid, size, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [difference_at_least(x, y) <= most for x, y, most in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    a, b = (_described(marks, pairs, k) for k in "ab")
    a = a.select(F.col("sid").alias("a"), F.col("mark").alias("ma"), reach(F.col("size"), percent).cast("long").alias("most"))
    b = b.select(F.col("sid").alias("b"), F.col("mark").alias("mb"))
    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "ma", "mb", "most"), run, "a long, b long")


def _screened(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of blocks in which some set may be in reach of a hub, written; blocks and sets, written tables, are used up.

    A hub that no set of its block can be in reach of links with none of them and leaves it, until hubs are left that some may reach.
    """
    spark, held = blocks.sparkSession, []
    marks = sets.where("length(mark) > 0").select("sid", "size", "mark")
    marks = materialize(_passing(marks, "sid", blocks.select("sid").distinct()).dropDuplicates(["sid"]), "marks")
    discard(sets)
    for k in range(16):
        hubs = materialize(_hubs(blocks, 1 << 4 * k, k), "hubs")
        if k == 0:
            sweep(spark)
        members = _passing(blocks, "block", hubs.select("block")).join(hubs, "block")
        met = materialize(members.where("sid <> hub"), "met")
        if k == 0:
            sweep(spark)
        pairs = met.where(_apart() <= reach(F.col("size"), percent)).select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        close = materialize(_screen(pairs, marks, percent), "close")
        some = materialize(met.join(close, (F.col("sid") == F.col("a")) & (F.col("hub") == F.col("b"))).select("block").distinct(), "reached")
        held.append(materialize(_passing(blocks, "block", some).join(some, "block", "left_semi"), "members"))
        left = met.join(some, "block", "left_anti").groupBy("block", "sid", "size", "place").agg(F.count(F.lit(1)).alias("n"))
        left = left.join(hubs.select("block", F.col("hub").alias("sid")), ["block", "sid"], "left_anti").drop("n")
        two = left.groupBy("block").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("block")
        rest = materialize(left.join(two, "block", "left_semi"), "blocks")
        discard(blocks, hubs, met, pairs, close, some)
        sweep(spark)
        blocks = rest
        if rest.isEmpty():
            break
    out = _union(held)
    out._rulewright_paths = [path for x in held for path in x._rulewright_paths]
    discard(rest, marks)
    return out


def _comparable(related: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """The relations of sets that may link to a set of another component in reach of their hub, and a few others.

    Linked sets' differences from a hub differ in number by what the sets may differ by. So relations are counted in rings around
    their hub, as wide as the largest set's slack; one stays if its ring and those beside it have sets of several components and
    one that is near the hub: two that aren't get compared with other hubs.
    """
    rooted = _rooted(related.select("a", "b", "sa", "d"), "a", roots, "root")
    width = rooted.groupBy("b").agg((F.max(slack(F.col("sa"), percent)) + 1).alias("width"))
    beside = (F.col("d") <= near(F.col("sa"), percent)).alias("beside")
    rings = rooted.join(width, "b").select("a", "b", "root", beside, F.floor(F.col("d") / F.col("width")).alias("ring"))
    seen = rings.select("b", "root", "beside", F.explode(F.array(F.col("ring") - 1, F.col("ring"), F.col("ring") + 1)).alias("ring"))
    mixed = seen.groupBy("b", "ring").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("beside").alias("beside"))
    mixed = mixed.where("low < high AND beside").select("b", "ring")
    wanted = materialize(rings.join(mixed, ["b", "ring"], "left_semi").select(F.xxhash64("a", "b").alias("key")), "comparable")
    out = _passing(related.withColumn("key", F.xxhash64("a", "b")), "key", wanted).drop("key")
    discard(wanted)
    return out


def _link_differences(related: DataFrame, elements: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between sets in reach of one hub, from their relations to it (a, b, sa, d, linked, difference), but for those already connected."""
    centres = materialize(_centres(related), "centres")
    moved = centres.where("b <> centre")
    settle(related.sparkSession)
    pairs = related.select("a", "b").join(moved, "b").select("a", F.col("centre").alias("b")).union(moved.select(F.col("b").alias("a"), F.col("centre").alias("b")))
    again = _relate(pairs.where("a <> b").distinct(), elements, percent, "all")
    found = again.where("linked").select("a", "b")
    related = related.join(moved, "b", "left_anti").select(*again.columns).union(again)

    # differences from a common hub: with overlap >= d - slack for any partner, rarest elements first
    kept = F.least(F.col("d"), slack(F.col("sa"), percent) + 1)
    parts = related.select(F.col("b").alias("hub"), F.col("a").alias("sid"), "sa", "d", "linked", kept.alias("kept"), F.explode("difference").alias("e"))
    rare = parts.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("linked").cast("int")).alias("all_linked"))
    order = Window.partitionBy("hub", "sid").orderBy("n", "e")
    indexed = parts.join(rare, ["hub", "e"]).withColumn("r", F.row_number().over(order)).where("r <= kept AND n > 1 AND all_linked = 0")
    table = materialize(_rooted(indexed.select("hub", "e", "sid", "sa", "d", (F.col("d") - F.col("r") + 1).alias("left")), "sid", roots, "root"), "differences")
    settle(related.sparkSession)
    mixed = table.groupBy("hub", "e").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("hub", "e")
    indexed = table.join(mixed, ["hub", "e"], "left_semi")
    one, two = (indexed.select("hub", "e", *[F.col(c).alias(f"{c}_{k}") for c in ("sid", "sa", "d", "left", "root")]) for k in "xy")
    most = F.floor((100 - percent) * (F.col("sa_x") + F.col("sa_y")) / (100 + percent))
    size = 100 * F.least("sa_x", "sa_y") >= percent * F.greatest("sa_x", "sa_y")
    # what is left of both from here on has to hold the common differences
    enough = (F.abs(F.col("d_x") - F.col("d_y")) <= most) & (2 * F.least("left_x", "left_y") >= F.col("d_x") + F.col("d_y") - most)
    pairs = one.join(two, ["hub", "e"]).where((F.col("sid_x") < F.col("sid_y")) & (F.col("root_x") != F.col("root_y")) & size & enough)
    pairs = pairs.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct()
    last = _relate(pairs, elements, percent)
    found = materialize(found.union(last.where("linked").select("a", "b")), "links")
    discard(centres, again, table, last)
    return found


def link_sets(docs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, root) of all sets with links: components of the sets (sid, size, prefix) of docs (text), a written table that is used up."""
    members = _screened(_blocks(docs, sets, percent), sets, percent)
    settle(docs.sparkSession)
    elements = materialize(_elements(docs, width, members.select("sid").distinct()), "elements")
    settle(docs.sparkSession)

    # first answers: each set against one of the hubs that it may link to
    met = members.join(_hubs(members, 1, 0), "block").where("sid <> hub")
    direct = F.col("place") + F.col("hub_place") + F.abs(F.col("size") - F.col("place") - F.col("hub_size") + F.col("hub_place"))
    met = met.where(direct <= (100 - percent) * (F.col("size") + F.col("hub_size")) / (100 + percent))
    first = met.groupBy(F.col("sid").alias("a")).agg(F.min(F.struct("hub_place", "hub")).alias("h")).select("a", F.col("h.hub").alias("b"))
    answers = _relate(first, elements, percent)
    links = materialize(answers.where("linked").select("a", "b"), "links")
    discard(answers)
    sweep(docs.sparkSession)
    roots = components(links)
    relations: list[DataFrame] = []
    for k in range(16):
        rooted = _rooted(members, "sid", roots, "root")
        mixed = rooted.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
        open_ = materialize(members.join(mixed, "block", "left_semi"), "open")
        discard(members)
        if open_.isEmpty():
            discard(open_)
            break
        met = open_.join(_hubs(open_, 1 << 4 * k, k), "block")
        pairs = met.where((F.col("sid") != F.col("hub")) & (_apart() <= reach(F.col("size"), percent))).select(F.col("sid").alias("a"), F.col("hub").alias("b")).distinct()
        for x in relations:
            pairs = pairs.join(x.select("a", "b"), ["a", "b"], "left_anti")
        related = _relate(pairs, elements, percent, "reach")
        relations.append(related)
        beside = _union(relations).where(F.col("d") <= near(F.col("sa"), percent)).select(F.col("a").alias("sid"), F.col("b").alias("hub"), F.lit(True).alias("gone"))
        left = met.join(beside, ["sid", "hub"], "left").groupBy("block", "sid", "size", "place")
        left = left.agg(F.max(F.coalesce("gone", F.col("sid") == F.col("hub"))).alias("gone")).where("NOT gone")
        members = materialize(left.drop("gone"), "members")
        more = related.where("linked").select("a", "b").join(links, ["a", "b"], "left_anti").distinct()
        if not more.isEmpty():
            old, added = (links, roots), materialize(links.union(more), "links")
            links, roots = added, components(added)
            discard(*old)
        discard(open_)
        settle(docs.sparkSession)
    if relations:
        useful = materialize(_comparable(_union(relations).where("difference IS NOT NULL"), roots, percent), "useful")
        found = _link_differences(useful, elements, roots, percent)
        old, roots = roots, components(links.union(found))
        discard(old, found, useful, *relations)
    discard(links, elements)
    return roots


def join_documents(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles long, component_id): component_id is the least id reachable by links, itself included.

    docs has id_col and text. Words are lower-cased by ASCII letters; a text of fewer than ``width`` words is one
    shingle; a null text or one without words has none and links with nothing. Equal sets link with each other. Repeated
    ids are rows of their own with the same answer if their texts are equal; a null id never names a component that has others.
    """
    listed = materialize(describe_sets(docs, width, percent, id_col), "listed-sets")
    sets = materialize(listed.select("doc_id", "size", "sid"), "sets")
    roots = link_sets(docs.select("text"), listed, width, percent)
    named = _rooted(sets.where("size > 0").groupBy("sid").agg(F.min("doc_id").alias("least")), "sid", roots, "root")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_set = named.join(least, "root").select("sid", "component_id")
    rows = sets.select("doc_id", "size", F.when(F.col("size") > 0, F.col("sid")).alias("sid"))
    out = rows.join(of_set, "sid", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 90 percent similarity of 3-word shingles."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_documents(docs, width=3, percent=90)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: the one of the least doc_id, nulls last, then of the least hash of its text.

    A document is what rows equal in doc_id and text share, so such rows stay or go together. Documents without words stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = join_documents(docs.select(key.alias("doc_id"), "text"), width, percent)
    gone = found.where("component_id < doc_id").select(F.col("doc_id.id").alias("__id"), F.col("doc_id.text").alias("__text"))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__text")), "left_anti")
