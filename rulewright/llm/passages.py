"""Removal of repeated passages: every byte covered by a ``width``-byte string that also starts elsewhere in the corpus.

Exact, for whole texts, by suffix sorting of those parts of the corpus that can hold a repeat:

1. Each string of ``width`` bytes has one anchor, the position of its least 64-byte hash (leftmost on ties); equal
   strings have equal anchors at equal distances. The starts that share an anchor form a segment. A text is
   reduced to its anchors: hash, hash of the segment's bytes, place. Equal texts count once, with their number.
2. An anchor hash seen once holds no repeat. One seen only with equal segments is repeated throughout.
   What is left are anchors seen with different segments; one example of each such segment is kept.
3. These are divided into parts of CHUNK starts at fixed distances from the anchor. All strings of a part share a core,
   and equal strings have equal cores, so step 2 is taken again with cores for anchors: mostly parts at the
   edge of a repeat are left.
4. Parts are dealt by core to shards, whose suffixes are sorted by external induced sorting; neighbours with a common
   prefix of ``width`` or more are repeats. Shards get SHARD bytes or so, and a larger one is sorted on disk. A core with more
   than HOT different parts, as a passage makes that very many texts share, is no one task's: its parts are cut
   into single strings, which are counted by two hashes wherever they fall.
5. Removed runs are the union of repeated strings; texts that have any are cut, others keep their bytes.

Texts are shuffled only if they have a segment to sort or a byte to remove: Bloom filters tell, which grow with what is
wanted up to BLOOM_BITS; what they let through in error, more and more beyond that, is dropped by a join. 64-bit hashes stand
for 64-byte strings and pairs of them for texts.
A null text counts as empty; an empty or short one is never touched; repeated rows and doc_ids are texts in other places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, discard, long_hashes, map_batches, materialize, mix, prepare_workers, scratch_dir, sweep, text_buffers, windows
from .inducedsort import repeated

GRAM = 64
CHUNK = 48
SHARD, HOT = 2 << 20, 5_000
#: Most bits of a Bloom filter (16 MB where it is sent), and of each part of it that a task builds.
BLOOM_BITS, BLOOM_PART = 1 << 27, 1 << 18
_SLICE = 2 << 20


def keys(text: Column) -> list[Column]:
    """The two 64-bit halves of a text's identity."""
    return [F.xxhash64(F.lit(i), text).alias(f"k{i}") for i in (1, 2)]


def anchors(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(text, anchor hash, segment hash, first start in the text, anchor less first start, starts) of every segment, in order."""
    window = width - GRAM + 1
    out = []
    for a in range(0, len(raw), _SLICE):
        part = raw[a : a + _SLICE + width - 1]
        n = len(part) - width + 1  # starts
        if n <= 0:
            break
        gram = windows(part, GRAM)
        value = (gram >> U64(23) << U64(23)) | np.arange(len(gram), dtype=U64)
        pad = np.full(-len(gram) % window, ~U64(0))
        grid = np.concatenate([value, pad]).reshape(-1, window)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:n], ahead[window - 1 : window - 1 + n]) & U64((1 << 23) - 1)).astype(np.int64)
        start = np.arange(n)
        text = np.searchsorted(offsets, start + a, "right") - 1
        ok = start + a + width <= offsets[text + 1]
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new & ok)
        if not len(first):
            continue
        # a segment ends where the next begins or its text has no further starts
        stop = np.append(np.flatnonzero(new), n)
        stop = stop[np.searchsorted(stop, first, "right")]
        stop = np.minimum(stop, offsets[text[first] + 1] - width + 1 - a)
        size = stop - first + width - 1
        seg = long_hashes(gram, GRAM, first, size)
        out.append((text[first], gram[anchor[first]], seg, first + a - offsets[text[first]], anchor[first] - first, stop - first))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, U64, U64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _reduce(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, gram, seg, at arrays) of each row with an anchor; at packs first start, anchor less first start (10 bits) and starts (10 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(2))
            text, gram, seg, first, ahead, starts = anchors(raw, offsets, width)
            bounds = np.searchsorted(text, np.arange(len(offsets)))
            lists = [_lists(x.view(np.int64), bounds) for x in (gram, seg, first << 20 | ahead << 10 | starts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["k1", "k2", "gram", "seg", "at"]).filter(pa.array(np.diff(bounds) > 0))

    if width - GRAM + 1 > 1023:
        raise ValueError("width is 64 to 1086")
    return map_batches(docs.select(*keys(F.col("text")), "text"), run, "k1 long, k2 long, gram array<long>, seg array<long>, at array<long>")


def bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of the k1 of wanted: 16 to 32 bits for each but no more than BLOOM_BITS, built in parts by tasks; the driver gets just these bits."""
    size = min(BLOOM_BITS, max(1 << 20, 1 << (16 * wanted.count()).bit_length()))
    places = wanted.select(F.pmod("k1", F.lit(size)).cast("int").alias("p"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            p = batch.column(0).to_numpy()
            for part in np.unique(p // BLOOM_PART).tolist():
                bits = parts.setdefault(part, np.zeros(BLOOM_PART, bool))
                bits[p[p // BLOOM_PART == part] % BLOOM_PART] = True
        yield pa.RecordBatch.from_arrays([pa.array(parts.keys(), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], ["part", "bits"])

    out = np.zeros(size // 8, np.uint8)
    dealt = places.repartition(16, F.floor(F.col("p") / BLOOM_PART))
    for part, bits in map_batches(dealt, build, "part int, bits binary").collect():
        out[part * BLOOM_PART // 8 : (part + 1) * BLOOM_PART // 8] |= np.frombuffer(bits, np.uint8)
    return out


def hits(bits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which keys a Bloom filter lets through."""
    p = np.mod(wanted, 8 * len(bits))
    return (bits[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)


def _texts(docs: DataFrame, filter_bits: np.ndarray) -> DataFrame:
    """(k1, k2, text), a row per distinct text that the filter lets through."""
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hits(sent.value, batch.column(0).to_numpy())))

    passed = map_batches(docs.select(*keys(F.col("text")), F.col("text").cast("binary").alias("text")), run, "k1 long, k2 long, text binary")
    return passed.groupBy("k1", "k2").agg(F.first("text").alias("text"))


def parts_of(raw: np.ndarray, offsets: np.ndarray, ahead: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(segment, core hash, part hash, first start in the segment, starts) of the parts of segments' bytes."""
    starts = np.diff(offsets) - width + 1
    low, high = np.maximum(0, -(-(ahead - starts + 1 - CHUNK + 1) // CHUNK)), ahead // CHUNK
    count = high - low + 1
    row = np.repeat(np.arange(len(starts)), count)
    j = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = np.maximum(0, ahead[row] - j * CHUNK - CHUNK + 1)
    last = np.minimum(starts[row] - 1, ahead[row] - j * CHUNK)
    grain = GRAM if width - CHUNK + 1 >= GRAM else 8
    hashes = windows(raw, grain)
    core = offsets[:-1][row] + ahead[row] - j * CHUNK
    at, size = offsets[:-1][row] + first, last - first + width
    cores = mix(long_hashes(hashes, grain, core, np.full(len(core), width - CHUNK + 1)) + j.astype(U64))
    return row, cores, long_hashes(hashes, grain, at, size), first, last - first + 1


def _parts(segments: DataFrame, width: int, bits: np.ndarray | None = None) -> DataFrame:
    """(core, part, k1, k2, first, starts[, bytes]) of segments (k1, k2, first, ahead, bytes); with bits, of the cores these let through."""
    sent = None if bits is None else segments.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(4))
            row, core, part, first, starts = parts_of(raw, offsets, batch.column(3).to_numpy(), width)
            names, extra = ["core", "part", "k1", "k2", "first", "starts"], []
            if sent is not None:
                ok = hits(sent.value, core.view(np.int64))
                row, core, part, first, starts = (x[ok] for x in (row, core, part, first, starts))
                at = offsets[:-1][row] + first
                extra = [pa.array([raw[a:b].tobytes() for a, b in zip(at, at + starts + width - 1, strict=True)], pa.binary())]
                names = [*names, "bytes"]
            columns = [core.view(np.int64), part.view(np.int64), batch.column(0).to_numpy()[row], batch.column(1).to_numpy()[row], batch.column(2).to_numpy()[row] + first, starts]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *extra], names)

    types = "core long, part long, k1 long, k2 long, first long, starts long" + ", bytes binary" * (bits is not None)
    return map_batches(segments.select("k1", "k2", "first", "ahead", "bytes"), run, types)


def _shard_repeats(segments: DataFrame, width: int, shards: int) -> DataFrame:
    """(k1, k2, first, starts) of repeated strings, from (core, k1, k2, first, bytes); shards are sorted side by side."""
    folder = scratch_dir(segments.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        whole = pa.Table.from_batches(held)
        found = repeated(whole["bytes"].to_pylist(), width, folder=folder)
        source, first, starts = [], [], []
        for i, mark in enumerate(found):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
            source += [i] * (len(edge) // 2)
            first += edge[::2].tolist()
            starts += (edge[1::2] - edge[::2]).tolist()
        at = pa.array(source, pa.int64())
        base = whole["first"].to_numpy()[source] if source else np.zeros(0, np.int64)
        columns = [whole["k1"].take(at).combine_chunks(), whole["k2"].take(at).combine_chunks(), pa.array(base + np.array(first, np.int64)), pa.array(starts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "first", "starts"])

    dealt = segments.repartition(shards, "core").select("k1", "k2", "first", "bytes")
    return map_batches(dealt, run, "k1 long, k2 long, first long, starts long")


def _counted_repeats(segments: DataFrame, width: int) -> DataFrame:
    """The same for anchors with very many segments: every string counted by its hash, in two 64-bit halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch.column(3))
            half = 1 << (width.bit_length() - 1)  # two of these cover a string
            starts = np.maximum(np.diff(offsets) - width + 1, 0)
            row = np.repeat(np.arange(len(starts)), starts)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts)
            p = offsets[:-1][row] + nth
            h = [mix(w[p] * U64(0xD6E8FEB86659FD93) + w[p + width - half]).view(np.int64) for w in (windows(raw, half, seed) for seed in (1, 2))]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(batch.column(2).to_numpy()[row] + nth), pa.array(h[0]), pa.array(h[1])], ["k1", "k2", "first", "h1", "h2"]
            )

    strings = map_batches(segments.select("k1", "k2", "first", "bytes"), run, "k1 long, k2 long, first long, h1 long, h2 long")
    often = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return strings.join(often, ["h1", "h2"]).select("k1", "k2", "first", F.lit(1).cast("long").alias("starts"))


def find_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """(k1, k2, whole boolean, places array<long>) of each distinct text with a repeat, from docs (text), written.

    whole: several rows have this text, so all its strings are repeated. A place is first start * 2**20 + starts.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    rows = _reduce(docs, width)
    texts = materialize(rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("gram", "seg", "at")]), "anchors")
    spread = texts.select("k1", "k2", F.explode(F.arrays_zip("gram", "seg", "at")).alias("x")).select("k1", "k2", "x.gram", "x.seg", "x.at")
    kinds = spread.groupBy("gram", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "at")).alias("example"))
    repeats = kinds.groupBy("gram").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > 1).select("gram", "kinds")
    found = anchored = materialize(kinds.join(repeats, "gram"), "repeated-anchors")

    direct = spread.join(found.where("n > 1").select("gram", "seg"), ["gram", "seg"])
    direct = direct.select("k1", "k2", F.shiftright("at", 20).alias("first"), F.col("at").bitwiseAND(F.lit(1023)).alias("starts"))

    wanted = found.where("kinds > 1").select("example.*").groupBy("k1", "k2").agg(F.collect_list("at").alias("ats"))
    opened = wanted = materialize(wanted, "open-segments")
    segments = _texts(docs, bloom(wanted)).join(wanted, ["k1", "k2"]).select("k1", "k2", "text", F.explode("ats").alias("at"))
    piece = F.expr(f"substring(text, CAST(shiftright(at, 20) AS INT) + 1, CAST(at & 1023 AS INT) + {width - 1})")
    ahead = F.shiftright("at", 10).bitwiseAND(F.lit(1023))
    segments = materialize(segments.select("k1", "k2", F.shiftright("at", 20).alias("first"), ahead.alias("ahead"), piece.alias("bytes")), "segments")

    discard(opened)
    parts = materialize(_parts(segments, width), "parts")
    kinds = parts.groupBy("core", "part").agg(F.count(F.lit(1)).alias("n"))
    cores = kinds.groupBy("core").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds")).where(F.col("all") > 1).select("core", "kinds")
    found = materialize(kinds.join(cores, "core"), "repeated-parts")
    equal = parts.join(found.where("n > 1").select("core", "part"), ["core", "part"]).select("k1", "k2", "first", "starts")
    open_ = found.where("kinds > 1").select("core", "part", (F.col("kinds") > HOT).alias("hot"))
    shown = _parts(segments, width, bloom(open_.select(F.col("core").alias("k1")))).groupBy("core", "part")
    shown = shown.agg(F.first(F.struct("k1", "k2", "first", "bytes")).alias("x")).join(open_, ["core", "part"])
    shown = materialize(shown.select("core", "hot", "x.*"), "open-parts")
    discard(segments)
    size = shown.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-size // SHARD))
    marks = direct.unionByName(equal).unionByName(_shard_repeats(shown.where("NOT hot"), width, shards)).unionByName(_counted_repeats(shown.where("hot"), width))
    marks = marks.groupBy("k1", "k2").agg(F.collect_list(F.col("first") * (1 << 20) + F.col("starts")).alias("places"))
    copies = texts.where("n > 1").select("k1", "k2", F.lit(True).alias("whole"))
    out = materialize(marks.join(copies, ["k1", "k2"], "full").select("k1", "k2", F.coalesce("whole", F.lit(False)).alias("whole"), "places"), "repeats")
    discard(texts, anchored, parts, found, shown)
    sweep(spark)
    return out


def removed_runs(size: int, width: int, whole: bool, places: list[int] | np.ndarray) -> np.ndarray:
    """Maximal removed runs [start, end) of a text."""
    if whole:
        return np.array([[0, size]] if size >= width else [], np.int64).reshape(-1, 2)
    at = np.sort(np.asarray(places, np.int64))
    start, end = at >> 20, (at >> 20) + (at & ((1 << 20) - 1)) + width - 1
    if not len(at):
        return np.zeros((0, 2), np.int64)
    reach = np.maximum.accumulate(end)
    new = np.ones(len(at), bool)
    new[1:] = start[1:] > reach[:-1]
    return np.stack([start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]], axis=1)


def cut_texts(docs: DataFrame, width: int = 400) -> DataFrame:
    """(k1, k2, n_bytes, n_removed, n_spans long, kept binary, left string: kept without parts of characters) of each distinct text of docs with a repeat."""
    repeats = find_repeats(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, whole, places in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                runs = removed_runs(len(text), width, whole, places or [])
                edges = [0, *runs.ravel().tolist(), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), int((runs[:, 1] - runs[:, 0]).sum()), len(runs), kept, kept.decode("utf-8", "ignore")))
            made = zip(*out, strict=True) if out else [[]] * 5
            arrays = [pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept", "left"])

    texts = _texts(docs, bloom(repeats)).join(repeats, ["k1", "k2"])
    return map_batches(texts.select("k1", "k2", "text", "whole", "places"), run, "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept binary, left string")


def remove_repeats(docs: DataFrame, width: int = 400) -> DataFrame:
    """docs with its texts cut; other columns, and their order, stay. Removed bytes may leave part of a character: it is dropped too."""
    cut = cut_texts(docs.select("text"), width).where("n_removed > 0").select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("left").alias("__kept"))
    k1, k2 = keys(F.col("text"))
    out = docs.join(cut, (k1 == F.col("__k1")) & (k2 == F.col("__k2")), "left")
    return out.select(*[F.coalesce("__kept", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op5(spark, sf_dir: str) -> DataFrame:
    """Every text without its repeated passages: counts of bytes and runs, and the digest of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = cut_texts(docs.select("text")).select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    every = docs.select("doc_id", *keys(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"))
    out = every.join(cut, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "own").alias("kept_sha256"))
