"""Byte-level BPE: encoding by a two-tier lookup, and decoding.

A pre-token that is in the vocabulary as a whole gets its id from a minimal perfect hash (hash and displace: as many
slots as tokens, one small displacement for each bucket of keys), read for all new pre-tokens of a batch at once.
Other pre-tokens start as linked bytes; a heap holds the rank of every neighbouring pair that is a token, and the
lowest rank, leftmost first, is merged until none is left. A worker remembers results: its memo grows old after ``MEMO``
pre-tokens, and it keeps the one before, too.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import U64, map_batches, mix, prepare_workers, span_hashes, worker_cache

MEMO = 400_000


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: slots 0 to n - 1, each taken once."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        h = hash_all(keys)
        bucket = (h % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(self.n, bool)
        self.shift = np.zeros(self.buckets, np.int64)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            mine = h[order[bounds[b] : bounds[b + 1]]]
            if len(mine) == 0:
                break
            d, block = 0, 16
            while True:  # a block of displacements at once, for the least that fits
                slots = self._slots(mine[None, :], np.arange(d, d + block)[:, None])
                fits = ~taken[slots].any(axis=1) & (np.diff(np.sort(slots, axis=1), axis=1) != 0).all(axis=1)
                if fits.any():
                    d, slots = d + int(fits.argmax()), slots[fits.argmax()]
                    break
                d, block = d + block, min(2 * block, 8192)
                if d > 50 * self.n + 1000:
                    raise ValueError("keys repeat")
            taken[slots] = True
            self.shift[b] = d

    def _slots(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + d.astype(U64) * U64(0xC2B2AE3D27D4EB4F)) % U64(max(1, self.n))).astype(np.int64)

    def __call__(self, keys: list[bytes]) -> np.ndarray:
        h = hash_all(keys)
        return self._slots(h, self.shift[(h % U64(self.buckets)).astype(np.int64)])


def hash_all(keys: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(keys), np.uint8)
    ends = np.cumsum([len(k) for k in keys]).astype(np.int64)
    return span_hashes(raw, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if keys else np.zeros(0, U64)


class Codec:
    """Encoder and decoder of one vocabulary: lines of base64 token and rank."""

    def __init__(self, ranks_file: bytes, pattern: str):
        lines = [x.split() for x in ranks_file.splitlines() if x.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.split = regex.compile(pattern).findall
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.slot_token: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.hash(tokens), tokens, strict=True):
            self.slot_token[slot] = token
        self.token = {i: t for t, i in self.ranks.items()}
        self.number = {i: str(i) for i in self.token}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}  # the memo before this one

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece that isn't a token itself; a byte that has no token of its own and is merged into none is a KeyError."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != stop or after[i] != j:
                continue  # one of the two was merged meanwhile
            end[i], after[i], end[j] = stop, after[j], -1
            if after[j] < n:
                before[after[j]] = i
                right = after[j]
                if (r := ranks.get(piece[i : end[right]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[right]))
            if (left := before[i]) >= 0 and (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Put pieces' ids into the memo."""
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        unseen = pieces.difference(self.memo)
        self.memo.update((p, self.old[p]) for p in unseen.intersection(self.old))
        new = list(unseen.difference(self.old))
        raw = [p.encode() for p in new]
        for piece, data, slot in zip(new, raw, self.hash(raw), strict=True):
            self.memo[piece] = (self.ranks[data],) if self.slot_token[slot] == data else self.merge(data)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        pieces = [self.split(t) for t in texts]
        self.learn(set(chain.from_iterable(pieces)))
        ids = self.memo.__getitem__
        return [list(chain.from_iterable(map(ids, p))) for p in pieces]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The worker's codec of these ranks, built once."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    loaded = worker_cache(__name__)
    if key not in loaded:
        loaded[key] = Codec(ranks_file, pattern)
    return loaded[key]


def _with(df: DataFrame, made: str, kind: str, make, text_col: str, ranks_path: str, pattern: str) -> DataFrame:
    prepare_workers(df.sparkSession)
    with open(ranks_path, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file, about 1 MB
    kept = [c for c in df.columns if c != made]
    at = kept.index(text_col)
    types = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(sent.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(tool, batch.column(at))], [*kept, made])

    return map_batches(df.select(*[f"`{c}`" for c in kept]), run, f"{types}`{made}` {kind}")


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """df with ids array<int>. A null text counts as empty, which has no ids; a column ids is replaced."""
    make = lambda tool, column: pa.array(tool.encode_batch([t or "" for t in column.to_pylist()]), pa.list_(pa.int32()))
    return _with(df, "ids", "array<int>", make, text_col, ranks_path, pattern)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded binary, the bytes of its ids; null ids give null. A column decoded is replaced."""
    make = lambda tool, column: pa.array([None if x is None else tool.decode(x) for x in column.to_pylist()], pa.binary())
    return _with(df, "decoded", "binary", make, ids_col, ranks_path, pattern)


def op7(spark, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded; counts and digests of both."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    prepare_workers(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    pattern = public_tokenizers.PATTERN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(sent.value, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ids = tool.encode_batch([t or "" for t in batch.column(1).to_pylist()])
            text = [sha(" ".join(map(tool.number.__getitem__, x)).encode()) for x in ids]
            back = [sha(tool.decode(x)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(text, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
