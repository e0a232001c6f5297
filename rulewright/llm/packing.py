"""Best-fit packing of token sequences, after reduction by dominance.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. What matters to packing is how many
pieces there are of each length, so an instance of any size is ``capacity`` counts, which the driver gets. Dominance
(Martello and Toth) fixes bins for good where no packing can do better: a piece with its exact complement; a
piece alone when nothing fits beside it; a piece with the largest that fits when no two others do, or when that one is at
least as long as any two that fit together. Each rule is applied to all equal pieces at once. Best fit, longest
first, packs what is left, again in groups of equal bins. The result is a list of runs: pieces of a length, by rank,
go to consecutive sequences at one offset. Ranks within a length are counted in salted groups, so a length that many
pieces share is no hot key.
"""

from __future__ import annotations

import bisect
import itertools
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, materialize, prepare_workers, worker_cache

#: Words beyond which a worker keeps half as many, those that it has used most, and pieces ranked in one group.
MEMO, GROUP = 300_000, 500_000

_KNOWN = [c for c in [*range(0x250), *range(0x2010, 0x2028), 0x20AC] if c != 0x130]


def _class(wanted: str) -> str:
    return "".join(re.escape(chr(c)) for c in _KNOWN if unicodedata.category(chr(c))[0] == wanted)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i] to starts[i] + sizes[i] - 1 for each i, concatenated."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTokens:
    """Ids of texts as little-endian 32-bit bytes, by a tokenizer whose words are encoded one by one.

    Texts of common characters are split here, by the tokenizer's own rule, and each distinct word gets a number and is
    encoded once by the tokenizer; any other text is encoded by it as a whole.
    """

    def __init__(self, json: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tool = Tokenizer.from_str(json)
        self.tool.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, numbers = _class("L"), _class("N")
        space = "\t\n\x0b\x0c\r \x85\xa0"
        self.split = re.compile(f"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{numbers}]|[^{space}{letters}{numbers}]+").findall
        self.split_ascii = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\t-\r a-z0-9]+").findall
        vocabulary = self.tool.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that end a word
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.odd = re.compile("[^" + "".join(re.escape(chr(c)) for c in _KNOWN) + "]").search
        self.bare = Tokenizer(self.tool.model)  # for words that are normal and split already
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.numbers: dict[str, int] = defaultdict(itertools.count().__next__)  # of words, from 0, in their order
        self.ids = np.zeros(0, "<u4")  # of all words, one after the other
        self.starts, self.sizes, self.used = (np.zeros(0, np.int64) for _ in range(3))

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has; a thousand are encoded as one text, and told apart by their last tokens."""
        ids, sizes = [self.ids[:0]], [self.sizes[:0]]
        groups = [words[a : a + 1000] for a in range(0, len(words), 1000)]
        for some, made in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids.append(np.array(made.ids, "<u4"))
            ends = np.flatnonzero(self.last[ids[-1]]) + 1
            if len(ends) != len(some) or (len(ends) and ends[-1] != len(ids[-1])):
                each = self._encode(some)
                ids[-1] = np.frombuffer(b"".join(each), "<u4")
                ends = np.cumsum([len(x) // 4 for x in each])
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self) -> None:
        """Encodes the words that have a number but no ids."""
        new = list(itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.sizes)))[::-1]
        ids, sizes = self._encode_words(new)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])

    def _forget(self) -> None:
        """Of more than MEMO words the half of MEMO that was used most stays; uses of long ago count less and less."""
        if len(self.sizes) <= MEMO:
            return
        kept = np.argsort(-self.used, kind="stable")[: MEMO // 2]
        words = list(self.numbers)
        self.numbers = defaultdict(itertools.count(len(kept)).__next__, {words[k]: i for i, k in enumerate(kept.tolist())})
        self.ids = self.ids[_ranges(self.starts[kept], self.sizes[kept])]
        self.sizes, self.used = self.sizes[kept], self.used[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        plain, words = [], []
        for i, t in enumerate(texts):
            if t.isascii():
                plain.append(i)
                words.append(self.split_ascii(t.lower()))
            elif not self.odd(t):
                plain.append(i)
                words.append(self.split(t.lower()))
        self._forget()
        text_ends = np.cumsum([0, *map(len, words)])
        numbers = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(words)), np.int64, int(text_ends[-1]))
        self._learn()
        self.used += np.bincount(numbers, minlength=len(self.used))
        sizes = self.sizes[numbers]
        data = self.ids[_ranges(self.starts[numbers], sizes)].tobytes()
        ends = (4 * np.concatenate([[0], np.cumsum(sizes)])[text_ends]).tolist()
        for i, a, b in zip(plain, ends[:-1], ends[1:], strict=True):
            out[i] = data[a:b]
        rest = [i for i in range(len(texts)) if out[i] is None]
        for i, x in zip(rest, self._encode([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece int, start long, length long, ids_crc32 long[, ids array<long>]), a row per piece, each document's ids followed by end_id.

    A null text counts as empty and is one piece of one token. Null and repeated doc_ids are documents of their own.
    """
    prepare_workers(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the tokenizer file, under 2 MB
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        key = zlib.crc32(sent.value.encode())
        tokenizers = worker_cache(__name__)
        if key not in tokenizers:
            tokenizers[key] = WordTokens(sent.value)
        last, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            source, piece, length, crc, ids = [], [], [], [], []
            for i, x in enumerate(tokenizers[key]([t or "" for t in batch.column(1).to_pylist()])):
                x += last
                for n, a in enumerate(range(0, len(x), step)):
                    part = x[a : a + step]
                    source.append(i)
                    piece.append(n)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            n = pa.array(piece, pa.int32())
            columns = [batch.column(0).take(pa.array(source, pa.int64())), n, pa.array(np.array(piece, np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.list_(pa.int64()))] * with_ids], names)

    types = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return map_batches(docs.select(id_col, text_col), run, types)


def reduce_by_dominance(count: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins that some best packing has, as (lengths, how many); their pieces are taken off count (indexed by length)."""
    fixed = []

    def fix(lengths: tuple[int, ...], n: int) -> None:
        fixed.append((lengths, n))
        for w in lengths:
            count[w] -= n

    def smallest(without: int, n: int) -> list[int]:
        """The n shortest pieces beside one of length without."""
        out: list[int] = []
        for w in sizes:
            have = count[w] - (w == without)
            if have > 0:
                out += [w] * min(n - len(out), have)
            if len(out) >= n:
                break
        return out

    sizes = [w for w in range(1, capacity + 1) if count[w]]
    for j in reversed(sizes):
        while count[j] > 0:
            room = capacity - j
            mate = room if room and count[room] - (room == j) > 0 else 0
            if not mate:
                low = smallest(j, 3)
                if not low or low[0] > room:
                    fix((j,), count[j])
                    break
                best = next(w for w in reversed(sizes) if w <= room and count[w] - (w == j) > 0)
                if len(low) < 2 or low[0] + low[1] > room:
                    mate = best
                elif len(low) < 3 or sum(low) > room:
                    pair = max((a + b for a in sizes if a < room and count[a] - (a == j) > 0 for b in (next((w for w in reversed(sizes) if w <= room - a and count[w] - (w == j) - (w == a) > 0), 0),) if b), default=0)
                    if best < pair:
                        break
                    mate = best
                else:
                    break
            fix((j, mate), count[j] // 2 if mate == j else min(count[j], count[mate]))
        if count[j] == 0:
            continue
    return fixed


def best_fit(count: list[int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The rest in bins, longest pieces first, each in the fullest bin that it fits: (lengths, how many)."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []  # sorted keys of open_bins
    done = []

    def put(lengths: tuple[int, ...], n: int, room: int) -> None:
        if not room:
            done.append((lengths, n))
        else:
            if room not in open_bins:
                bisect.insort(rooms, room)
            open_bins.setdefault(room, []).append((lengths, n))

    for w in range(capacity, 0, -1):
        n = count[w]
        while n:
            k = bisect.bisect_left(rooms, w)
            if k == len(rooms):
                each = capacity // w
                if n >= each:
                    put((w,) * each, n // each, capacity - each * w)
                if n % each:
                    put((w,) * (n % each), 1, capacity - n % each * w)
                break
            room = rooms[k]
            lengths, have = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
                rooms.pop(k)
            used = min(n, have)
            if have > used:
                put(lengths, have - used, room)
            # a bin of room for several equal pieces takes them one after the other, as best fit would
            put((*lengths, w), used, room - w)
            n -= used
        count[w] = 0
    return done + [x for group in open_bins.values() for x in group]


def plan(count: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, offset), sorted by length and rank; offsets are gapless in each sequence."""
    counts = [count.get(w, 0) for w in range(capacity + 1)]
    bins = reduce_by_dominance(counts, capacity) + best_fit(counts, capacity)
    used, runs, sequence = [0] * (capacity + 1), [], 0
    for lengths, n in bins:
        offset = 0
        for w in lengths:
            runs.append((w, used[w], n, sequence, offset))
            used[w] += n
            offset += w
        sequence += n
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id long (from 0, gapless) and offset long. Lengths are 1 to capacity.

    pieces is read twice and should be a written table. Columns of those names are replaced; no pieces give no rows.
    """
    prepare_workers(pieces.sparkSession)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    count = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    runs = plan(count, capacity)
    groups = F.element_at(F.create_map(*[F.lit(x) for w, n in count.items() for x in (w, -(-n // GROUP))]), F.col("length")) if count else F.lit(1)
    salted = pieces.select(*kept, F.pmod(F.xxhash64(F.lit(5), "doc_id", "piece"), groups).alias("__salt"))
    sizes = salted.groupBy("length", "__salt").agg(F.count(F.lit(1)).alias("n"))
    above = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "__salt", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__first"))  # a row per GROUP pieces and length
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("__rank", F.row_number().over(within)).join(F.broadcast(firsts), ["length", "__salt"])
    ranked = ranked.select(*kept, (F.col("__first") + F.col("__rank") - 1).cast("long").alias("__rank"))
    starts = runs[:, 0] << 44 | runs[:, 1]
    at = kept.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(len(kept)).to_numpy()
            run = np.searchsorted(starts, batch.column(at).to_numpy() << 44 | rank, "right") - 1
            sequence = runs[run, 3] + rank - runs[run, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(runs[run, 4])], [*kept, "sequence_id", "offset"])

    types = "".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}, " for c in kept)
    return map_batches(ranked, place, types + "sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """All of docs (doc_id, text) in sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(materialize(cut(docs, tokenizer_path, capacity), "pieces"), capacity)


def op3(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
