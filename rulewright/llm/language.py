"""Language ID by cross-parsing: the language whose labelled text covers a document in the fewest phrases wins.

A phrase is the longest prefix of what is left of the document that occurs in the language's training text; a suffix
automaton of that text finds it byte by byte. The cost of a document is its phrases times log2 of the training
text's length, per byte. Documents are parsed in blocks of 512 bytes, side by side with numpy: one step advances
every block of a batch by one byte through a dense transition table. All blocks first begin a phrase; then each but a
text's first is parsed again from the state in which the block before ends, until it is in the state that it was in
before at the same place, from where on nothing changes. Blocks that end in another state have the next one parsed
again. So phrases are those of the whole text, and parses that started apart soon agree.

Training text is a bounded sample of whole texts: of each language, at most ``rows`` documents with the smallest hashes of
doc_id, as many as have ``sample_bytes`` in total, none longer than an eighth of that where there are shorter ones. The text
is sent to executors, which build the automata once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, fold, map_batches, prepare_workers, text_buffers, worker_cache

BLOCK = 512
#: Bytes below which phrase limits don't apply: a number or a key may be most of such a text.
SHORT = 128
#: Set in a transition that begins a phrase.
BEGINS = 1 << 30


def suffix_automaton(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class of each byte value, table[state * classes + class]); state 0 is the initial one, the last one is before any phrase.

    Class 0 is padding, which changes nothing; the last class is of bytes that the text lacks.
    """
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(follow)
                follow.append(follow[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    known = sorted(set(text))
    classes = np.full(256, len(known) + 1, np.uint8 if len(known) < 254 else np.int16)
    classes[known] = np.arange(1, len(known) + 1)
    width, none = len(known) + 2, len(follow)
    table = np.full((none + 1, width), none | BEGINS, np.int32)  # an unknown byte is a phrase of its own
    table[:, 0] = np.arange(none + 1)
    for c, to in follow[0].items():
        table[:, classes[c]] = to | BEGINS
    state = np.repeat(np.arange(none), [len(x) for x in follow])
    steps = [(c, to) for x in follow for c, to in x.items()]
    if steps:
        byte, to = np.array(steps).T
        table[state, classes[byte]] = to
    return classes, table.ravel()


def _advance(table: np.ndarray, width: int, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return table[(state & (BEGINS - 1)).astype(np.int64) * width + codes]


def count_phrases(raw: np.ndarray, offsets: np.ndarray, automaton: tuple[np.ndarray, np.ndarray], step: int = 4096) -> np.ndarray:
    """Phrases of each text, ``step`` blocks of all texts at once."""
    classes, table = automaton
    width = int(classes.max()) + 1
    size = np.diff(offsets)
    blocks = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), blocks)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = offsets[:-1][text] + nth * BLOCK
    stop = np.minimum(start + BLOCK, offsets[1:][text])
    codes = np.concatenate([classes[LOWER[raw]], np.zeros(BLOCK, classes.dtype)])
    phrases = np.zeros(len(text), np.int64)
    initial = len(table) // width - 1
    ended = np.full(1, initial, np.int32)  # the state in which the last chunk of blocks ends
    for a in range(0, len(text), step):
        at, end = start[a : a + step], stop[a : a + step]
        grid = codes[at[:, None] + np.arange(BLOCK)]
        grid[np.arange(BLOCK) >= (end - at)[:, None]] = 0
        grid = np.ascontiguousarray(grid.T)
        seen = np.empty(grid.shape, np.int32)  # transitions taken
        state = np.full(len(at), initial, np.int32)
        begun = np.zeros(len(at), np.int64)
        for k, row in enumerate(grid):
            seen[k] = state = _advance(table, width, state, row)
            begun += state >> 30
        lanes = np.flatnonzero(nth[a : a + step] > 0)
        while len(lanes):
            before = np.where(lanes > 0, seen[-1, lanes - 1], ended)
            state, active, late = before, lanes, []
            for k in range(BLOCK):
                state = _advance(table, width, state, grid[k, active])
                was = seen[k, active]
                begun[active] += (state >> 30) - (was >> 30)
                seen[k, active] = state
                apart = (state ^ was) & (BEGINS - 1) != 0
                if not apart.all():
                    state, active = state[apart], active[apart]
                    if not len(active):
                        break
            late = active + 1 if len(active) else active
            late = late[late < len(at)]
            lanes = late[nth[a + late] > 0]
        phrases[a : a + step] = begun
        ended = seen[-1, -1:]
    return np.bincount(text, phrases, len(size)).astype(np.int64)


def sample_languages(docs: DataFrame, rows: int = 60, sample_bytes: int = 32_768) -> dict[str, bytes]:
    """Training text by language from (doc_id, text, lang): whole texts of smallest hash, at most ``rows`` and ``sample_bytes`` of each.

    Texts of more than an eighth of sample_bytes are taken after all others; only if a language has no text within
    sample_bytes, its first one is cut to that.
    """
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64(F.lit(7), "doc_id"))
    docs = docs.withColumn("size", F.octet_length("text")).withColumn("long", F.col("size") > sample_bytes // 8)
    share = docs.groupBy("lang", "long").count().select("lang", "long", (F.least(F.lit(1.0), 4 * rows / F.col("count")) * 2.0**63).alias("top"))
    first = Window.partitionBy("lang").orderBy("long", "h", "text")
    few = docs.join(F.broadcast(share), ["lang", "long"]).where(F.abs(F.col("h").cast("double")) <= F.col("top")).drop("top")
    few = few.withColumn("n", F.row_number().over(first)).where(F.col("n") <= rows)
    few = few.withColumn("all", F.sum(F.col("size") + 1).over(Window.partitionBy("lang").orderBy("n")))
    picked = few.where((F.col("all") <= sample_bytes + 1) | (F.col("n") == 1)).select("lang", "n", F.substring("text", 1, sample_bytes).alias("text"))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(picked.collect()):
        out.setdefault(lang, []).append(text)
    return {k: "\n".join(v).encode()[:sample_bytes] for k, v in out.items()}


def letters(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) & (raw < 128)
    ends = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = ends[offsets[1:]] > ends[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, raw[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore")))
    return found


def phrase_limits(sample: dict[str, bytes], times: float = 2.25, least: int = 4096) -> dict[str, float]:
    """Phrases a byte beyond which a text isn't of a language: ``times`` what the first half of its training text needs for the second.

    The median over blocks, so single odd documents don't count. A language of fewer than ``least`` bytes has no limit.
    """
    out = {}
    for lang, text in sample.items():
        half = len(text) // 2
        if len(text) >= least:
            offsets = np.arange(half // BLOCK + 1) * BLOCK
            counts = count_phrases(np.frombuffer(text[half:], np.uint8), offsets, suffix_automaton(text[:half].translate(LOWER.tobytes())))
            out[lang] = times * float(np.median(counts)) / BLOCK
    return out


def predict(raw: np.ndarray, offsets: np.ndarray, sample: dict[str, bytes], limits: dict[str, float] | None = None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: a softmax of costs in phrases, tempered by the root of the least.

    With limits, a text of more phrases than its language's limit, and the root of its bytes for chance, is ``und`` if it has SHORT bytes.
    """
    langs = sorted(k for k, v in sample.items() if v)
    found, scores = letters(raw, offsets), np.zeros(len(offsets) - 1)
    if not langs or not len(scores):
        return ["und"] * len(scores), scores
    costs, built = [], worker_cache(__name__)
    for lang in langs:
        key = (lang, sample[lang])
        if key not in built:
            if len(built) > 64:
                built.clear()
            built[key] = suffix_automaton(sample[lang].translate(LOWER.tobytes()))
        costs.append(count_phrases(raw, offsets, built[key]) * math.log2(len(sample[lang]) + 1) / 15)
    cost = np.array(costs)
    best = cost.min(axis=0)
    scores[found] = (1 / np.exp(-(cost - best) / (1 + np.sqrt(best))).sum(axis=0))[found]
    win = cost.argmin(axis=0)
    if limits:
        size = np.diff(offsets)
        phrases = best * np.array([15 / math.log2(len(sample[k]) + 1) for k in langs])[win]
        found &= (size < SHORT) | (phrases <= np.array([limits.get(k, math.inf) for k in langs])[win] * size + np.sqrt(size))
        scores[~found] = 0
    return [langs[w] if f else "und" for w, f in zip(win, found, strict=True)], scores


def identify(docs: DataFrame, sample: dict[str, bytes], text_col: str = "text", limits: dict[str, float] | None = None) -> DataFrame:
    """docs with lang_pred (``und`` for a null text, one without a letter or beyond limits, or an empty sample) and score in [0, 1], 0 for ``und``.

    Columns of those names are replaced; rows are judged one by one, so repeats get equal answers.
    """
    prepare_workers(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    at = kept.index(text_col)
    types = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(*text_buffers(batch.column(at)), sample, limits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], [*kept, "lang_pred", "score"])

    return map_batches(docs.select(*[f"`{c}`" for c in kept]), run, types + "lang_pred string, score double")


def filter_language(docs: DataFrame, least: float = 0.26) -> DataFrame:
    """The rows of docs whose language is told: not ``und``, within ``phrase_limits``, and with a score of ``least`` or, if that is less, above an even guess."""
    sample = sample_languages(docs.select("doc_id", "text", "lang"))
    told = identify(docs.select(F.struct("*").alias("row"), "text"), sample, limits=phrase_limits(sample))
    return told.where(F.col("lang_pred") != "und").where(F.col("score") >= min(least, 1.01 / max(1, len(sample)))).select("row.*")


def op10(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose fold of 4 isn't 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sample = sample_languages(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), 4) != 2))
    out = identify(docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "text"), sample)
    return out.select("doc_id", "held_out", "lang_pred", "score")
