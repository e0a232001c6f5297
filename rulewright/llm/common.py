"""Helpers shared by the training-data operators.

Operators that run Python on executors receive Arrow record batches; the string column's own
UTF-8 buffer is then handled with numpy, without one Python object per row.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; a worker holds a few batches at a time.
BATCH_ROWS, BATCH_BYTES = 2048, 2 << 20

U64 = np.uint64
#: 0x20 and 0x09 to 0x0D separate words everywhere in this subpackage.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="rulewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch_dir(spark: SparkSession) -> str | None:
    """The shared folder as a path, where it is mounted; None if only Spark's readers can open it, which leaves tasks their own folders."""
    path = shared_dir(spark)
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return path if path.startswith("/") else None


#: Paths of tables that ``materialize`` wrote and nothing has deleted, in order.
_WRITTEN: dict[str, None] = {}

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and no executor's loss loses it.

    The write's shuffles go as it ends, as nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    _WRITTEN[path] = None
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._rulewright_paths = [path]
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing reads any more."""
    _delete(written[0].sparkSession, [x for df in written for x in df._rulewright_paths])


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for x in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.pop(x, None)


@contextmanager
def leaving(left: list[str]) -> Iterator[None]:
    """Adds to left the tables that are written meanwhile and not deleted as it ends: a lazy result may read them."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        left += [x for x in _WRITTEN if x not in before]


def release(spark: SparkSession, left: list[str], reader: DataFrame | None = None) -> None:
    """Delete the tables of left, and take them off it, but for those that reader reads."""
    files = reader.inputFiles() if left and reader is not None else []
    gone = [x for x in left if not any(x.rpartition("/")[2] in f for f in files)]
    _delete(spark, gone)
    left[:] = [x for x in left if x not in gone]


def sweep(spark: SparkSession) -> None:
    """Let go of finished shuffles' files: Spark's cleaner removes them once the driver has collected what referred to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(spark: SparkSession) -> None:
    """Before another kind of work: ``sweep``, and executors collect their garbage, which gives heap that they don't use back to the machine."""
    sweep(spark)
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).selectExpr("java_method('java.lang.System', 'gc') AS done").collect()


def prepare_workers(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the Arrow batches that workers get."""
    context = spark.sparkContext
    if getattr(context, "_rulewright_sent", None) != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="rulewright-")) / f"rulewright_{context.applicationId.replace('-', '_')}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(package.rglob("*.py")):
                z.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._rulewright_sent = context.applicationId
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_CACHES: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a worker keeps of an operator's models from task to task, by the operator's module; it goes when another operator's task begins."""
    return _CACHES.setdefault(owner, {})


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema), whose workers give back the memory that they don't need any more.

    Workers outlive tasks: models of other operators go when a task begins, and broadcast values, which are read again
    from the executor's file, when it ends.
    """
    owner = run.__module__

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.core.broadcast import _broadcastRegistry

        for other in [k for k in _CACHES if k != owner]:
            del _CACHES[other]
        yield from run(batches)
        for value in _broadcastRegistry.values():
            if getattr(value, "_path", None):
                value.__dict__.pop("_value", None)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(trimmed, schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def chain(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """h with one more 64-bit value taken in: for a given h or a given value a bijection, and no linear one."""
    return mix((h ^ value) * U64(0xD6E8FEB86659FD93) + U64(0xA0761D6478BD642F))


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as an integer, zeros beyond the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary Arrow array and its n + 1 offsets, from 0; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def windows(raw: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of the ``size`` bytes from each position, by doubling; size is a power of two, 8 at least."""
    h = eight_bytes(raw)[: max(0, len(raw) - 7)] * U64(0x9E3779B97F4A7C15 + 2 * seed)
    n = 8
    while n < size:
        h ^= h >> U64(31)
        h = h[: max(0, len(h) - n)] * U64(0xD6E8FEB86659FD93 + 2 * seed) + h[n:]
        n *= 2
    return mix(h)


def long_hashes(hashes: np.ndarray, size: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:start + length], of ``size`` bytes at least, from ``windows`` of that size; the last one overlaps."""
    h = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    for k in range(0, int(length.max(initial=0)), size):
        i = np.flatnonzero(length > k)
        h[i] = chain(h[i], hashes[start[i] + np.minimum(k, length[i] - size)])
    return h


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and offsets of each text's words among them. Words don't cross texts."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    word[1:-1] = ~SPACE[raw]
    starts = word[1:-1] & ~word[:-2]
    ends = word[1:-1] & ~word[2:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    starts[inner] = word[1:-1][inner]
    ends[inner - 1] = word[1:-1][inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand.

    Eight bytes at a time are mixed in, so that no structure of the bytes makes different spans collide; spans of more than
    64 bytes are hashed one by one by BLAKE2.
    """
    size = ends - starts
    words = eight_bytes(raw)
    h = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
    for k in range(0, min(64, int(size.max(initial=0))), 8):
        i = np.flatnonzero(size > k)
        left = np.minimum(size[i] - k, 8).astype(U64)
        h[i] = chain(h[i], words[starts[i] + k] & (~U64(0) >> (U64(64) - U64(8) * left)))
    for i in np.flatnonzero(size > 64):
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def sorted_by(group: np.ndarray, n_groups: int, key: np.ndarray) -> np.ndarray:
    """Indices that order by (group, key), from one sort of 64-bit integers; ties of its shortened keys are sorted in full."""
    bits = U64(max(1, int(n_groups).bit_length()))
    short = (group.astype(U64) << (U64(64) - bits)) | (key >> bits)
    order = np.argsort(short)
    short, whole = short[order], key[order]
    tie = short[1:] == short[:-1]
    if np.any(tie & (whole[1:] != whole[:-1])):
        return np.lexsort((key, group))
    return order


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of width-word shingles of each lower-cased text, and each text's offsets among them.

    A text of fewer words has its whole sequence as one shingle; a text without words has none.
    """
    raw = LOWER[raw]
    starts, ends, words = word_spans(raw, offsets)
    h = span_hashes(raw, starts, ends)
    count = np.diff(words)
    made = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(made)), made)
    out = np.concatenate([[0], np.cumsum(made)])
    first = words[:-1][text] + np.arange(out[-1]) - out[:-1][text]
    length = np.minimum(count[text], width)
    total = np.zeros(len(first), U64)
    for i in range(width):
        inside = i < length
        total[inside] = chain(total[inside], h[first[inside] + i])
    order = sorted_by(text, len(made), total)
    text, total = text[order], total[order]
    keep = np.ones(len(text), bool)
    keep[1:] = (text[1:] != text[:-1]) | (total[1:] != total[:-1])
    return total[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=len(made)))]).astype(np.int64)
