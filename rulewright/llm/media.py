"""Media columns: Netpbm and BMP images as binary columns, decoded, area-resized, written as NPY tiles, hashed.

``decode`` reads PBM, PGM and PPM (plain and raw, P1 to P6, 8 or 16 bits a sample) and uncompressed BMP of 1, 4, 8,
24 or 32 bits a pixel. ``area_resize`` averages the source area under every target pixel exactly, by an integral
image. ``difference_hash`` compares neighbours of a 9 x 8 tile. ``write_npy`` and ``read_npy`` are the NPY format 1.0.

A null or undecodable image has null width, height, tile and hash; it never fails a job.
"""

from __future__ import annotations

import ast
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, prepare_workers

_TOKEN = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*([^\s#]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw 8-bit PGM of a (height, width) array."""
    return b"P5\n%d %d\n255\n" % samples.shape[::-1] + np.ascontiguousarray(samples, np.uint8).tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = int(data[1:2]), 2, []
    while len(numbers) < (2 if kind in (1, 4) else 3):
        m = _TOKEN.match(data, at)
        numbers.append(int(m[1]))
        at = m.end()
    width, height, top = *numbers[:2], numbers[2] if kind not in (1, 4) else 1
    channels = 3 if kind in (3, 6) else 1
    if not 0 < top < 65536 or width < 1 or height < 1:
        raise ValueError("bad header")
    n = width * height * channels
    if kind == 1:
        body = re.sub(rb"\s", b"", re.sub(rb"#[^\n\r]*", b"", data[at:]))[:n]
        if body.strip(b"01"):
            raise ValueError("neither 0 nor 1")
        out = 49 - np.frombuffer(body, np.uint8).astype(np.int64)
    elif kind in (2, 3):
        out = np.array(re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n], np.int64)
    elif kind == 4:
        line = -(-width // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at + 1).reshape(height, line), axis=1)
        out = 1 - bits[:, :width].astype(np.int64).ravel()
    else:
        out = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if out.size != n:
        raise ValueError("too short")
    if top < 255 or out.dtype != np.uint8:
        if out.min() < 0 or out.max() > top:
            raise ValueError("a sample above the greatest one")
    if top == 255 and out.dtype == np.uint8:
        return out.reshape(height, width, channels)
    return ((out.astype(np.int64) * 255 + top // 2) // top).astype(np.uint8).reshape(height, width, channels)


def _bmp(data: bytes) -> np.ndarray:
    word = lambda at, n=4: int.from_bytes(data[at : at + n], "little", signed=n == 4)
    start, head, width, height, bits = word(10), word(14), word(18), word(22), word(28, 2)
    masks = tuple(data[54:66]) if word(30) == 3 and bits == 32 else None  # only blue, green, red in this order are read
    if head < 40 or word(30) not in (0, 3) or (word(30) == 3 and masks != (0, 0, 255, 0, 0, 255, 0, 0, 255, 0, 0, 0)) or width < 1 or not height:
        raise ValueError("not an uncompressed bitmap")
    line = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    if bits <= 8:
        colours = np.frombuffer(data, np.uint8, (word(46) or 1 << bits) * 4, 14 + head).reshape(-1, 4)
        index = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits) @ (1 << np.arange(bits)[::-1])
        out = colours[index[:, :width], 2::-1]
    elif bits in (24, 32):
        out = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        raise ValueError("depth")
    return out[::-1] if height > 0 else out


def decode(data: bytes) -> np.ndarray:
    """An image as a (height, width, channels) array of 8-bit samples. Raises ValueError on anything else."""
    try:
        if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
            return _netpbm(data)
        if data[:2] == b"BM":
            return _bmp(data)
    except (TypeError, IndexError, OverflowError) as e:
        raise ValueError(str(e)) from e
    raise ValueError("neither Netpbm nor BMP")


def area_resize(image: np.ndarray, height: int, width: int, band_bytes: int = 4 << 20) -> np.ndarray:
    """The exact mean of the source area under each target pixel, rounded half up; (height, width, channels).

    The integral image is made in bands of rows of about ``band_bytes``, of which only the rows at target edges are kept.
    """
    h, w, c = image.shape

    def at(edges: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        whole = edges * size // n  # edge = edges * size / n
        return whole, edges * size - whole * n

    r, fr = at(np.arange(height + 1), height, h)
    s, fs = at(np.arange(width + 1), width, w)
    r1, s1 = np.minimum(r + 1, h), np.minimum(s + 1, w)
    needed = np.unique(np.concatenate([r, r1]))
    total = np.zeros((len(needed), w + 1, c), np.int64)
    step, carry = max(1, band_bytes // (8 * (w + 1) * c)), np.zeros((w + 1, c), np.int64)
    for a in range(0, h, step):
        band = np.zeros((min(step, h - a) + 1, w + 1, c), np.int64)
        np.cumsum(image[a : a + step], axis=0, out=band[1:, 1:], dtype=np.int64)
        np.cumsum(band[1:, 1:], axis=1, out=band[1:, 1:])
        band += carry
        some = (needed >= a) & (needed < a + len(band))
        total[some], carry = band[needed[some] - a], band[-1]
    top, bottom = np.searchsorted(needed, r), np.searchsorted(needed, r1)
    fr, fs = fr[:, None, None], fs[None, :, None]
    rows = total[top] * (height - fr) + total[bottom] * fr  # scaled by height, then by width: all integers
    both = rows[:, s] * (width - fs) + rows[:, s1] * fs
    area = np.diff(np.diff(both, axis=0), axis=1)
    return ((2 * area + h * w) // (2 * h * w)).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: of each row of a 9 x 8 tile of the mean channel, whether a pixel is less than its right neighbour."""
    tile = area_resize(image, 8, 9).mean(axis=2)
    return np.packbits(tile[:, :-1] < tile[:, 1:]).tobytes().hex()


def write_npy(array: np.ndarray) -> bytes:
    """NPY format 1.0."""
    head = f"{{'descr': '{array.dtype.str}', 'fortran_order': False, 'shape': {array.shape}, }}"
    head += " " * (-(len(head) + 11) % 64) + "\n"
    return b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head.encode() + np.ascontiguousarray(array).tobytes()


def read_npy(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[8:10], "little")
    head = ast.literal_eval(data[10 : 10 + n].decode())
    return np.frombuffer(data, head["descr"], -1, 10 + n).reshape(head["shape"])


def store_payload(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", line: int = 64) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of ``line``, as a raw PGM of that width.

    A null text counts as empty. Rows keep their ids, null and repeated ones too.
    """
    prepare_workers(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                data = text or b""
                sizes.append(len(data))
                data += bytes(max(line, -(-len(data) // line) * line) - len(data))
                media.append(encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, line)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), store, f"id {kind}, n_bytes long, media binary")


def describe_media(df: DataFrame, media_col: str = "media", tile: int = 32) -> DataFrame:
    """df's other columns and width, height, channels, samples (decoded, as bytes), tile (an NPY file of tile x tile) and dhash.

    Columns of those names are replaced. Repeated images have equal results.
    """
    prepare_workers(df.sparkSession)
    new = ["width", "height", "channels", "samples", "tile", "dhash"]
    kept = [c for c in df.columns if c not in [*new, media_col]]
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f"{', ' if kept else ''}`{media_col}` binary, "

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(len(kept)).to_pylist():
                try:
                    image = decode(data or b"")
                    rows.append((*image.shape[1::-1], image.shape[2], image.tobytes(), write_npy(area_resize(image, tile, tile)), difference_hash(image)))
                except ValueError:
                    rows.append((None,) * 6)
            made = zip(*rows, strict=True) if rows else [[]] * 6
            arrays = [pa.array(x, t) for x, t in zip(made, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*kept, media_col, *new])

    return map_batches(df.select(*[f"`{c}`" for c in kept], media_col), describe, types + "width int, height int, channels int, samples binary, tile binary, dhash string")


def op2(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a PGM and read back; digests of the decoded samples, of the stored form and its features."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    seen = describe_media(store_payload(docs))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples, media, tiles = (batch.column(i).to_pylist() for i in (2, 3, 4))
            sha = lambda x: hashlib.sha256(x).hexdigest()
            feature = [f"{h}:{zlib.crc32(t):08x}" for h, t in zip(batch.column(5).to_pylist(), tiles, strict=True)]
            made = [
                pa.array(map(len, samples), pa.int64()), pa.array(map(sha, samples), pa.string()), pa.array((zlib.crc32(x[-64:]) for x in samples), pa.int64()),
                pa.array(map(len, media), pa.int64()), pa.array(map(sha, media), pa.string()), pa.array(feature, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_batches(seen.select("id", "n_bytes", "samples", "media", "tile", "dhash"),
        digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
