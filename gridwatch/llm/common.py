"""Tables, scratch space and byte-level word kernels shared by the corpus operators.

Words are maximal runs of bytes other than ASCII white space (space, 0x09-0x0D), after
lower-casing A-Z only. Null texts count as empty. The kernels work on lists of UTF-8 byte strings
and hold at most ``CHUNK_BYTES`` of text, or one longer document, at a time.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 19
#: Bytes of text, and words, of which scratch arrays are held at a time, whatever the length of a document.
BLOCK_BYTES, BLOCK_WORDS = 1 << 20, 1 << 16
#: Bytes of an Arrow batch, about, where the user has set none: Spark's default of 64 MB puts all texts of a partition in one.
BATCH, _BATCH_KEY = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"
_MASK = np.ones(256, dtype=bool)
_MASK[[9, 10, 11, 12, 13, 32]] = False
_rng = np.random.default_rng(20240131)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Bytes of alphanumeric words: letters, digits, and all bytes of characters beyond ASCII.
ALPHANUMERIC = np.array([chr(b).isalnum() or b >= 128 for b in range(256)])
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(4096, np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)
_HIGH = np.cumprod(np.concatenate([[np.uint64(1)], np.full(4095, _POWERS[-1])]), dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="gridwatch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/gridwatch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back: later work doesn't repeat its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of texts that go to Python workers: both sides hold a batch several times over. Holds for the session."""
    if spark.conf.get(_BATCH_KEY, None) is None:
        spark.conf.set(_BATCH_KEY, BATCH)


def release() -> None:
    """Give a worker's free memory back at the end of a task: it may run other operators next."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def as_bytes(texts: Iterable[str | None]) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[slice]:
    """Slices of consecutive documents that hold about ``limit`` bytes each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(place: np.ndarray) -> np.ndarray:
    """Powers of the hash's factor, from two tables."""
    out = _POWERS[place & 4095]
    if len(place) and (high := place >> 12).any():
        out *= _HIGH[high & 4095] * _HIGH[4095 - (high >> 12)] if (high >> 12).any() else _HIGH[high]
    return out


class Words:
    """Words of a chunk of documents: byte offsets, 64-bit hashes, and each document's range of words."""

    def __init__(self, docs: list[bytes], mask: np.ndarray = _MASK, lower: bool = True):
        self.joined = b"\n".join(docs) + b"\n"
        self.joined = self.joined.lower() if lower else self.joined
        self.buf = np.frombuffer(self.joined, dtype=np.uint8)
        inside = mask[self.buf]
        self.inside = inside
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        offsets = np.zeros(len(docs) + 1, dtype=np.int64)
        np.cumsum([len(d) + 1 for d in docs], out=offsets[1:])
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        sums = np.zeros(len(self.starts), dtype=np.uint64)
        for lo in range(0, len(self.buf), BLOCK_BYTES):
            hi = min(lo + BLOCK_BYTES, len(self.buf))
            # words that have bytes in the block
            a, b = np.searchsorted(self.ends, lo, side="right"), np.searchsorted(self.starts, hi)
            if a == b:
                continue
            first = np.maximum(self.starts[a:b], lo)
            at = np.arange(first[0], hi)
            spans = np.diff(first, append=hi)
            place = at - np.repeat(self.starts[a:b], spans)
            terms = _BYTE[self.buf[at[0] : hi]] * self.inside[at[0] : hi]
            terms *= _powers(np.where(self.inside[at[0] : hi], place, 0))
            sums[a:b] += np.add.reduceat(terms, first - first[0])
        return mix(sums + (self.ends - self.starts).astype(np.uint64) * _STEP)

    def word(self, i: int) -> bytes:
        return self.joined[self.starts[i] : self.ends[i]]


def shingles(words: Words, k: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct hashes of ``k`` consecutive words; fewer words count as one shingle."""
    h, n = words.hashes, len(words.hashes)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(n - k + 1, 0), dtype=np.uint64)
        for j in range(k):
            rolled = mix(rolled + h[j : n - k + 1 + j] + np.uint64(j + 1) * _STEP) if len(rolled) else rolled
        out = []
        for a, b in zip(words.first[:-1], words.first[1:], strict=True):
            if b - a >= k:
                s = np.sort(rolled[a : b - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif b > a:
                x = np.array([b - a], dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
                for j in range(a, b):
                    x = mix(x + h[j] + np.uint64(j - a + 1) * _STEP)
                out.append(x)
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out
