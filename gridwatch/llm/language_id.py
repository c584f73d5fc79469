"""Language identification: averaged hashed subword embeddings with a linear softmax, trained in numpy.

Subwords are runs of two, three and four bytes of the lower-cased text in which white space (one space for
any run's byte) stands only at an end; each hashes to a row of an embedding table. A document is the
average of its subwords' embeddings, and a linear softmax gives the languages. Stochastic gradient descent
over single documents trains both. A temperature fitted on calibration rows makes the largest probability a
confidence, and texts whose confidence is under a low quantile of those of calibration rows are rejected.

The fit uses about ``SAMPLE`` rows of each language, drawn by the hash of their doc_id against a bound from the
language's count, and about ``SAMPLE_ROWS`` in all, at least one of each language. Prediction covers every whole text. Texts that are null or have no letter are ``und`` with score 0 and rejected, and so
is every text where no row has a language. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_bytes, chunks, release, small_batches

#: Rows of each language, and rows in all, that the fit uses.
SAMPLE, SAMPLE_ROWS = 1200, 20_000
BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.array([32 if b in (9, 10, 11, 12, 13, 32) else b for b in range(256)], dtype=np.uint8)


def _subwords(docs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block of the joined texts and each length: the bucket at every byte (``BUCKETS`` for none), the
    documents that have bytes in the block, and the first of each there."""
    joined = b"\n\n".join(docs).lower()
    every = np.frombuffer(b"\n" + joined + b"\n" * 6, dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(d) + 2 for d in docs])])
    for lo in range(0, int(first[-1]), BLOCK_BYTES):
        n = min(BLOCK_BYTES, int(first[-1]) - lo)
        buf = _SPACE[every[lo : lo + n + max(ORDERS)]].astype(np.uint32)
        space = buf == 32
        own = np.arange(np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, lo + n))
        last = first[own + 1] - 1 - lo
        for k in ORDERS:
            h = np.full(n, k, dtype=np.uint32)
            for j in range(k):
                h = h * np.uint32(0x01000193) ^ buf[j : j + n]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            bucket = (h >> np.uint32(17)).astype(np.int32)
            bad = space[:n] & space[k - 1 : k - 1 + n] if k == 2 else np.logical_or.reduce([space[j : j + n] for j in range(1, k - 1)])
            bucket[bad] = BUCKETS
            bucket[last[last < n]] = BUCKETS  # the second of two line ends: it belongs to no text
            yield bucket, own, np.maximum(first[own] - lo, 0)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    n = sum(np.bincount(b, minlength=BUCKETS + 1) for b, _, _ in _subwords(as_bytes([text])))[:BUCKETS]
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float32)


def sample(docs: DataFrame, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Buckets, counts and language of the rows to fit on: a bounded sample."""
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and text is not null and lang is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return []
    most = max(1, min(SAMPLE, SAMPLE_ROWS // len(counts)))
    # the draw's bound leaves room for chance, so that a small language still has a row
    bounds = rows.sparkSession.createDataFrame([(r["lang"], int(min(1.0, (most + 3 * most**0.5) / r["count"]) * (1 << 62))) for r in counts], "lang string, bound bigint")
    drawn = rows.join(F.broadcast(bounds), "lang").where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 2) <= F.col("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [_counts(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array([a.astype(np.uint16).tobytes() for a, _ in both], pa.binary()), pa.array([n.tobytes() for _, n in both], pa.binary())], names=["doc_id", "lang", "at", "n"])

    got = drawn.select("doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, at binary, n binary").toPandas()
    got = got.sort_values(["doc_id", "lang", "at", "n"], kind="stable").drop_duplicates(["doc_id", "lang"])
    return [(np.frombuffer(a, dtype=np.uint16), np.frombuffer(n, dtype=np.float32), g) for a, n, g in zip(got["at"], got["n"], got["lang"], strict=True) if len(a)]


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, str]], epochs: int = 4, seed: int = 3, reject: float = 0.001):
        self.langs = sorted({g for _, _, g in rows})
        rng = np.random.default_rng(seed)
        c = max(len(self.langs), 1)
        emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        out, bias = rng.normal(0, 0.5, (DIM, c)).astype(np.float32), np.zeros(c, dtype=np.float32)
        order = rng.permutation(len(rows))
        hold, fit = order[: len(order) // 5], order[len(order) // 5 :]
        steps, done = epochs * len(fit), 0
        for _ in range(epochs):
            for i in rng.permutation(fit):
                at, n, g = rows[i]
                share = (n / n.sum())[:, None]
                x = (emb[at] * share).sum(axis=0)
                p = _softmax(x @ out + bias)
                p[self.langs.index(g)] -= 1
                rate = np.float32(1 - done / steps)
                back = out @ p
                out -= 0.5 * rate * np.outer(x, p)
                bias -= 0.1 * rate * p
                emb[at] -= 8 * rate * share * back
                done += 1
        self.table = np.concatenate([emb @ out, np.zeros((1, c), dtype=np.float32)]).astype(np.float32)
        self.bias, self.heat, self.least = bias, 1.0, 0.0
        z = np.array([(self.table[at] * n[:, None]).sum(axis=0) / n.sum() + bias for at, n, _ in (rows[i] for i in hold)])
        if len(z):
            y = np.array([self.langs.index(rows[i][2]) for i in hold])
            loss = {t: -np.log(_softmax(z * t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 8, 40)}
            self.heat = min(loss, key=loss.get)
            self.least = float(min(0.5, np.quantile(_softmax(z * self.heat).max(axis=1), reject)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        letters = [t is not None and _LETTER.search(t) is not None for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums, n = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for bucket, own, first in _subwords(as_bytes(texts)):
            sums[own] += np.add.reduceat(self.table[bucket], first)
            n[own] += np.add.reduceat((bucket < BUCKETS).astype(np.int64), first)
        p = _softmax((sums / np.maximum(n, 1)[:, None] + self.bias) * self.heat)
        best = p.argmax(axis=1)
        return [self.langs[i] if ok else "und" for i, ok in zip(best, letters, strict=True)], np.where(letters, p.max(axis=1), 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _predicted(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    langs, scores = [], [np.zeros(0)]
    for s in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        g, p = model.predict(texts.slice(s.start, s.stop - s.start).to_pylist())
        langs += g
        scores.append(p)
    return langs, np.concatenate(scores)


def language_of(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document."""
    small_batches(docs.sparkSession)
    model = Model(sample(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, p = _predicted(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(g, pa.string()), pa.array(p)], names=["doc_id", "lang_pred", "score"])
        release()

    out = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", ((F.col("lang_pred") == "und") | (F.col("score") < model.least)).alias("rejected"))


def without_rejected(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language isn't rejected, with all of their columns. Only texts go to Python workers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model(sample(docs)))

    @F.arrow_udf("boolean")
    def known(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            g, p = _predicted(texts, shared.value)
            yield pa.array([x != "und" for x in g], pa.bool_()) if not g else pa.array((np.array(g) != "und") & (p >= shared.value.least))
        release()

    return docs.where(known(docs["text"].cast("string")))
