"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word (a run of ASCII letters and digits or of bytes beyond ASCII, lower-cased) is the sum of the
embeddings of five hashes: the whole word and its first four to seven bytes. Filters over one, two
and three consecutive words run over the whole text, each takes its maximum, and a logistic layer turns the
maxima into a logit. Training starts from the smoothed log-odds of each hash bucket and goes on by Adam on
minibatches, with gradients through the positions of the maxima only.

Thresholds by language: a linear softmax over hashed words (trained on the same rows) sorts a text into a
language group from its words alone, and on calibration rows that training didn't see each group gets the
logit that separates best. The score is a logistic curve shifted so that this logit scores 0.7; it depends
on nothing but the text.

The fit uses at most ``SAMPLE`` labelled rows of each class, in hash order of doc_id; longer rows than
``SAMPLE_WORDS`` words are left out of it. Scoring covers every whole text. Rows with null labels, ids or texts are
not learnt from; a doc_id that repeats in the labels counts as toxic if any of its labels says so. Null and empty texts are scored by the model's maxima over no words (0). Without labelled rows of both
classes every score is the share of toxic labels, below 0.7 without any. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, BLOCK_WORDS, Words, as_bytes, chunks, mix, release, small_batches

#: Labelled rows of each class that the fit may use, and words of a row.
SAMPLE, SAMPLE_WORDS = 2500, 5000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
_PREFIX = (4, 5, 6, 7)
KINDS = 1 + len(_PREFIX)


def _features(words: Words, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """Five buckets for each of some consecutive words of a chunk."""
    hashes, starts = words.hashes[lo:hi], words.starts[lo:hi]
    out = np.empty((len(hashes), KINDS), dtype=np.uint16)
    shift = np.uint64(64 - 15)
    out[:, 0] = hashes >> shift
    long = words.ends[lo:hi] - starts
    with np.errstate(over="ignore"):
        h = np.zeros(len(long), dtype=np.uint64)
        for j in range(max(_PREFIX)):
            at = np.minimum(starts + j, len(words.buf) - 1)
            h = h * np.uint64(0x100000001B3) + np.where(long > j, words.buf[at], 0).astype(np.uint64) + np.uint64(1)
            if j + 1 in _PREFIX:
                out[:, 1 + _PREFIX.index(j + 1)] = mix(h) >> shift
    return out


def sample(docs: DataFrame, labels: DataFrame, seed: int = 0) -> list[tuple[np.ndarray, int, str | None]]:
    """Word features, label and language of the rows to fit on: a bounded sample."""
    spark = docs.sparkSession
    known = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = []
    for t in (0, 1):  # two classes, each cut by a top-k of hash order
        picked += [(r["doc_id"], t) for r in known.where(F.col("toxic") == t).select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE).collect()]
    if not picked:
        return []
    chosen = spark.createDataFrame(picked, "doc_id bigint, toxic int")
    has_lang = "lang" in docs.columns
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"), (docs["lang"] if has_lang else F.lit(None)).cast("string").alias("lang"))
    rows = rows.where("text is not null").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(as_bytes(b.column("text").to_pylist()), ALPHANUMERIC)
            f = _features(w)
            short = [y - x <= SAMPLE_WORDS for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
            data = [f[x:y].tobytes() for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("lang"), pa.array(data, pa.binary())], names=["doc_id", "toxic", "lang", "words"]).filter(pa.array(short))

    got = rows.select("doc_id", "text", "toxic", "lang").mapInArrow(run, "doc_id bigint, toxic int, lang string, words binary").toPandas()
    got = got.sort_values(["doc_id", "words"], kind="stable").drop_duplicates("doc_id")
    return [(np.frombuffer(w, dtype=np.uint16).reshape(-1, KINDS), int(t), g) for w, t, g in zip(got["words"], got["toxic"], got["lang"], strict=True)]


class Model:
    def __init__(self, rows: list[tuple[np.ndarray, int, str | None]], epochs: int = 6, seed: int = 11):
        y = np.array([t for _, t, _ in rows])
        self.constant = None if len(set(y.tolist())) == 2 else (float(y[0]) if len(y) else 0.0) * 0.69
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        hold = order[: len(order) // 5]
        fit = [rows[i] for i in order[len(order) // 5 :]]
        odds = self._odds(fit)
        self.emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.emb[:, 0] = odds
        self.filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0, : FILTERS // 2] += 0.5
        self.bias = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32)
        self.out, self.base = np.full(len(WIDTHS) * FILTERS, 0.1, dtype=np.float32), np.float32(-1)
        self._train(fit, epochs, rng)
        self._languages(rows, rng)
        self._calibrate([rows[i] for i in hold] or fit)

    @staticmethod
    def _odds(rows) -> np.ndarray:
        """Smoothed log-odds that a toxic row rather than another holds a bucket."""
        n = np.zeros((2, BUCKETS))
        for f, t, _ in rows:
            n[t, np.unique(f)] += 1
        total = np.array([sum(t == c for _, t, _ in rows) for c in (0, 1)])[:, None]
        rate = (n + 0.5) / (total + 1)
        shrink = n.sum(axis=0) / (n.sum(axis=0) + 4)
        return (np.clip(np.log(rate[1] / rate[0]), -3, 3) * shrink).astype(np.float32)

    def _forward(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.emb[f].sum(axis=1)
        x = np.concatenate([x, np.zeros((max(WIDTHS), DIM), dtype=np.float32)])
        tops, places = np.zeros((len(WIDTHS), FILTERS), dtype=np.float32), np.full((len(WIDTHS), FILTERS), -1)
        for k, (w, g) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            n = len(f)
            if n:
                z = sum(x[j : j + n] @ g[j] for j in range(w)) + self.bias[k]
                at = z.argmax(axis=0)
                top = z[at, np.arange(FILTERS)]
                tops[k], places[k] = np.maximum(top, 0), np.where(top > 0, at, -1)
        return tops, places, x

    def _train(self, rows, epochs: int, rng) -> None:
        dense = [*self.filters, self.bias, self.out, self.base.reshape(1).copy()]
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
        scale = np.zeros(BUCKETS, dtype=np.float32)
        step, rate, size = 0, 0.01, 16
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for s in range(0, len(order), size):
                grads = [np.zeros_like(p) for p in dense]
                part = order[s : s + size]
                buckets, pushes = [], []
                for i in part:
                    f, t, _ = rows[i]
                    tops, places, x = self._forward(f)
                    z = float(tops.ravel() @ dense[-2] + dense[-1][0])
                    d = np.float32((1 / (1 + np.exp(-z)) - t) / len(part))
                    grads[-2] += d * tops.ravel()
                    grads[-1] += d
                    back = d * dense[-2].reshape(tops.shape) * (places >= 0)
                    grads[len(WIDTHS)] += back
                    for k, w in enumerate(WIDTHS):
                        on = np.flatnonzero(places[k] >= 0)
                        for j in range(w):
                            at = places[k, on] + j
                            grads[k][j][:, on] += (back[k, on][:, None] * x[at]).T
                            inside = at < len(f)
                            push = back[k, on][:, None] * dense[k][j][:, on].T
                            buckets.append(f[at[inside]].ravel())
                            pushes.append(np.repeat(push[inside], KINDS, axis=0))
                step += 1
                for p, g, (m, v) in zip(dense, grads, state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
                b, g = np.concatenate(buckets), np.concatenate(pushes)
                if len(b):
                    u, inv = np.unique(b, return_inverse=True)
                    total = np.zeros((len(u), DIM), dtype=np.float32)
                    np.add.at(total, inv, g)
                    scale[u] += (total * total).mean(axis=1)
                    self.emb[u] -= 0.02 * total / (np.sqrt(scale[u])[:, None] + 1e-6)
        self.out, self.base = dense[-2], dense[-1][0]

    def _languages(self, rows, rng) -> None:
        """A linear softmax over the first hash of each word, for the language groups."""
        self.groups = sorted({g for _, _, g in rows if g})
        self.words = np.zeros((BUCKETS, max(len(self.groups), 1)), dtype=np.float32)
        for _ in range(2):
            for i in rng.permutation(len(rows)):
                f, _, g = rows[i]
                if g and len(f):
                    u, n = np.unique(f[:, 0], return_counts=True)
                    share = (n / n.sum()).astype(np.float32)[:, None]
                    z = (self.words[u] * share).sum(axis=0)
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    p[self.groups.index(g)] -= 1
                    self.words[u] -= 20 * share * p

    def logits(self, features: Callable[[int, int], np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logit and language group of each document of a chunk, from all words of its whole text. ``features``
        gives those of a range of words; filters run over ``BLOCK_WORDS`` positions at a time."""
        n, reach = len(first) - 1, max(WIDTHS) - 1
        tops = np.full((n, len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        votes = np.zeros((n, self.words.shape[1]))
        for lo in range(0, int(first[-1]), BLOCK_WORDS):
            hi = min(lo + BLOCK_WORDS, int(first[-1]))
            f = features(lo, min(hi + reach, int(first[-1])))
            x = self.emb[f[:, 0]]
            for c in range(1, KINDS):
                x += self.emb[f[:, c]]
            docs = np.arange(np.searchsorted(first, lo, side="right") - 1, np.searchsorted(first, hi))
            docs = docs[first[docs + 1] > first[docs]]
            at = np.maximum(first[docs], lo) - lo
            ends = first[docs + 1] - lo
            for k, (w, g) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                z = (x @ g[0])[: hi - lo]
                for j in range(1, w):
                    more = x[j:] @ g[j]
                    for e in ends:  # a filter doesn't reach into the next document
                        more[max(e - j, 0) : e] = 0
                    m = min(len(z), len(more))
                    z[:m] += more[:m]
                part = tops[docs, k * FILTERS : (k + 1) * FILTERS]
                tops[docs, k * FILTERS : (k + 1) * FILTERS] = np.maximum(part, np.maximum.reduceat(z, at))
            votes[docs] += np.add.reduceat(self.words[f[: hi - lo, 0]], at)
        tops = np.where(np.isfinite(tops), np.maximum(tops + self.bias.ravel(), 0), 0)
        return tops @ self.out + self.base, votes.argmax(axis=1)

    def _calibrate(self, rows) -> None:
        n = np.array([len(f) for f, _, _ in rows])
        every = np.concatenate([f for f, _, _ in rows])
        z, group = self.logits(lambda lo, hi: every[lo:hi], np.concatenate([[0], np.cumsum(n)]))
        y = np.array([t for _, t, _ in rows])
        self.cut = np.array([_best_cut(z, y)] * max(len(self.groups), 1))
        for g in range(len(self.groups)):
            own = group == g
            if y[own].sum() >= 10 and (1 - y[own]).sum() >= 10:
                self.cut[g] = _best_cut(z[own], y[own])

    def score(self, words: Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.first) - 1, self.constant)
        z, group = self.logits(lambda lo, hi: _features(words, lo, hi), words.first)
        return 1 / (1 + np.exp(-(z - self.cut[group]).astype(float) - np.log(0.7 / 0.3)))


def _best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap among the cuts with the fewest wrong rows; a wrong clean row counts double."""
    order = np.argsort(z, kind="stable")
    s, t = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) + 2 * np.concatenate([np.cumsum((1 - t)[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 2], s, [s[-1] + 2]])
    gap = np.diff(edges)
    best = np.flatnonzero((wrong == wrong[gap > 0].min()) & (gap > 0))
    i = best[gap[best].argmax()]
    return float((edges[i] + edges[i + 1]) / 2)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_scores(b.column(1), shared.value))], names=["doc_id", "score"])
        release()

    scored = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, score double")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    out = [np.zeros(0)]
    for s in chunks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        out.append(model.score(Words(as_bytes(texts.slice(s.start, s.stop - s.start).to_pylist()), ALPHANUMERIC)))
    return np.concatenate(out)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``least``, with all of their columns. Only texts go to Python workers."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels)))

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(_scores(texts, shared.value))
        release()

    return docs.where(score(docs["text"].cast("string")) < least)
