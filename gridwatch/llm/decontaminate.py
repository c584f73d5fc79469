"""Benchmark decontamination by spaced seeds.

Words are runs of ASCII letters and digits or of bytes beyond ASCII, after lower-casing A-Z. A mask is laid
over consecutive words and hashes only those at its set positions, so a seed survives substitutions at the
others; items shorter than every mask are hashed as a whole. The seeds of all items set two bits each in a
filter of bounded size, the only thing that is broadcast. Every position of every document is looked up;
runs of neighbouring seeds that pass leave the task with the word hashes around them, are joined with the
items' seeds on the hash, and each pair of item and diagonal is verified: within ``window`` consecutive item
words (or the whole shorter item) at least ``agreement`` of them must equal the document's words. Words that
were inserted or left out start another diagonal.

Result: one row for each document and item that match, with the place of the match, the item's words that
equal the document's, and those of the item covered by good windows. Items with the same words count as
their smallest item_id; items with fewer than ``least_words`` words identify nothing, as clean documents hold one or
two given words by chance (1 makes every item count). Null or empty texts and
null ids match nothing; rows that repeat a doc_id give one row with the best match. Other columns are
ignored; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, Words, as_bytes, chunks, mix, stored

#: Positions that a mask takes (1) or ignores (0). The last two are laid over items of 8 to 11 words only, where the others miss some substitutions.
MASKS = ("111111", "1110111", "11010111", "1011010011", "11001000111", "1111", "11011")
_SHORT, _SHORT_ITEMS = (5, 6), range(8, 12)
_SHORTEST = min(map(len, MASKS))
_FACTORS = np.random.default_rng(99).integers(1, 1 << 63, (len(MASKS) + 1, 16), dtype=np.uint64) | np.uint64(1)


def _seeds(h: np.ndarray, mask: int) -> np.ndarray:
    """Hashes of one mask laid over every position; ``mask`` under 0: the first -mask words as a whole."""
    taken = [i for i, c in enumerate(MASKS[mask]) if c == "1"] if mask >= 0 else list(range(-mask))
    n = len(h) - (len(MASKS[mask]) if mask >= 0 else -mask) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(mask + 64))
    for f, i in zip(_FACTORS[mask if mask >= 0 else len(MASKS)], taken, strict=False):
        out += h[i : i + n] * f
    return mix(out)


def _kinds(n: int) -> list[int]:
    """The masks that an item of ``n`` words is hashed with."""
    return [m for m in range(len(MASKS)) if len(MASKS[m]) <= n and (m not in _SHORT or n in _SHORT_ITEMS)] or [-n]


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - bits)).astype(np.int64), (h & np.uint64((1 << bits) - 1)).astype(np.int64)


def item_words(items: DataFrame, least_words: int) -> DataFrame:
    """``item_id, words``: word hashes of each distinct sequence of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = Words(as_bytes(b.column(1).to_pylist()), ALPHANUMERIC)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([w.hashes[x:y].view(np.int64) for x, y in zip(w.first[:-1], w.first[1:], strict=True)], pa.list_(pa.int64()))], names=["item_id", "words"])

    words = items.select(items["item_id"].cast("bigint"), items["text"].cast("string")).where("item_id is not null").mapInArrow(run, "item_id bigint, words array<bigint>")
    return words.where(F.size("words") >= max(least_words, 1)).groupBy("words").agg(F.min("item_id").alias("item_id")).select("item_id", "words")


def _item_seeds(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            item, seed, pos, kind = [], [], [], []
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.array(w, dtype=np.int64).view(np.uint64)
                for m in _kinds(len(h)):
                    s = _seeds(h, m)[: None if m >= 0 else 1]
                    seed.append(s.view(np.int64))
                    item.append(np.full(len(s), i))
                    pos.append(np.arange(len(s), dtype=np.int32))
                    kind.append(np.full(len(s), m, dtype=np.int32))
            if seed:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (seed, item, pos, kind)], names=["seed", "item_id", "item_pos", "kind"])

    return items.mapInArrow(run, "seed bigint, item_id bigint, item_pos int, kind int")


def contaminated(docs: DataFrame, items: DataFrame, window: int = 13, agreement: float = 0.8, max_filter_bits: int = 27, least_words: int = 3) -> DataFrame:
    """``doc_id, item_id, doc_word, n_equal, n_covered, item_words`` of every document and item that match."""
    spark = docs.sparkSession
    items = stored(item_words(items, least_words), "items")
    seeds = stored(_item_seeds(items), "seeds")
    n = seeds.count()
    kinds = sorted(r["kind"] for r in seeds.select("kind").distinct().collect())  # at most a value for each mask and short length
    bits = int(min(max_filter_bits, max(12, np.ceil(np.log2(max(n, 1) * 512)))))
    table = np.zeros(1 << (bits - 3), dtype=np.uint8)

    def bytes_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.concatenate(_bits(b.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array(both >> 3), pa.array((1 << (both & 7)).astype(np.int32))], names=["at", "bit"])

    for r in seeds.select("seed").mapInArrow(bytes_set, "at bigint, bit int").groupBy("at").agg(F.bit_or("bit").alias("v")).toLocalIterator():
        table[r["at"]] = r["v"]
    shared = spark.sparkContext.broadcast(table)
    margin = window + max(map(len, MASKS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = shared.value
        for batch in batches:
            for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                texts = batch.column(1).slice(s.start, s.stop - s.start).to_pylist()
                w = Words(as_bytes(texts), ALPHANUMERIC)
                found_at, found = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
                for m in kinds:
                    h = _seeds(w.hashes, m)
                    x, y = _bits(h, bits)
                    hit = np.flatnonzero((passes[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
                    y = y[hit]
                    hit = hit[((passes[y >> 3] >> (y & 7).astype(np.uint8)) & 1).astype(bool)]
                    found_at.append(hit)
                    found.append(h[hit])
                at, seed = np.concatenate(found_at), np.concatenate(found).view(np.int64)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                doc = np.searchsorted(w.first, at, side="right") - 1
                cut = np.flatnonzero((np.diff(doc, prepend=-1) > 0) | (np.diff(at, prepend=-1) > margin))
                rows = []
                for i, j in zip(cut, np.append(cut[1:], len(at)), strict=True):
                    d = doc[i]
                    low, high = max(w.first[d], at[i] - margin), min(w.first[d + 1], at[j - 1] + 2 * margin)
                    rows.append((s.start + int(d), int(low - w.first[d]), w.hashes[low:high].view(np.int64), seed[i:j], (at[i:j] - low).astype(np.int32)))
                pick, start, words, seeds_, places = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(pick)), pa.array(start, pa.int32()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds_, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                    names=["doc_id", "start", "words", "seeds", "places"],
                )

    texts = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).where("doc_id is not null and text is not null")
    runs = texts.mapInArrow(scan, "doc_id bigint, start int, words array<bigint>, seeds array<bigint>, places array<int>")
    runs = stored(runs, "runs")
    met = runs.select("doc_id", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("doc_id", "start", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    met = met.join(seeds.drop("kind"), "seed").select("doc_id", "start", "item_id", (F.col("place") - F.col("item_pos")).alias("shift")).distinct()
    both = met.join(runs.select("doc_id", "start", "words"), ["doc_id", "start"]).join(items.withColumnRenamed("words", "item"), "item_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, start, i, shift, words, item in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "item_id", "shift", "words", "item")), strict=True):
                equal, covered = _agreement(np.array(words), np.array(item), shift, window, agreement)
                if covered:
                    rows.append((d, i, start + shift, equal, covered, len(item)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=_SCHEMA)

    hits = both.select("doc_id", "start", "item_id", "shift", "words", "item").mapInArrow(verify, "doc_id bigint, item_id bigint, doc_word bigint, n_equal bigint, n_covered bigint, item_words bigint")
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_covered", "n_equal", (-F.col("doc_word")).alias("at"), "item_words")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.at")).alias("doc_word"), F.col("m.n_equal").alias("n_equal"), F.col("m.n_covered").alias("n_covered"), F.col("m.item_words").alias("item_words"))


_SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "doc_word", "n_equal", "n_covered", "item_words")])


def _agreement(words: np.ndarray, item: np.ndarray, shift: int, window: int, agreement: float) -> tuple[int, int]:
    """Item words equal on this diagonal, and those covered by windows with enough of them; a short item must agree whole."""
    low, high = max(0, -shift), min(len(item), len(words) - shift)
    same = np.zeros(len(item), dtype=np.int64)
    same[low:high] = words[low + shift : high + shift] == item[low:high]
    span = min(window, len(item))
    need = span if span < 8 else int(np.ceil(agreement * span))
    sums = np.convolve(same, np.ones(span, dtype=np.int64), "valid")
    good = np.zeros(len(item) + 1, dtype=np.int64)
    hits = np.flatnonzero(sums >= need)
    np.add.at(good, hits, 1)
    np.add.at(good, hits + span, -1)
    covered = np.cumsum(good)[:-1] > 0
    return int(same.sum()), int(covered.sum())


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item, with all of their columns."""
    found = contaminated(docs, items).select("doc_id").distinct()
    return docs.join(found, docs["doc_id"].cast("bigint") == found["doc_id"], "left_anti")
