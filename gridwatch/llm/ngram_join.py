"""N-gram Jaccard join: components of documents whose sets of word n-grams overlap enough.

Documents are rows and n-grams columns of a sparse incidence matrix; two documents link when
``100 * |A n B| >= percent * |A u B|``. The product of the matrix with its transpose is taken in blocks, cell by
cell where a cell can matter:

* Equal rows are one class (a 128-bit digest of the sorted set), whose smallest doc_id stands for it.
* Columns have one global order: those that many documents share come last (a bit for each in a bitmap of a
  checked size; columns that meet in a bit move together, and any order is right), the others by
  hash. A partner must share one of a row's first ``n - ceil(percent * n / 100) + 1`` columns, so only
  those entries say which cells are not zero (size-derived bound), and a cell is dropped when the set sizes, or what is
  left after the shared column in both rows, can't reach the overlap needed.
* A cell whose rows' parity bitmaps (each column flips one of at least ``PARITY_BITS`` bits) differ in more bits than
  the sizes allow the sets to differ in is dropped as well: another exact bound.
* The other cells are multiplied in blocks: a task takes a block of cells with both their rows, numbers the block's
  columns, looks every entry of one row up in the incidence of the other and accumulates the overlap counts of all
  cells at once; cells below the bound that follows from both sizes are discarded.
* Cells of a column are chosen so that no group of similar rows is expanded into pairs. In each of ``rounds`` rounds
  every entry of a column meets one pivot entry (linear in the entries). Linked rows become components; the pivots
  leave their columns, as all their cells have been seen, and columns within one component are done. What is left
  are columns of rows that share it and still are in many components: a block product inside the tasks compares
  all rows of different components there by size, place and bitmap, and only cells that may link leave a task. Its first
  passes let a few cells of each row leave, which join what is similar; the last takes every other cell between the
  components that remain, where large columns are dealt out as pairs of blocks of ``BLOCK`` rows.
* The first order knows a column as frequent only where one task holds it twice. After the first round, rows left in a
  column of several components and more than ``OFTEN`` rows that such columns fill are therefore ordered anew, by exact counts of all of their columns
  over all tasks. A passage that they share then stands late in every row, where too little is left after it to reach the
  overlap needed.

A pair with enough overlap shares an early column, and there it is in one component, met as a pivot's cell, or
compared in the last step; where its column had many rows, that happens in the new order, in which the pair
shares an early column as well. No link between components can be missed.

Null or empty texts have an empty set and link with nothing, as do rows with a null doc_id; fewer words
than ``k`` are one shingle. Rows that repeat a doc_id are one document with links of each of its texts.
Every input row gets an output row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, as_bytes, chunks, shingles, stored
from .graph import components

#: Rows of a column beyond which it is ordered last. The order decides the work, not the result.
OFTEN = 8
#: Share of a row's first columns, one in so many, from which on such columns fill it.
FILLED = 4
#: Bits of the bitmap of such columns, least and most (128 MB): a power of two, 16 for each column up to there.
LATE_BITS = (1 << 20, 1 << 30)
#: Bits of a row's parity bitmap, at least; longer rows take a power of two over their size.
PARITY_BITS = 1024
#: Rows of a block of a large column in the last step.
BLOCK = 1000
#: Partners of a row in a column that the passes of the last step check, inside a block; the last pass takes all in all blocks.
PARTNERS = (4, 16, None)
#: Documents whose texts are fetched by a broadcast of their ids; beyond it by a shuffled join.
BROADCAST_IDS = 200_000


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            n = s.stop - s.start
            texts = as_bytes(batch.column(1).slice(s.start, n).to_pylist())
            yield batch.column(0).slice(s.start, n), shingles(Words(texts), k)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parity(s: np.ndarray) -> bytes:
    """Bitmap of which slots an odd number of a row's columns falls into."""
    bits = max(PARITY_BITS.bit_length() - 1, int(len(s) - 1).bit_length() if len(s) else 0)
    slots = (s >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=1 << bits) & 1).astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ, the longer one folded: at most the size of the sets' difference."""
    x, y = sorted((np.unpackbits(np.frombuffer(v, dtype=np.uint8)) for v in (a, b)), key=len)
    return int((x ^ (y.reshape(len(x), -1).sum(axis=1) & 1)).sum())


def shingle_sets(docs: DataFrame, k: int = 5, flush: int = 4_000_000) -> DataFrame:
    """``doc_id, n_shingles, set_key, parity`` of each document; rows with a null set_key hold ``frequent``: columns
    that several distinct sets of a task share (of each ``flush`` entries), and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        held = 0
        for ids, sets in _sets(batches, k):
            keys = [_digest(s) for s in sets]
            seen.update(zip(keys, sets, strict=True))
            held += sum(map(len, sets))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(list(map(parity, sets)), pa.binary()), pa.nulls(len(sets), _FREQUENT)],
                names=_SET_NAMES,
            )
            if held > flush:
                yield _shared_in(seen)
                seen, held = {}, 0
        if seen:
            yield _shared_in(seen)

    return _texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, parity binary, frequent array<struct<col:bigint,n:bigint>>")


_SET_NAMES = ["doc_id", "n_shingles", "set_key", "parity", "frequent"]
_FREQUENT = pa.list_(pa.struct([("col", pa.int64()), ("n", pa.int64())]))


def _shared_in(seen: dict[bytes, np.ndarray]) -> pa.RecordBatch:
    values, n = np.unique(np.concatenate(list(seen.values())), return_counts=True)
    values, n = values[n > 1].view(np.int64), n[n > 1]
    cells = pa.StructArray.from_arrays([pa.array(values), pa.array(n)], names=["col", "n"])
    lists = pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), cells)
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), lists], names=_SET_NAMES)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))


def late_bitmap(columns: DataFrame) -> np.ndarray:
    """Bytes of a bitmap with the bit of each ``col`` set; its pages are made in the tasks."""
    least, most = LATE_BITS
    bits = min(max(1 << (16 * columns.count()).bit_length(), least), most)
    page = 1 << 16
    slots = columns.select(F.col("col").bitwiseAND(F.lit(bits - 1)).alias("slot")).distinct().withColumn("page", F.shiftright("slot", 16))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(page, dtype=np.uint8)
        flags[part["slot"].to_numpy() & (page - 1)] = 1
        return pd.DataFrame({"page": part["page"].iloc[:1], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in slots.groupBy("page").applyInPandas(run, "page bigint, bits binary").toLocalIterator():
        out[r["page"] * page // 8 :][: page // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def is_late(bitmap: np.ndarray, s: np.ndarray) -> np.ndarray:
    slot = s & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _counts(docs: DataFrame, k: int, flush: int = 4_000_000) -> DataFrame:
    """``col, n``: rows of each column over all tasks that hold it twice, summed within the tasks first; equal sets of a
    task are one row. Rows that share columns come in one task; a column that tasks hold once each stays uncounted, which costs work only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0
        for _, sets in chain(_sets(batches, k), [(None, None)]):
            for s in sets or []:
                if len(s) and (key := _digest(s)) not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
            if held and (sets is None or size > flush):
                values, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["col", "n"])
                held, size = [], 0

    return _texts(docs).mapInArrow(run, "col bigint, n bigint").groupBy("col").agg(F.sum("n").alias("n"))


def _entries(docs: DataFrame, k: int, percent: int, late: np.ndarray) -> DataFrame:
    """``col, doc, n, pos``: the first columns of each row, once for each distinct set of a task."""
    shared = docs.sparkSession.sparkContext.broadcast(late)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, set()
        for ids, sets in _sets(batches, k):
            cols, doc, size, pos = [], [], [], []
            for d, s in zip(ids.to_pylist(), sets, strict=True):
                if d is None or not len(s) or (key := _digest(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                first = n - -(-percent * n // 100) + 1
                late = is_late(bitmap, s)
                s = np.concatenate((s[~late], s[late]))
                cols.append(s[:first])
                doc.append(np.full(first, d))
                size.append(np.full(first, n, dtype=np.int32))
                pos.append(np.arange(first, dtype=np.int32))
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([c.view(np.int64) for c in cols], doc, size, pos)], names=["col", "doc", "n", "pos"])

    return _texts(docs).mapInArrow(run, "col bigint, doc bigint, n int, pos int")


def _reachable(na: str, pa_: str, nb: str, pb: str, percent: int) -> str:
    """Whether the overlap needed fits into the sizes and into what is left from a shared column on."""
    need = f"{percent} * ({na} + {nb})"
    return f"100 * least({na}, {nb}) >= {percent} * greatest({na}, {nb}) and {100 + percent} * least({na} - {pa_}, {nb} - {pb}) >= {need}"


def _shared_columns(entries: DataFrame) -> DataFrame:
    """The entries of columns with several documents."""
    several = entries.groupBy("col").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low <> high").select("col")
    return stored(entries.join(stored(several, "columns"), "col"), "shared-columns")


def _round(entries: DataFrame, salt: int) -> DataFrame:
    """Entries of columns with several components (``comp``), each with a pivot entry of its column. The first round takes
    the same rows as pivots where it can, so that cells repeat; the others another one in every column, so that a row meets many."""
    order = F.xxhash64("doc", *(["col"] if salt else []), F.lit(salt))
    pivots = entries.groupBy("col").agg(
        F.min(F.struct(order.alias("h"), "doc", "n", "pos", "comp")).alias("p"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    pivots = stored(pivots.where("low <> high").select("col", F.col("p.doc").alias("p_doc"), F.col("p.n").alias("p_n"), F.col("p.pos").alias("p_pos"), F.col("p.comp").alias("p_comp")), "pivots")
    return stored(entries.join(pivots, "col"), "met")


def _cells(met: DataFrame, percent: int) -> DataFrame:
    return met.where("comp <> p_comp").where(_reachable("n", "pos", "p_n", "p_pos", percent)).select(F.col("doc").alias("a"), F.col("p_doc").alias("b")).distinct()


def _reordered(docs: DataFrame, entries: DataFrame, own: DataFrame, k: int, percent: int) -> DataFrame:
    """The entries, those of columns with more than ``OFTEN`` filled rows in several components replaced: all rows of such a
    column are ordered anew by exact counts, so a pair meets in the new order or in a column that stays. A row is filled where columns of more than ``OFTEN`` rows
    are one in ``FILLED`` of its first columns; two others share too little to get past the bitmaps, as a rule. Columns of the new order have names of their own."""
    spread = entries.groupBy("col").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("k")).where("low <> high")
    spread = stored(spread.select("col", "k"), "spread")
    often = stored(entries.join(spread.where(F.col("k") > OFTEN).select("col"), "col").select("col", "doc", "n"), "often-entries")
    first = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    filled = often.groupBy("doc", "n").agg(F.count("*").alias("w")).where(FILLED * F.col("w") >= first).select("doc").distinct()
    moved = often.join(filled, "doc", "left_semi").groupBy("col").agg(F.count("*").alias("f")).where(F.col("f") > OFTEN)
    moved = stored(moved.select("col"), "moved")
    wide = stored(often.join(moved, "col").groupBy(F.col("doc").alias("doc_id")).agg(F.min(F.xxhash64("col")).alias("near")), "wide")
    n = wide.count()
    if not n:
        return entries
    part = _near_each_other(_texts(docs).join(F.broadcast(wide) if n <= BROADCAST_IDS else wide, "doc_id"), wide)
    late = late_bitmap(stored(_counts(part, k).where(F.col("n") > OFTEN).select("col"), "late"))
    again = _shared_columns(_entries(part, k, percent, late)).join(own.withColumnRenamed("doc_id", "doc"), "doc")
    narrow = entries.join(spread.select("col"), "col").join(moved, "col", "left_anti")
    return narrow.unionByName(again.withColumn("col", F.xxhash64("col")))


def _near_each_other(texts: DataFrame, wide: DataFrame) -> DataFrame:
    """The texts, those of rows whose least moved column is the same in one task, or in blocks of about ``BLOCK`` rows."""
    large = wide.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).where("blocks > 1")
    dealt = texts.join(F.broadcast(large), "near", "left").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))))
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return stored(dealt.repartition(parts, "near", "block").select("doc_id", "text"), "wide-texts")


def _left_cells(entries: DataFrame, rows: DataFrame, percent: int, partners: int | None) -> tuple[DataFrame, DataFrame, bool]:
    """What is left of the columns, cells between its rows of different components by size, place and bitmap, and whether
    there are others. With a number of ``partners``, rows meet within one block of their column, as many cells for a row at
    most: those that link join groups of similar rows by a number of cells that grows like the rows."""
    spread = entries.groupBy("col").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    open_ = stored(entries.join(spread.where("low <> high").select("col", "blocks"), "col"), "open-columns")
    folded = F.substring("parity", 1, PARITY_BITS // 8)  # longer bitmaps are compared afterwards, whole
    short = rows.where(F.length("parity") == PARITY_BITS // 8).groupBy(F.col("doc_id").alias("doc")).agg(F.min(folded).alias("bits"), F.count("*").alias("k"))
    bits = open_.select("doc").distinct().join(short.where("k = 1").select("doc", "bits"), "doc")
    dealt = open_.join(bits, "doc", "left").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)) if partners is None else F.col("own"))
    dealt = dealt.select("col", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "n", "pos", "comp", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, set()
        for b in chain(batches, [None]):
            t = b if held is None else held if b is None else pa.concat_batches([held, b])
            if t is None or not t.num_rows:
                continue
            key = np.stack([t.column(i).to_numpy() for i in (0, 1, 2)])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if b is not None:  # the last column may go on in the next batch
                held = t.slice(int(cuts[-1]) if len(cuts) else 0)
            ends = cuts if b is not None else [*cuts, t.num_rows]
            for x, y in zip([0, *ends], ends, strict=False):
                found = list(_compared(t.slice(x, y - x), percent, partners))
                if None in found:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names=["a", "b"])
                pairs = set(found) - seen - {None}
                if len(seen) < 1_000_000:
                    seen |= pairs
                if pairs:
                    p, q = zip(*pairs, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    cells = dealt.repartition(parts, "col", "i", "j").sortWithinPartitions("col", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()
    cells = stored(cells, "left-cells")
    others = partners is not None and (cells.where("a is null").limit(1).count() or open_.where("blocks > 1").limit(1).count()) > 0
    return open_.drop("blocks"), cells.where("a is not null"), others


def _compared(t: pa.RecordBatch, percent: int, partners: int | None) -> Iterator[tuple[int, int] | None]:
    """Pairs of documents of one column's block, or two, whose overlap may be enough; None where a row has more ``partners``."""
    i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
    own, doc, n, pos, comp = (t.column(c).to_numpy() for c in (3, 4, 5, 6, 7))
    known = pc.is_valid(t.column(8)).to_numpy(zero_copy_only=False)
    bits = np.zeros((len(doc), PARITY_BITS // 64), dtype=np.uint64)
    bits[known] = np.frombuffer(b"".join(t.column(8).drop_null().to_pylist()), dtype=np.uint64).reshape(-1, PARITY_BITS // 64)
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    given = np.zeros(len(doc), dtype=np.int64)
    for s in range(0, len(left), 128):
        x = left[s : s + 128, None]
        na, nb = n[x].astype(np.int64), n[right].astype(np.int64)
        need = percent * (na + nb)
        ok = (comp[x] != comp[right]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & ((100 + percent) * np.minimum(na - pos[x], nb - pos[right]) >= need)
        if i == j:
            ok &= doc[x] < doc[right]
        p, q = np.nonzero(ok)
        if len(p):
            a, b = x[p, 0], right[q]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
            keep = ~(known[a] & known[b]) | ((100 + percent) * (n[a].astype(np.int64) + n[b] - apart) >= 2 * percent * (n[a].astype(np.int64) + n[b]))
            a, b = a[keep], b[keep]
            if partners is not None and len(a):
                by = np.argsort(b, kind="stable")
                a, b = a[by], b[by]
                first = np.flatnonzero(np.diff(b, prepend=-1))
                rank = given[b] + np.arange(len(b)) - np.repeat(first, np.diff(first, append=len(b)))
                given[b] = rank + 1  # of a row that repeats, the last counts
                a, b, had = a[rank < partners], b[rank < partners], len(b)
                if len(b) < had:
                    yield None
            yield from zip(np.minimum(doc[a], doc[b]).tolist(), np.maximum(doc[a], doc[b]).tolist(), strict=True)


def _close(cells: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The cells whose parity bitmaps differ in no more bits than the sizes allow."""
    side = lambda c: rows.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    both = cells.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(i).to_numpy() for i in (2, 3))
            apart = np.array([differing(x, y) for x, y in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)], dtype=np.int64)
            # overlap is half of what the sizes leave over the difference
            yield b.select([0, 1]).filter(pa.array((100 + percent) * (na + nb - apart) >= 2 * percent * (na + nb)))

    return both.select("a", "b", "n_a", "n_b", "p_a", "p_b").mapInArrow(run, "a bigint, b bigint").distinct()


def _verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, cells: DataFrame, k: int, percent: int) -> DataFrame:
    """The cells, as classes, whose exact overlap is enough."""
    rep = classes.select("doc_id", "rep").distinct()
    cells = cells.join(rep.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra")), "a").join(rep.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb")), "b")
    cells = cells.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    cells = stored(_close(cells, rows, percent), "cells")
    ids = stored(cells.select(F.col("a").alias("doc_id")).union(cells.select(F.col("b").alias("doc_id"))).distinct(), "cell-docs")
    n = ids.count()
    if not n:
        return cells
    texts = stored(_texts(docs).join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id"), "texts")
    both = cells.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_pylist()
            for s in chunks(sizes):
                part = batch.slice(s.start, s.stop - s.start)
                a, b, ta, tb = (c.to_pylist() for c in part.columns)
                row = {x: k for k, x in enumerate(dict.fromkeys([*zip(a, ta, strict=True), *zip(b, tb, strict=True)]))}
                sets = shingles(Words(as_bytes(t for _, t in row)), k)
                i, j = (np.array([row[x] for x in zip(d, t, strict=True)]) for d, t in ((a, ta), (b, tb)))
                n, both = np.array(list(map(len, sets))), overlaps(sets, i, j)
                yield part.select([0, 1]).filter(pa.array((both > 0) & (100 * both >= percent * (n[i] + n[j] - both))))

    return both.select("a", "b", "text_a", "text_b").where("text_a is not null and text_b is not null").mapInArrow(run, "a bigint, b bigint")


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cells (i, j) of the product of a block's incidence matrix with its transpose; rows are sorted sets of columns."""
    n = np.array(list(map(len, sets)))
    if not n.sum():
        return np.zeros(len(i), dtype=np.int64)
    columns, number = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(n) - n
    entries = np.repeat(np.arange(len(sets)), n) * len(columns) + number  # in rising order
    i, j = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    cell = np.repeat(np.arange(len(i)), n[i])
    place = np.arange(len(cell)) - np.repeat(np.cumsum(n[i]) - n[i], n[i]) + start[i][cell]
    wanted = j[cell] * len(columns) + number[place]
    at = np.minimum(np.searchsorted(entries, wanted), len(entries) - 1)
    return np.bincount(cell[entries[at] == wanted], minlength=len(i))


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 75, rounds: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (the smallest doc_id reachable by links, itself included)."""
    sets = stored(shingle_sets(docs, k), "sets")
    often = sets.select(F.explode("frequent").alias("f")).groupBy("f.col").agg(F.sum("f.n").alias("n"))
    late = late_bitmap(stored(often.where(F.col("n") > OFTEN).select("col"), "often"))
    sets = sets.where("set_key is not null")
    keyed = sets.where("n_shingles > 0 and doc_id is not null").select("doc_id", "n_shingles", "set_key")
    reps = stored(keyed.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps")
    classes = stored(keyed.join(reps, "set_key").select("doc_id", "rep"), "classes")
    rows = sets.select("doc_id", "n_shingles", "parity")
    # a doc_id that repeats with several sets ties their classes together
    ties = classes.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).where("a <> b").select("a", "b")
    links = classes.where("rep <> doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).join(ties.select("a").union(ties.select("b")).distinct(), "a", "left_semi").union(ties)
    links = stored(links, "links")
    labels, entries = components(links), _shared_columns(_entries(docs, k, percent, late)).withColumn("comp", F.col("doc"))
    own = classes.select("doc_id", F.col("doc_id").alias("comp")).distinct()
    others = True
    for salt in range(rounds + len(PARTNERS)):
        if not others:
            break
        if salt:
            own = stored(_labelled(classes, labels).groupBy("doc_id").agg(F.min("component_id").alias("comp")), "own")
            entries = entries.drop("comp").join(own.withColumnRenamed("doc_id", "doc"), "doc")
        if salt == min(1, rounds):  # the first round has told most groups of copies from rows that only share a passage
            entries = _reordered(docs, entries, own, k, percent)
        if salt < rounds:
            met = _round(entries, salt)
            entries = met.where("doc <> p_doc").select("col", "doc", "n", "pos", "comp")
            cells = _cells(met, percent)
        else:
            entries, cells, others = _left_cells(entries, rows, percent, PARTNERS[salt - rounds])
        more = stored(_verified(docs, rows, classes, cells, k, percent), "more-links")
        if more.limit(1).count():
            labels = _joined(labels, more)
    own = _labelled(classes, labels).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return sets.select("doc_id", "n_shingles").join(own, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: only what these join is labelled anew, components as nodes."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    top = components(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    up = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    moved = labels.join(up, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return stored(moved.union(top.join(labels.select("node"), "node", "left_anti").select("node", "component")), "labels")


def _labelled(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's component: that of its class, or the class itself where nothing links to it."""
    return classes.join(labels, classes["rep"] == labels["node"], "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose document is its component's smallest; all of its columns, empty texts included."""
    found = jaccard_components(docs, k, percent)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["doc_id"], "left_anti")


def brute_force(rows: list[tuple[int, str | None]], k: int = 5, percent: int = 75) -> dict[int, tuple[int, int]]:
    """The same result for a small list, by comparing all pairs of sets of words: doc_id -> (n, component)."""
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                x, y = group[a], group[b]
                group = {d: min(x, y) if g in (x, y) else g for d, g in group.items()}
    return {d: (len(sets[d]), group[d]) for d in ids}


SQL = """with recursive
w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
places as (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) as i from w where len(words) > 0),
s as (select distinct doc_id, array_to_string(words[i:i + 4], ' ') as shingle from places),
sizes as (select doc_id, count(*) as n from s group by 1),
shares as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
one as (select a, b from shares join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
links as (select a, b from one union all select b, a from one),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
lowest as (select a, min(b) as low from reached group by a)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id
from documents d left join sizes z on d.doc_id = z.doc_id left join lowest l on d.doc_id = l.a"""
