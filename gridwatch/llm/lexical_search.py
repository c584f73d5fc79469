"""Ranked lexical search: the best documents of each query item, by masks of the terms that they hold.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with only A-Z lower-cased; they
are known by 64-bit hashes. A first pass over the documents keeps, in the shared folder, blocks of up to ``BLOCK_DOCS``
documents: the number of terms of each, and postings (term, document, occurrences) of the terms that the items ask for.
Counts over the whole corpus come from these blocks. A second pass scores them. In each block and for each item,
one bitmap of documents a term gives every document's mask of matched terms; documents of equal masks form a group, whose
score can't pass the sum, over the mask's terms, of the weight times the block's largest share of that term. Groups are scored exactly
by falling bound until the bound is under the task's k-th best score, so no document that belongs to the result is left
out. Tasks pass on at most ``k`` rows an item.

Items are the stated query set: they are taken in blocks of at most ``ITEM_BYTES`` of text, each one pass over the
documents, so what tasks hold of them is bounded. Null and empty texts hold no term: such documents match nothing and
such items return nothing. Repeated rows are documents (items) of their own; equal scores go by doc_id, nulls first. Empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ALPHANUMERIC, Words, as_bytes, chunks, stored

BLOCK_DOCS, BLOCK_POSTINGS = 2048, 1 << 20
#: Text of the items that one pass over the documents serves, and documents that are scored between two looks at the bound.
ITEM_BYTES, BATCH = 4 << 20, 128
#: Constants of the score: term saturation and length share are fixed-point numbers.
SCALE, LENGTH_SHARE = 1_000_000_000, 75

_INDEX = "doc_ids array<bigint>, n_terms array<bigint>, term binary, doc binary, tf binary, with_terms bigint, all_terms bigint, df array<struct<term:int,n:bigint>>"
_FOUND = "item int, doc_id bigint, score bigint, task int"


class Queries:
    """Items as lists of (place of a term among all terms, occurrences); ``terms`` are the sorted hashes."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        words = Words(as_bytes(texts), ALPHANUMERIC)
        self.ids = ids
        self.terms, at = np.unique(words.hashes, return_inverse=True)
        self.items = [np.unique(at[a:b], return_counts=True) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]


def item_blocks(items: DataFrame, limit: int = ITEM_BYTES) -> Iterator[Queries]:
    """The items in blocks of at most ``limit`` bytes of text (or one longer item), read a partition at a time."""
    ids, texts, size = [], [], 0
    for item, text in items.select("item_id", "text").toLocalIterator():
        n = len((text or "").encode("utf-8", "surrogatepass")) + 64
        if ids and size + n > limit:
            yield Queries(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += n
    if ids:
        yield Queries(ids, texts)


class _Block:
    """Documents gathered for one row of the index."""

    def __init__(self):
        self.ids, self.n, self.parts, self.postings = [], [], [], 0

    def add(self, ids: list[int | None], n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((term, doc + len(self.ids), tf))
        self.ids += ids
        self.n += n.tolist()
        self.postings += len(term)

    def row(self) -> pa.RecordBatch:
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order].astype("<i4"), doc[order].astype("<i4"), tf[order].astype("<i8")
        used, df = np.unique(term, return_counts=True)
        cells = [{"term": t, "n": c} for t, c in zip(used.tolist(), df.tolist(), strict=True)]
        columns = [[self.ids], [self.n], [term.tobytes()], [doc.tobytes()], [tf.tobytes()], [sum(x > 0 for x in self.n)], [sum(self.n)], [cells]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("term", pa.int32()), ("n", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])


def index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Blocks of documents with the postings of ``terms`` and the counts that the weights need."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, block = shared.value, _Block()
        for batch in batches:
            for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                words = Words(as_bytes(batch.column(1).slice(s.start, s.stop - s.start).to_pylist()), ALPHANUMERIC)
                at = np.minimum(np.searchsorted(asked, words.hashes), len(asked) - 1)
                hit = np.flatnonzero(asked[at] == words.hashes)
                doc = np.searchsorted(words.first, hit, side="right") - 1
                pairs, tf = np.unique(doc * len(asked) + at[hit], return_counts=True)
                block.add(batch.column(0).slice(s.start, s.stop - s.start).to_pylist(), np.diff(words.first), pairs // len(asked), pairs % len(asked), tf)
                if len(block.ids) >= BLOCK_DOCS or block.postings >= BLOCK_POSTINGS:
                    yield block.row()
                    block = _Block()
        if block.ids:
            yield block.row()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, _INDEX)


def _bitmaps(rows: int, width: int, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row of ``width`` bytes for each term, with the bit of every document that holds it; postings are sorted."""
    out = np.zeros(rows * width, dtype=np.uint8)
    cell = term * width + (doc >> 3)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    out[cell[first]] = np.add.reduceat((128 >> (doc & 7)).astype(np.uint8), first)
    return out.reshape(rows, width)


def masks(bitmaps: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct masks (rows of 0 and 1 by term) of ``n`` documents, and which of them each document has."""
    bits = np.unpackbits(bitmaps, axis=1, count=n)
    packed = np.packbits(bits, axis=0)
    packed = np.concatenate([packed, np.zeros((-len(packed) % 8, n), dtype=np.uint8)])
    words = np.ascontiguousarray(packed.T).view(np.uint64)
    _, first, group = np.unique(words[:, 0], return_index=True, return_inverse=True)
    for w in words.T[1:]:  # more than 64 terms: refine by the next 64
        _, inner = np.unique(w, return_inverse=True)
        _, first, group = np.unique(group * n + inner, return_index=True, return_inverse=True)
    return bits[:, first].T, group


class _Scored:
    """A block of the index, ready to be searched."""

    def __init__(self, ids: list[int | None], n: list[int], term: np.ndarray, doc: np.ndarray, tf: np.ndarray, documents: int, words: int):
        self.ids, self.n = ids, len(ids)
        length = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * x * documents) // words for x in n], dtype=np.int64)
        self.terms, self.first = np.unique(term, return_index=True)
        self.ends = np.append(self.first[1:], len(term))
        self.doc, self.share = doc, (SCALE * tf) // (1000 * tf + 8 * length[doc])
        self.most = np.maximum.reduceat(self.share, self.first)
        place = np.repeat(np.arange(len(self.terms)), self.ends - self.first)
        self.bitmaps = _bitmaps(len(self.terms), -(-self.n // 8), place, doc)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
        """The first ``k`` of ``best`` and this block's documents, as (-score, 0 for a null id, id)."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weights > 0)
        at, weights = at[held], weights[held]
        if not len(at):
            return best
        mask, group = masks(self.bitmaps[at], self.n)
        bound = mask.astype(np.int64) @ (weights * self.most[at])
        order = np.argsort(-bound, kind="stable")
        sizes = np.bincount(group, minlength=len(mask))
        starts = np.cumsum(sizes) - sizes
        by_group = np.argsort(group, kind="stable")
        share, i = None, 0
        while i < len(order) and bound[order[i]] > 0 and (len(best) < k or bound[order[i]] >= -best[-1][0]):
            if share is None:
                share = np.zeros((len(at), self.n), dtype=np.int64)
                for r, t in enumerate(at):
                    span = slice(self.first[t], self.ends[t])
                    share[r, self.doc[span]] = self.share[span]
            taken, docs = i, []
            while i < len(order) and (i == taken or sum(map(len, docs)) < BATCH) and bound[order[i]] > 0:
                docs.append(by_group[starts[order[i]] : starts[order[i]] + sizes[order[i]]])
                i += 1
            docs = np.concatenate(docs)
            scores = weights @ share[:, docs]
            if len(best) >= k:
                keep = scores >= -best[-1][0]
                docs, scores = docs[keep], scores[keep]
            found = [(-s, 0 if self.ids[d] is None else 1, self.ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True) if s > 0]
            if found:
                best = sorted(best + found, key=lambda x: (x[0], x[1], x[2] or 0))[:k]
        return best


def _weights(df: dict[int, int], n_terms: int, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(n_terms)], dtype=np.int64)


def _search(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = docs.sparkSession
    none = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not len(queries.terms):
        return none
    blocks = stored(index(docs, queries.terms), "lexical-index")
    one = blocks.agg(F.sum("with_terms").alias("d"), F.sum("all_terms").alias("w")).first()
    if not one["w"]:
        return none
    # a row for each term of the items at most
    df = {r["term"]: r["n"] for r in blocks.select(F.explode("df").alias("x")).groupBy("x.term").agg(F.sum("x.n").alias("n")).collect()}
    weight = _weights(df, len(queries.terms), one["d"])
    shared = spark.sparkContext.broadcast([(t, weight[t] * c) for t, c in queries.items])
    documents, words = one["d"], one["w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        asked = shared.value
        best: list[list] = [[] for _ in asked]
        for batch in batches:
            for ids, n, term, doc, tf in zip(*(batch.column(i) for i in range(5)), strict=True):
                term, doc, tf = (np.frombuffer(x.as_py(), dtype=t).astype(np.int64) for x, t in ((term, "<i4"), (doc, "<i4"), (tf, "<i8")))
                if len(term):
                    block = _Scored(ids.as_py(), n.as_py(), term, doc, tf, documents, words)
                    best = [block.search(t, w, k, b) for (t, w), b in zip(asked, best, strict=True)]
        rows = [(i, d, -s) for i, b in enumerate(best) for s, _, d in b]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        item, doc, score = (pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True))
        task = pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32())
        yield pa.RecordBatch.from_arrays([item, doc, score, task], names=["item", "doc_id", "score", "task"])

    found = blocks.select("doc_ids", "n_terms", "term", "doc", "tf").mapInArrow(run, _FOUND)
    # the tasks' rows of an item first meet in groups, so that the last window takes k rows of each group only
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    some = found.withColumn("rank", F.row_number().over(W.partitionBy("item", F.pmod("task", F.lit(64))).orderBy(*order))).where(F.col("rank") <= k)
    top = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(queries.ids)), "item int, item_id bigint")
    return top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` highest-scoring documents with a score above 0."""
    parts = [stored(_search(docs, q, k), "lexical-found") for q in item_blocks(items)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")


SQL = """with words as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from documents),
asked as (
  select item_id, term, count(*) as q from (select item_id, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from benchmark) group by 1, 2),
sizes as (select doc_id, count(*) as n from words group by 1),
totals as (select count(*)::bigint as nn, sum(n)::bigint as ll from sizes),
tf as (select doc_id, term, count(*) as tf from words where term in (select term from asked) group by 1, 2),
df as (select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, totals group by 1),
scores as (
  select item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll))))::bigint as score
  from asked join df using (term) join tf using (term) join sizes using (doc_id), totals group by 1, 2),
ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10"""
