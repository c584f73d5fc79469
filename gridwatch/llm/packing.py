"""Cost-balanced packing: documents as token sequences of at most ``capacity``, of even attention cost and without padding.

A document's ids and one end id are cut into pieces of ``capacity`` ids and a remainder. Full pieces are sequences as they
are. Remainders are dealt by a hash into groups of about ``GROUP_TOKENS`` ids, and each group is packed by itself: it
opens as many sequences of ``capacity`` as its ids fill and, for what is over, one sequence for each power of
two in that number, which needs no padding. Remainders go, longest first, to the sequence of least cost that
has room for them. A piece of n ids costs ``linear * n + quadratic * n * n``: attention works within pieces. Where no
sequence has room for all of it, the piece fills the sequence of least cost that has any room, and what is left goes on as a shorter piece.
A group's room is the number of its ids, so every sequence is full in the end.

Null and empty texts are the end id alone. Every row is a document of its own, also where its doc_id repeats or is
null. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_units import byte_encoder
from .common import chunks, stored

#: Ids and pieces of a group on average.
GROUP_TOKENS, GROUP_PIECES = 1 << 20, 1 << 15
#: Share of attention in the cost of a piece: a layer of width w works 24 w w for an id and 4 w more for every id that it looks at; w is 1024.
LINEAR, QUADRATIC = 1.0, 1 / 6144

_PIECE = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
_SEQUENCE = "sequence_id bigint, length int, cost double, ids binary, pieces array<struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,offset:bigint>>"
_CELL = pa.struct([(x, pa.int64()) for x in ("doc_id", "start", "length", "doc_tokens", "offset")])


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Full pieces and the remainder of every document; ids take two or four bytes each, by the size of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = byte_encoder(path)
        end = np.array([end_id], dtype=e.kind)
        for batch in batches:
            for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                docs = batch.column(0).slice(s.start, s.stop - s.start).to_pylist()
                texts = [t or "" for t in batch.column(1).slice(s.start, s.stop - s.start).to_pylist()]
                rows = []
                for doc, ids in zip(docs, e.encode(texts), strict=True):
                    ids = np.concatenate([ids, end])
                    rows += [(doc, i, min(capacity, len(ids) - i), len(ids), ids[i : i + capacity].tobytes()) for i in range(0, len(ids), capacity)]
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, _PIECE)


def rooms(total: int, capacity: int) -> list[int]:
    """Sizes of the sequences that ``total`` ids fill: ``capacity``, and powers of two for what is over."""
    over = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]


def assign(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray, np.ndarray]:
    """(piece, ids of it before, length, sequence, offset) of each part, and the sizes and costs of the sequences. ``lengths`` fall."""
    size = np.array(rooms(int(lengths.sum()), capacity), dtype=np.int64)
    left, cost, out = size.copy(), np.zeros(len(size)), []
    for piece, n in enumerate(lengths.tolist()):
        done = 0
        while n:
            fits = left >= n
            if not fits.any():
                fits = left > 0
            at = int(np.where(fits, cost, np.inf).argmin())
            part = min(n, int(left[at]))
            out.append((piece, done, part, at, int(size[at] - left[at])))
            left[at] -= part
            cost[at] += linear * part + quadratic * part * part
            done, n = done + part, n - part
    return out, size, cost


def _packed(capacity: int, linear: float, quadratic: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("at", "ascending")])
        group = table.column("group")[0].as_py()
        doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        blobs = table.column("ids").to_pylist()
        lengths = table.column("length").to_numpy()
        width = len(blobs[0]) // int(lengths[0])
        parts, size, cost = assign(lengths, capacity, linear, quadratic)
        ids: list[list[bytes]] = [[] for _ in size]
        cells: list[list[dict]] = [[] for _ in size]
        for p, done, n, at, offset in parts:  # a sequence's parts come in the order of their offsets
            ids[at].append(blobs[p][done * width : (done + n) * width])
            cells[at].append({"doc_id": doc[p], "start": start[p] + done, "length": n, "doc_tokens": total[p], "offset": offset})
        names = [2 * ((group << 32) + i) + 1 for i in range(len(size))]
        columns = [pa.array(names, pa.int64()), pa.array(size, pa.int32()), pa.array(cost), pa.array([b"".join(x) for x in ids], pa.binary()), pa.array(cells, pa.list_(_CELL))]
        return pa.Table.from_arrays(columns, names=["sequence_id", "length", "cost", "ids", "pieces"])

    return run


def packed_sequences(docs: DataFrame, path: str, end_id: int = 0, capacity: int = 1024, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """``sequence_id, length, cost, ids, pieces``: sequences of ids, and the pieces of documents that each holds in order."""
    # the pieces' numbers are written with them, so a task that runs again sees the same
    every = stored(pieces(docs, path, end_id, capacity).withColumn("at", F.monotonically_increasing_id()), "pieces")
    whole, rest = every.where(F.col("length") == capacity), every.where(F.col("length") < capacity)
    one = rest.agg(F.sum("length").alias("ids"), F.count("*").alias("n")).first()
    groups = max(1, -(-(one["ids"] or 0) // GROUP_TOKENS), -(-one["n"] // GROUP_PIECES))
    cell = F.struct("doc_id", "start", "length", "doc_tokens", F.lit(0).cast("bigint").alias("offset"))
    full = whole.select((2 * F.col("at")).alias("sequence_id"), F.col("length").cast("int").alias("length"), (linear * F.col("length") + quadratic * F.col("length") * F.col("length")).alias("cost"), "ids", F.array(cell).alias("pieces"))
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("bigint"))
    return full.unionByName(dealt.groupBy("group").applyInArrow(_packed(capacity, linear, quadratic), _SEQUENCE))


def piece_digests(sequences: DataFrame) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece, read from the sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for b in batches:
            rows = []
            for sequence, n, blob, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(blob, dtype="<u2" if len(blob) == 2 * n else "<u4").astype("<u4")
                for x in cells:
                    own = ids[x["offset"] : x["offset"] + x["length"]]
                    rows.append((x["doc_id"], x["start"], x["length"], zlib.crc32(own.tobytes()), x["doc_tokens"], sequence, x["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

    return sequences.select("sequence_id", "length", "ids", "pieces").mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
