"""Token-ID files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Writing. A first pass encodes each document, adds the end id, keeps the ids in the shared scratch folder and
counts each task's ids beside them. Ids are ranked by falling count (ties: smaller id first), so
frequent ids get small ranks. The counts are one row for each id of the vocabulary, which bounds the rank
table that is broadcast. A second pass writes the documents' ranks as groups of four: a control byte with four two-bit lengths less one, kept apart from the data
bytes (little-endian, 1 to 4 of them). Documents are range-partitioned and sorted by doc_id; a file holds
``doc_id, n_tokens, control, data`` as Parquet rows, under ``part=<n>`` in ascending doc_id order, and the
vocabulary by rank stands beside them.

Reading. Four lengths and the byte offsets come from a table with 256 rows; ranks are gathered with numpy
and mapped back to ids. ``start`` adds the tokens of all earlier parts to those before a document in its
own part.

A null or empty text is the end id alone. Rows with the same doc_id are kept, ordered among themselves by
their ids' bytes. An empty table writes no rows and reads back none; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, chunks, stored

_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
_OFFSETS = np.concatenate([np.zeros((256, 1), dtype=np.int64), np.cumsum(_LENGTHS, axis=1)], axis=1)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit integers; the last group is filled with zeros."""
    v = np.zeros(-(-len(values) // 4) * 4, dtype="<u4")
    v[: len(values)] = values
    n = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = (n - 1).reshape(-1, 4)
    control = (four << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4) < n[:, None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The first ``n`` integers of ``pack``'s bytes, by lookup of each control byte."""
    c, d = np.frombuffer(control, dtype=np.uint8), np.frombuffer(data, dtype=np.uint8)
    sizes = _OFFSETS[c, 4]
    base = np.cumsum(sizes) - sizes
    at = (base[:, None] + _OFFSETS[c, :4]).ravel()[:n]
    long = _LENGTHS[c].ravel()[:n]
    out = d[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(long > k)
        out[more] |= d[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class Encoder:
    """Ids of whole texts. White space is dropped and no piece runs across it, so each distinct word between
    spaces and line ends is encoded once and known by its 64-bit hash after that. In texts of Latin-1 characters,
    which lower-casing leaves composed and which the library would lower-case the same way, words are taken in
    lower case and full stops and commas that touch no other mark stand on their own, as the pre-tokenizer cuts
    there too. ``most`` bounds the words and ids that are kept: a full table starts anew, with the same results."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.size, self.most = t.get_vocab_size(with_added_tokens=True), most
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(self.size, dtype=bool)
        for token, i in t.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.known: dict[int, int] = {}  # hash: place in the pool and number of ids, in one integer
        self.pool, self.used = np.zeros(1 << 16, dtype=self.kind), 0

    def _keep(self, keys: list[int], lengths: np.ndarray, ids: np.ndarray) -> None:
        """Append the ids of some words to the pool."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), dtype=self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        places = self.used + np.cumsum(lengths) - lengths
        self.known.update(zip(keys, ((places << 28) | lengths).tolist(), strict=True))
        self.used += len(ids)

    def _add(self, keys: list[int], units: list[str]) -> None:
        """Encode words: those of letters many at a time, told apart by the pieces that end a word; the others one by one."""
        rest, plain = [], []
        for k, u in zip(keys, units, strict=True):
            (plain if u.isalpha() and _latin(u) else rest).append((k, u))
        groups = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join([u for _, u in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group):
                self._keep([k for k, _ in group], np.diff(cuts, prepend=0), ids)
            else:
                rest += group
        if rest:
            every = [e.ids for e in self.tokenizer.encode_batch_fast([u for _, u in rest], add_special_tokens=False)]
            self._keep([k for k, _ in rest], np.array(list(map(len, every))), np.array(list(chain.from_iterable(every)), dtype=self.kind))

    @staticmethod
    def prepared(text: str) -> bytes:
        """The text as words between spaces and line ends that are encoded on their own."""
        if "<|" not in text and _latin(text):  # special strings count as they are written
            text = text.lower()
            if not _TOUCHING.search(text.replace("\n", " ")):
                text = text.replace(".", " . ").replace(",", " , ")
        return text.encode()

    def _places(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of every word of a chunk."""
        hashes, first, at = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > self.most or self.used > 8 * self.most:
            self._clear()
        keys = hashes.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            new = first[missing]
            spans = zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)
            self._add([keys[i] for i in missing], [words.joined[x:y].decode() for x, y in spans])
        place = np.array(list(map(self.known.__getitem__, keys)), dtype=np.int64)[at]
        return place >> 28, place & ((1 << 28) - 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = Words(list(map(self.prepared, texts)), _BETWEEN, lower=False)
        if not len(words.hashes):
            return [np.zeros(0, dtype=self.kind)] * len(texts)
        place, n = self._places(words)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(place - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[words.first]
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[10, 32]] = False
#: A full stop or comma next to another mark. White space is the tokenizer's own, which U+001C to U+001F aren't.
_TOUCHING = re.compile(r"[.,](?:(?<=[.,])[^\t-\r \x85\xa0a-z0-9à-öø-ÿ]|(?<=[^\t-\r \x85\xa0a-z0-9à-öø-ÿ][.,]))")


def _latin(text: str) -> bool:
    try:
        return bool(text.encode("latin-1")) or True
    except UnicodeEncodeError:
        return False


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
            n = s.stop - s.start
            yield batch.column(0).slice(s.start, n), [t or "" for t in batch.column(1).slice(s.start, n).to_pylist()]


_COUNTS = pa.list_(pa.struct([("id", pa.int32()), ("n", pa.int64())]))


def encode_ids(docs: DataFrame, path: str, end_id: int, size: int) -> DataFrame:
    """``doc_id, ids`` (little-endian, two or four bytes each), the end id included; rows with null ``ids`` hold a
    task's ``counts`` of each id, at most one for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, names = encoder(path), np.zeros(size, dtype=np.int64), ["doc_id", "ids", "counts"]
        end = np.array([end_id], dtype=e.kind)
        for docs, texts in _parts(batches):
            every = e.encode(texts)
            seen += np.bincount(np.concatenate(every), minlength=size)
            seen[end_id] += len(every)
            blobs = pa.array([np.concatenate([x, end]).tobytes() for x in every], pa.binary())
            yield pa.RecordBatch.from_arrays([docs, blobs, pa.nulls(len(every), _COUNTS)], names=names)
        used = np.flatnonzero(seen)
        cells = pa.StructArray.from_arrays([pa.array(used, pa.int32()), pa.array(seen[used])], names=["id", "n"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), cells)], names=names)

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, ids binary, counts array<struct<id:int,n:bigint>>")


def write_ids(docs: DataFrame, path: str, out: str, end_id: int = 2, parts: int | None = None) -> None:
    """Write the ids of ``docs`` under ``out``: ``ids/part=<n>`` and ``vocabulary`` (rank, id)."""
    spark = docs.sparkSession
    kind, size = encoder(path).kind, max(encoder(path).size, end_id + 1)
    encoded = stored(encode_ids(docs, path, end_id, size), "ids")
    counts = encoded.select(F.explode("counts").alias("c")).groupBy("c.id").agg(F.sum("c.n").alias("n")).orderBy(F.desc("n"), "id").toPandas()  # a row for each id of the vocabulary at most
    by_rank = counts["id"].to_numpy(dtype=np.int64)
    encoded = encoded.where("ids is not null").select("doc_id", "ids")
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{out}/vocabulary")
    ranks = np.zeros(size, dtype=np.uint32)
    ranks[by_rank] = np.arange(len(by_rank))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    shared = spark.sparkContext.broadcast((ranks, np.array(_bounds(encoded, n), dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, bounds = shared.value
        for b in batches:
            every = [np.frombuffer(x, dtype=kind) for x in b.column(1).to_pylist()]
            packed = [pack(rank[x]) for x in every]
            part = np.searchsorted(bounds, pc.fill_null(b.column(0), -(1 << 63)).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(list(map(len, every)), pa.int64()), pa.array([c for c, _ in packed], pa.binary()), pa.array([d for _, d in packed], pa.binary()), pa.array(part, pa.int32())],
                names=["doc_id", "n_tokens", "control", "data", "part"],
            )

    rows = encoded.mapInArrow(run, "doc_id bigint, n_tokens bigint, control binary, data binary, part int")
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "doc_id", "data")
    rows.write.partitionBy("part").option("compression", "none").parquet(f"{out}/ids")


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most ``n`` - 1 cut points of doc_id; they decide which file a row is in, never whether it is kept."""
    q = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), [i / n for i in range(1, n)], 10_000).alias("q")).first() if n > 1 else None
    return sorted(set(q["q"])) if q and q["q"] else []


def read_ids(spark: SparkSession, out: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of ``write_ids``'s files, decoded from them."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{out}/vocabulary").orderBy("rank").collect()], dtype="<u4")
    shared = spark.sparkContext.broadcast(by_rank)
    files = spark.read.schema("doc_id bigint, n_tokens bigint, control binary, data binary, part int").parquet(f"{out}/ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column("n_tokens").to_pylist()
            crc = [zlib.crc32(shared.value[unpack(c.as_py(), d.as_py(), k)].tobytes()) for c, d, k in zip(b.column("control"), b.column("data"), n, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "part", "n_tokens", "ids_crc32"])

    docs = stored(files.mapInArrow(run, "doc_id bigint, part int, n_tokens bigint, ids_crc32 bigint"), "read-ids")
    totals = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(W.partitionBy("part").orderBy("doc_id", "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    return docs.withColumn("own", own).join(before, "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
