"""SentencePiece encoding and decoding through a table of distinct marked words.

The library turns spaces into a marker and puts one marker in front of a text. When no piece of the
model has a marker after another character, merges never cross from a word to the next marker, so a
text is the concatenation of marked words (a run of markers and the characters up to the next one) and
each distinct marked word needs to be segmented and decoded only once; ids and decoded text are joined
back by position. ``marked_words_are_independent`` proves this from the vocabulary, and a model that
fails it is encoded text by text. The table lives in each Python worker for a task and is bounded in bytes: a table over all
documents would move every position of every text through a shuffle for the same ids.

Null and empty texts have no ids and an empty decoded text. Repeated rows give repeated results; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import chunks, small_batches
from .units import UnitTable

MARK = "▁"
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    def __init__(self, path: str, limit: int = 48 << 20):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.independent = marked_words_are_independent(self.model)
        self.table = UnitTable(self._segment, limit, 400, 8)
        self.lone = self.model.piece_to_id(MARK)

    def words(self, text: str) -> list[str]:
        """Marked words of a text, each without its first marker."""
        if MARK not in text and "  " not in text and text[:1] != " " and text[-1:] != " ":
            return text.split(" ")
        return [w[1:] for w in _MARKED.findall(MARK + text.replace(" ", MARK))]

    def _segment(self, words: list[str]) -> list[tuple[int, bytes, bytes, str]]:
        ids = self.model.encode(words, num_threads=1)
        ids = [i if w else [self.lone] for i, w in zip(ids, words, strict=True)]
        texts = self.model.decode(ids, num_threads=1)
        return list(map(_entry, ids, texts))

    def rows(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes, str]]]:
        """Each text's entries of the table, in order."""
        if not self.independent:
            ids = self.model.encode(texts, num_threads=1)
            return [[_entry(i, self.model.decode(i))] if i else [] for i in ids]
        parts = [self.words(t) if t else [] for t in texts]
        self.table.cover(set().union(*parts))
        get = self.table.__getitem__
        return [list(map(get, p)) for p in parts]


def _entry(ids: list[int], decoded: str) -> tuple[int, bytes, bytes, str]:
    """Number of ids, the ids as 32-bit integers and as text, and the decoded text after a space."""
    return len(ids), np.array(ids, dtype="<i4").tobytes(), ",".join(map(str, ids)).encode(), " " + decoded


def marked_words_are_independent(model) -> bool:
    """No piece has a marker after another character, and the model leaves characters and spaces alone."""
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = all(model.decode(model.encode(x)) == x for x in ("a  b", " a ", "Ａ ﬁ", "a\tb\n c"))
    return kept and not any(MARK in p.lstrip(MARK) for p in pieces)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every document: the ids and what they decode to."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for ids, texts in _parts(batches):
            rows = p.rows(texts)
            every = [b"".join([e[1] for e in r]) for r in rows]
            ends = np.cumsum([0, *map(len, every)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(every), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([ids, lists, pa.array(["".join([e[3] for e in r])[1:] for r in rows], pa.string())], names=["doc_id", "ids", "decoded"])
        p.table.release()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, from its ids and decoded text."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, hexed = pieces(path), lambda b: hashlib.sha256(b).hexdigest()
        for ids, texts in _parts(batches):
            rows = p.rows(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([sum([e[0] for e in r]) for r in rows], pa.int64()),
                    pa.array([hexed(b",".join([e[2] for e in r])) for r in rows]),
                    pa.array([hexed("".join([e[3] for e in r])[1:].encode()) for r in rows]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        p.table.release()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for s in chunks(sizes):
            n = s.stop - s.start
            yield batch.column(0).slice(s.start, n), [t or "" for t in batch.column(1).slice(s.start, n).to_pylist()]
