"""Ids of a byte-level BPE tokenizer file by units that can be encoded on their own.

The pre-tokenizer's pattern takes, in turn, contractions after an apostrophe, a run of letters, of digits or of other marks
with at most one space before it, and runs of white space, of which one that goes on with other characters gives up its last.
So a piece always ends before white space that follows something else, between letters, digits and marks
(apostrophes apart), and after a single tab or line end between other characters. Texts are cut there, by bytes; each distinct
unit is encoded once by the library and known by its 64-bit hash in a bounded table. Characters beyond ASCII
count as no certain class, and white space among them keeps a text from being cut beside them. The proof needs
the file's pattern to be the plain one: ``edges_are_stable`` looks, and other files encode whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import Words
from .token_counts import edges_are_stable

_SPACE, _LETTER, _DIGIT, _MARK, _OTHER, _BREAK = range(6)
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[33:127] = [_LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _OTHER if chr(b) == "'" else _MARK for b in range(33, 127)]
_CLASS[32], _CLASS[9:14] = _SPACE, _BREAK
#: White space beyond ASCII.
_WIDE = re.compile("[\x85\xa0  -     　]")


def _pairs(wide: bool) -> np.ndarray:
    """Classes of two neighbours, as 6 * left + right, between which a piece always ends."""
    cut = np.zeros((6, 6), dtype=bool)
    sure = [_LETTER, _DIGIT, _MARK]
    for a in sure:
        for b in (*sure, _SPACE, _BREAK):
            cut[a, b] = a != b
    if not wide:
        cut[_OTHER, _SPACE] = cut[_OTHER, _BREAK] = True
    return cut.ravel()


_PAIRS = {w: _pairs(w) for w in (False, True)}


def starts_of_units(buf: np.ndarray, wide: bool) -> np.ndarray:
    """Which bytes of a text begin a unit; the first does."""
    c = _CLASS[buf]
    out = np.ones(len(buf), dtype=bool)
    out[1:] = _PAIRS[wide][6 * c[:-1] + c[1:]]
    # after a tab or line end that stands alone between other characters
    lone = (c[1:-1] == _BREAK) & (c[:-2] != _BREAK) & (c[:-2] != _SPACE) & (c[2:] != _BREAK) & (c[2:] != _SPACE)
    if wide:
        lone &= (c[:-2] != _OTHER) & (c[2:] != _OTHER)
    out[2:] |= lone
    return out


class Units(Words):
    """Units of texts, as ``Words`` has words."""

    def __init__(self, docs: list[bytes], wide: list[bool]):
        self.joined = b"".join(docs)
        self.buf = np.frombuffer(self.joined, dtype=np.uint8)
        self.inside = np.ones(len(self.buf), dtype=bool)
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        if any(wide):
            spans = zip(offsets[:-1], offsets[1:], wide, strict=True)
            begin = np.concatenate([starts_of_units(self.buf[a:b], w) for a, b, w in spans])
        else:
            begin = starts_of_units(self.buf, False)
            begin[offsets[:-1][offsets[:-1] < len(begin)]] = True
            # a line end alone at the edge of a text: its neighbour isn't in the same text, which changes nothing
        self.starts = np.flatnonzero(begin)
        self.ends = np.append(self.starts[1:], len(self.buf))
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash()


class ByteEncoder:
    """Ids of whole texts, with a table of distinct units: sorted hashes beside the places of their ids in one pool. The latest
    units stand in a small table of their own, merged into the large one when it fills. A table of ``most`` units
    starts anew, with the same results."""

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.size, self.most = t.get_vocab_size(with_added_tokens=True), most
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.cut = edges_are_stable(t)
        special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
        self.special = {k: np.array([i], dtype=self.kind) for k, i in special.items()}
        self.find = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._clear()

    def _clear(self) -> None:
        none = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        self.old, self.new = none, none  # hashes, places in the pool, numbers of ids
        self.pool, self.used = np.zeros(1 << 16, dtype=self.kind), 0

    def _lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of ids of each unit; a place of -1 where it isn't known."""
        place, n = np.full(len(hashes), -1, dtype=np.int64), np.zeros(len(hashes), dtype=np.int64)
        for keys, places, lengths in (self.old, self.new):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == hashes)
                place[hit], n[hit] = places[at[hit]], lengths[at[hit]]
        return place, n

    def _add(self, hashes: np.ndarray, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        every = [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]
        n = np.array(list(map(len, every)), dtype=np.int64)
        ids = np.fromiter(chain.from_iterable(every), dtype=self.kind, count=int(n.sum()))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), dtype=self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        place = self.used + np.cumsum(n) - n
        self.used += len(ids)
        self.new = self._merged(self.new, (hashes, place, n))
        if len(self.new[0]) > max(1 << 15, len(self.old[0]) // 8):
            self.old, self.new = self._merged(self.old, self.new), tuple(x[:0] for x in self.new)
        return place, n

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")
        return keys[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:], strict=True))

    def _places(self, units: Units) -> tuple[np.ndarray, np.ndarray]:
        hashes, first, at = np.unique(units.hashes, return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.new[0]) + len(hashes) > self.most or self.used > 8 * self.most:
            self._clear()
        place, n = self._lookup(hashes)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            spans = zip(units.starts[first[missing]].tolist(), units.ends[first[missing]].tolist(), strict=True)
            place[missing], n[missing] = self._add(hashes[missing], [units.joined[x:y].decode() for x, y in spans])
        return place[at], n[at]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special strings."""
        units = Units([t.encode() for t in texts], [not t.isascii() and bool(_WIDE.search(t)) for t in texts])
        if not len(units.hashes):
            return [np.zeros(0, dtype=self.kind)] * len(texts)
        place, n = self._places(units)
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = self.pool[np.repeat(place - ends[:-1], n) + np.arange(ends[-1])]
        cuts = ends[units.first]
        return [ids[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return [np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        parts = [self.find.split(t) if self.find and self.find.search(t) else [t] for t in texts]
        plain = iter(self._plain([p for x in parts for p in x[::2]]))
        out = []
        for x in parts:
            ids = [self.special[p] if i % 2 else next(plain) for i, p in enumerate(x)]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
