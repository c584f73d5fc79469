"""Token counts of whole documents by a byte-level BPE tokenizer file, with overlap resynchronisation.

A document of up to ``chunk_chars`` characters is encoded as it is. A longer one is encoded as overlapping
chunks with offsets, each by the library as a text of its own. Two neighbouring chunks are spliced at a place
in their overlap where both encodings have a token edge and which is stable whatever stands to either side. The
pre-tokenizer's pattern proves such places: where white space follows another character, and between letters, digits and other
marks, but for apostrophes; ``edges_are_stable`` looks whether the file has that pattern, and without it every
document is encoded whole. A chunk ends ``overlap`` characters after the first stable place that it can be cut at,
so text without such places is one chunk, and every character is encoded about once. Where two chunks don't
align at the place, the left one is widened to twice its length and encoded again.

Null and empty texts have 0 bytes and 0 tokens. Special strings inside texts are handled as the library
does by default. Repeated rows give repeated results; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import chunks

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks int"
# The white space of the pre-tokenizer's pattern.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_MARK = rf"[^\p{{L}}\p{{N}}{_WHITE}']"
#: Places where a piece ends, whatever stands to either side.
_STABLE = regex.compile(
    rf"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=\p{{L}})|(?<=\p{{L}})(?={_MARK})|(?<={_MARK})(?=\p{{L}})|(?<=\p{{N}})(?={_MARK})|(?<={_MARK})(?=\p{{N}})"
)


def edges_are_stable(tokenizer) -> bool:
    """Nothing rewrites the text before it is cut; a byte-level pre-tokenizer cuts it by its own pattern, whose pieces hold letters, digits or
    marks of one kind after at most one space, a contraction after an apostrophe, or white space alone; no special string holds white space or takes any in."""
    spec = json.loads(tokenizer.to_str())
    cut = spec["pre_tokenizer"] or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    return bool(plain and added and spec["normalizer"] is None and spec["post_processor"] is None)


class Counter:
    def __init__(self, path: str, chunk_chars: int, overlap: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk_chars, self.overlap = chunk_chars, overlap
        self.stable = edges_are_stable(self.tokenizer)
        names = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.longest, self.special = max(map(len, names), default=0), re.compile("|".join(map(re.escape, names))) if names else None

    def ends(self, text: str) -> np.ndarray:
        """Offsets at which the tokens of a chunk end, in order."""
        return np.array([b for _, b in self.tokenizer.encode(text, add_special_tokens=False).offsets], dtype=np.int64)

    def spliced(self, text: str) -> tuple[int, int]:
        """Tokens of a long text, and the chunks it took."""
        total = n = begin = 0
        skip, size = 0, self.chunk_chars  # skip: the place in the text up to which tokens are counted already
        while True:
            place = self._place(text, max(begin + size, skip + 1))
            ends = self.ends(text[begin : min(place + self.overlap, len(text))]) + begin
            if place < len(text):
                after = max(place - self.overlap, begin)
                right = self.ends(text[after : place + self.overlap]) + after
                if not (ends == place).any() or not (right == place).any():
                    size *= 2  # they don't align: widen the left chunk
                    continue
                total += int((ends <= place).sum() - (ends <= skip).sum())
                begin, skip, size, n = after, place, self.chunk_chars, n + 1
            else:
                return total + int((ends > skip).sum()), n + 1

    def _place(self, text: str, at: int) -> int:
        """The first stable place from ``at`` on; special strings aren't cut. Without one, the text's end."""
        while at < len(text):
            m = _STABLE.search(text, at)
            if m is None:
                break
            around = self.special.finditer(text, max(m.start() - self.longest, 0), m.start() + self.longest) if self.special else ()
            if not any(x.start() < m.start() < x.end() for x in around):
                return m.start()
            at = m.start() + 1
        return len(text)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        long = {i for i, t in enumerate(texts) if self.stable and len(t) > self.chunk_chars}
        whole = iter(self.tokenizer.encode_batch_fast([t for i, t in enumerate(texts) if i not in long], add_special_tokens=False))
        return [self.spliced(t) if i in long else (len(next(whole)), int(bool(t))) for i, t in enumerate(texts)]


@lru_cache(maxsize=2)
def counter(path: str, chunk_chars: int, overlap: int) -> Counter:
    return Counter(path, chunk_chars, overlap)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk_chars: int = 1 << 15, overlap: int = 256) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more tokens than ``limit``) and ``n_chunks`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path, chunk_chars, overlap)
        for batch in batches:
            ids, sizes = batch.column(0), pa.compute.fill_null(pa.compute.binary_length(batch.column(1)), 0).to_pylist()
            for s in chunks(sizes):
                texts = [t or "" for t in batch.column(1).slice(s.start, s.stop - s.start).to_pylist()]
                n, k = zip(*c.count(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(s.start, len(n)), pa.array(sizes[s], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n]), pa.array(k, pa.int32())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chunks"],
                )

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, SCHEMA)
