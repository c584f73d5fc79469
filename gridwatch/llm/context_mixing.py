"""LM scoring by online logistic context mixing over the whole corpus.

A text is its sequence of tokens: words (after lower-casing A-Z) and one end. The ``LEXICON`` most frequent
training words (of at least ``LEAST`` tokens) and an escape have a prefix code from their counts; a token is the bits of its code in the text's
order. Each bit is predicted by several contexts: none, the word before, the two words before, and the word before with
the last very frequent word before that. All but the first are hashed with the bit's place in the code and look up how
often a 0 and a 1 followed in all training texts. The logits of these estimates are combined by weights that a gate
picks (how well the two longest contexts are known), learnt online by logistic gradient over the training tokens in
an order that their hashes give; an adaptive map of the mixed probability refines it. A word outside the lexicon costs its escape and then
its share of such training words, discounted, with what the discount frees spelt by bytes: bits predicted by the last one
to four bytes of the word, mixed and refined in the same way. The bits of a text add up to ``score`` (log10)
and, over its bytes, to ``bits_per_byte``. The score of a training text takes each token's own occurrence out
of the counts of contexts and of words outside the lexicon, so that texts score as ones that the model hasn't seen.

Scale: words are counted by task and then by word. Tokens go once to the shard of the word before them, in compressed columns by chunk of documents; shards hold about ``SHARD`` tokens, so their number grows with the
corpus, and so do the contexts that are kept. A shard holds tokens that agree in all contexts once, with their number, counts its contexts, learns its weights and map from all of
its training tokens, and sends back a cost for each document, which chunks add up. A word that more than ``SHARD`` tokens
follow has several shards, dealt by the word before it (and by document where a word repeats or both are very
frequent), each with counts of its own. Only the lexicon and the tables of byte contexts, both of fixed size, are broadcast.
Words outside the lexicon join their probabilities by shuffle. Costs are rounded up to 1/2048 of a decimal digit.

Null and empty texts hold the end token alone. Rows with a null doc_id are scored and not learnt from, with
a null ``held_out``. Repeated rows are scored, and learnt from, each on its own. Without training rows all counts are 0.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix, release, small_batches, stored

#: Words with a code; tokens of a shard, about; tokens and documents of a chunk that is sent to shards.
LEXICON, SHARD, CHUNK_TOKENS, CHUNK_DOCS = 60_000, 150_000, 1_500_000, 30_000
#: Bytes of text that are split into words at a time, about.
TEXT_BYTES = 1 << 21
#: Tokens of a shard that share tables, about: words fall into that many groups by hash.
GROUP = 10_000
#: Words that count as very frequent; words whose share of tokens is at least this are dealt by document too.
FREQUENT, HEAVY = 64, 1 / 64
#: Distinct words outside the lexicon that a task learns the weights of the byte contexts from, about; all training words teach.
TAUGHT = 400_000
#: Training tokens that a word of the lexicon has at least; what is taken off the count of the others.
LEAST, DISCOUNT = 2, 0.75
END, ESCAPE, START = b"\n", 0, 0xFFFF
UNIT, FINE = 2048, 1 << 30  # a decimal digit in costs, and in logarithms of counts
_GATES, _STEPS = 25, 65
_BLOCK = 1 << 12
_SIZES = (16, 20, 21, 21)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def is_training(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of about ``TEXT_BYTES`` (or one longer document) and at most a sixteenth of a chunk's documents at a time."""
    most = max(1, CHUNK_DOCS // 16)
    for batch in batches:
        for s in chunks(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), TEXT_BYTES):
            for a in range(s.start, s.stop, most):
                n = min(most, s.stop - a)
                yield batch.column(0).slice(a, n).to_pylist(), batch.column(1).slice(a, n)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of some texts, one text's after the other's, and how many each has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, first = parts.flatten().cast(pa.binary()), np.cumsum([0, *pc.list_value_length(parts).to_pylist()])
    full = pc.binary_length(words).to_numpy() > 0  # white space at an end of a text leaves an empty word
    if full.all():
        return words, np.diff(first)
    return words.filter(pa.array(full)), np.diff(np.concatenate([[0], np.cumsum(full)])[first])


def word_counts(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    """``word, n_train, n_all`` over whole texts, the end token (a line end) included."""

    def merged(held: list[pa.Table]) -> list[pa.RecordBatch]:
        t = pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n_train", "sum"), ("n_all", "sum")])
        return t.select(["word", "n_train_sum", "n_all_sum"]).rename_columns(["word", "n_train", "n_all"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for ids, texts in _slices(batches):
            train = np.array(list(map(is_training, ids)))
            words, n = _split(texts)
            coded = words.dictionary_encode()
            code, known = coded.indices.to_numpy(), len(coded.dictionary)
            both = [np.bincount(code[np.repeat(train, n)], minlength=known), np.bincount(code, minlength=known)]
            both = [pa.array(np.append(x, y)) for x, y in zip(both, (train.sum(), len(train)), strict=True)]
            held.append(pa.table([pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), *both], names=["word", "n_train", "n_all"]))
            rows += known + 1
            if rows > flush:
                yield from merged(held)
                held, rows = [], 0
        if held:
            yield from merged(held)
        held = []
        release()

    texts = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return texts.mapInArrow(run, "word binary, n_train bigint, n_all bigint").groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


class Lexicon:
    """Symbols (the escape, then words by falling count), their codes, and the shards that follow them."""

    def __init__(self, words: list[bytes], n_train: np.ndarray, n_all: np.ndarray, escapes: int, total: int):
        self.words, self.total = pa.array(words, pa.binary()), total
        weight = np.concatenate([[escapes + 1], np.maximum(n_train, 1)])
        self._code(weight.tolist())
        self.shards = np.ones(1 << 16, dtype=np.int64)
        self.heavy = np.zeros(1 << 16, dtype=bool)
        follow = np.concatenate([[escapes], n_all])
        self.shards[: len(follow)] = -(-follow // SHARD)
        self.shards[START] = -(-int(n_all[words.index(END)]) // SHARD) if END in words else 1
        self.shards = np.maximum(self.shards, 1)
        self.heavy[: len(follow)] = follow >= HEAVY * max(total, 1)
        self.parts = max(1, -(-total // SHARD))

    def _code(self, weight: list[int]) -> None:
        k = len(weight)
        parent, side, n = np.zeros(2 * k, dtype=np.int64), np.zeros(2 * k, dtype=np.int64), [*weight, *[0] * k]
        heap = [(w, i) for i, w in enumerate(weight)]
        heapq.heapify(heap)
        odds = np.zeros(k, dtype=np.float32)
        for new in range(k, 2 * k - 1):
            (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
            parent[i], parent[j], side[j], n[new] = new, new, 1, a + b
            odds[new - k] = np.log(b / a)
            heapq.heappush(heap, (a + b, new))
        root, cur, steps = 2 * k - 2, np.arange(k), []
        while (cur != root).any():
            steps.append((np.where(cur == root, -1, parent[cur] - k), side[cur]))
            cur = np.where(cur == root, root, parent[cur])
        nodes = np.stack([x for x, _ in steps]) if steps else np.zeros((0, k), dtype=np.int64)
        self.length = (nodes >= 0).sum(axis=0)
        self.first = np.cumsum(self.length) - self.length
        self.node, self.bit = np.zeros(int(self.length.sum()), dtype=np.uint32), np.zeros(int(self.length.sum()), dtype=np.uint8)
        for step, (node, bit) in enumerate(steps):
            on = np.flatnonzero(node >= 0)
            at = self.first[on] + self.length[on] - 1 - step
            self.node[at], self.bit[at] = node[on], bit[on]
        # by place in the codes
        self.odds, self.key = odds[self.node], self.node.astype(np.uint64) * _A

    def symbols(self, words: pa.Array) -> np.ndarray:
        """The number of each word, ``ESCAPE`` for words outside."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy() + np.int32(1)

    def part(self, before: np.ndarray, last: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The shard of each token by the two words before it (``last`` is the nearer) and, for repeats and heavy pairs, its document."""
        n = self.shards[last].astype(np.uint64)
        salt = before.astype(np.uint64) * _A
        by_doc = (before == last) | (self.heavy[before] & self.heavy[last])
        salt = np.where(by_doc, salt + doc.astype(np.uint64) * _C, salt)
        salt = (mix(salt) >> np.uint64(20)) % n
        return (mix(last.astype(np.uint64) * _B + salt * _C) % np.uint64(self.parts)).astype(np.int64)


class Mixer:
    """Gated weights and an adaptive map, learnt online, batch by batch."""

    def __init__(self, inputs: int, start: float = 0.4):
        self.weights = np.full((_GATES, inputs), start, dtype=np.float32)
        self.map = np.tile(1 / (1 + np.exp(-np.linspace(-8, 8, _STEPS))), (_GATES, 1))
        self.grown, self.seen = np.zeros(_GATES), np.full(self.map.shape, 30.0)

    def mixed(self, inputs: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        rows = self.weights.take(gate, axis=0)
        z = inputs[0] * rows[:, 0]
        for k in range(1, len(inputs)):
            z += inputs[k] * rows[:, k]
        return np.clip(z, -12, 12, out=z)

    def learn(self, inputs: list[np.ndarray], gate: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, batch: int = 8000) -> None:
        """Take a step for each batch of bits, each as often as ``times`` says (default: once)."""
        times = np.ones(len(y), dtype=np.float32) if times is None else times
        for s in range(0, len(y), batch):
            part, g, t, often = [x[s : s + batch] for x in inputs], gate[s : s + batch], y[s : s + batch], times[s : s + batch]
            z = self.mixed(part, g)
            e = np.exp(-z)
            e += 1
            error = t - np.divide(1, e, out=e)
            error *= often
            at = g * _STEPS + _step(z)
            hit = np.bincount(at, often, self.map.size).reshape(self.map.shape)
            on = np.bincount(at, t * often, self.map.size).reshape(self.map.shape)
            n = hit.sum(axis=1)
            rate = 0.6 / (n + 30) / np.sqrt(1 + self.grown / 50_000)
            for k, x in enumerate(part):
                self.weights[:, k] += rate * np.bincount(g, error * x, _GATES)
            self.grown += n
            self.map = (self.map * self.seen + on) / (self.seen + hit)
            self.seen += hit

    def cost(self, inputs: list[np.ndarray], gate: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-log10 of the probability of each bit."""
        z = self.mixed(inputs, gate)
        half = self.map.astype(np.float32).ravel() / 2
        p = half.take(gate * _STEPS + _step(z))
        np.exp(-z, out=z)
        z += 1
        p += np.divide(np.float32(0.5), z, out=z)
        np.clip(p, np.float32(1e-6), np.float32(1 - 1e-6), out=p)
        p -= 1 - y  # the other bit's probability, below 0, where the bit is 0
        np.log(np.abs(p, out=p), out=p)
        p *= np.float32(-1 / np.log(10))
        return p


def _step(z: np.ndarray) -> np.ndarray:
    """The map's nearest step."""
    z = np.clip(z, -8, 8)
    z += 8
    z *= np.float32((_STEPS - 1) / 16)
    return np.rint(z, out=z).astype(np.intp)


def _own(table: np.ndarray, y: np.ndarray, counted: np.ndarray | bool) -> np.ndarray:
    """What each bit has added to its slots: one to the half of its value where it is ``counted``."""
    return (table.dtype.type(1) << y * table.dtype.type(4 * table.itemsize)) * np.asarray(counted, dtype=table.dtype)


def _level(n: np.ndarray) -> np.ndarray:
    """0 to 4: not seen, seen once, less than 5 times, less than 32 times, more."""
    return (n >= 1).view(np.uint8) + (n >= 2) + (n >= 5) + (n >= 32)


def _gate(longest: np.ndarray, other: np.ndarray) -> np.ndarray:
    return (5 * _level(longest) + _level(other)).astype(np.intp)


def _estimate(table: np.ndarray, slot: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logit and total of the counts in each slot, without ``own``; each half of a slot is a count."""
    pair = table[slot]
    pair -= own
    half = pair.view(f"<u{table.itemsize // 2}")
    n0, n1 = half[0::2].astype(np.float32), half[1::2].astype(np.float32)
    total = n0 + n1
    n0 += np.float32(0.1)
    n1 += np.float32(0.1)
    n1 /= n0
    return np.log(n1, out=n1), total


def _pairs(counts: np.ndarray) -> np.ndarray:
    """Counts of 0 and 1 by slot, one after the other, as the slots of ``_estimate``."""
    # a slot that outgrows 16 bits is halved as a whole, which keeps its odds; what was seen stays above 0
    zero, one = counts[0::2].copy(), counts[1::2].copy()
    while len(over := np.flatnonzero((zero > 65535) | (one > 65535))):
        zero[over], one[over] = (zero[over] + 1) >> 1, (one[over] + 1) >> 1
    return zero | one << np.uint32(16)


class Shard:
    """The tokens of one shard: the word two before, the word before, the last very frequent one, the token, and whether it teaches.
    Tokens that agree in all of these have the same bits, contexts and cost: they are held once, with their number.
    Arrays of bits are held for ``piece`` of them at a time; a larger shard goes over them again."""

    def __init__(self, lexicon: Lexicon, before: np.ndarray, last: np.ndarray, often: np.ndarray, token: np.ndarray, train: np.ndarray, block: int = 20_000, piece: int = 400_000):
        key = ((last << 16 | before) << 24 | token << 8 | often << 1 | train).astype(np.uint64)
        # in the order of mixed keys: an even mixture, whatever the order of the texts
        _, at, back, times = np.unique(mix(key), return_index=True, return_inverse=True, return_counts=True)
        # those that teach come first
        order = np.argsort(~train[at].astype(bool), kind="stable")
        place = np.empty(len(at), dtype=np.intp)
        place[order] = np.arange(len(at))
        at, self.back, times = at[order], place[back], times[order]
        self.lexicon, self.block, self.piece = lexicon, block, piece
        self.columns = (before[at], last[at], often[at], token[at], train[at], times.astype(np.float32))
        events = 2 * int(lexicon.length[token[at]].sum())
        self.shift = np.uint64(64 - max(10, int(events).bit_length()))

    def _events(self, s: int, end: int) -> tuple:
        """Bits of a block of tokens: bit, logit of its place in the code, how often those that teach do so, which come first, slots, first bit of each token."""
        lex = self.lexicon
        before, last, often, token, train, times = (c[s : min(s + self.block, end)] for c in self.columns)
        n = lex.length[token]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(lex.first[token] - first, n)
        node = lex.key[at]
        one = last.astype(np.uint64) * _B
        keys = [one, one + (before.astype(np.uint64) + np.uint64(1)) * _C, one + (often.astype(np.uint64) + np.uint64(1 << 20)) * _C]
        slots = []
        for k in keys:
            slot = np.repeat(mix(k), n)
            slot += node
            slot *= _C
            slot >>= self.shift
            slots.append(slot.view(np.int64))
        k = np.count_nonzero(train)
        return lex.bit[at], lex.odds[at], np.repeat(times[:k], n[:k]), slots, first

    def _blocks(self, s: int) -> list[tuple]:
        end = min(s + self.piece, len(self.columns[3]))
        return [self._events(x, end) for x in range(s, end, self.block)]

    def costs(self, mixer: Mixer) -> np.ndarray:
        """-log10 of the probability of each token, once ``mixer`` has learnt from them."""
        starts = range(0, len(self.columns[3]), self.piece)
        taught = float((self.columns[5] * self.columns[4]).sum())
        kind = np.uint32 if taught < 1 << 16 else np.uint64  # no count outgrows half of it
        tables, held, out = [np.zeros(1 << (64 - int(self.shift)), dtype=kind) for _ in range(3)], {}, []
        for s in starts:
            blocks = self._blocks(s)
            for y, _, times, slots, _ in blocks:
                more = _own(tables[0], y[: len(times)], times.astype(kind))
                for c, x in zip(tables, slots, strict=True):
                    np.add.at(c, x[: len(times)], more)
            held = {s: blocks}
        for s in starts:
            held = {s: [self._inputs(e, tables) for e in held.get(s) or self._blocks(s)]}
            for st, gate, y, times, _ in held[s]:
                n = len(times)
                mixer.learn([x[:n] for x in st], gate[:n], y[:n], times)
        for s in starts:
            for st, gate, y, _, first in held.get(s) or [self._inputs(e, tables) for e in self._blocks(s)]:
                out.append(np.add.reduceat(mixer.cost(st, gate, y), first) if len(y) else np.zeros(len(first)))
        return np.concatenate(out)[self.back] if out else np.zeros(0)

    def _inputs(self, events: tuple, tables: list[np.ndarray]) -> tuple:
        y, odds, times, slots, first = events
        own = _own(tables[0], y, np.arange(len(y)) < len(times))
        (one, n), (two, m), (often, _) = (_estimate(t, x, own) for t, x in zip(tables, slots, strict=True))
        return [odds, one, two, often], _gate(m, n), y, times, first


# ---- words outside the lexicon, spelt by bytes


class Letters:
    """Every byte of some words, each followed by a space (which ends the end token too), with the hashes of its contexts: the last one to four bytes of the word."""

    def __init__(self, words: list[bytes]):
        coded = [w + b" " for w in words]
        n = np.array([len(w) for w in coded])
        self.first = np.cumsum(n) - n
        b = np.frombuffer(b"".join(coded), dtype=np.uint8)
        self.byte = b.astype(np.int64)
        place = np.arange(len(b)) - np.repeat(self.first, n)
        key, self.contexts = np.zeros(len(b), dtype=np.uint64), []
        for k in range(1, 5):
            x = np.zeros(len(b), dtype=np.uint64)
            x[k:] = b[:-k]
            x[place < k] = 0
            key = key | x << np.uint64(8 * (k - 1))
            self.contexts.append(mix(key * np.uint64(8) + np.uint64(k)))

    def bit(self, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bit ``k`` of every byte from the top, and each context's slot for it in all tables, one after another."""
        partial = ((self.byte | 256) >> (8 - k)).astype(np.uint64) * _B
        slots, offset = [], 0
        for c, size in zip(self.contexts, _SIZES, strict=True):
            slots.append((((c + partial) * _A) >> np.uint64(64 - size)).astype(np.int64) + offset)
            offset += 1 << size
        return ((self.byte >> (7 - k)) & 1).astype(np.uint8), slots


_SLOTS = sum(1 << s for s in _SIZES)


def letter_counts(words: DataFrame, distinct: int) -> np.ndarray:
    """How often 0 and 1 followed in each slot, over the distinct training words: a flat table of pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * _SLOTS, dtype=np.uint32)
        for b in batches:
            for s in range(0, b.num_rows, 10_000):
                e = Letters(b.column(0).slice(s, 10_000).to_pylist())
                for k in range(8):
                    y, slots = e.bit(k)
                    for x in slots:
                        np.add.at(n, 2 * x + y, np.uint32(1))
        blocks = n.reshape(-1, 2 * _BLOCK)
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([blocks[i].tobytes()], pa.binary())], names=["block", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), dtype=np.uint32) for x in t.column("n"))
        return pa.table({"block": t.column("block").slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    tasks = max(3, distinct // 400_000)  # a task sends each block that it used once
    parts = words.where("n_train > 0").select("word").coalesce(tasks).mapInArrow(count, "block bigint, n binary")
    out = np.zeros((_SLOTS // _BLOCK, 2 * _BLOCK), dtype=np.uint32)
    for r in parts.groupBy("block").applyInArrow(add, "block bigint, n binary").toLocalIterator():  # tables of fixed size
        out[r["block"]] = np.frombuffer(r["n"], dtype=np.uint32)
    return _pairs(out.ravel())


def _letter_inputs(e: Letters, k: int, table: np.ndarray, own: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    y, slots = e.bit(k)
    both = [_estimate(table, x, _own(table, y, own)) for x in slots]
    return [x for x, _ in both], _gate(both[3][1], both[2][1]), y


def letter_mixer(rare: DataFrame, table: np.ndarray, words: int = 0) -> Mixer:
    """Weights and map of the byte contexts, learnt from every training word of ``rare``: the means of what tasks learnt
    online, by how often each was used."""
    shared = rare.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixer(4)
        for b in batches:
            for s in range(0, b.num_rows, 2000):
                e = Letters(b.column(0).slice(s, 2000).to_pylist())
                for k in range(8):
                    m.learn(*_letter_inputs(e, k, shared.value, True))
        state = np.concatenate([m.grown, m.weights.ravel(), m.seen.ravel(), m.map.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([state.tobytes()], pa.binary())], names=["state"])

    taught = rare.where("n_train > 0").select("word")
    # by hash: the same words in the same order whatever the layout, an even mixture in each task
    taught = taught.repartition(max(1, words // TAUGHT), "word").sortWithinPartitions(F.xxhash64("word"), "word")
    out, n, weights, seen, maps = Mixer(4), 0.0, 0.0, 0.0, 0.0
    for r in taught.mapInArrow(run, "state binary").collect():  # 27 kB for each task
        grown, w, s, m = np.split(np.frombuffer(r["state"]), np.cumsum([_GATES, 4 * _GATES, _GATES * _STEPS]))
        grown = grown + 1e-3
        n, weights = n + grown, weights + grown[:, None] * w.reshape(_GATES, 4)
        seen, maps = seen + s, maps + s * m
    if np.ndim(n):
        out.weights, out.map = (weights / n[:, None]).astype(np.float32), (maps / seen).reshape(_GATES, _STEPS)
    return out


def spelt(words: list[bytes], table: np.ndarray, mixer: Mixer) -> np.ndarray:
    """-log10 of the probability of each word's bytes, the space after it included."""
    if not words:
        return np.zeros(0)
    e = Letters(words)
    total = sum(mixer.cost(*_letter_inputs(e, k, table, False)) for k in range(8))
    return np.add.reduceat(total, e.first)


# ---- texts


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of 16-bit integers, low bytes and high bytes apart, compressed for the shuffle."""
    both = np.concatenate([c.view(np.uint8).reshape(-1, 2).T.ravel() for c in columns]).tobytes()
    return len(both).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(both, asbytes=True)


def _unpacked(blob: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    flat = np.frombuffer(pa.Codec("zstd").decompress(blob[8:], n, asbytes=True), dtype=np.uint8).reshape(columns, 2, -1).astype(np.int64)
    return flat[:, 0] | flat[:, 1] << 8


def _packed_words(words: pa.Array, times: np.ndarray, owner: np.ndarray) -> bytes:
    """Words, which hold no line end, how often each occurs in its document, and the number of that document, in rising order."""
    numbers = np.concatenate([times.astype("<i4"), np.diff(owner.astype("<i4"), prepend=np.int32(0))]).astype("<i4")
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), END)
    both = numbers.view(np.uint8).reshape(-1, 4).T.tobytes() + joined[0].as_py()
    return len(words).to_bytes(8, "little") + len(both).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(both, asbytes=True)


def _unpacked_words(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    n, size = (int.from_bytes(blob[a : a + 8], "little") for a in (0, 8))
    both = pa.Codec("zstd").decompress(blob[16:], size, asbytes=True)
    numbers = np.frombuffer(both[: 8 * n], dtype=np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    return both[8 * n :].split(END) if n else [], numbers[:n], np.cumsum(numbers[n:])


def _packed_docs(docs: np.ndarray) -> bytes:
    """Rising numbers of documents, with the training mark in the top bit, by their steps."""
    return _packed(np.diff(docs & 0x7FFF, prepend=np.uint16(0)) << 1 | docs >> 15)


def _unpacked_docs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = _unpacked(blob, 1)[0]
    return np.cumsum(steps >> 1), steps & 1 == 1



def _by_document(doc: np.ndarray, cost: np.ndarray) -> tuple[bytes, bytes]:
    """The documents, in rising order, and the sum of each one's costs, packed."""
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    total = np.add.reduceat(cost, first)
    low, high = (total & 0xFFFF).astype("<u2"), (total >> 16).astype("<u2")  # the high halves are nearly all 0
    return _packed_docs(doc[first].astype("<u2")), _packed(low, high)


_SENT = "part bigint, chunk bigint, docs binary, tokens binary, heads binary, ids array<bigint>, words binary"
_HEADS = "chunk bigint, docs binary, costs binary, heads binary, ids array<bigint>, words binary"
_HEAD = np.dtype([("tokens", "<i8"), ("known", "<i8"), ("bytes", "<i8"), ("base", "<i8"), ("train", "?")])


def _fine(n: np.ndarray) -> np.ndarray:
    """log10 of counts and one, in whole steps that add up alike in any order."""
    return np.rint(np.log10(n + 1.0) * FINE).astype(np.int64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _tokens(docs: DataFrame, lexicon, base) -> DataFrame:
    """Packed tokens by chunk and shard, and a row of each chunk's documents and words outside the lexicon."""
    schema = _schema(_SENT)

    def sent(chunk: int, held: list, tokens: list, sizes: list, ids: list, rare: list, owners: list) -> Iterator[pa.RecordBatch]:
        lex = lexicon.value
        start = np.cumsum([0, *map(len, ids)])
        token, tokens, ids = np.concatenate(held), np.concatenate(tokens), [d for x in ids for d in x]
        first = np.cumsum(tokens) - tokens
        train = np.array(list(map(is_training, ids)))
        heads = np.zeros(len(ids), dtype=_HEAD)
        heads["tokens"], heads["bytes"], heads["train"] = tokens, np.maximum(np.concatenate(sizes), 1), train
        heads["known"], heads["base"] = np.add.reduceat((token != ESCAPE).astype(np.int64), first), np.add.reduceat(base.value[token], first)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), tokens)
        last = np.concatenate([token[:1], token[:-1]])
        last[first] = START
        before = np.concatenate([token[:1], last[:-1]])
        before[first] = START
        at = np.arange(len(token), dtype=np.int32)
        marks = np.where((last > 0) & (last <= FREQUENT), at, 0)
        marks[first] = at[first]
        marks = np.maximum.accumulate(marks)
        often = np.where(last[marks] == START, 0, last[marks])
        part = lex.part(before, last, doc + np.int64(chunk) * 7919)
        part = part.astype(np.uint16) if lex.parts <= 1 << 16 else part  # 16 bits are sorted faster
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1))
        n, docs_, three = len(cuts), [], []
        columns = [x[order].astype("<u2") for x in (doc | train[doc].astype(np.int32) << 15, before, last, often, token)]
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            docs_.append(_packed_docs(columns[0][a:b]))
            three.append(_packed(*(c[a:b] for c in columns[1:])))
        arrays = [pa.array(part[order][cuts].astype(np.int64)), pa.array(np.full(n, chunk)), pa.array(docs_, pa.binary()), pa.array(three, pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(n, schema.field(i).type) for i in range(4, 7))], schema=schema)
        head = pa.array([heads.tobytes()], pa.binary())
        coded = pa.concat_arrays(rare).dictionary_encode()
        owner = np.concatenate([x + a for x, a in zip(owners, start[:-1], strict=True)])
        pair, times = np.unique(owner << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
        missing = coded.dictionary.take(pa.array(pair & 0xFFFFFFFF))
        lists = [pa.array([ids], schema.field(5).type), pa.array([_packed_words(missing, times, pair >> 32)], pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([chunk % lex.parts]), pa.array([chunk]), *(pa.nulls(1, pa.binary()) for _ in range(2)), head, *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, chunk = lexicon.value, TaskContext.get().partitionId() << 24
        end = lex.symbols(pa.array([END], pa.binary()))
        held, total = [], 0
        for ids, texts in _slices(batches):
            words, n = _split(texts)
            symbol, last = lex.symbols(words), np.cumsum(n)
            token = np.insert(symbol, last, end)  # the end token after each text's words
            size = np.diff(np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)])[last], prepend=0)
            missing = symbol == ESCAPE
            held.append((token, n + 1, size + n, ids, words.filter(pa.array(missing)), np.repeat(np.arange(len(n)), n)[missing]))
            total += len(token)
            if total >= CHUNK_TOKENS or sum(len(h[3]) for h in held) >= CHUNK_DOCS:
                yield from sent(chunk, *map(list, zip(*held, strict=True)))
                held, total, chunk = [], 0, chunk + 1
        if held:
            yield from sent(chunk, *map(list, zip(*held, strict=True)))
        held = []
        release()

    return docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string")).mapInArrow(run, _SENT)


_HERE = ["doc_id", "n_tokens", "n_bytes", "known", "base", "cost"]
_FOUND = f"row bigint, word binary, times int, here struct<{', '.join(f'{c}:bigint' for c in _HERE)}>"
_FOUND_SCHEMA = pa.schema([("row", pa.int64()), ("word", pa.binary()), ("times", pa.int32()), ("here", pa.struct([(c, pa.int64()) for c in _HERE]))])


def lm_scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    words = stored(word_counts(docs), "words")
    n_train, n_all, distinct = (x or 0 for x in words.agg(F.sum("n_train"), F.sum("n_all"), F.sum((F.col("n_train") > 0).cast("int"))).first())
    top = words.where(F.col("n_train") >= LEAST).orderBy(F.desc("n_train"), "word").limit(LEXICON).collect()
    known = [bytes(r["word"]) for r in top]
    counts = np.array([[r["n_train"], r["n_all"]] for r in top], dtype=np.int64).reshape(-1, 2)
    n_rare, v_rare = n_train - int(counts[:, 0].sum()), distinct - len(known)
    lexicon = spark.sparkContext.broadcast(Lexicon(known, counts[:, 0], counts[:, 1], n_all - int(counts[:, 1].sum()), n_all))
    scale = np.log10(n_train + distinct + 1)  # N + V + 1, once known words are added one each
    base = spark.sparkContext.broadcast(np.concatenate([[0], _fine(counts[:, 0])]))

    in_lexicon = spark.createDataFrame([(w,) for w in known], "word binary")
    rare = words.join(F.broadcast(in_lexicon), "word", "left_anti")
    table = letter_counts(words, distinct)
    letters = spark.sparkContext.broadcast((table, letter_mixer(rare, table, v_rare)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 5000):
                p = b.slice(s, 5000)
                n = p.column(1).to_numpy().astype(float)
                free = DISCOUNT * v_rare / n_rare if n_rare else 1.0
                with np.errstate(divide="ignore"):  # in logarithms: a long word's probability is no double
                    spell = np.log(free) - spelt(p.column(0).to_pylist(), *letters.value) * np.log(10)
                    costs = [-np.logaddexp(np.log(np.maximum(c - DISCOUNT, 0) / max(n_rare, 1)), spell) / np.log(10) for c in (n - 1, n)]
                costs = [pa.array(np.ceil(c * UNIT).astype(np.int64)) for c in costs]
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array(n > 0), pa.array(_fine(n)), *costs], names=["word", "known", "base", "cost_train", "cost_held"])

    scored = stored(rare.select("word", "n_train").mapInArrow(score, "word binary, known boolean, base bigint, cost_train bigint, cost_held bigint"), "scored-words")

    def shard(t: pa.Table) -> pa.Table:
        tokens = t.filter(pc.is_valid(t.column("docs")))
        both = [_unpacked_docs(x) for x in tokens.column("docs").to_pylist()]
        train = [x for _, x in both]
        ends = np.cumsum([0, *map(len, train)])
        cost = np.zeros(ends[-1])
        if len(train):
            columns = np.concatenate([_unpacked(x, 4) for x in tokens.column("tokens").to_pylist()], axis=1)
            train = np.concatenate(train)
            group, mixer = mix(columns[1]) % np.uint64(-(-len(train) // GROUP)), Mixer(4)
            order = np.argsort(group.astype(np.uint16) if len(train) < GROUP << 16 else group, kind="stable")  # 16 bits are sorted faster
            columns, train, group = columns[:, order], train[order], group[order]
            starts = np.flatnonzero(np.diff(group.astype(np.int64), prepend=-1))
            for a, b in zip(starts, np.append(starts[1:], len(group)), strict=True):
                cost[order[a:b]] = Shard(lexicon.value, *columns[:, a:b], train[a:b]).costs(mixer)
        cost = np.ceil(cost * UNIT).astype(np.int64)
        back = [_by_document(d, cost[a:b]) for (d, _), a, b in zip(both, ends[:-1], ends[1:], strict=True)]
        names = [c.split()[0] for c in _HEADS.split(", ")]
        schema = _schema(_HEADS)
        back = pa.Table.from_arrays([tokens.column("chunk"), *(pa.array(x, pa.binary()) for x in zip(*back, strict=True)), *(pa.nulls(len(back), schema.field(i).type) for i in range(3, 6))], schema=schema) if back else schema.empty_table()
        heads = t.filter(pc.is_valid(t.column("heads")))
        passed = pa.Table.from_arrays([heads.column("chunk"), pa.nulls(heads.num_rows, pa.binary()), pa.nulls(heads.num_rows, pa.binary()), *(heads.column(n) for n in names[3:])], schema=schema)
        return pa.concat_tables([back, passed])

    def assembled(t: pa.Table) -> pa.Table:
        head = t.filter(pc.is_valid(t.column("heads")))
        rows = np.frombuffer(head.column("heads")[0].as_py(), dtype=_HEAD)
        parts = t.filter(pc.is_valid(t.column("docs")))
        cost = np.zeros(len(rows), dtype=np.int64)
        for d, c in zip(parts.column("docs").to_pylist(), parts.column("costs").to_pylist(), strict=True):
            low, high = _unpacked(c, 2)
            cost[_unpacked_docs(d)[0]] += low | high << 16
        first = head.column("chunk")[0].as_py() << 15
        words, times, owner = _unpacked_words(head.column("words")[0].as_py())
        words = pa.array(words, pa.binary())
        by_word = pc.array_sort_indices(words)  # like words lie together, so they take less room in the shuffle
        words, owner = words.take(by_word), owner[by_word.to_numpy()]
        times = times[by_word.to_numpy()]
        ids = first + np.arange(len(rows))
        # held-out documents have their numbers of occurrences below 0
        # no word begins with a line end, so these rows join nothing, each in a partition of its own
        own = pa.array([END + str(r).encode() for r in ids.tolist()], pa.binary())
        n, m, schema = len(rows), len(owner), _FOUND_SCHEMA
        here = pa.StructArray.from_arrays([head.column("ids")[0].values, *(pa.array(x) for x in (rows["tokens"], rows["bytes"], rows["known"], rows["base"], cost))], names=_HERE)
        heads = [pa.array(ids), own, pa.nulls(n, pa.int32()), here]
        found = [pa.array(first + owner.astype(np.int64)), words, pa.array(np.where(rows["train"][owner], times, -times), pa.int32()), pa.nulls(m, schema.field(3).type)]
        return pa.concat_tables([pa.Table.from_arrays(heads, schema=schema), pa.Table.from_arrays(found, schema=schema)])

    found = _tokens(docs, lexicon, base).groupBy("part").applyInArrow(shard, _HEADS).groupBy("chunk").applyInArrow(assembled, _FOUND)
    part = found.join(scored.hint("shuffle_hash"), "word", "left")  # a word is one row there: its partitions are even and small
    k = F.abs("times")
    of = lambda here, word: F.sum(F.coalesce(F.col(here), k * word, F.lit(0)).cast("bigint"))
    cost = F.when(F.col("times") > 0, F.col("cost_train")).otherwise(F.col("cost_held")).cast("bigint")
    sums = part.groupBy("row").agg(
        F.max("here.doc_id").alias("doc_id"), F.sum("here.n_tokens").alias("n_tokens"), F.sum("here.n_bytes").alias("n_bytes"),
        of("here.known", F.col("known").cast("int")).alias("n_known"), of("here.base", F.col("base")).alias("base"), of("here.cost", cost).alias("cost"),
    )
    base_score = F.col("base") / F.lit(float(FINE)) - F.col("n_tokens") * F.lit(float(scale))
    sums = sums.withColumns({"base_score": base_score, "score": -F.col("cost") / F.lit(float(UNIT))})
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return sums.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
