"""The trained operators: held-out accuracy, exact counts and edge cases."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwatch.llm import context_mixing as ctx
from gridwatch.llm.context_mixing import Lexicon, lm_scores
from gridwatch.llm.language_id import language_of, without_rejected
from gridwatch.llm.toxicity import toxicity_scores, without_toxic

PARTS = {"en": ["th", "er", "ing", "on", "the", "ed"], "de": ["sch", "ung", "ein", "ß", "ü", "keit"], "fr": ["eau", "é", "que", "ou", "è", "tion"]}
BAD = {"en": ["idiot", "scum", "trash"], "de": ["lowei"], "fr": ["vequ"]}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for d in range(900):
        g = rng.choice(list(PARTS))
        word = lambda: "".join(rng.choice(PARTS[g]) for _ in range(rng.randrange(1, 4)))  # noqa: E731, B023
        w = [word() for _ in range(rng.choice([10, 40, 200]))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(BAD[g]) + (word() if g != "en" else rng.choice(["", ",", "!"]))
        docs.append((d, " ".join(w), g, "score"))
        labels.append((d, int(toxic), 1))
    odd = [(1000, None, "en", "x"), (1001, "", "en", "x"), (1002, "12 34 -- 5", None, "x"), (1003, "a " * 50_000, "en", "x"), (None, "the thing", "en", "x")]
    return (
        spark.createDataFrame(docs + odd + docs[:3], "doc_id long, text string, lang string, score string").repartition(5),
        spark.createDataFrame([*labels, (None, 1, 1), (5, None, 1)], "doc_id long, toxic int, text int"),
        {d: (t, g, labels[d][1]) for d, t, g, _ in docs},
        len(docs) + len(odd) + 3,
    )


def test_toxicity(corpus):
    docs, labels, truth, n = corpus
    got = toxicity_scores(docs, labels).collect()
    assert len(got) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    hit = sum(r.predicted and truth[r.doc_id][2] for r in held)
    assert hit >= 0.9 * sum(truth[r.doc_id][2] for r in held) and hit >= 0.95 * sum(r.predicted for r in held)
    kept = without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0}


def test_language(corpus):
    docs, _, truth, n = corpus
    got = language_of(docs).collect()
    assert len(got) == n
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id][1] for r in held) >= 0.98 * len(held) > 100
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002))
    assert sum(r.rejected for r in got) <= 8
    kept = without_rejected(docs)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got)
    none = language_of(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in none.collect()} == {"und"} and language_of(docs.limit(0)).count() == 0


def test_lm_scores(corpus, monkeypatch):
    docs, _, truth, n = corpus
    got = lm_scores(docs).collect()
    assert len(got) == n
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    train, distinct = Counter(), 0
    for d, t in rows:
        if d is not None and zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*(t or "").encode().lower().split(), b"\n"])
    total, distinct = sum(train.values()), len(train)
    texts = dict(rows)
    for r in got:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b"\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(train[w] > 0 for w in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in tokens))
        assert r.score < 0 and r.bits_per_byte > 0
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    monkeypatch.setattr(ctx, "SHARD", 700)
    monkeypatch.setattr(ctx, "CHUNK_DOCS", 50)
    many = lm_scores(docs).collect()
    assert sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6)) for r in many) == sorted((r.doc_id or -1, r.n_known, round(r.base_score, 6)) for r in got)
    assert lm_scores(docs.limit(0)).count() == 0


def _lexicon():
    rng = np.random.default_rng(4)
    words = [b"\n", *(b"w%d" % i for i in range(300))]
    n = np.sort(rng.integers(2, 5000, len(words)))[::-1]
    return Lexicon(words, n, n, 700, int(n.sum()) + 700), rng


def test_token_probabilities_sum_to_one():
    """In one context, with whatever was learnt, all symbols together have probability one; so have all bytes of a word."""
    lex, rng = _lexicon()
    k = len(lex.length)
    assert (0.5 ** lex.length).sum() == pytest.approx(1)
    before, last, often, token = (rng.integers(0, 20, 4000) for _ in range(4))
    every = np.arange(k)
    for c in ((3, 4, 5), (ctx.START, ctx.START, 0), (900, 7, 1)):
        columns = [np.concatenate([x, np.full(k, v)]) for x, v in zip((before, last, often), c, strict=True)]
        train = np.arange(4000 + k) < 4000
        for block, piece in ((30_000, 400_000), (611, 1500)):
            cost = ctx.Shard(lex, *columns, np.concatenate([token, every]), train, block, piece).costs(ctx.Mixer(4))[4000:]
            assert (10**-cost).sum() == pytest.approx(1, abs=2e-3)  # bits of probability under 1e-6 count as that
    table = ctx._pairs(rng.integers(0, 50, 2 * ctx._SLOTS))
    m = ctx.Mixer(4)
    e = ctx.Letters([bytes([b]) for b in range(256)])
    first = sum(m.cost(*ctx._letter_inputs(e, k, table, False))[e.first] for k in range(8))
    assert (10**-first).sum() == pytest.approx(1, abs=1e-4)


def test_contexts_count():
    """What followed a context in training texts is likely there, counted without the token's own occurrence."""
    lex, rng = _lexicon()
    noise = [rng.integers(1, 300, 3000) for _ in range(4)]
    seen = np.tile([[11], [12], [1], [250]], 40)
    cost = lambda *rows: ctx.Shard(lex, *np.concatenate([np.stack(noise), *rows], axis=1), np.arange(3000 + sum(r.shape[1] for r in rows)) < 3000 + seen.shape[1]).costs(ctx.Mixer(4))
    with_it = cost(seen, np.array([[11, 13], [12, 12], [1, 1], [250, 250]]))
    without = ctx.Shard(lex, *np.concatenate([np.stack(noise), np.array([[11], [12], [1], [250]])], axis=1), np.arange(3001) < 3001).costs(ctx.Mixer(4))
    assert with_it[-2] < 0.3 and without[-1] > 2 and with_it[-2] <= with_it[-1] < without[-1]


def test_copies_score_apart(spark):
    rng = random.Random(1)
    vocab = [f"v{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocab, k=80))) for i in range(400)]
    docs += [(400 + i, docs[i][1]) for i in range(60)]
    got = {r.doc_id: r.bits_per_byte for r in lm_scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    twice = [d for d in range(60) if zlib.crc32(str(400 + d).encode()) % 7 != 2]
    single = sorted(got[d] for d in range(60, 400))
    assert sum(got[d] < single[10] for d in twice) > 0.9 * len(twice)


def test_parts():
    lex, _ = _lexicon()
    assert lex.part(np.array([5, 5, 9]), np.array([5, 9, 5]), np.array([0, 1, 2])).max() < lex.parts


def test_long_words_cost_in_proportion(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(40)) for _ in range(300)]
    sizes = (50, 1_000, 20_000, 400_000)
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2]
    learnt = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [*zip(learnt, texts), *((i, "".join(rng.choices(letters, k=n))) for i, n in zip(held, sizes))]
    got = {r["doc_id"]: r for r in lm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").collect()}
    per_byte = [-got[i]["score"] / n for i, n in zip(held, sizes)]
    assert all(1.2 < x < 2.4 for x in per_byte[1:]) and per_byte[3] == pytest.approx(per_byte[2], rel=0.1)


def test_large_counts_keep_their_odds():
    pairs = ctx._pairs(np.array([3, 5, 0, 70_000, 1, 400_000, 200_000, 100_000], dtype=np.uint32))
    zero, one = pairs & 0xFFFF, pairs >> 16
    assert zero[:2].tolist() == [3, 0] and one[0] == 5 and 35_000 == one[1] and zero[2] == 1 and one[2] == 50_000
    assert zero[3] == pytest.approx(2 * one[3], abs=2)


@pytest.mark.parametrize("at", [0, 5])
def test_every_rare_word_teaches(spark, at):
    """The byte weights are those of a mixer that learns from all training words, of every hash class, and from no others."""
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abcdef", k=rng.randint(2, 6))).encode() for _ in range(3000)})
    rare = spark.createDataFrame([(w, 1 if i % 5 else 0) for i, w in enumerate(words)], "word binary, n_train long")
    rare = rare.where(F.pmod(F.xxhash64("word"), F.lit(16)) == at if at else F.lit(True))
    learnt = [bytes(r["word"]) for r in rare.where("n_train > 0").orderBy(F.xxhash64("word"), "word").collect()]
    table = np.random.default_rng(1).integers(1, 50, ctx._SLOTS).astype(np.uint32) * np.uint32(65537)
    want = ctx.Mixer(4)
    for s in range(0, len(learnt), 2000):
        e = ctx.Letters(learnt[s : s + 2000])
        for k in range(8):
            want.learn(*ctx._letter_inputs(e, k, table, True))
    got = ctx.letter_mixer(rare.repartition(5), table)
    assert np.allclose(got.weights, want.weights, atol=1e-4) and np.allclose(got.map, want.map, atol=1e-4)
    assert not np.allclose(got.weights, ctx.Mixer(4).weights, atol=1e-4)


def test_costs_by_document():
    doc = np.array([0, 0, 3, 3, 3, 9, 32_767])
    docs, costs = ctx._by_document(doc, np.array([1, 70_000, 5, 0, 2, 0, 4]))
    low, high = ctx._unpacked(costs, 2)
    assert ctx._unpacked_docs(docs)[0].tolist() == [0, 3, 9, 32_767] and (low | high << 16).tolist() == [70_001, 7, 0, 4]


def test_words_split_in_columns():
    texts = ["", None, " \t\r\n\x0b\x0c", "a", "  A b\x0bB  ", "É é É x \x1c\x85Z", "x" * 5000 + " y", "\n\nB\n"]
    words, n = ctx._split(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == list(map(len, want)) and words.to_pylist() == sum(want, [])
    words, n = ctx._split(pa.array([None, ""], pa.string()))
    assert n.tolist() == [0, 0] and len(words) == 0


def test_word_counts_take_less_than_counting_one_by_one(spark):
    rng = np.random.default_rng(8)
    words = np.array([f"w{i}" for i in range(30_000)])
    texts = [" ".join(words[(rng.pareto(1, 500) * 20).astype(int) % 30_000]) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    class Docs:  # keeps the function that Spark would run
        __getitem__ = lambda self, name: F.lit(name)
        select = lambda self, *a: self
        groupBy = lambda self, *a: self
        agg = lambda self, *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    run, plain = ctx.word_counts(Docs()).run, Counter()
    took, one = [], []
    for _ in range(3):
        began = time.process_time()
        got = list(run(iter([batch])))
        took.append(time.process_time() - began)
        began = time.process_time()
        plain = Counter()
        for t in texts:
            plain.update(t.encode().lower().split())
        one.append(time.process_time() - began)
    counts = {w: n for b in got for w, n in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)}
    assert counts == plain | {ctx.END: 1500}
    assert min(took) < 0.8 * min(one)
