"""Ranked search against scores of every document, and packing against the tokenizer library."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from gridwatch.llm import byte_units, lexical_search, packing, queries

DOCS = "doc_id bigint, text string, lang string, score string, rank int"
ITEMS = "item_id bigint, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t) for t in TERM.findall(text or "")]


def ranked(docs, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for (d, c), size in zip(counts, sizes):
            m = 25 + (75 * size * n) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            found.append((-s, d is not None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1) if s < 0]
    return sorted(out, key=str)


@pytest.mark.parametrize("words", [12, 300])
def test_search_equals_all_scores(spark, monkeypatch, words):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 40)
    monkeypatch.setattr(lexical_search, "BATCH", 8)
    rng = random.Random(words)
    vocabulary = [f"W{i}" if i % 3 else f"é{i}Ä" for i in range(words)] + ["中文", "a_b", "x-y"]
    text = lambda n: rng.choice(" .\n-").join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(len(vocabulary))], k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(30)] + [(1, "W1 W1"), (None, "w1"), (900, None), (901, ""), (902, "..."), (903, "W2 " * 30000)]
    items = [(i, text(rng.randint(1, 90))) for i in range(12)] + [(3, "W1"), (None, "W1 w1 é0Ä"), (20, None), (21, ""), (22, "unknown"), (23, " ".join(vocabulary))]
    d = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], DOCS).repartition(5)
    q = spark.createDataFrame([(i, t, "z") for i, t in items], ITEMS)
    got = [tuple(r) for r in lexical_search.lexical_search(d, q).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == ranked(docs, items)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 2000)  # several passes over the documents
    again = [tuple(r) for r in lexical_search.lexical_search(d, q, 3).collect()]
    assert sorted(again, key=str) == [x for x in sorted(got, key=str) if x[1] <= 3]


def test_search_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", "", "", 1)], DOCS)
    items = spark.createDataFrame([(1, "a", "")], ITEMS)
    assert lexical_search.lexical_search(none, items).count() == 0
    assert lexical_search.lexical_search(some, items.limit(0)).count() == 0
    assert lexical_search.lexical_search(some, items.withColumn("text", lexical_search.F.lit("?"))).count() == 0


def test_masks_of_many_terms():
    rng = np.random.default_rng(1)
    held = rng.random((150, 90)) < 0.02
    held[:, 40:60] = held[:, [3]]
    found, group = lexical_search.masks(np.packbits(held, axis=1), 90)
    assert (found[group] == held.T).all() and len({x.tobytes() for x in found}) == len(found)


def test_search_twin(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op11_lexical_search"]).fetchall()
    got = queries.op11_lexical_search(spark, d).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# Packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    return t


def test_units_equal_library():
    rng, e, t = random.Random(3), byte_units.ByteEncoder(PATH, most=300), library()
    parts = ["a", "B", "7", "٣", "é", "中", " ", " ", "  ", "\n", "\t", "\n\n", "\r\n", ".", ",", "'", "'s", "'ll", "?!", "\xa0", " ", "　", "́", "<|endoftext|>", "<|", "|>", "\x1c", "_", "-", "🎉", "don't", "\x85"]
    for _ in range(40):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(40)]
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


def test_assign_fills_every_sequence():
    rng = np.random.default_rng(2)
    for capacity, n in ((16, 1), (16, 200), (1024, 900)):
        lengths = np.sort(rng.integers(1, capacity, n))[::-1]
        parts, size, cost = packing.assign(lengths, capacity)
        filled = np.zeros(len(size), dtype=int)
        done = Counter()
        for piece, before, length, at, offset in parts:
            assert before == done[piece] and offset == filled[at] and length > 0
            done[piece] += length
            filled[at] += length
        assert (filled == size).all() and [done[i] for i in range(n)] == lengths.tolist()
        assert all(s == capacity or s & (s - 1) == 0 for s in size.tolist())
        full = cost[size == capacity]
        if n == 900:
            assert full.max() < 1.1 * full.min()  # costs are even


def check_pieces(rows, docs, capacity=1024):
    t = library()
    ids = [t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in docs]
    want = Counter((d, len(x), tuple(x)) for (d, _), x in zip(docs, ids))
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    total = {k: sum(r["length"] for r in v) for k, v in by_doc.items()}
    assert total == Counter({k: sum(n * c for (d, n, _), c in want.items() if (d, n) == k) for k in by_doc}) and len(by_doc) == len({k[:2] for k in want})
    for (d, n, x), copies in want.items():
        if sum(1 for k in want if k[:2] == (d, n)) == 1:
            for r in by_doc[d, n]:
                own = np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4")
                assert len(own) == r["length"] and zlib.crc32(own.tobytes()) == r["ids_crc32"]
            covered = Counter(i for r in by_doc[d, n] for i in range(r["start"], r["start"] + r["length"]))
            assert set(covered.values()) == {copies}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == capacity or at & (at - 1) == 0
    return sequences


def test_packing_equals_library(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    rng = random.Random(8)
    words = ["the", "Ünder", "foo.bar", "x" * 30, "don't", "42", "\n\n", "中文字", "<|endoftext|>"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 300)))) for i in range(80)]
    docs += [(3, "again"), (3, "again"), (None, "no id"), (100, None), (101, ""), (102, "word " * 9000), (103, "y" * 5000), (2**60 + 1, "big id")]
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], "doc_id bigint, text string, length string, ids string, start int").repartition(4)
    sequences = packing.packed_sequences(df, PATH)
    rows = packing.piece_digests(sequences).collect()
    check_pieces(rows, docs)
    assert sorted(r["length"] for r in sequences.collect()) == sorted(sum(r["length"] for r in rows if r["sequence_id"] == s) for s in {r["sequence_id"] for r in rows})
    assert packing.piece_digests(packing.packed_sequences(df.limit(0), PATH)).count() == 0


def test_packing_query(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check_pieces(queries.op13_packing(spark, d).collect(), docs)
