"""Token counts, pieces and id files against the libraries, text by text."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from gridwatch.llm.common import scratch_path
from gridwatch.llm.id_files import Encoder, pack, read_ids, unpack, write_ids
from gridwatch.llm.pieces import encode_pieces, piece_digests, pieces
from gridwatch.llm.token_counts import Counter, token_counts

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", " \n a\t\tb \r\n c", "▁x ▁ y▁", "don't  it's 12 345 x　y", "<|endoftext|> a<|endoftext|> b <|endoftext|>",
       "<s> x</s>", "é ́a Å ﬁ", "\x00\x1c a\x1fb", "日本語 テキスト 😀😀 x", "ΑΣ Σ ΣΑ", "x" * 3000, "a " * 900, "-" * 500 + " y", "it 's we 'll", "A.b, C.D.. E,'x 3.14,15 Ünï, ÀB.", "Word. Word, WORD. wörd,x .y", "a.<|endoftext|>, b", "\x85a.\xa0b, İ. ſ, µ. ª,"]


def texts():
    rng = random.Random(5)
    words = ["the", "of", "naïve", "don't", "12", ",", ".", "\n", "  ", "▁", "über", "x y", "<|endoftext|>", "\t", "'s", "日本", "zz9"]
    return ODD + ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "", "  ", "\n "]) for _ in range(rng.randrange(60))) for _ in range(200)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", -1) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, ids_crc32 string, n_tokens int").repartition(5)


def test_token_counts(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 20) for i, x in enumerate(texts())]
    for chunk_chars, overlap in ((1 << 16, 256), (40, 4), (8, 1)):
        got = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), 20, chunk_chars, overlap)
        assert sorted(tuple(r)[:4] for r in got.collect()) == sorted([*want, want[5]])


def test_splicing_widens_and_merges():
    c = Counter(public_tokenizers.path("byte_bpe_50k.json"), 50, 2)
    long = "word " * 40 + "x" * 200 + " tail" * 30
    n, chunks = c.spliced(long)
    assert n == len(c.tokenizer.encode(long, add_special_tokens=False).ids) and 3 < chunks < len(long) // 50


def test_splices_agree_with_the_library():
    """Random texts in chunks of a few characters, where most overlaps have to be widened or merged."""
    c = Counter(public_tokenizers.path("byte_bpe_50k.json"), 12, 3)
    assert c.stable
    rng = random.Random(12)
    some = [*"ab'.,  \n\t1é日😀", " ", " ", "the", " house", "<|endoftext|>", "'s", "\u3000", "\x1c", "  "]
    every = ["".join(rng.choices(some, k=rng.randrange(90))) for _ in range(3000)]
    spliced = 0
    for t, (n, chunks) in zip(every, c.count(every), strict=True):
        assert n == len(c.tokenizer.encode(t, add_special_tokens=False).ids), t
        spliced += chunks > 2
    assert spliced > 1000


def test_pieces(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert pieces(path).independent
    want = {}
    for i, x in enumerate(texts()):
        ids = model.encode(x or "")
        want[i] = (ids, model.decode(ids))
    for r in encode_pieces(docs, path).collect():
        assert (r.ids, r.decoded) == want[r.doc_id], texts()[r.doc_id]
    got = piece_digests(docs, path).collect()
    assert len(got) == docs.count()
    for r in got:
        ids, text = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 4, 5, 1000):
        v = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        control, data = pack(v)
        assert len(control) == -(-n // 4) and np.array_equal(unpack(control, data, n), v)


def test_id_files(spark, docs):
    path, out = public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "t")
    write_ids(docs, path, out, parts=4)
    got = read_ids(spark, out).orderBy("start").collect()
    t = Tokenizer.from_file(path)
    start = 0
    for r, i in zip(got, sorted([*range(len(texts())), 5]), strict=True):
        ids = [*t.encode(texts()[i] or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())), texts()[i]
        start += len(ids)


def test_id_encoder_on_random_texts():
    """Texts of marks, control characters and letters of several kinds, one by one and together, by a table that starts anew."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(77)
    some = [*".,<|>'!?", *"aAzZ09éÉßµªÿÀ×÷", *" \n\t\r\x0b\x0c", *map(chr, range(0x1C, 0x20)), *"\x00\x85\xa0\u0301\u3000İΣ日", "<|endoftext|>", "<|ENDOFTEXT|>", "it's", "word", "3,14"]
    every = ["3,\x1f", ".\x1f\x1f", "\x0c\x1c.", "".join(map(chr, range(256)))] + ["".join(rng.choices(some, k=rng.randrange(1, 14))) for _ in range(20_000)]
    e = Encoder(public_tokenizers.path("word_bpe_49k.json"), most=5000)
    for i in range(0, len(every), 500):
        for x, got in zip(every[i : i + 500], e.encode(every[i : i + 500]), strict=True):
            assert got.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert piece_digests(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    out = scratch_path(spark, "t")
    write_ids(none, public_tokenizers.path("word_bpe_49k.json"), out)
    assert read_ids(spark, out).count() == 0


def test_every_character_is_encoded_about_once():
    """Long texts without single spaces: one word, Chinese, base 64, white space alone, special strings side by side."""
    rng = random.Random(4)
    n = 300_000
    every = {"word": "x" * n, "chinese": "".join(rng.choice("的一是在不了有和人这。") for _ in range(n)), "base64": "".join(rng.choice("abcXYZ0189+/") for _ in range(n)), "white": " " * n, "special": "<|endoftext|>" * (n // 13)}
    for name, text in every.items():
        c = Counter(public_tokenizers.path("byte_bpe_50k.json"), 1 << 13, 256)
        asked, ends = [], c.ends
        c.ends = lambda t, asked=asked, ends=ends: (asked.append(len(t)), ends(t))[1]
        got, chunks = c.spliced(text)
        assert got == len(c.tokenizer.encode(text, add_special_tokens=False).ids), name
        assert sum(asked) < 1.3 * len(text) and (chunks > 20) == (name in ("chinese", "base64")), name


def test_chunks_that_do_not_align_are_widened():
    c = Counter(public_tokenizers.path("byte_bpe_50k.json"), 100, 8)
    text, ends, refused = "some words, " * 100, c.ends, []

    def other(t):
        found = ends(t)
        if len(refused) < 3 and len(t) < 60:  # the right chunk's region, as if it had no edge in common
            refused.append(t)
            return found[:0]
        return found

    c.ends = other
    assert c.spliced(text)[0] == len(c.tokenizer.encode(text, add_special_tokens=False).ids) and len(refused) == 3
