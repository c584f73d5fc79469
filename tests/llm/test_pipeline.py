"""The pipeline against a step-by-step version on a small table: library ids, brute-force groups, planted passages."""

import random

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridwatch.llm.language_id import language_of
from gridwatch.llm.ngram_join import brute_force
from gridwatch.llm.pieces import encode_pieces
from gridwatch.llm.toxicity import toxicity_scores

PARTS = {"en": ["th", "er", "ing", "on", "the", "ed", "and"], "de": ["sch", "ung", "ein", "ß", "ü", "keit", "der"]}


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    word = lambda g: "".join(rng.choice(PARTS[g]) for _ in range(rng.randrange(1, 4)))
    items = [(i, " ".join(word("en") for _ in range(30))) for i in range(5)]
    docs, labels, leaks = [], [], set()
    for d in range(300):
        g = rng.choice(list(PARTS))
        w = [word(g) for _ in range(rng.choice([20, 60, 150]))]
        toxic = rng.random() < 0.2
        if toxic:
            w[rng.randrange(len(w))] = "idiot"
            w[rng.randrange(len(w))] = "Scum,"
        if d % 17 == 0:
            w[5:5] = items[d % 5][1].split()
            leaks.add(d)
        docs.append((d, " ".join(w), g, "s", len(w)))
        labels.append((d, 1, int(toxic)))
        if d % 10 == 3:
            docs.append((1000 + d, docs[-1][1].replace(" ", "  ", 2), g, "s", 0))
            leaks |= {1000 + d} if d in leaks else set()
    docs += [(2000, None, None, "s", 0), (2001, "12 -- 3", None, None, 0), (2002, "", "en", "s", 0), (2003, "der " * 4000 + "ung", "de", "s", 0)]
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = {d: t for d, t, *_ in docs}

    clean = {r.doc_id for r in toxicity_scores(table, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if not r.predicted}
    kept = corpus_pipeline.toxicity(spark, table, str(tmp_path))
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == clean
    known = {r.doc_id for r in language_of(kept).collect() if not r.rejected}
    assert not known & {2000, 2001, 2002} and len(known) > 200
    groups = brute_force([(d, texts[d]) for d in known])
    first = {d for d in known if groups[d][1] == d}
    assert len(first) < len(known)
    want = first - leaks
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == want
    for d, r in got.items():
        assert r.ids == model.encode(texts[d]) and r.decoded == model.decode(r.ids)


def test_texts_go_to_workers_in_small_batches(spark):
    """32 MB of texts in one partition; a value that the user has set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefg "), 1000).alias("text"), F.lit("en").alias("lang"))
    sizes = lambda: [r.n for r in docs.select("text").mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n bigint").collect()]
    spark.conf.unset(key)
    assert max(sizes()) > 20 << 20
    encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert max(sizes()) < 5 << 20 and sum(sizes()) > 30 << 20
    spark.conf.set(key, "8m")
    encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert spark.conf.get(key) == "8m"
    spark.conf.unset(key)
