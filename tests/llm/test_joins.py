"""The joins against brute force over small tables."""

import random

import numpy as np
import pytest

from gridwatch.llm import ngram_join, vectors
from gridwatch.llm.decontaminate import contaminated, without_contaminated
from gridwatch.llm.graph import components
from gridwatch.llm.ngram_join import brute_force, jaccard_components, one_of_each
from gridwatch.llm.quotations import parse, reply_ordered
from gridwatch.llm.vectors import near_duplicate_vectors


def _texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    line = " ".join(rng.choice(vocab) for _ in range(40))
    out: list[str | None] = [None, "", "  \n", "one two", "One  two", "a b c d e", "a b c d", "x " * 4000, "x " * 3000]
    while len(out) < n:
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 30, 60, 120]))]
        base = " ".join(words)
        out.append(base + (" " + line if rng.random() < 0.4 else ""))
        for _ in range(rng.choice([0, 0, 1, 3, 6])):
            w = out[-1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper())
    order = list(range(len(out)))
    rng.shuffle(order)
    return [(7 * i - 50, out[j]) for i, j in enumerate(order)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_components(spark, seed):
    rows = _texts(seed, 260)
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, component_id string, rep int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()}
    want = brute_force(rows)
    assert got == want and sum(d != c for d, (_, c) in want.items()) > 40
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_jaccard_in_blocks_and_rounds(spark, monkeypatch):
    """Frequent columns and the shuffled fetch of texts give the same; repeated and null ids don't break it."""
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 3)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    monkeypatch.setattr(ngram_join, "LATE_BITS", (1 << 16, 1 << 16))
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rows = _texts(9, 200)
    docs = spark.createDataFrame([*rows, (None, rows[20][1]), rows[15], rows[15]], "doc_id long, text string").repartition(3)
    got = jaccard_components(docs, rounds=0).collect()
    want = brute_force(rows)
    assert len(got) == len(rows) + 3 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_components(docs.limit(0)).count() == 0


def _cells_of(monkeypatch, docs, **kw):
    """Result and the number of cells whose overlaps were asked for."""
    asked, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda d, r, c, cells, *a: asked.append(cells.count()) or verified(d, r, c, cells, *a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, **kw).collect()}
    monkeypatch.setattr(ngram_join, "_verified", verified)
    return got, sum(asked)


def test_shared_passage_makes_no_pairs(spark, monkeypatch):
    """Documents that share most of their words but link with nothing, each in a task of its own: cells grow like the documents."""
    rng = random.Random(4)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(1200)]
    cells = {}
    for n in (24, 48):
        rows = [(i, " ".join([f"u{i}.{j}" for j in range(rng.randrange(280, 320))] + shared)) for i in range(n)]
        rows += [(n + i, rows[i][1] + " a few words more " * (i + 1)) for i in range(3)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
        got, cells[n] = _cells_of(monkeypatch, docs)
        assert got == brute_force(rows) and [got[n + i][1] for i in range(3)] == [0, 1, 2]
    assert cells[24] < 6 * 27 and cells[48] < 6 * 51


def test_near_copies_make_no_pairs_in_the_last_step(spark, monkeypatch):
    """Every two of the rows link: the cells that leave the last step, and the links, grow like the rows."""
    rng = random.Random(8)
    base, cells, links = [f"b{i}" for i in range(120)], {}, {}
    joined = ngram_join._joined
    for n in (60, 120):
        rows = [(i, " ".join(base[: (at := rng.randrange(120))] + [f"own{i}"] + base[at + 1 :])) for i in range(n)]
        found = []
        monkeypatch.setattr(ngram_join, "_joined", lambda labels, more: found.append(more.count()) or joined(labels, more))  # noqa: B023
        got, cells[n] = _cells_of(monkeypatch, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rounds=0)
        assert got == brute_force(rows) and {c for _, c in got.values()} == {0}
        links[n] = sum(found)
    assert cells[60] < 12 * 60 and cells[120] < 12 * 120 and links[120] < 12 * 120, (cells, links)


def test_columns_of_one_row_are_not_counted(spark, monkeypatch):
    """Rows that share a passage, one a task, are counted in one task: their own columns don't leave it, those of the passage do."""
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, " ".join(f"u{i}.{j}" for j in range(80)) + " " + passage) for i in range(15)]
    again, counts = [], ngram_join._counts
    monkeypatch.setattr(ngram_join, "_counts", lambda part, k: again.append(counts(part, k).collect()) or counts(part, k))
    got = jaccard_components(spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_force(rows)
    (cols,) = again
    assert len(cols) == 296 and {r.n for r in cols} == {14}  # the pivot of the first round has met all of them


def test_late_columns(spark):
    rng = np.random.default_rng(5)
    cols = np.unique(rng.integers(-(2**63), 2**63 - 1, 3000))
    bitmap = ngram_join.late_bitmap(spark.createDataFrame([(int(c),) for c in cols], "col long"))
    assert ngram_join.is_late(bitmap, cols.view(np.uint64)).all() and len(bitmap) == ngram_join.LATE_BITS[0] // 8
    other = np.setdiff1d(rng.integers(-(2**63), 2**63 - 1, 3000), cols).view(np.uint64)
    assert ngram_join.is_late(bitmap, other).mean() < 0.02
    assert not ngram_join.late_bitmap(spark.createDataFrame([], "col long")).any()


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 90, n, dtype=np.uint64)) for n in (0, 1, 5, 40, 60, 200)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(6), np.arange(6)))
    assert ngram_join.overlaps(sets, i, j).tolist() == [len(set(sets[a]) & set(sets[b])) for a, b in zip(i, j, strict=True)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)] + [(1, 1), (5, 4), (4, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    group = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for e in edges:
            if None not in e:
                group[e[0]] = group[e[1]] = min(group[e[0]], group[e[1]])
    assert got == group


def test_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 32))
    x = [base[rng.integers(60)] + rng.normal(size=32) * rng.choice([0.02, 0.1, 0.15, 0.4]) for _ in range(900)]
    rows = [(i, [float(v) for v in a], int(rng.integers(3))) for i, a in enumerate(x)]
    rows += [(900 + i, rows[i][1], rows[i][2]) for i in range(40)]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 32, 1), (1003, [float("nan")] * 32, 1), (1004, [None, *[1.0] * 31], 1), (1005, rows[0][1], None), (1006, [1e300] * 32, 2), (1007, [2e300] * 32, 2), (1008, [1.0, 2.0], 1)]
    schema = "vec_id long, embedding array<double>, label int, kept string"
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], schema).repartition(4)
    ids = np.array([r[0] for r in rows])
    e = np.array([r[1] for r in rows])
    e /= np.linalg.norm(e, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    links = (e @ e.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(links, False)
    for block, pivots in ((1000, None), (40, 300)):
        got = {r.vec_id: r for r in near_duplicate_vectors(table, block=block, pivots=pivots).collect()}
        assert len(got) == len(rows) + len(odd)
        n = np.array([got[i].n_links for i in ids])
        assert (n <= links.sum(axis=1)).all() and n.sum() >= 0.97 * links.sum() and links.sum() > 500
        for i in ids:
            assert got[i].component_id <= i and got[i].kept == (got[i].component_id == i)
            same = [j for j in ids if got[j].component_id == got[i].component_id]
            assert min(same) == got[i].component_id
        assert all((got[r[0]].n_links, got[r[0]].component_id) == (0, r[0]) for r in odd if r[0] not in (1006, 1007))
        assert got[1007].component_id == 1006 and got[1006].n_links == 1
    few = spark.createDataFrame([(1, [1.0, 0.0, 0.1], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.0, 0.11], 0), (3, [0.0, 1.0, 0.01], 0), (4, [0.0, 0.0, 1.0], 0), (4, [0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(few).collect()) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 4), (4, 1, 4)]
    assert near_duplicate_vectors(table.limit(0)).count() == 0
    assert vectors._cosine(np.ones((1, 2)), np.ones((1, 2)))[0] == pytest.approx(1)


def test_decontamination(spark):
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([3, 5, 8, 15, 30, 60, 40, 200])]
    items += [(20, items[4][1]), (21, None), (22, ""), (23, "a b"), (None, items[5][1])]
    docs, want = [], set()
    for d in range(120):
        w = text(rng.choice([0, 20, 300]))
        if d % 3 == 0:
            i, t = items[d // 3 % 8]
            t = t.split()
            if d % 2 and len(t) >= 13:
                for at in range(rng.randrange(7), len(t), 9):  # a substitution every nine words
                    t[at] = "other"
            if len(t) > 40:
                t = t[5:33]
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in t]
            want.add((d, i))
        docs.append((d, " ".join(w)))
    docs += [(200, None), (201, ""), (None, items[4][1]), (202, " ".join(items[6][1].split()[:8])), docs[3]]
    table = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, seed int")
    got = contaminated(table, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    left = without_contaminated(table, bench)
    assert left.columns == table.columns and sorted(r.doc_id or -1 for r in left.collect()) == sorted(d if d is not None else -1 for d, _ in docs if (d, 0) not in {(x, 0) for x, _ in want})
    assert contaminated(table.limit(0), bench).count() == 0 and contaminated(table, bench.limit(0)).count() == 0


def test_quotations(spark):
    original = "First line here.\nSecond line.\n\nAnother  paragraph of words."
    assert parse(original)[0] == original and parse(None) == ("", [], [])
    rows = [
        (1, 0, "user", original),
        (1, 1, "assistant", "> Another paragraph of WORDS.\n\nI agree."),
        (1, 2, "user", "No quotes at all"),
        (1, 3, "assistant", "Alice wrote:\n> I agree.\n>> Another paragraph of words.\nGood point."),
        (1, 4, "user", "> nothing that was said\nHm."),
        (1, 5, "user", "> no quotes at all\n> > Second line.\nThat one."),
        (1, 6, "user", ">Good point.\nThanks"),
        (2, 0, "user", "> I agree.\nOther conversation"),
        (2, 1, "user", None),
        (2, 2, None, "> Own\nOwn"),
        (None, 3, "user", "> I agree.\nx"),
        (2, 1, "user", None),
    ]
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, path int")
    got = reply_ordered(table).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert {k: r.reply_to for k, r in by.items() if r.reply_to is not None} == {(1, 1): 0, (1, 3): 1, (1, 5): 2, (1, 6): 3}
    assert by[1, 6].path == [0, 1, 3, 6] and by[1, 6].depth == 3 and by[1, 3].n_linked == 2
    assert by[1, 3].formatted == "<|assistant|>\nGood point.\n" and by[2, 1].formatted == "<|user|>\n\n"
    assert [r.turn for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.path)] == [0, 1, 3, 6, 2, 5, 4]
    chain = spark.createDataFrame([(1, i, "user", (f"> message {i - 1}\n" if i else "") + f"message {i}") for i in range(70)], "conv_id long, turn long, role string, text string")
    assert {r.turn: r.depth for r in reply_ordered(chain).collect()} == {i: i for i in range(70)}
    assert reply_ordered(table.limit(0)).count() == 0


def test_a_shared_line_orders_no_rows_anew(spark, monkeypatch):
    """Rows that share a line only stay in their order, however many they are; rows that shared passages fill don't."""
    rng = random.Random(6)
    line, passage = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(n)) for c, n in (("s", 24), ("p", 300)))
    own = lambda i, n: " ".join(f"u{i}.{j}" for j in range(n))
    again, counts = [], ngram_join._counts
    monkeypatch.setattr(ngram_join, "_counts", lambda part, k: again.extend(r.doc_id for r in part.collect()) or counts(part, k))
    rows = [(i, f"{own(i, 200)} {line}") for i in range(30)] + [(30, rows_like := f"{own(0, 198)} {line}"), (31, rows_like + " x")]
    docs = lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows)).collect()}
    assert got == brute_force(rows) and got[31][1] == 0 and again == []
    rows += [(100 + i, f"{own(100 + i, 80)} {passage}") for i in range(15)] + [(200, f"{own(200, 60)} {line} {passage}")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs(rows)).collect()}
    assert got == brute_force(rows) and set(range(100, 115)) & set(again)
