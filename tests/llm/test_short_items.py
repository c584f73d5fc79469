"""Every substitution that verification accepts has a seed that finds it."""

from itertools import combinations

import numpy as np
import pytest

from gridwatch.llm import decontaminate as dc


@pytest.mark.parametrize("n", range(3, 14))
def test_accepted_substitutions_have_seeds(n):
    item = np.random.default_rng(n).integers(1, 1 << 62, n, dtype=np.uint64)
    seeds = {m: dc._seeds(item, m)[: None if m >= 0 else 1] for m in dc._kinds(n)}
    for k in range(n):
        accepted = 0
        for at in combinations(range(n), k):
            doc = item.copy()
            doc[list(at)] += np.uint64(1)
            if dc._agreement(doc.view(np.int64), item.view(np.int64), 0, 13, 0.8)[1]:
                accepted += 1
                assert any((dc._seeds(doc, m)[: len(s)] == s).any() for m, s in seeds.items()), at
        if not accepted:
            break
    assert k == n - (n if n < 8 else -(-8 * n // 10)) + 1


def test_short_item_is_found(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, "x y " + item.replace("zeta", "other", 1) + " z"), (2, item.replace("zeta", "other").replace("beta", "b"))], "doc_id long, text string")
    got = dc.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_equal) for r in got] == [(1, 7, 7)]


def test_items_of_one_or_two_words(spark):
    docs = spark.createDataFrame([(1, "an Xylograph, here"), (2, "two words stand"), (3, "words two stand")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "xylograph"), (8, "two words")], "item_id long, text string")
    assert dc.contaminated(docs, items).count() == 0
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(docs, items, least_words=1).collect()) == [(1, 7), (2, 8)]
