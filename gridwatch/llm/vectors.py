"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``depth`` nearest of the reference points, in order of nearness. There are about twice as
many of these as the square root of the number of vectors (a power of two, from 64 to ``MOST_PIVOTS``), so that lists grow with that root
too; they come from a sample of that size (distinct vectors in hash order; directions drawn
from a fixed seed fill up a dimension with fewer). Every vector is indexed: it stands in the inverted lists
of its first ``depth - shared + 1`` reference points by number, so two vectors with ``shared`` common ones
meet in a list. Lists are dealt out in blocks of about ``block`` entries, and a task takes two blocks of one
list: it counts the common reference points of all their pairs from the incidence of the descriptors,
takes those with at least ``shared`` whose first common point is this list's, and verifies them by cosine in
double precision. Only sums of links and, for each vector, its smallest neighbour in the block's components
leave a task, never the pairs. Equal vectors of a label are one entry that carries their number.

Vectors link only within equal non-null labels and equal dimension. Vectors that are null, empty, all zero,
or hold null or non-finite components link with nothing, as do null labels. Rows that repeat a vec_id are
taken as vectors of their own, with links of their own, and one component. Other columns are ignored; an empty table gives an empty
result. The recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components


#: Reference points at most: what is broadcast.
MOST_PIVOTS = 1 << 15


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _references(vectors: DataFrame, n: int, seed: int) -> dict[int, np.ndarray]:
    """Unit reference points for each dimension in the sample, which holds at most ``n`` vectors."""
    rows = vectors.orderBy(F.xxhash64("entry", F.lit(seed)), "entry").limit(n).select("vector").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: _unit(np.concatenate([np.array(v, dtype=float), _drawn(d, n - len(v), seed)])) for d, v in out.items()}


def _drawn(dimension: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dimension]).standard_normal((n, dimension))


def near_duplicate_vectors(rows: DataFrame, threshold: float = 0.98, pivots: int | None = None, depth: int = 8, shared: int = 3, block: int = 1000, seed: int = 7) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = rows.sparkSession
    given = rows.select(rows["vec_id"].cast("bigint").alias("vec_id"), rows["embedding"].cast("array<double>").alias("vector"), rows["label"].cast("string").alias("label"))
    sound = given.where("vec_id is not null and label is not null and size(vector) > 0").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    # numbers of distinct vectors: they stay as they are, as the table is written before it is used
    entries = stored(sound.groupBy("label", "vector").agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies")).withColumn("entry", F.monotonically_increasing_id()), "entries")
    if pivots is None:
        pivots = min(MOST_PIVOTS, max(64, 1 << int(np.ceil(np.log2(2 * max(entries.count(), 1) ** 0.5)))))
    shared_refs = spark.sparkContext.broadcast(_references(entries, pivots, seed))
    keep = depth - shared + 1

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, part in b.groupby(b["vector"].map(len)):
                refs = shared_refs.value.get(d)
                refs = _unit(_drawn(d, pivots, seed)) if refs is None else refs
                near = np.argsort(-(_unit(np.stack(part["vector"].to_numpy())) @ refs.T), axis=1, kind="stable")[:, :depth]
                yield part.assign(near=list(near.astype(np.int32)), lists=list(np.sort(near, axis=1)[:, :keep].astype(np.int32)))

    described = entries.select("label", "vector", "entry", "copies").mapInPandas(describe, "label string, vector array<double>, entry bigint, copies bigint, near array<int>, lists array<int>")
    listed = stored(described.select("label", F.size("vector").alias("dim"), "entry", "copies", "vector", "near", F.explode("lists").alias("pivot")), "lists")
    sizes = listed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = stored(sizes, "list-sizes")
    dealt = listed.join(sizes, ["label", "dim", "pivot"]).withColumn("own", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int"))
    # an entry goes to every pair of blocks that its own block is in
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")

    def verify(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _, _, pivot, i, j = key
        a, b = part[part["own"] == i], part[part["own"] == j]
        ia, ib, early = _incidence(a["near"], b["near"], pivot)
        xa, xb = (np.stack(x["vector"].to_numpy()) if len(x) else np.zeros((0, key[1])) for x in (a, b))
        hits = (ia @ ib.T >= shared) & (ia[:, :early] @ ib[:, :early].T == 0)
        if i == j:
            np.fill_diagonal(hits, False)
        p, q = np.nonzero(hits)
        good = np.concatenate([_cosine(xa[p[s : s + 50_000]], xb[q[s : s + 50_000]]) for s in range(0, len(p), 50_000)] or [np.zeros(0)]) >= threshold
        p, q = p[good], q[good]
        ids = np.concatenate([a["entry"].to_numpy(), b["entry"].to_numpy()]) if i != j else a["entry"].to_numpy()
        n = np.concatenate([a["copies"].to_numpy(), b["copies"].to_numpy()]) if i != j else a["copies"].to_numpy()
        if i != j:
            q = q + len(a)
            p, q = np.concatenate([p, q]), np.concatenate([q, p])
        links = np.bincount(p, weights=n[q], minlength=len(ids)).astype(np.int64)
        low = ids.copy()
        while len(p):
            new = low.copy()
            np.minimum.at(new, p, low[q])
            if np.array_equal(new, low):
                break
            low = new
        some = links > 0
        return pd.DataFrame({"entry": ids[some], "low": low[some], "links": links[some]})

    found = dealt.groupBy("label", "dim", "pivot", "i", "j").applyInPandas(verify, "entry bigint, low bigint, links bigint")
    found = stored(found, "found")
    # a vec_id that repeats with several vectors ties their components together
    ids = stored(sound.join(entries.select("label", "vector", "entry"), ["label", "vector"]).select("vec_id", "entry"), "ids")
    several = ids.groupBy("vec_id").agg(F.min("entry").alias("a"), F.max("entry").alias("b")).where("a <> b").select("vec_id", "a")
    ties = ids.join(several, "vec_id").select("a", F.col("entry").alias("b"))
    labels = components(found.select(F.col("entry").alias("a"), F.col("low").alias("b")).union(ties).where("a <> b"))
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    whole = entries.select("entry", "low_id", "copies").join(links, "entry", "left").join(labels, F.col("entry") == F.col("node"), "left")
    whole = stored(whole.select("entry", "low_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "entry").alias("component")), "by-entry")
    lowest = whole.groupBy("component").agg(F.min("low_id").alias("component_id"))
    out = ids.join(whole.join(lowest, "component").select("entry", "n_links", "component_id"), "entry").select("vec_id", "n_links", "component_id")
    rest = given.where("vec_id is null").select("vec_id").unionAll(
        given.where("vec_id is not null").where(
            ~F.coalesce((F.size("vector") > 0) & F.col("label").isNotNull() & F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("vector", lambda x: F.coalesce(x != 0, F.lit(False))), F.lit(False))
        ).select("vec_id")
    )
    out = out.unionByName(rest.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _incidence(a: pd.Series, b: pd.Series, pivot: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Which of the reference points in use, by number, each vector of both blocks has, and how many come before ``pivot``."""
    near = [np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1), dtype=np.int32) for x in (a, b)]
    used = np.unique(np.concatenate([x.ravel() for x in near]))
    out = []
    for x in near:
        m = np.zeros((len(x), len(used)), dtype=np.float32)
        np.put_along_axis(m, np.searchsorted(used, x), 1, axis=1)
        out.append(m)
    return *out, int(np.searchsorted(used, pivot))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


SQL = """with recursive
v as (select vec_id, label, embedding::double[] as e from embeddings),
fit as (select * from v where label is not null and e is not null and not list_contains(list_transform(e, lambda x: x is null or not isfinite(x)), true) and list_contains(list_transform(e, lambda x: x <> 0), true)),
links as (select distinct a.vec_id as a, b.vec_id as b from fit a join fit b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
lowest as (select a, min(b) as low from reached group by a),
counted as (select a, count(*) as n from links group by a)
select v.vec_id, coalesce(n, 0) as n_links, least(v.vec_id, coalesce(low, v.vec_id)) as component_id, v.vec_id = least(v.vec_id, coalesce(low, v.vec_id)) as kept
from v left join counted c on v.vec_id = c.a left join lowest l on v.vec_id = l.a"""
