"""Operators on vectors against brute force, on small tables with odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedaudit.llm import cover_tree, kmeans_tree

SCHEMA = "vec_id long, embedding array<float>, label int"


def _vectors(spark, n, width=8, groups=5, seed=3, extra=()):
    rng = np.random.default_rng(seed)
    near = rng.normal(size=(groups, width))
    points = (near[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, width))).astype(np.float32)
    rows = [(i, x.tolist(), int(i % 4)) for i, x in enumerate(points)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


ODD = [
    (1000, None, 1), (1100, [], 1), (1200, [None] + [0.5] * 7, 2), (1300, [math.nan] + [0.5] * 7, 2), (1400, [math.inf] + [0.5] * 7, 2), (1500, [0.0] * 8, 3),
    (1600, [1.0] * 3, 3), (None, [0.5] * 8, 3), (1700, [0.25] * 8, 1), (1700, [0.25] * 8, 1), (1701, [0.25] * 8, 1), (1702, [0.25] * 8, None), (1800, [-0.25] * 8, None),
]


@pytest.fixture(scope="module")
def some(spark):
    d = _vectors(spark, 600, extra=ODD)
    for c in ("id", "vector", "leaf", "block", "query_id", "rank", "score", "width", "count"):
        d = d.withColumn(c, F.lit("clash"))
    return d.cache()


def _usable(df, zeros):
    out = []
    for r in df.select("vec_id", "embedding", "label").collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v)):
            out.append((r["vec_id"], np.array(v, float), r["label"]))
    return out


def _nearest(rows, every, k):
    want = {}
    for q, v, _ in rows:
        if q % every == 0:
            want[q] = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x, _ in rows if i != q)[:k]
    return want


def test_kmeans_tree_with_all_leaves_is_brute_force(some):
    index = kmeans_tree.indexed(some, sample_rows=200, block_rows=64)
    assert index.tree.leaves > 5 and index.rows.count() == len(_usable(some, False))
    queries = kmeans_tree.queried(index, "id % 20 = 0")
    got = {}
    for r in kmeans_tree.searched(index, queries, 7, index.tree.leaves).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = _nearest(_usable(some, False), 20, 7)
    assert {q: [i for _, i in x] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert all(abs(a - b) < 1e-12 for q in want for (a, _), (b, _) in zip(got[q], want[q], strict=True))


def test_kmeans_tree_reaches_its_recall(spark):
    many = _vectors(spark, 3000, width=16, groups=40)
    index = kmeans_tree.indexed(many)
    queries = kmeans_tree.queried(index, "id % 20 = 0")
    visits, recall = kmeans_tree.calibrated(index, queries, 10)
    assert recall >= kmeans_tree.RECALL and visits < index.tree.leaves
    got = {}
    for r in kmeans_tree.searched(index, queries, 10, visits).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = [(r[0], np.array(r[1], float), r[2]) for r in many.collect()]
    want = _nearest(rows, 20, 10)
    hits = sum(len(got[q] & {i for _, i in x}) for q, x in want.items())
    assert hits >= 0.9 * 10 * len(want) and all(len(x) == 10 for x in got.values())


def test_kmeans_tree_of_few_and_of_equal_rows(spark):
    few = spark.createDataFrame([(100, [1.0, 2.0], 0), (101, [1.0, 2.0], 0), (7, [3.0, 2.0], 0)], SCHEMA)
    got = [tuple(r) for r in kmeans_tree.neighbours(few, "id % 100 = 0").orderBy("rank").collect()]
    assert got == [(100, 1, 101, 0.0), (100, 2, 7, 2.0)]
    assert kmeans_tree.neighbours(few.limit(0), "id % 100 = 0").count() == 0
    equal = spark.range(500).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    got = kmeans_tree.neighbours(equal, "id % 100 = 0").orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == list(range(1, 11)) and len(got) == 50


def test_best_bins_go_by_distance():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(400, 4))
    tree = kmeans_tree.fit(points, leaf_rows=10)
    own = kmeans_tree.leaf_of(tree, points)
    assert sorted(set(own.tolist())) == list(range(tree.leaves))
    for q in points[:5]:
        to = ((tree.centers - q) ** 2).sum(1)
        order = kmeans_tree.best_bins(tree, to, tree.leaves)
        assert sorted(order) == list(range(tree.leaves)) and order[0] == kmeans_tree.leaf_of(tree, q[None])[0]
        assert kmeans_tree.best_bins(tree, to, 3) == order[:3]
        assert len(kmeans_tree.best_bins(tree, to, 1, np.bincount(own), 50)) > 1


def _hard(rows, every=20, positives=5, negatives=5):
    rows = [(i, np.floor(256 * v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows if label is not None]
    out = []
    for a, q, label in rows:
        if a % every:
            continue
        scores = sorted((-int(v @ q), i, other) for i, v, other in rows if i != a)
        for p, i, _ in [s for s in scores if s[2] == label][:positives]:
            fit = [s for s in scores if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fit[:negatives])]
    return sorted(out)


def _mined(df, every=20, **bounds):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = cover_tree.indexed(df, label=label, component=lambda x: F.floor(256 * x), **bounds)
    got = cover_tree.hard_negatives(index, cover_tree.anchors(index, f"id % {every} = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def test_hard_negatives_are_brute_force(spark):
    odd = [r for r in ODD if r[0] != 1700] + [(1700, [0.25] * 8, 1), (2000, [0.0] * 8, 1), (2020, [-3.0] * 8, 2), (2040, [2.0] * 8, 77), (2041, [2.0] * 8, 2)]
    some = _vectors(spark, 600, extra=odd)
    for c in ("id", "vector", "block", "query_id", "rank", "score", "high", "low", "tree", "windows", "center", "place"):
        some = some.withColumn(c, F.lit("clash"))
    got = _mined(some, centers=8, block_rows=64, sample_rows=100)
    assert got == _hard(_usable(some, True)) and len(got) > 100
    assert got == _mined(some)  # other centres and blocks, same rows


def test_hard_negatives_of_copies_few_and_none(spark):
    rows = [(i, [1.0, 0.5], i % 3) for i in range(300)] + [(300 + i, [0.9, 0.1 * (i % 4)], i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA)
    want = _hard([(i, np.array(np.float32(v), float), label) for i, v, label in rows])
    assert _mined(d, block_rows=32) == want
    assert _mined(d.limit(1)) == [] and _mined(d.limit(0)) == []
    with pytest.raises(ValueError, match="too large"):
        _mined(spark.createDataFrame([(0, [1e9, 1.0], 1)], SCHEMA))


def test_cover_tree_covers():
    rng = np.random.default_rng(5)
    points = np.vstack([np.round(40 * rng.normal(size=6) + 6 * rng.normal(size=(60, 6))) for _ in range(8)])
    largest = float((points**2).sum(1).max())
    tree = cover_tree.build(np.arange(len(points)), np.zeros(len(points)), points, largest)
    above = cover_tree.augmented(tree.points, largest)
    assert (tree.count > 0).sum() > 1 and sorted(tree.ids.tolist()) == list(range(len(points)))
    queries = rng.normal(size=(5, 6)) * 30
    low, high = cover_tree.bounds(queries @ tree.points[tree.lo].T, (queries**2).sum(1), largest, tree.radius)
    for node in range(len(tree.lo)):
        a, b = tree.lo[node], tree.hi[node]
        assert np.sqrt(((above[a:b] - above[a]) ** 2).sum(1)).max() <= tree.radius[node] + 1e-6
        scores = queries @ tree.points[a:b].T
        assert (scores.max(1) <= high[:, node]).all() and (scores.min(1) >= low[:, node]).all()
        kids = range(tree.first[node], tree.first[node] + tree.count[node])
        assert sum(tree.hi[j] - tree.lo[j] for j in kids) in (0, b - a)
