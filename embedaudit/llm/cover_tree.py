"""Hard negatives by a cover tree over norm-augmented vectors.

A vector x gets one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that all lie on one sphere and the
inner product with a query q is (|q|^2 + M^2 - d^2) / 2, d being the distance to (q, 0). A node of the tree has a
centre and a covering radius r, so the inner products below it lie between the values at d + r and d - r.

The tree's upper level is a net of centres from a bounded sample; every row belongs to its nearest centre, in blocks
of bounded size, and each block has a cover tree of its own, built once and stored. A query visits the blocks of its
nearest centres first; what it finds there raises the least score it still needs, and only blocks whose bounds meet
one of its windows of scores are visited after that. Within a block nodes are taken best bound first, those outside
all windows are skipped, and leaves are verified with exact integers. Nothing is lost by the bounds.
"""

from __future__ import annotations

import dataclasses
import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .vectors import BLOCK_ROWS, SAMPLE_ROWS, matrix, met, packed, sampled, unpacked, usable

#: Radii fall by this factor from level to level; a node of no more rows is a leaf, and so is one whose rows are so far
#: apart that a level would give it more than a child for each FEWEST of them: bounds would then cost more than scores.
BASE, LEAF_ROWS, FEWEST = 1.5, 32, 4
#: Most centres of the upper level, and centres whose blocks a query visits first.
CENTERS, HOME = 512, 2
_LONG = np.iinfo(np.int64)


def augmented(points: np.ndarray, largest: float) -> np.ndarray:
    """Rows with one more component that brings each to the norm whose square is ``largest``."""
    return np.hstack([points, np.sqrt(np.maximum(largest - (points**2).sum(1), 0.0))[:, None]])


def net(points: np.ndarray, radius: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Centres more than ``radius`` apart that cover all points within it: their rows (the first point comes first), each
    point's centre and distance to it. None if that takes more than ``most`` centres."""
    centers, own = [0], np.zeros(len(points), np.int64)
    distance = np.sqrt(((points - points[0]) ** 2).sum(1))
    while distance[far := int(distance.argmax())] > radius:
        if len(centers) >= most:
            return None
        to = np.sqrt(((points - points[far]) ** 2).sum(1))
        nearer = to < distance
        own[nearer], distance[nearer] = len(centers), to[nearer]
        centers.append(far)
    return np.array(centers), own, distance


@dataclasses.dataclass(frozen=True)
class CoverTree:
    """Rows in the tree's order; node i has rows lo[i] to hi[i], its centre being the first of them, and the children
    first[i] .. first[i] + count[i] - 1 (none: a leaf)."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray


def build(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, largest: float, leaf_rows: int = LEAF_ROWS) -> CoverTree:
    """The cover tree of some rows: level by level, a node's rows go to the nearest centre of a net of a smaller radius."""
    order = np.lexsort(tuple(points.T[::-1]) + (ids,))
    ids, labels, points = ids[order], labels[order], points[order]
    above = augmented(points, largest)
    place = np.arange(len(ids))
    reach = float(np.sqrt(((above - above[0]) ** 2).sum(1).max()))
    lo, hi, first, count, radius = [0], [len(ids)], [0], [0], [reach]
    node = 0
    while node < len(lo):
        a, b = lo[node], hi[node]
        inside = place[a:b]
        split = net(above[inside], radius[node] / BASE, (b - a) // FEWEST) if b - a > leaf_rows and radius[node] > 0 else None
        if split:
            _, own, distance = split
            moved = np.lexsort((distance, own))  # a centre is the first of its rows
            place[a:b] = inside[moved]
            sizes = np.bincount(own)
            first[node], count[node] = len(lo), len(sizes)
            ends = a + np.cumsum(sizes)
            lo += (ends - sizes).tolist()
            hi += ends.tolist()
            first += [0] * len(sizes)
            count += [0] * len(sizes)
            radius += [float(distance[own == j].max()) for j in range(len(sizes))]
        node += 1
    return CoverTree(ids[place], labels[place], points[place], *map(np.array, (lo, hi, first, count, radius)))


def bounds(products: np.ndarray, own: np.ndarray, largest: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries (squared norms ``own``) with what lies within ``radius`` of centres,
    given the products with the centres; a little wider than exact, for rounding."""
    whole = own[:, None] + largest
    distance = np.sqrt(np.maximum(whole - 2 * products, 0.0))
    slack = 1e-9 * whole + 1e-6
    return (whole - (distance + radius) ** 2) / 2 - slack, (whole - np.maximum(distance - radius, 0.0) ** 2) / 2 + slack


def search(tree: CoverTree, low_of: np.ndarray, high_of: np.ndarray, query: np.ndarray, query_id: int, label: int, same: bool, windows: list[list[int]], k: int) -> list[tuple[int, int, int]]:
    """(window, id, score) of the ``k`` best rows in each window [low, high] of scores, ties to smaller ids: rows of the
    query's label (``same``) or of others, not of its id. ``low_of`` and ``high_of`` bound the scores below each node."""
    low, high = [w[0] for w in windows], [w[1] for w in windows]
    best: list[list[tuple[int, int]]] = [[] for _ in windows]
    queue = [(-high_of[0], 0)]
    while queue:
        top, node = heapq.heappop(queue)
        if -top < min(low):
            break  # no node left reaches a window
        if not any(-top >= a and low_of[node] <= b for a, b in zip(low, high, strict=True)):
            continue  # all windows are above or below the node
        if tree.count[node]:
            for child in range(tree.first[node], tree.first[node] + tree.count[node]):
                heapq.heappush(queue, (-high_of[child], child))
            continue
        a, b = tree.lo[node], tree.hi[node]
        scores = tree.points[a:b] @ query
        fit = ((tree.labels[a:b] == label) == same) & (tree.ids[a:b] != query_id)
        for j in range(len(windows)):
            some = np.flatnonzero(fit & (scores >= low[j]) & (scores <= high[j]))
            if len(some) > k:
                kth = np.partition(scores[some], len(some) - k)[len(some) - k]
                some = some[scores[some] >= kth]
            if len(some):
                best[j] = sorted(best[j] + [(-int(s), int(i)) for s, i in zip(scores[some], tree.ids[a + some], strict=True)])[:k]
                if len(best[j]) == k:
                    low[j] = max(low[j], -best[j][-1][0])
    return [(windows[j][1], i, -s) for j, found in enumerate(best) for s, i in found]


@dataclasses.dataclass(frozen=True)
class Index:
    """``rows`` (id, label, vector, block), ``trees`` (block, tree), and the centres with their radius and blocks."""

    rows: DataFrame
    trees: DataFrame
    centers: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    largest: float
    width: int


def indexed(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, component=None, centers: int = CENTERS, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS
) -> Index:
    """The index of all rows that take part (see :func:`usable`; a null label takes none). ``component`` makes a whole
    number of each component. The centres come from a sample of at most ``sample_rows`` rows; there are at most
    ``centers``, and a centre's rows are dealt to as many blocks as they need."""
    marked = df.withColumn("__label", (label if label is not None else F.col("label")).cast("long")).filter("__label IS NOT NULL")
    rows, width = usable(marked, id_col, vector_col, "__label")
    if component is not None:
        rows = rows.withColumn("vector", F.transform("vector", component).cast("array<double>"))
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("largest"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("component")).first()
    if (stats["component"] or 0) ** 2 * width >= 2**52:
        raise ValueError("components are too large for exact scores: width x component squared is to stay below 2 ** 52")
    largest = float(stats["largest"] or 0.0)
    drawn = sampled(rows, stats["n"], width, sample_rows)
    at = augmented(drawn if len(drawn) else np.zeros((1, width)), largest)
    wanted = max(1, min(centers, -(-2 * stats["n"] // block_rows)))
    chosen, distance = [0], np.sqrt(((at - at[0]) ** 2).sum(1))
    while len(chosen) < wanted and distance.max() > 0:  # farthest first: centres cover the sample ever closer
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.sqrt(((at - at[chosen[-1]]) ** 2).sum(1)))
    net_of = at[chosen]

    def assign(batches):
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            above = augmented(points, largest)
            own = (0.5 * (net_of**2).sum(1) - above @ net_of.T).argmin(1)
            reach = np.sqrt(((above - net_of[own]) ** 2).sum(1))
            columns = [batch.column("id"), batch.column("__label"), pa.array(own, pa.int32()), pa.array(reach), packed(points.astype("<i4"))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "center", "reach", "vector"])

    found = written(rows.mapInArrow(assign, "id long, label long, center int, reach double, vector binary"), "centers")
    held = {r["center"]: (r["n"], r["reach"]) for r in found.groupBy("center").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("reach")).collect()}
    counts = np.array([held.get(i, (0, 0.0))[0] for i in range(len(chosen))])
    parts = -(-counts // block_rows)
    first = np.cumsum(parts) - parts
    places = df.sparkSession.createDataFrame([(i, int(a), int(p)) for i, (a, p) in enumerate(zip(first, parts, strict=True))], "center int, first int, parts int")
    turn = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")
    blocks = found.join(F.broadcast(places), "center").select("id", "label", "vector", (F.col("first") + turn).alias("block"))

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = build(part["id"].to_numpy(), part["label"].to_numpy(), unpacked(part["vector"], width, "<i4").astype(float), largest)
        return pd.DataFrame({"block": [key[0]], "tree": [pickle.dumps(dataclasses.replace(tree, points=tree.points.astype("<i4")))]})

    trees = written(blocks.groupBy("block").applyInPandas(grow, "block int, tree binary"), "trees")
    radius = np.array([held.get(i, (0, 0.0))[1] for i in range(len(chosen))])
    return Index(blocks, trees, net_of, radius, first, parts, largest, width)


def anchors(index: Index, condition: str) -> DataFrame:
    """``query_id, label, vector`` of the rows that meet a condition on ``id``; rows that repeat an id are one query, with
    the least of their labels and vectors."""
    least = F.min(F.struct("label", "vector"))
    return index.rows.filter(condition).groupBy(F.col("id").alias("query_id")).agg(least.alias("x")).select("query_id", "x.label", "x.vector")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id", "high").orderBy(F.desc("score"), "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def _visited(index: Index, queries: DataFrame, same: bool, k: int, home: bool) -> DataFrame:
    """``query_id, high, id, score`` found in the blocks of the queries' nearest centres, or in all others whose bounds
    meet one of their windows."""
    width, largest, centers, radius, blocks, parts = index.width, index.largest, index.centers, index.radius, index.first, index.parts

    def route(batches):
        held = np.flatnonzero(parts > 0)
        for batch in batches:
            vectors, out = batch.column("vector").to_pylist(), []
            points = unpacked(vectors, width, "<i4").astype(float)
            products, own = points @ centers[held, :-1].T, (points**2).sum(1)
            low_of, high_of = bounds(products, own, largest, radius[held])
            near = np.argsort(-products, axis=1, kind="stable")[:, :HOME]
            for i, (query, label, vector, windows) in enumerate(zip(batch.column("query_id").to_pylist(), batch.column("label").to_pylist(), vectors, batch.column("windows").to_pylist(), strict=True)):
                meets = np.zeros(len(held), bool)
                for w in windows:
                    meets |= (high_of[i] >= w["low"]) & (low_of[i] <= w["high"])
                first = np.isin(np.arange(len(held)), near[i])
                flat = [x for w in windows for x in (w["low"], w["high"])]
                for c in held[meets & (first if home else ~first)]:
                    out += [(int(blocks[c]) + p, query, label, vector, flat) for p in range(parts[c])]
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "query_id", "label", "vector", "windows"])

    def work(block: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(visitors):
            tree = pickle.loads(block["tree"].iloc[0])
            tree = dataclasses.replace(tree, points=tree.points.astype(float))
            queries = unpacked(visitors["vector"], width, "<i4").astype(float)
            low_of, high_of = bounds(queries @ tree.points[tree.lo].T, (queries**2).sum(1), largest, tree.radius)
            for i, (query, label, flat) in enumerate(zip(visitors["query_id"], visitors["label"], visitors["windows"], strict=True)):
                windows = np.asarray(flat).reshape(-1, 2).tolist()
                out += [(query, *x) for x in search(tree, low_of[i], high_of[i], queries[i], query, label, same, windows, k)]
        return pd.DataFrame(out, columns=["query_id", "high", "id", "score"])

    schema = "query_id long, high long, id long, score long"
    routes = written(queries.mapInArrow(route, "block int, query_id long, label long, vector binary, windows array<long>"), "routes")
    return met(index.trees, routes, work, schema)


def best_in_windows(index: Index, queries: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """``query_id, high, id, score, place``: for each window (``query_id, high, low``) of scores the ``k`` best rows in
    it, of the query's label or of others. Exact: blocks are left out by their bounds alone."""

    def asked(some: DataFrame) -> DataFrame:
        of = some.groupBy("query_id").agg(F.collect_list(F.struct("low", "high")).alias("windows"))  # a window for each positive
        return queries.join(of, "query_id")

    near = written(_ranked(_visited(index, asked(windows), same, k, True), k), "near")
    kth = near.filter(F.col("place") == k).select("query_id", "high", F.col("score").alias("kth"))
    raised = windows.join(kth, ["query_id", "high"], "left").select("query_id", "high", F.greatest("low", "kth").alias("low"))
    rest = _visited(index, asked(raised), same, k, False)
    return _ranked(near.select("query_id", "high", "id", "score").unionByName(rest), k)


def hard_negatives(index: Index, queries: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its first ``positives`` other rows of the same label by inner product, ties to smaller
    ids; for each, the first ``negatives`` rows of other labels whose score is between ``low`` hundredths of the
    positive's score and that score. Fewer are returned where there are fewer; a negative positive score has an empty
    window. Rows with the anchor's id are neither.
    """
    every = queries.select("query_id", F.lit(int(_LONG.max)).alias("high"), F.lit(int(_LONG.min)).alias("low"))
    kin = best_in_windows(index, queries, every, True, positives)
    kin = written(kin.select("query_id", F.col("id").alias("positive_id"), F.col("score").alias("high"), F.col("place").alias("of")), "positives")
    floor = F.floor(F.lit(low) * F.col("high") / 100).cast("long")  # then exactly: the quotient was rounded
    floor = F.when(floor * 100 < F.lit(low) * F.col("high"), floor + 1).otherwise(floor)
    windows = written(kin.filter("high >= 0").select("query_id", "high", floor.alias("low")).distinct(), "windows")
    found = best_in_windows(index, queries, windows, False, negatives)
    joined = kin.join(found, ["query_id", "high"])
    return joined.select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        F.col("high").alias("positive_score"), F.col("score").alias("negative_score"),
    )
