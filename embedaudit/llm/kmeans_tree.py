"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; every row is then indexed under its leaf. A query walks the tree with a
priority queue of the branches it has passed by, nearest centre first, and visits leaves in that order. How many is
calibrated: for a bounded set of queries the true neighbours are found by a full scan, and the number of leaves is
widened until their recall reaches the target. Leaves are stored in blocks of neighbouring leaves (a large leaf is
dealt over many), so that a query travels once to each block that it visits, with the leaves it visits there.
"""

from __future__ import annotations

import dataclasses
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .vectors import BLOCK_ROWS, SAMPLE_ROWS, matrix, met, packed, sampled, unpacked, usable

#: Children of a node, rows of the sample below which a node is a leaf, and rounds of k-means.
BRANCHING, LEAF_SAMPLE, ROUNDS = 8, 32, 8
#: Recall to be reached over so many queries of the calibration; leaves visited grow by a quarter until it is.
RECALL, CALIBRATION, WIDER = 0.95, 256, 1.25
_AT_ONCE = 256  # queries that meet a block's rows in one matrix


@dataclasses.dataclass(frozen=True)
class Tree:
    """Node 0 is the root; node i has the children first[i] .. first[i] + count[i] - 1. Leaves are numbered from left
    to right in ``leaf`` (-1 elsewhere)."""

    centers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Each point's cluster, from 0 without gaps. Seeds are drawn by squared distance to those drawn before."""
    centers = points[rng.integers(len(points))][None]
    least = ((points - centers[0]) ** 2).sum(1)
    while len(centers) < k and least.max() > 0:
        centers = np.vstack([centers, points[np.searchsorted(np.cumsum(least), rng.random() * least.sum()).clip(0, len(points) - 1)]])
        least = np.minimum(least, ((points - centers[-1]) ** 2).sum(1))
    for _ in range(ROUNDS):
        own = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)
        kinds, own = np.unique(own, return_inverse=True)
        centers = np.stack([points[own == j].mean(0) for j in range(len(kinds))])
    return own


def fit(points: np.ndarray, branching: int = BRANCHING, leaf_rows: int = LEAF_SAMPLE, seed: int = 7) -> Tree:
    """The tree of a sample; an empty sample gives one leaf. The same sample gives the same tree."""
    rng = np.random.default_rng(seed)
    width = points.shape[1]
    # vectors far apart in size are brought to one scale, which leaves their order by distance as it is
    scale = float(np.abs(points).max()) if len(points) else 0.0
    points = points / scale if scale > 0 else points
    centers, first, count = [points.mean(0) if len(points) else np.zeros(width)], [0], [0]
    todo = [(0, points)]
    for node, inside in todo:  # grows as it is walked
        own = _kmeans(inside, branching, rng) if len(inside) > leaf_rows else np.zeros(len(inside), int)
        kinds = int(own.max()) + 1 if len(own) else 1
        if kinds < 2:
            continue
        first[node], count[node] = len(centers), kinds
        for j in range(kinds):
            part = inside[own == j]
            todo.append((len(centers), part))
            centers.append(part.mean(0))
            first.append(0)
            count.append(0)
    leaf, numbered, stack = np.full(len(centers), -1), 0, [0]
    while stack:
        node = stack.pop()
        if count[node]:
            stack += range(first[node] + count[node] - 1, first[node] - 1, -1)
        else:
            leaf[node], numbered = numbered, numbered + 1
    return Tree(np.array(centers) * (scale if scale > 0 else 1.0), np.array(first), np.array(count), leaf)


def leaf_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """The leaf that each point falls into, by the nearest centre at every level."""
    node = np.zeros(len(points), np.int64)
    while len(open_ := np.flatnonzero(tree.count[node])):
        for at in np.unique(node[open_]):
            some = open_[node[open_] == at]
            kids = tree.centers[tree.first[at] : tree.first[at] + tree.count[at]]
            node[some] = tree.first[at] + (0.5 * (kids**2).sum(1) - points[some] @ kids.T).argmin(1)
    return tree.leaf[node]


def best_bins(tree: Tree, distance: np.ndarray, visits: int, rows: np.ndarray | None = None, least: int = 0) -> list[int]:
    """Leaves in the order of best-bin-first search, given a query's distance to all centres: ``visits`` of them, and
    more until they hold ``least`` of the rows counted in ``rows``."""
    queue, out, seen = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or seen < least):
        node = heapq.heappop(queue)[1]
        while tree.count[node]:
            a, b = tree.first[node], tree.first[node] + tree.count[node]
            near = a + int(distance[a:b].argmin())
            for other in range(a, b):
                if other != near:
                    heapq.heappush(queue, (distance[other], other))
            node = near
        out.append(int(tree.leaf[node]))
        seen += int(rows[out[-1]]) if rows is not None else 0
    return out


def _to_centers(tree: Tree, queries: np.ndarray) -> np.ndarray:
    return (tree.centers**2).sum(1) - 2 * queries @ tree.centers.T + (queries**2).sum(1)[:, None]


def nearest(query: np.ndarray, query_id: int, points: np.ndarray, ids: np.ndarray, rough: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k points nearest to a query (not of its id), ties to smaller ids. ``rough`` holds
    squared distances that are true to ``slack``, infinite where a point is not looked at."""
    rough = np.where(ids == query_id, np.inf, rough)
    kth = np.partition(rough, k - 1)[k - 1] if len(rough) > k else np.inf
    some = np.flatnonzero((rough <= kth + slack) & (rough < np.inf))
    exact = np.sqrt(((points[some] - query) ** 2).sum(1))
    first = np.lexsort((ids[some], exact))[:k]
    return ids[some][first], exact[first]


def _scanned(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, looked: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest of ``points`` for each query; ``looked`` (query x point) says which points it looks at."""
    out = []
    norms, scale = (points**2).sum(1), float(np.abs(points).max(initial=0.0))
    for a in range(0, len(queries), _AT_ONCE):
        some = queries[a : a + _AT_ONCE]
        own = (some**2).sum(1)
        rough = own[:, None] + norms - 2 * some @ points.T
        for i, q in enumerate(some):
            slack = 1e-12 * len(q) * (own[i] + scale * scale * len(q))
            row = rough[i]
            if not np.isfinite(row).all() or not np.isfinite(slack):  # squares beyond doubles: no short cut
                row, slack = np.nan_to_num(((points - q) ** 2).sum(1), posinf=np.finfo(float).max), 0.0
            got, exact = nearest(q, query_ids[a + i], points, ids, row if looked is None else np.where(looked[a + i], row, np.inf), k, slack)
            out.append(pd.DataFrame({"query_id": query_ids[a + i], "vec_id": got, "score": exact}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


@dataclasses.dataclass(frozen=True)
class Index:
    """Every row under its leaf, in blocks; ``leaves``: rows, first block and number of blocks of each leaf."""

    tree: Tree
    rows: DataFrame
    leaves: pd.DataFrame
    width: int


def indexed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS) -> Index:
    """The index of all rows that take part (see :func:`usable`; zero vectors take none). The tree is fitted on at most
    ``sample_rows`` of them, so it has a bounded number of leaves; an empty table gives one empty leaf."""
    rows, width = usable(df, id_col, vector_col, zeros=False)
    tree = fit(sampled(rows, rows.count(), width, sample_rows))

    def assign(batches):
        for batch in batches:
            points = matrix(batch.column("vector"), width)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(leaf_of(tree, points), pa.int32()), packed(points)], ["id", "leaf", "vector"])

    found = written(rows.mapInArrow(assign, "id long, leaf int, vector binary"), "leaves")
    counted = {r["leaf"]: r["count"] for r in found.groupBy("leaf").count().collect()}  # a row for each leaf of the tree
    block, table, filled = 0, [], 0
    for leaf in range(tree.leaves):
        n = counted.get(leaf, 0)
        if filled and filled + n > block_rows:
            block, filled = block + 1, 0
        parts = max(1, -(-n // block_rows))
        table.append((leaf, n, block, parts))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    leaves = pd.DataFrame(table, columns=["leaf", "rows", "block", "parts"])
    places = df.sparkSession.createDataFrame(table, "leaf int, rows long, first int, parts int").select("leaf", "first", "parts")
    turn = F.pmod(F.monotonically_increasing_id(), F.col("parts")).cast("int")  # of a written table: each file has its rows in order
    return Index(tree, found.join(F.broadcast(places), "leaf").select("id", "leaf", "vector", (F.col("first") + turn).alias("block")), leaves, width)


def queried(index: Index, condition: str) -> DataFrame:
    """``query_id, vector, copies`` of the indexed rows that meet a condition on ``id``. Rows that repeat an id are one
    query, with the least of their vectors; ``copies`` counts them."""
    return index.rows.filter(condition).groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"), F.count(F.lit(1)).alias("copies"))


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = RECALL, most: int = CALIBRATION) -> tuple[int, float]:
    """Leaves to visit, and the recall that they reach over at most ``most`` of the queries (those of the least hash):
    the true neighbours are found among all rows, and visits are widened until enough of their leaves are visited."""
    width, tree = index.width, index.tree
    drawn = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(most).toPandas()
    if not len(drawn):
        return 1, 1.0
    ids, vectors = drawn["query_id"].to_numpy(), unpacked(drawn["vector"], width)

    def scan(batches):
        best, leaves = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "leaf": []}), None
        for batch in batches:
            own, points = batch.column("id").to_numpy(), unpacked(batch.column("vector").to_pylist(), width)
            found = _scanned(own, points, ids, vectors, k)
            leaves = pd.Series(batch.column("leaf").to_numpy(), own)
            found["leaf"] = leaves[~leaves.index.duplicated()].reindex(found["vec_id"]).to_numpy()
            best = pd.concat([best, found]).sort_values(["query_id", "score", "vec_id"]).groupby("query_id").head(k)
        if leaves is not None:
            yield pa.RecordBatch.from_pandas(best.astype({"query_id": "int64", "vec_id": "int64", "leaf": "int32"}), preserve_index=False)

    every = index.rows.select("id", "leaf", "vector").mapInArrow(scan, "query_id long, vec_id long, score double, leaf int")
    truth = _ranked(every, k).select("query_id", "leaf").toPandas()  # k rows for each query of the calibration
    distance = dict(zip(ids.tolist(), _to_centers(tree, vectors), strict=True))
    place = []
    for query, leaves in truth.groupby("query_id")["leaf"]:
        order = {leaf: i for i, leaf in enumerate(best_bins(tree, distance[query], tree.leaves))}
        place += [order[leaf] for leaf in leaves]
    place, visits = np.array(place), 1
    while len(place) and (place < visits).mean() < recall:
        visits = int(np.ceil(visits * WIDER)) + 1
    return min(visits, tree.leaves), float((place < visits).mean()) if len(place) else 1.0


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def searched(index: Index, queries: DataFrame, k: int, visits: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found in ``visits`` leaves (in more, while these hold fewer
    than k rows), by Euclidean distance over the original vectors, ties to smaller ids. Rows with the query's id are
    not its neighbours; other rows that repeat an id each count."""
    tree, width, leaves = index.tree, index.width, index.leaves
    counts, first, parts = (leaves[c].to_numpy() for c in ("rows", "block", "parts"))

    def route(batches):
        for batch in batches:
            out = []
            vectors = batch.column("vector").to_pylist()
            distance = _to_centers(tree, unpacked(vectors, width))
            for query, copies, vector, to in zip(batch.column("query_id").to_pylist(), batch.column("copies").to_pylist(), vectors, distance, strict=True):
                bins = np.array(sorted(best_bins(tree, to, visits, counts, k + copies)))
                bins = bins[counts[bins] > 0]
                for block in np.unique(first[bins]):
                    inside = bins[first[bins] == block].astype("<i4")
                    for part in range(parts[inside[0]]):
                        out.append((int(block + part), query, vector, inside.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["block", "query_id", "vector", "leaves"])

    def work(rows: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or visitors.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        kinds, own = np.unique(rows["leaf"].to_numpy(), return_inverse=True)
        looked = np.stack([np.isin(kinds, np.frombuffer(x, "<i4")) for x in visitors["leaves"]])[:, own]
        return _scanned(rows["id"].to_numpy(), unpacked(rows["vector"], width), visitors["query_id"].to_numpy(), unpacked(visitors["vector"], width), k, looked)

    routes = written(queries.mapInArrow(route, "block int, query_id long, vector binary, leaves binary"), "routes")
    found = _ranked(met(index.rows, routes, work, "query_id long, vec_id long, score double"), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbours(df: DataFrame, condition: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest rows of every row whose ``id`` meets ``condition``, at the recall calibrated (see
    :func:`calibrated`, :func:`searched`). An empty table gives an empty result; columns other than the two named are
    not read."""
    index = indexed(df, id_col, vector_col)
    queries = queried(index, condition)
    return searched(index, queries, k, calibrated(index, queries, k, recall)[0])
