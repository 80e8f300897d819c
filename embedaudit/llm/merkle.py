"""A Merkle manifest of a dataset: a root for each source, one root over all, and a witness for every row.

Rows become leaves and leaves are appended, in order, to trees whose runs of 16 nodes are hashed to a parent. A
subtree that is still open keeps what is known of its nodes' witnesses; each run that completes above it extends
them. A tree grows in stages: a task appends a block of 4096 nodes, which start at a multiple of 4096, and the roots
of the blocks are appended in the same way by the next stage, until a source has one root; the sources' roots are a
tree of their own. Witnesses then go down the stages: a block's rows get their own siblings and those of their block.
No task holds more than a block, and stages grow with the logarithm of the largest source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import released, written

#: Nodes of a run, and levels and nodes of one stage's block.
RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Siblings of a node and its place among them, run by run upwards; in tables, ``place:siblings`` joined by commas.
Witness = list[tuple[int, bytes]]


def digest(data: bytes) -> bytes:
    """SHA-256 as lowercase hex."""
    return hashlib.sha256(data).hexdigest().encode()


def leaf(fields: list[Column]) -> Column:
    """The leaf of a row: each field as ``length in bytes:value``, or ``-`` where it is null."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in text)), 256)


class Node:
    """A node with its place in its run; ``run`` and ``parent`` are set when that run completes."""

    __slots__ = ("digest", "parent", "place", "run")

    def __init__(self, value: bytes):
        self.digest, self.parent, self.place, self.run = value, None, 0, b""

    def siblings(self) -> bytes:
        """The digests of the run's other nodes."""
        return self.run[: self.place * 64] + self.run[self.place * 64 + 64 :]

    def witness(self) -> Witness:
        """What is known so far, from this node up to the open subtree it is part of."""
        node, out = self, []
        while node.parent is not None:
            out.append((node.place, node.siblings()))
            node = node.parent
        return out


class Frontier:
    """The open runs of a tree of ``levels`` levels; nodes are appended one after another, at any time."""

    def __init__(self, levels: int):
        self.open: list[list[Node]] = [[] for _ in range(levels + 1)]

    def append(self, value: bytes) -> Node:
        node = Node(value)
        self._place(0, node)
        return node

    def _place(self, level: int, node: Node) -> None:
        run = self.open[level]
        node.place = len(run)
        run.append(node)
        if len(run) == RUN and level + 1 < len(self.open):
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run's parent joins the next level; the witnesses of all rows below the run grow by one step."""
        run, self.open[level] = self.open[level], []
        joined = b"".join(x.digest for x in run)
        parent = Node(digest(joined))
        for node in run:
            node.run, node.parent = joined, parent
        self._place(level + 1, parent)

    def root(self) -> bytes:
        """Completes what is open, from below; nothing can be appended after it."""
        for level in range(len(self.open) - 1):
            if self.open[level]:
                self._complete(level)
        return self.open[-1][0].digest


def levels_of(nodes: int) -> int:
    """Levels until one node remains, at most those of a stage."""
    levels = 0
    while nodes > 1 and levels < LEVELS:
        nodes, levels = -(-nodes // RUN), levels + 1
    return levels


def folded(value: bytes, witness: Witness) -> bytes:
    """The root that a node's digest and its witness lead to."""
    for place, others in witness:
        value = digest(others[: place * 64] + value + others[place * 64 :])
    return value


def _told(witness: Witness) -> str:
    return ",".join(f"{place}:{others.decode()}" for place, others in witness)


def _read(witness: str) -> Witness:
    return [(int(place), others.encode()) for place, _, others in (x.partition(":") for x in witness.split(",") if x)]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``key``) with ``index``, from 0 in their order within the key, nulls first, and ``total``, the
    key's rows. Rows are dealt by sampled ranges of key and order, so a key with a third of all rows is many ranges;
    what the ranges before hold of a key is added up over (range, key)."""
    dealt = rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order)
    placed = written(dealt.withColumn("__row", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn("__range", F.shiftright("__row", 33))
    held = placed.groupBy("key", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    whole = Window.partitionBy("key")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = held.select("key", "__range", (before - F.col("__first")).alias("__start"), F.sum("__n").over(whole).alias("total"))
    return placed.join(held, ["key", "__range"]).withColumn("index", F.col("__row") + F.col("__start")).drop("__row", "__range", "__start")


def _appended(table: pa.Table) -> tuple[pa.Table, list[Node], bytes]:
    """A block's rows in order, their nodes and their root."""
    table = table.sort_by("index")
    frontier = Frontier(levels_of(table["total"][0].as_py()))
    nodes = [frontier.append(x.encode()) for x in table["digest"].to_pylist()]
    return table, nodes, frontier.root()


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("index") / BLOCK).cast("long")).groupBy("key", "block")


def grown(nodes: DataFrame) -> list[DataFrame]:
    """The stages of all keys' trees, from ``nodes`` (``key, index, total, digest``) to one node for each key."""

    def root(key: tuple, table: pa.Table) -> pa.Table:
        value, total = _appended(table)[2].decode(), table["total"][0].as_py()
        return pa.table({"key": [key[0].as_py()], "index": [key[1].as_py()], "total": [-(-total // BLOCK)], "digest": [value]})

    stages = [nodes]
    while (stages[-1].agg(F.max("total")).first()[0] or 0) > 1 or len(stages) == 1:
        some = stages[-1].select("key", "index", "total", "digest")
        stages.append(written(_blocks(some).applyInArrow(root, "key string, index long, total long, digest string"), "roots"))
    return stages


def _with_upper(nodes: DataFrame, upper: DataFrame, work, schema: str) -> DataFrame:
    """``work`` over each block of ``nodes`` and the row of ``upper`` (``key, index, top, witness``) of its root."""
    above = upper.select(F.col("key").alias("of"), F.col("index").alias("at"), "top", "witness").groupBy("of", "at")
    return _blocks(nodes).cogroup(above).applyInArrow(work, schema)


def witnessed(nodes: DataFrame, upper: DataFrame) -> DataFrame:
    """``key, index, top, witness`` of each node: its own siblings, then its block's."""

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        table, found, _ = _appended(left)
        above = _read(right["witness"][0].as_py())
        told = [_told(x.witness() + above) for x in found]
        return pa.table({"key": table["key"], "index": table["index"], "top": pa.array([right["top"][0].as_py()] * len(told)), "witness": pa.array(told)})

    return _with_upper(nodes, upper, extend, "key string, index long, top string, witness string")


def _proofs(nodes: list[Node], values: list[bytes], above: Witness) -> Iterator[tuple[str, str]]:
    """For each row the digest of its siblings and the root that its value folds to. What rows of a run share above
    it is put together once, and folded once for each value that reaches it."""
    rest = b"".join(x for _, x in above)
    shared: dict[int, bytes] = {}
    known: dict[tuple[int, bytes], bytes] = {}

    def after(node: Node) -> bytes:
        if node.parent is None:
            return rest
        if (at := id(node)) not in shared:
            shared[at] = node.siblings() + after(node.parent)
        return shared[at]

    def fold(node: Node, value: bytes) -> bytes:
        at = (id(node), value)
        if at not in known:
            known[at] = folded(value, above) if node.parent is None else fold(node.parent, folded(value, [(node.place, node.siblings())]))
        return known[at]

    for node, value in zip(nodes, values, strict=True):
        if node.parent is None:
            yield digest(rest).decode(), folded(value, above).decode()
        else:
            own = node.siblings()
            yield digest(own + after(node.parent)).decode(), fold(node.parent, folded(value, [(node.place, own)])).decode()


def manifest(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, changed: Column | None = None) -> DataFrame:
    """One row per input row: id, ``leaf``, ``subroot`` (its source's root), ``root``, ``proof_sha256`` (of its siblings
    from the leaf's run up to the root's), ``folded_root`` and ``verified``.

    ``changed`` is the text that stands in the place of ``text`` when the row is folded again with its siblings (null
    text stays null); without it rows are folded as they are. Leaves of a source ascend by id, nulls first, then by
    digest, so repeated rows follow each other and each has its own place; a null source is a source of its own and
    comes first. An empty table gives an empty result. Columns other than ``fields`` are not read.
    """
    key = F.coalesce(F.concat(F.lit("~"), F.col(source_col)), F.lit(""))  # in UTF-8 order, null first
    columns = [F.col(c) for c in fields]
    own = leaf(columns)
    other = leaf([F.coalesce(changed, F.col(c)) if c == "text" else F.col(c) for c in fields]) if changed is not None else own
    leaves = written(df.select(key.alias("key"), F.col(id_col).alias("doc_id"), own.alias("digest"), F.nullif(other, own).alias("other")), "leaves")
    placed = written(numbered(leaves, "doc_id", "digest"), "placed")
    released(leaves)
    stages = grown(placed)
    roots = stages[-1].select(F.lit("").alias("key"), F.col("key").alias("name"), F.col("digest"))
    sources = written(numbered(roots, "name"), "sources")
    over = grown(sources)
    last = over[-1].first()
    root = last["digest"] if last else ""
    upper = over[-1].select("key", "index", F.col("digest").alias("top"), F.lit("").alias("witness"))
    for nodes in over[-2::-1]:
        upper = witnessed(nodes, upper)
    # from the sources' tree to their own: each source's root is the one node of its last stage
    found = upper.join(sources.select(F.col("index").alias("__i"), "name", "digest"), F.col("index") == F.col("__i"))
    upper = found.select(F.col("name").alias("key"), F.lit(0).cast("long").alias("index"), F.col("digest").alias("top"), "witness")
    for nodes in stages[-2:0:-1]:
        upper = witnessed(nodes, upper)

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        table, nodes, _ = _appended(left)
        values = [(b or a).encode() for a, b in zip(table["digest"].to_pylist(), table["other"].to_pylist(), strict=True)]
        proofs, folds = zip(*_proofs(nodes, values, _read(right["witness"][0].as_py())), strict=True)
        top = pa.array([right["top"][0].as_py()] * len(nodes))
        return pa.table({"doc_id": table["doc_id"], "leaf": table["digest"], "subroot": top, "proof_sha256": pa.array(proofs), "folded_root": pa.array(folds)})

    kind = df.schema[id_col].dataType.simpleString()
    out = _with_upper(placed, upper, verify, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select(F.col("doc_id").alias(id_col), "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)
