"""Exact corpus-wide counts for keys of texts, asked for and answered by blocks of documents.

Texts are stored as blocks: a row holds some MB of texts, compressed together. A block asks once for each of its
distinct keys (64-bit fingerprints) with its own count; questions are dealt by the keys' leading bits to buckets,
each bucket adds up what all blocks ask and answers each in the order of its question. Questions travel as sorted,
difference-coded, compressed arrays: a few bytes a key, where rows would take thirty. A key that many documents
share is one entry for each block, so no key is hot. Blocks and buckets are bounded in bytes, and their numbers grow
with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

#: Bytes of text in a block (one text may be longer), and of text for each bucket of keys.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
_ASK = "block long, bucket int, ask binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers as one compressed value; sorted unsigned ones travel as differences, bytes by their place."""
    out = []
    for x in arrays:
        x = np.ascontiguousarray(x)
        delta = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.diff(x, prepend=x.dtype.type(0)) if delta else x
        planes = np.ascontiguousarray(y.view(np.uint8).reshape(len(y), x.dtype.itemsize).T).tobytes()
        out.append(f"{x.dtype.str} {len(x)} {int(delta)}\n".encode() + planes)
    return zstandard.compress(b"".join(out), 1)


def squeezed_apart(*arrays: np.ndarray) -> bytes:
    """As :func:`squeezed`, but each byte of the numbers is compressed alone, or left as it is where that is shorter:
    smaller for long arrays of mostly random bytes, and slower."""
    out = [b"P"]
    for x in arrays:
        x = np.ascontiguousarray(x)
        delta = x.dtype == np.uint64 and len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.diff(x, prepend=x.dtype.type(0)) if delta else x
        planes = []
        for plane in np.ascontiguousarray(y.view(np.uint8).reshape(len(y), x.dtype.itemsize).T):
            raw = plane.tobytes() if plane.any() else b""
            planes.append(min(raw, zstandard.compress(raw, 1), key=len) if raw else raw)
        out += [f"{x.dtype.str} {len(x)} {int(delta)} {','.join(str(len(p)) for p in planes)}\n".encode(), *planes]
    return b"".join(out)


def _unsqueezed_apart(value: bytes) -> list[np.ndarray]:
    at, out = 1, []
    while at < len(value):
        stop = value.index(b"\n", at)
        kind, n, delta, sizes = value[at:stop].decode().split()
        at, dtype, n = stop + 1, np.dtype(kind), int(n)
        planes = np.zeros((dtype.itemsize, n), np.uint8)
        for plane, size in zip(planes, map(int, sizes.split(",")), strict=True):
            if size:
                raw = value[at : at + size]
                plane[:] = np.frombuffer(raw if size == n else zstandard.decompress(raw), np.uint8)
            at += size
        x = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
        out.append(np.cumsum(x, dtype=dtype) if delta == "1" else x)
    return out


def unsqueezed(value: bytes) -> list[np.ndarray]:
    """The arrays of :func:`squeezed` or :func:`squeezed_apart`."""
    if value[:1] == b"P":
        return _unsqueezed_apart(value)
    data, at, out = zstandard.decompress(value), 0, []
    while at < len(data):
        stop = data.index(b"\n", at)
        kind, n, delta = data[at:stop].decode().split()
        dtype, n = np.dtype(kind), int(n)
        at = stop + 1 + n * dtype.itemsize
        x = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * dtype.itemsize, stop + 1).reshape(dtype.itemsize, n).T).reshape(-1).view(dtype)
        out.append(np.cumsum(x, dtype=dtype) if delta == "1" else x)
    return out


def pack_texts(texts: list[bytes], level: int = 6) -> bytes:
    return zstandard.compress(b"".join([np.array([len(texts), *map(len, texts)], np.int64).tobytes(), *texts]), level)


def unpack_texts(value: bytes) -> list[bytes]:
    data = zstandard.decompress(value)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ends = 8 * (n + 1) + np.append(0, np.cumsum(np.frombuffer(data, np.int64, n, 8)))
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def distinct_pairs(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of both, sorted, and the place of each pair among them."""
    order = np.argsort(keys)
    k, m = keys[order], more[order]
    if ((k[1:] == k[:-1]) & (m[1:] != m[:-1])).any():
        order = np.lexsort((more, keys))
        k, m = keys[order], more[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], m[new], place


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, level: int = 6) -> DataFrame:
    """Blocks of the whole table: ``block, n_bytes, ids, texts``. Null text counts as empty; ids may be null or repeat.
    A block's number is stored with it, so every later step means the same block by it."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            arrays = [pa.array([size], pa.int64()), pa.ListArray.from_arrays([0, sum(map(len, ids))], pa.concat_arrays(ids)), pa.array([pack_texts(texts, level)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["n_bytes", "ids", "texts"])

        for batch in batches:
            values, start = batch.column(1), 0
            for k in range(batch.num_rows):
                text = (values[k].as_py() or "").encode()
                if size and size + len(text) > block_bytes:
                    ids.append(batch.column(0).slice(start, k - start))
                    yield block()
                    ids, texts, size, start = [], [], 0, k
                texts.append(text)
                size += len(text)
            ids.append(batch.column(0).slice(start))
        if texts:
            yield block()

    made = df.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"n_bytes long, ids array<{kind}>, texts binary")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def bucket_count(blocks: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-(blocks.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes))


def bucket_bounds(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's keys begin in sorted 64-bit keys, and the end."""
    limits = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


def asked(blocks: DataFrame, buckets: int, ask: Callable[[list[bytes]], tuple[np.ndarray, ...]]) -> DataFrame:
    """A question of each block to each bucket. ``ask`` gives sorted keys first, other arrays beside them."""

    def rows(batches):
        for batch in batches:
            for block, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, *more = ask(unpack_texts(value.as_py()))
                yield questions(block, buckets, keys, *more)

    return blocks.select("block", "texts").mapInArrow(rows, _ASK)


def questions(block: int, buckets: int, keys: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    at = bucket_bounds(keys, buckets)
    some = np.flatnonzero(np.diff(at)).tolist()
    values = [squeezed(keys[at[b] : at[b + 1]], *(x[at[b] : at[b + 1]] for x in more)) for b in some]
    return pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(values, pa.binary())], ["block", "bucket", "ask"])


def answered(questions: DataFrame, answer: Callable[[list[list[np.ndarray]]], list[tuple[np.ndarray, ...]]]) -> DataFrame:
    """``block, bucket, ask``: what a bucket tells each block. ``answer`` gets the arrays of all questions to a bucket,
    in the order of blocks, and gives arrays for each, in the order of the question's keys."""

    def bucket(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        told = answer([unsqueezed(x) for x in group["ask"]])
        return group.assign(ask=[squeezed(*x) for x in told])

    return questions.groupBy("bucket").applyInPandas(bucket, _ASK)


def told(group: pd.DataFrame, width: int) -> list[np.ndarray]:
    """A block's answers from all buckets, put together in the order of its sorted keys."""
    parts = [unsqueezed(x) for x in group.sort_values("bucket")["ask"]]
    return [np.concatenate([p[k] for p in parts]) for k in range(width)] if parts else []


def with_answers(blocks: DataFrame, answers: DataFrame, work: Callable[[Any, list[bytes], pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """``work(block, texts, answers, ids)`` for every block, once."""
    empty = pd.DataFrame({"block": np.zeros(0, np.int64), "bucket": np.zeros(0, np.int32), "ask": []})

    def one(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        return work(int(row["block"]), unpack_texts(row["texts"]), right if len(right) else empty, row["ids"])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(one, schema)
