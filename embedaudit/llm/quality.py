"""Quality classifier: a byte-level convolutional network in numpy.

A text is cut into overlapping chunks that cover all of it. Learned filters slide over a chunk's bytes, embedded by a
learned table; a filter's mean rectified response is a chunk's feature. Features are max-pooled (and averaged) over
the chunks and combined by a small layer into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .toxicity import training_rows

#: Size of a byte's embedding, a filter's bytes and step, and filters.
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 6, 10, 5, 32, 24
#: Steps of the filters in a chunk (800 bytes), and between chunks' beginnings.
CHUNK_STEPS, CHUNK_HOP = 160, 80
#: Labelled rows that are fitted at most, of each label.
TRAIN_ROWS = 1_000
#: Bytes of short texts that are worked on at once, and of a long text's pieces.
BLOCK = 1 << 17


class Net:
    """Parameters, all float32; ``forward`` and ``backward`` over several texts at once."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBED, scale=0.5), "filters": normal(WIDTH * EMBED, FILTERS, scale=(WIDTH * EMBED) ** -0.5), "shift": np.zeros(FILTERS, np.float32),
            "mean": np.zeros(2 * FILTERS, np.float32), "spread": np.ones(2 * FILTERS, np.float32),
            "dense": normal(2 * FILTERS, HIDDEN, scale=(2 * FILTERS) ** -0.5), "dense_shift": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, scale=HIDDEN**-0.5), "out_shift": np.zeros(1, np.float32),
        }

    def responses(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes under each filter step (a row each), the rectified responses, and each text's steps."""
        padded = [x.ljust(WIDTH, b"\0") if len(x) < WIDTH else x + b"\0" * (-(len(x) - WIDTH) % STRIDE) for x in texts]
        steps = np.array([(len(x) - WIDTH) // STRIDE + 1 for x in padded])
        data = np.frombuffer(b"".join(padded), np.uint8)
        starts = np.append(0, np.cumsum([len(x) for x in padded]))[:-1]
        at = np.repeat(starts - STRIDE * (np.cumsum(steps) - steps), steps) + STRIDE * np.arange(steps.sum())
        seen = np.lib.stride_tricks.sliding_window_view(data, WIDTH)[at]
        z = self.p["embed"][seen].reshape(len(at), -1) @ self.p["filters"] + self.p["shift"]
        return seen, np.maximum(z, 0, out=z), steps

    @staticmethod
    def chunked(steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last step of each chunk, and its text. Each text ends with a chunk that reaches its end."""
        count = np.maximum(0, -(-(steps - CHUNK_STEPS) // CHUNK_HOP)) + 1
        text = np.repeat(np.arange(len(steps)), count)
        k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        base = (np.cumsum(steps) - steps)[text]
        first = np.maximum(0, np.minimum(k * CHUNK_HOP, steps[text] - CHUNK_STEPS))
        return base + first, base + np.minimum(first + CHUNK_STEPS, steps[text]), text

    def chunks(self, texts: list[bytes]):
        seen, a, steps = self.responses(texts)
        first, last, text = self.chunked(steps)
        sums = np.zeros((len(a) + 1, a.shape[1]))
        np.cumsum(a, 0, out=sums[1:])
        chunk = ((sums[last] - sums[first]) / (last - first)[:, None]).astype(np.float32)
        return seen, a, first, last, text, chunk

    def groups(self, texts: list[bytes]) -> list[tuple[list[bytes], np.ndarray]]:
        """What is worked on at once, and whose text each piece is: all short texts together, a text over BLOCK bytes in
        pieces of whole chunks. A piece ends where its last chunk ends, so pieces have the chunks of the whole."""
        many = BLOCK // STRIDE // CHUNK_HOP
        short = [k for k, x in enumerate(texts) if len(x) <= BLOCK]
        out = [([texts[k] for k in short], np.array(short))] if short else []
        for k, x in enumerate(texts):
            if len(x) > BLOCK:
                steps = -(-(len(x) - WIDTH) // STRIDE) + 1
                chunks = -(-(steps - CHUNK_STEPS) // CHUNK_HOP) + 1
                for first in range(0, chunks, many):
                    last = min(first + many, chunks)
                    end = steps if last == chunks else (last - 1) * CHUNK_HOP + CHUNK_STEPS
                    begin = min(first * CHUNK_HOP, steps - CHUNK_STEPS)
                    out.append(([x[begin * STRIDE : (end - 1) * STRIDE + WIDTH]], np.array([k])))
        return out

    def features(self, texts: list[bytes], kept: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's greatest and mean chunk features, its chunks, and how many of them share the greatest. What a
        single group's backward pass needs is put into ``kept``."""
        most, total = np.full((len(texts), FILTERS), -np.inf, np.float32), np.zeros((len(texts), FILTERS), np.float32)
        count, ties = np.zeros(len(texts), np.float32), np.zeros((len(texts), FILTERS), np.float32)
        groups = self.groups(texts)
        for pieces, owner in groups:
            parts = self.chunks(pieces)
            text, chunk = parts[-2], parts[-1]
            if kept is not None and len(groups) == 1:
                kept.append(parts)
            bounds = np.searchsorted(text, np.arange(len(pieces)))
            top = np.maximum.reduceat(chunk, bounds)
            equal = np.add.reduceat(chunk == top[text], bounds, dtype=np.float32)
            old = most[owner]
            ties[owner] = np.where(top > old, equal, np.where(top == old, ties[owner] + equal, ties[owner]))
            most[owner] = np.maximum(old, top)
            total[owner] += np.add.reduceat(chunk, bounds)
            count[owner] += np.bincount(text, minlength=len(pieces)).astype(np.float32)
        return np.concatenate([most, total / count[:, None]], 1), count, ties

    def head(self, features: np.ndarray):
        p = self.p
        x = (features - p["mean"]) / p["spread"]
        h = np.maximum(x @ p["dense"] + p["dense_shift"], 0)
        return x, h, h @ p["out"] + p["out_shift"][0]

    def score(self, texts: list[bytes]) -> np.ndarray:
        z = self.head(self.features(texts)[0])[2].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def gradient(self, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, g = self.p, {}
        kept: list = []
        features, count, ties = self.features(texts, kept)
        x, h, z = self.head(features)
        dz = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight / len(texts)).astype(np.float32)
        g["out"], g["out_shift"] = h.T @ dz, dz.sum(keepdims=True)
        dh = np.outer(dz, p["out"]) * (h > 0)
        g["dense"], g["dense_shift"] = x.T @ dh, dh.sum(0)
        df = dh @ p["dense"].T / p["spread"]
        dmost, dmean = df[:, :FILTERS], df[:, FILTERS:]
        g |= {"filters": 0.0, "shift": 0.0, "embed": 0.0}
        for pieces, owner in self.groups(texts):
            seen, a, first, last, text, chunk = kept[0] if kept else self.chunks(pieces)
            text = owner[text]
            dchunk = (dmean / count[:, None])[text]
            best = chunk == features[text, :FILTERS]
            dchunk += best * (dmost / np.maximum(ties, 1))[text]
            # a chunk's gradient reaches all its steps: a running sum of what begins and ends
            turn = np.zeros((len(a) + 1, FILTERS), np.float32)
            each = dchunk / (last - first)[:, None].astype(np.float32)
            np.add.at(turn, first, each)
            np.add.at(turn, last, -each)
            da = np.cumsum(turn[:-1], 0, dtype=np.float32) * (a > 0)
            rows = p["embed"][seen].reshape(len(a), -1)
            g["filters"], g["shift"] = g["filters"] + rows.T @ da, g["shift"] + da.sum(0)
            de = (da @ p["filters"].T).reshape(-1, EMBED)
            g["embed"] = g["embed"] + np.stack([np.bincount(seen.ravel(), de[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return g


def fit(texts: list[bytes], labels: np.ndarray, balance: float, passes: int = 14, batch_bytes: int = 120_000, rate: float = 0.01, seed: int = 0) -> Net:
    """A network fitted by Adam. ``balance`` is the weight of a row of label 1, that of label 0 being 1.

    Every text is seen whole in each pass; one longer than a batch is a batch of its own, worked on piece by piece."""
    net, r = Net(seed), np.random.default_rng(seed)
    m, v, k = {n: 0.0 for n in net.p}, {n: 0.0 for n in net.p}, 0
    base = np.concatenate([net.features(texts[a:b])[0] for a, b in bytewords.chunks(texts, batch_bytes)])
    net.p["mean"], net.p["spread"] = base.mean(0), base.std(0) + np.float32(1e-2)
    fixed = ("mean", "spread")
    total = passes * sum(1 for _ in bytewords.chunks(texts, batch_bytes)) + 1
    for _ in range(passes):
        order = r.permutation(len(texts))
        shuffled = [texts[i] for i in order]
        for a, b in bytewords.chunks(shuffled, batch_bytes):
            y = labels[order[a:b]]
            g = net.gradient(shuffled[a:b], y, np.where(y == 1, balance, 1.0))
            k += 1
            pace = rate * max(0.02, 1 - k / total)
            for n, x in g.items():
                if n not in fixed:
                    m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.98 * v[n] + 0.02 * x * x
                    net.p[n] = net.p[n] - (pace * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.98**k)) + 1e-6)).astype(np.float32)
    return net


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS) -> Net | None:
    """A network from at most ``rows`` documents of each label, weighted so that both count as in all labels; None
    without labelled documents."""
    usable = F.lit(True) if usable is None else usable
    texts, y = training_rows(docs, labels, "quality", usable, rows)
    if not len(y):
        return None
    share = {r["quality"]: r["n"] for r in labels.filter(usable & F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    taken = np.bincount(y, minlength=2)
    balance = (share.get(1, 0) / max(taken[1], 1)) / max(share.get(0, 0) / max(taken[0], 1), 1e-9) if taken.min() else 1.0
    return fit(texts, y, float(balance))


def with_quality(df: DataFrame, net: Net | None, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``df`` with ``score`` and ``predicted`` (score >= threshold).

    The whole text is scored, long ones a piece of whole chunks at a time, so memory does not follow them; null counts as empty, which is a chunk of zero
    bytes. Equal texts get equal scores. Without a network every score is 0.5. Columns named as the new ones are
    replaced.
    """
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    at = kept.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            for a, b in bytewords.chunks(texts, BLOCK):
                score = shared.value.score(texts[a:b]) if shared.value else np.full(b - a, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int"])
    return df.select(*kept).mapInArrow(work, schema)
