"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence is a bag of hashed words and word beginnings with a logistic score; a document is toxic if any sentence
is, so its probability is the noisy-or 1 - prod(1 - p). The weights are trained from document labels through that
formula, and then locate the offending sentences of any text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytewords

#: Weights of the model; the size of what is sent to executors (4 bytes each).
DIMENSION = 1 << 18
#: Labelled rows that are fitted at most, of each label; the rows with the least hash of their id are taken.
TRAIN_ROWS = 2_500
#: Bytes of each label's texts that are fitted at most.
TRAIN_BYTES = 32 << 20
#: Word beginnings that are features beside whole words, in bytes.
PREFIXES = (3, 4, 5, 6)
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,!?;:\"'()[]{}|*#$%&<>"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its features (a row each) and sentence; of each sentence: its text and first byte in it.

    A sentence ends with ``. ! ?`` or a line's end; each text starts one, an empty text too.
    """
    w = bytewords.words(texts)
    stop = _STOP[w.data]
    limits = np.append(0, np.cumsum([len(x) + 1 for x in texts]))
    ends = np.unique(np.concatenate([np.flatnonzero(stop) + 1, limits]))
    begins = ends[:-1]
    # sentences without a word are dropped, but each text keeps its first
    has = np.diff(np.searchsorted(w.starts, ends)) > 0
    has |= np.isin(begins, limits[:-1])
    begins = begins[has]
    text = np.searchsorted(limits, begins, "right") - 1
    sentence = np.searchsorted(begins, w.starts, "right") - 1
    # punctuation at a word's ends is no part of it
    edge = _EDGE[w.data]
    inner = np.flatnonzero(~edge & ~np.isin(w.data, (9, 10, 11, 12, 13, 32)))
    if not len(inner):
        return np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64), text, begins - limits[text]
    first = inner[np.minimum(np.searchsorted(inner, w.starts), len(inner) - 1)]
    last = inner[np.maximum(np.searchsorted(inner, w.ends) - 1, 0)] + 1
    real = (first < w.ends) & (last > first) & (first >= w.starts)
    first, last, sentence = first[real], last[real], sentence[real]
    print_of = bytewords.Rolling(w.data)
    rows = [print_of(first, last)]
    for n in PREFIXES:
        rows.append(np.where(last - first > n, bytewords.mix(print_of(first, np.minimum(first + n, last)), n), np.uint64(0)))
    # a word that is too short for a beginning gets feature 0, which is kept free of weight
    features = (np.stack(rows, 1) >> np.uint64(64 - DIMENSION.bit_length() + 1)).astype(np.int64)
    return features, sentence, text, begins - limits[text]


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0) + np.log1p(np.exp(-np.abs(x)))


def fit(texts: list[bytes], labels: np.ndarray, passes: int = 120, rate: float = 0.15, decay: float = 1.0, z_least: float = 4.5) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of sentence scores likeliest, by Adam over all documents with L2 decay.

    Only features that toxic documents have more often than others, by ``z_least`` standard errors, get a weight; of n
    documents at most half of what n can reach (its square root), so that few documents are fitted too.
    """
    weights, bias, y = np.zeros(DIMENSION), -4.0, labels.astype(bool)
    # which features a document has; chunks hold whole documents
    with_it = np.zeros((2, DIMENSION))
    for a, b in bytewords.chunks(texts):
        features, sentence, text, _ = sentences(texts[a:b])
        pairs = np.unique((text[sentence] * DIMENSION)[:, None] + features)
        for side in (0, 1):
            with_it[side] += np.bincount(pairs[y[a + pairs // DIMENSION] == side] % DIMENSION, minlength=DIMENSION)
    n = np.maximum(np.array([(~y).sum(), y.sum()]), 1)
    rates, both = with_it / n[:, None], with_it.sum(0) / n.sum()
    z_score = (rates[1] - rates[0]) / np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n).sum())
    z_least = min(z_least, np.sqrt(n.sum()) / 2)
    used = np.flatnonzero((z_score > z_least) & (np.arange(DIMENSION) > 0))
    slot = np.zeros(DIMENSION, np.int64)  # 0: a feature without weight
    slot[used] = np.arange(1, len(used) + 1)
    # of the rest only what has a weight is kept
    feature, owner, text, first = [], [], [], 0
    for a, b in bytewords.chunks(texts):
        features, sentence, mine, _ = sentences(texts[a:b])
        at = slot[features]
        row, column = np.nonzero(at)
        feature.append(at[row, column])
        owner.append(sentence[row] + first)
        text.append(mine + a)
        first += len(mine)
    feature, owner, text = map(np.concatenate, (feature, owner, text))
    w, m, v, mb, vb = np.zeros(len(used) + 1), np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.0, 0.0
    for k in range(1, passes + 1):
        z = bias + np.bincount(owner, w[feature], len(text))
        total = np.bincount(text, _softplus(z), len(y))
        slope = np.where(y, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-9), 1.0)
        g = slope[text] / (1 + np.exp(-np.clip(z, -50, 50)))
        gw, gb = np.bincount(feature, g[owner], len(w)) + decay * w, g.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        a, b = 1 - 0.9**k, 1 - 0.99**k
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    weights[used] = w[1:]
    return weights.astype(np.float32), float(bias)


def scored(texts: list[bytes], model: tuple[np.ndarray, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; of each sentence its probability, text and first byte."""
    features, sentence, text, begins = sentences(texts)
    z = model[1] + np.bincount(sentence, model[0][features].sum(1), len(text))
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    return -np.expm1(-np.bincount(text, _softplus(z), len(texts))), p, text, begins


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, each: int, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_BYTES):
    """Texts and labels, at most ``each`` rows of label 1 and of 0: those with the least hash of their id, as far as
    ``most`` bytes of each label hold whole texts; those over a 64th of that come last.

    ``usable`` says of the labels' rows which may be learnt from. Ids with several labels count by the largest.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & usable).groupBy(F.col(id_col).alias("__id")).agg(F.max(label).alias("__y"))
    order = [F.xxhash64("__id"), "__id"]
    chosen = known.filter("__y = 1").orderBy(*order).limit(each).unionAll(known.filter("__y = 0").orderBy(*order).limit(each))
    rows = docs.select(F.col(id_col).alias("__doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # the chosen labels are bounded; ids that repeat among the documents give one text
    found = rows.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min(F.struct("t", "__y")).alias("r")).select("__id", "r.*")
    size = F.octet_length("t")
    so_far = F.sum(size).over(Window.partitionBy("__y").orderBy(size > most // 64, *order))  # at most ``each`` rows
    got = sorted((r["__id"], r["t"], r["__y"]) for r in found.withColumn("__bytes", so_far).filter(F.col("__bytes") <= most).collect())
    return [t.encode() for _, t, _ in got], np.array([y for _, _, y in got])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, rows: int = TRAIN_ROWS):
    """A model from at most ``rows`` documents of each label; without a labelled document it scores all alike."""
    texts, y = training_rows(docs, labels, "toxic", F.lit(True) if usable is None else usable, rows)
    return fit(texts, y) if len(y) else (np.zeros(DIMENSION, np.float32), -4.0)


def with_toxicity(df: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with ``score``, ``predicted`` (score >= threshold) and ``offending``: sentences with p >= threshold
    as first byte and probability.

    The whole text is scored; null counts as empty and gets the score of an empty sentence. Equal texts get equal
    scores. Columns named as the new ones are replaced.
    """
    new = ["score", "predicted", "offending"]
    kept = [c for c in df.columns if c not in new]
    at = kept.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("p", pa.float64())]))

    def work(batches):
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(at).to_pylist()]
            for a, b in bytewords.chunks(texts):
                score, p, text, begins = scored(texts[a:b], shared.value)
                found: list[list] = [[] for _ in range(b - a)]
                for k in np.flatnonzero(p >= threshold).tolist():
                    found[text[k]].append({"start": int(begins[k]), "p": float(p[k])})
                columns = batch.slice(a, b - a).columns
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(found, span)], [*kept, *new])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "score double, predicted int, offending array<struct<start:int,p:double>>"])
    return df.select(*kept).mapInArrow(work, schema)
