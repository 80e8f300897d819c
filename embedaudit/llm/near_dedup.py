"""MinHash near-dedup by improved consistent weighted sampling (ICWS) over TF-IDF shingles.

1. Document frequencies of all shingles of five words come from :mod:`blocks`, over all documents.
2. A text whose shingles of other documents too (frequency 2 or more) make up less than the threshold of its weight
   can be similar to no other, and is settled.
3. The others draw ICWS samples; bands of four samples are bucket keys.
4. In each bucket all members are compared to its least one by the weighted Jaccard similarity of the whole texts.
   Members of large buckets that are not in the component of that one are compared to a few more members drawn by
   hash, which joins what is left of large groups of copies. Then, so that no link between components is lost, members
   that are still apart are compared to all the bucket's members of other components, whatever the bucket's size.
5. Classes are the connected components of the links.

Pairs whose weights alone rule out the similarity are not compared.

Equal word series are one node, so copies are never compared.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .bytewords import Rolling, chunks, mix, words
from .components import components
from .storage import join_counted, released, written

#: Words of a shingle, least similarity, bands and samples of a band: a pair at the least similarity shares no bucket
#: with a chance of (1 - 0.8**4)**20 = 3e-5, as samples are drawn by the weights that are verified.
SHINGLE, SIMILARITY, BANDS, SAMPLES = 5, 0.8, 20, 4
#: In buckets of more members, members drawn by hash are met first.
SMALL = 32
DRAWN = 4
#: Members of a block in which those of a bucket are compared.
CHUNK = 1000
#: Weight of a shingle in the similarity: occurrences * (1 + IDF_SPAN * ln(N / frequency) / ln N). A small span keeps a
#: large group of near copies similar: with a plain logarithm what they share weighs little and their few differences
#: much.
IDF_SPAN = 0.2
#: Document frequencies are counted for 48 bits of a fingerprint.
_KEY = np.uint64(0xFFFFFFFFFFFF0000)
_ODD = [int(x) | 1 for x in mix(np.arange(1, SHINGLE + 1, dtype=np.uint64), 11)]


def shingles(texts: list[bytes]):
    """Of some texts: each one's node, and rows of (text, shingle, occurrences), sorted by both.

    A text of one to four words is one shingle; one without words has none.
    """
    w = words(texts)
    prints = Rolling(w.data)(w.starts, w.ends)
    count = np.diff(w.first)
    series = np.zeros(len(prints) + 1, np.uint64)
    spread = mix(prints, 3)
    # a node is a fingerprint of the words in order: a polynomial over the words' places
    place = np.arange(len(prints)) - np.repeat(w.first[:-1], count)
    np.cumsum(mix(spread ^ mix(place.astype(np.uint64), 4), 5), out=series[1:])
    node = mix(series[w.first[1:]] - series[w.first[:-1]] + count.astype(np.uint64), 6)
    n = max(len(prints) - SHINGLE + 1, 0)
    code = np.zeros(n, np.uint64)
    for k, odd in enumerate(_ODD):
        code += prints[k : k + n] * np.uint64(odd)
    text = np.repeat(np.arange(len(texts)), count)
    whole = np.flatnonzero(text[:n] == text[SHINGLE - 1 : SHINGLE - 1 + n])
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    owner = np.concatenate([text[whole], short])
    value = np.concatenate([mix(code[whole], 8), mix(node[short], 9)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return node, owner[at], value[at], np.diff(np.append(at, len(owner)))


def _ask(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a block with the number of its documents that have each."""
    found = np.sort(np.concatenate([np.zeros(0, np.uint64), *(shingles(texts[a:b])[2] & _KEY for a, b in chunks(texts))]))
    keys, count = np.unique(found, return_counts=True)
    return keys, count.astype(np.uint32)


def _answer(asks: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    keys, counts = (np.concatenate([a[k] for a in asks]) for k in range(2))
    _, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts).astype(np.uint32)[place]
    return [(x,) for x in np.split(total, np.cumsum([len(a[0]) for a in asks])[:-1])]


def weights(occurrences: np.ndarray, frequency: np.ndarray, documents: int, span: float = IDF_SPAN) -> np.ndarray:
    idf = 1 + span * np.log(documents / frequency) / np.log(max(documents, 2))
    return occurrences * idf


def icws(value: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """Samples of each set (a row each): sets are ranges of ``value`` that begin at ``starts``, none empty.

    Two sets agree in a sample with a chance of their weighted Jaccard similarity: with r, c from Gamma(2, 1) and b
    uniform, drawn from the element and the sample's number, t = floor(ln w / r + b), y = exp(r (t - b)), and the
    element of the least c / (y e^r) is taken with its t.
    """
    log_w = np.log(weight).astype(np.float32)
    sizes = np.diff(np.append(starts, len(value)))
    out = np.empty((len(starts), samples), np.uint64)
    unit = np.float32(2.0**-21)
    low, half = np.uint64((1 << 21) - 1), np.float32(0.5)
    for k in range(samples):
        one, two = mix(value, 2 * k + 101), mix(value, 2 * k + 102)
        u = [((x >> np.uint64(s)) & low).astype(np.float32) for x, s in ((one, 0), (one, 21), (one, 42), (two, 0), (two, 21))]
        r = -np.log((u[0] + half) * unit) - np.log((u[1] + half) * unit)
        c = -np.log((u[3] + half) * unit) - np.log((u[4] + half) * unit)
        b = u[2] * unit
        t = np.floor(log_w / r + b)
        cost = np.log(c) - r * (t - b) - r
        least = np.minimum.reduceat(cost, starts)
        hit = np.flatnonzero(cost == np.repeat(least, sizes))
        at = hit[np.searchsorted(hit, starts)]
        out[:, k] = mix(value[at] ^ mix(t[at].astype(np.int64).view(np.uint64), 12), 13)
    return out


def bands(samples: np.ndarray, per_band: int = SAMPLES) -> np.ndarray:
    """Bucket keys: the samples of a band and its number."""
    keys = np.zeros((len(samples), samples.shape[1] // per_band), np.uint64)
    for k in range(keys.shape[1]):
        for j in range(per_band):
            keys[:, k] = mix(keys[:, k] ^ samples[:, k * per_band + j], 200 + k)
    return keys.view(np.int64)


def _similarity(a: list[np.ndarray], b: list[np.ndarray], weight_a: float, weight_b: float, documents: int, span: float) -> float:
    """Weighted Jaccard similarity of two texts from what each shares with any other document and its whole weight."""
    (va, oa, fa), (vb, ob, _) = a, b
    at = np.searchsorted(vb, va)
    at[at == len(vb)] = 0
    both = np.flatnonzero(vb[at] == va) if len(vb) else np.zeros(0, np.int64)
    common = float(weights(np.minimum(oa[both], ob[at[both]]), fa[both], documents, span).sum())
    total = weight_a + weight_b - common
    return common / total if total > 0 else 1.0


_SIGNED = "node long, ids array<{kind}>, bands array<long>, weight double, shared binary"


def _signed(blocks: DataFrame, documents: int, kind: str, threshold: float, span: float) -> DataFrame:
    """Each block's nodes with the ids of its documents; those that can be similar to another have bands, their whole
    weight and their shingles of frequency 2 or more."""
    answers = B.answered(B.asked(blocks, B.bucket_count(blocks), _ask), _answer)

    def work(_block, texts, told, ids):
        keys = _ask(texts)[0]
        frequency_of = B.told(told, 1)[0] if len(told) else np.zeros(0, np.uint32)
        nodes: dict[int, list] = {}
        rows = {}
        for a, b in chunks(texts):
            node, owner, value, occurrences = shingles(texts[a:b])
            node = node.view(np.int64)
            fresh = np.zeros(b - a, bool)
            for k, x in enumerate(node.tolist()):
                fresh[k] = x not in nodes
                nodes.setdefault(x, []).append(ids[a + k])
            some = fresh[owner]
            owner, value, occurrences = owner[some], value[some], occurrences[some]
            frequency = frequency_of[np.searchsorted(keys, value & _KEY)]
            weight = weights(occurrences, frequency, documents, span)
            whole = np.bincount(owner, weight, b - a)
            shared = np.bincount(owner, weight * (frequency > 1), b - a)
            able = (shared >= threshold * whole * (1 - 1e-9)) & (whole > 0)
            some = able[owner]
            owner, value, occurrences, frequency, weight = (x[some] for x in (owner, value, occurrences, frequency, weight))
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            if not len(starts):
                continue
            keys_of = bands(icws(value, weight, starts, BANDS * SAMPLES))
            for k, (s, e) in enumerate(zip(starts, np.append(starts[1:], len(owner)), strict=True)):
                many = frequency[s:e] > 1
                vector = B.squeezed(value[s:e][many], occurrences[s:e][many].astype(np.uint32), frequency[s:e][many])
                rows[int(node[owner[s]])] = (keys_of[k].tolist(), float(whole[owner[s]]), vector)
        none = (None, None, None)
        return pd.DataFrame([(x, list(v), *rows.get(x, none)) for x, v in nodes.items()], columns=["node", "ids", "bands", "weight", "shared"])

    return B.with_answers(blocks, answers, work, _SIGNED.format(kind=kind))


def _verified(pairs: DataFrame, vectors: DataFrame, documents: int, threshold: float, span: float) -> DataFrame:
    """Pairs (a, b) whose similarity reaches the threshold."""
    left = vectors.select(F.col("node").alias("a"), F.col("weight").alias("weight_a"), F.col("shared").alias("shared_a"))
    right = vectors.select(F.col("node").alias("b"), F.col("weight").alias("weight_b"), F.col("shared").alias("shared_b"))

    def work(batches):
        for batch in batches:
            c = {n: batch.column(n) for n in ("shared_a", "shared_b")}
            wa, wb = batch.column("weight_a").to_pylist(), batch.column("weight_b").to_pylist()
            yes = [_similarity(B.unsqueezed(x.as_py()), B.unsqueezed(y.as_py()), p, q, documents, span) >= threshold - 1e-9 for x, y, p, q in zip(c["shared_a"], c["shared_b"], wa, wb, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").mapInArrow(work, "a long, b long")


def _apart_links(several: DataFrame, vectors: DataFrame, documents: int, threshold: float, span: float) -> DataFrame:
    """Links of members that are apart to members of other components of their buckets.

    A bucket is dealt in blocks: members that ask by members that are asked, each CHUNK at most about. Pairs are
    formed and compared within a block and only links leave it; what they have joined is not compared again there.
    """
    chunks_of = F.ceil(F.col("members") / CHUNK).cast("int")
    home = F.pmod(F.xxhash64("node"), chunks_of).cast("int")
    every = F.explode(F.sequence(F.lit(0), chunks_of - 1))
    base = ["key", "node", "weight", "label", "apart"]
    asks = several.filter("apart").select(*base, home.alias("i"), every.alias("j"), F.lit(True).alias("asks"))
    rows = several.select(*base, every.alias("i"), home.alias("j"), F.lit(False).alias("asks"))
    filled = asks.unionAll(rows).join(vectors.select("node", "shared"), "node")

    def block(group: pd.DataFrame) -> pd.DataFrame:
        rows, links = group[~group["asks"]], []
        if not len(rows):
            return pd.DataFrame(links, columns=["a", "b"])
        weight, node, apart = (rows[c].to_numpy() for c in ("weight", "node", "apart"))
        asked = group[group["asks"]]
        label = np.unique(np.concatenate([rows["label"], asked["label"]]), return_inverse=True)[1]
        # all members' shingles, in their order
        shared = [B.unsqueezed(x)[:2] for x in rows["shared"]]
        value, occurrences = (np.concatenate([x[k] for x in shared]) for k in range(2))
        owner = np.repeat(np.arange(len(rows)), [len(x[0]) for x in shared])
        order = np.argsort(value, kind="stable")
        value, occurrences, owner = value[order], occurrences[order], owner[order]
        for n, x in enumerate(asked.itertuples(), len(rows)):
            able = np.minimum(weight, x.weight) >= np.maximum(weight, x.weight) * threshold * (1 - 1e-9)
            # of two members that both ask, one does
            able &= (label[: len(rows)] != label[n]) & (~apart | (node > x.node))
            if not able.any():
                continue
            v, o, f = B.unsqueezed(x.shared)
            first = np.searchsorted(value, v)
            size = np.searchsorted(value, v, "right") - first
            at = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            least = np.minimum(occurrences[at], np.repeat(o, size))
            common = np.bincount(owner[at], weights(least, np.repeat(f, size), documents, span), len(rows))
            total = weight + x.weight - common
            for k in np.flatnonzero(able & (common >= (threshold - 1e-9) * total)).tolist():
                if label[k] != label[n]:
                    label[label == label[k]] = label[n]
                    links.append((x.node, node[k]))
        return pd.DataFrame(links, columns=["a", "b"])

    return filled.groupBy("key", "i", "j").applyInPandas(block, "a long, b long")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, span: float = IDF_SPAN) -> DataFrame:
    """One row per document: id, ``class_id`` (the least id of its class), ``class_size`` and ``kept`` (one row of
    each class: that of the least id).

    Words are what white space separates, A-Z lower-cased. Equal word series are one class; texts without words
    (empty, null) are one class too. Rows with the same id are documents of their own, of which one is kept; null ids
    count as larger than all, and a class of null ids alone has a null class id. An empty table gives no rows.
    Columns other than id and text are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    blocks = B.stored(df, id_col, text_col)
    documents = blocks.agg(F.sum(F.size("ids"))).first()[0] or 0
    signed = written(_signed(blocks, documents, kind, threshold, span), "signed")
    released(blocks)
    vectors = signed.filter("bands IS NOT NULL").select("node", "weight", "shared").dropDuplicates(["node"])
    member = written(signed.filter("bands IS NOT NULL").select("node", "weight", F.explode("bands").alias("key")).distinct(), "buckets")
    able = F.least("weight_a", "weight_b") >= F.greatest("weight_a", "weight_b") * (threshold * (1 - 1e-9))
    tops = member.groupBy("key").agg(F.min(F.struct("node", "weight")).alias("hub"), F.max("node").alias("top"), F.count("*").alias("members"))
    hubs = tops.filter("hub.node < top").select("key", F.col("hub.node").alias("a"), F.col("hub.weight").alias("weight_a"), "members")
    first = member.withColumnRenamed("weight", "weight_b").join(hubs, "key").filter((F.col("node") != F.col("a")) & able).select("a", F.col("node").alias("b")).distinct()
    links = written(_verified(first, vectors, documents, threshold, span), "links")
    label = written(components(links), "labels")
    # large buckets: what is apart from the least member meets a few others
    drawn = member.groupBy("key").agg(F.count("*").alias("members"), *[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "weight")).alias(f"d{k}") for k in range(DRAWN)])
    drawn = drawn.filter(F.col("members") > SMALL).select("key", F.explode(F.array(*[F.struct(F.col(f"d{k}.node").alias("node"), F.col(f"d{k}.weight").alias("weight")) for k in range(DRAWN)])).alias("d"))
    drawn = drawn.select("key", F.col("d.node").alias("a"), F.col("d.weight").alias("weight_a")).distinct()
    labelled = lambda: member.join(label, "node", "left").select("key", "node", "weight", F.coalesce("label", "node").alias("label"))
    ends = label.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    met = labelled().withColumnRenamed("weight", "weight_b").join(drawn.join(ends, "a", "left").withColumn("label_a", F.coalesce("label_a", "a")), "key")
    met = met.filter((F.col("label") != F.col("label_a")) & able).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    drawn_links = written(_verified(met, vectors, documents, threshold, span), "links")
    old, both = label, links.unionAll(drawn_links)
    label = written(components(both), "labels")
    released(old)
    # buckets of several components
    hub_labels = hubs.join(label, F.col("a") == F.col("node"), "left").select("key", "members", F.coalesce("label", "a").alias("hub_label"))
    several = labelled().join(hub_labels, "key").withColumn("apart", F.col("label") != F.col("hub_label"))
    mixed = several.filter("apart").select("key").distinct()
    several = written(several.join(mixed, "key", "left_semi"), "several")
    more = written(_apart_links(several, vectors, documents, threshold, span), "links")
    final = written(components(both.unionAll(more)), "labels")
    rows = signed.select("node", F.explode("ids").alias("id")).withColumn("row", F.monotonically_increasing_id())
    named = written(rows.join(final, "node", "left").select("id", "row", F.coalesce("label", "node").alias("label")), "named")
    released(signed, member, several, links, drawn_links, more, label, final)
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("row").alias("row")))
    classes = written(named.groupBy("label").agg(best.alias("best"), F.count("*").alias("class_size")), "classes")
    whole = join_counted(named, classes, "label", "class_size", documents)
    return whole.select(F.col("id").alias(id_col), F.col("best.id").alias("class_id"), "class_size", (F.col("row") == F.col("best.row")).alias("kept"))
