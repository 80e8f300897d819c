"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is a series of tokens: words, each ended by a space, then one end. Counts are pretrained on all training
documents, and code lengths are found in two parts.

The longest context of a token is all bytes of the two tokens before it (as a fingerprint of 40 bits; a token that
follows is known by 40 bits beside it). If it is known
and has been followed by this token, the token is coded there as a whole; if it is known and has not, an escape is
coded (method C: as likely as the number of distinct followers). Below it is a trie of byte contexts within the token
(at most ``ORDER`` bytes back, the token's beginning included): each node counts the bytes that follow. A byte is
coded in the longest known context; if that has not seen it, an escape leads to the next shorter context, where the
bytes of the longer one are excluded. (Tokens of the longest context are not excluded below: that would need the sum
of their byte codes. So probabilities add up to somewhat less than 1, never more.)

What the trie gives a token depends on the token alone, so each distinct word is coded once, where its counts meet,
and documents add up what :mod:`blocks` tells them. The trie itself is dealt by the last two bytes of its contexts:
where words' counts meet, they ask these buckets for the nodes and contexts of their steps. Only contexts of at most
one byte, 65,536 counts at most, are known everywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .bytewords import Rolling, chunks, mix, words
from .storage import written

#: Bytes of the longest context.
ORDER = 5
#: Symbols: bytes but the six that separate words, the end of a word and the end of a text.
SYMBOLS = 256 - 6 + 2
SPACE, END = 0x20, 0x0A
_END_KEY = np.uint64(0x0A0A0A0A0A0A0A0A)
_SYM, _TAG = np.uint64(8), np.uint64(8 * (ORDER + 1))


def held_out(ids, modulus: int = 7, rest: int = 2) -> np.ndarray:
    """Documents that are not learnt from: crc32 of the id as text has this remainder. A null id is learnt from."""
    return np.array([i is not None and i == i and zlib.crc32(str(int(i)).encode()) % modulus == rest for i in ids], bool)


class Tokens:
    """Distinct tokens, sorted by fingerprint, as bytes with their last symbol, and a count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.keys, self.counts, self.sizes, self.data = keys, counts, sizes, data

    def part(self, a: int, b: int) -> Tokens:
        ends = np.append(0, np.cumsum(self.sizes, dtype=np.int64))
        return Tokens(self.keys[a:b], self.counts[a:b], self.sizes[a:b], self.data[ends[a] : ends[b]])

    def packed(self) -> bytes:
        """Counts and bytes alone: sizes and fingerprints follow from the bytes, as only a token's last symbol separates."""
        return B.squeezed_apart(self.counts, self.data)

    @staticmethod
    def unpacked(value: bytes, keyed: bool = False) -> Tokens:
        """Tokens in the order they were packed in; fingerprints are all 0 unless asked for."""
        counts, data = B.unsqueezed(value)
        ends = np.flatnonzero((data == SPACE) | (data == END))
        starts = np.append(0, ends + 1)[:-1]
        keys = np.where(data[ends] == END, _END_KEY, Rolling(data)(starts, ends)) if keyed else np.zeros(len(ends), np.uint64)
        return Tokens(keys, counts, (ends - starts + 1).astype(np.uint32), data)

    @staticmethod
    def merged(parts: list[Tokens]) -> tuple[Tokens, np.ndarray]:
        """One set of all, and the place of each part's tokens in it."""
        keys = np.concatenate([p.keys for p in parts])
        sizes = np.concatenate([p.sizes for p in parts]).astype(np.int64)
        data = np.concatenate([p.data for p in parts])
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(place, np.concatenate([p.counts for p in parts]), len(distinct)).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        return Tokens(distinct, counts, sizes[first].astype(np.uint32), _ragged(data, begins[first], sizes[first])), place


def _ragged(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return data[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _token_keys(texts: list[bytes]):
    """Of some texts: words with their fingerprints."""
    w = words(texts)
    return w, Rolling(w.data)(w.starts, w.ends)


def tokens(texts: list[bytes], training: np.ndarray) -> Tokens:
    """All distinct tokens of a block; only training documents count."""
    ends = int(training.sum())
    parts = [Tokens(np.array([_END_KEY]), np.array([ends]), np.array([1], np.uint32), np.array([END], np.uint8))]
    for a, b in chunks(texts):
        w, keys = _token_keys(texts[a:b])
        learnt = np.repeat(training[a:b], np.diff(w.first))
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        sizes = w.ends[first] - w.starts[first] + 1  # each word's separator is made a space
        data = _ragged(w.data, w.starts[first], sizes)
        data[np.cumsum(sizes) - 1] = SPACE
        parts.append(Tokens(distinct, np.bincount(place, learnt, len(distinct)).astype(np.int64), sizes.astype(np.uint32), data))
    return Tokens.merged(parts)[0]


def _steps(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The code of every symbol of every token, and its token: the longest context and the symbol as one number.

    Its lowest byte is the symbol, before it are up to ORDER bytes of context (the token's beginning is a space), and
    the bits above hold their number."""
    sizes = t.sizes.astype(np.int64)
    token = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = t.data.astype(np.uint64)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(code), np.uint64)
        before[back:] = t.data[:-back] if back <= len(t.data) else 0
        before = np.where(place >= back, before, np.where(place == back - 1, np.uint64(SPACE), np.uint64(0)))
        code |= before << np.uint64(8 * back)
    order = np.minimum(place + 1, ORDER).astype(np.uint64)
    return code | order << _TAG, token


def _shorter(code: np.ndarray) -> np.ndarray:
    """Codes with a context one byte shorter; of order 1 and more."""
    order = code >> _TAG
    keep = (np.uint64(1) << (np.uint64(8) * order)) - np.uint64(1)
    return code & keep | (order - np.uint64(1)) << _TAG


def _node_counts(t: Tokens, every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all orders and their counts; with ``every``, those of tokens that do not count too."""
    code, token = _steps(t)
    some = (t.counts[token] > 0) | every
    code, count = code[some], t.counts[token[some]]
    kept = []
    order = code >> _TAG
    for k in range(ORDER, -1, -1):
        # the codes of order k: those whose longest context it is, and the longer ones cut
        mine = order == k
        distinct, place = np.unique(code[mine], return_inverse=True)
        total = np.bincount(place, count[mine], len(distinct)).astype(np.int64)
        kept.append((distinct, total))
        if k:
            code = np.concatenate([code[~mine], _shorter(distinct)])
            count = np.concatenate([count[~mine], total])
            order = code >> _TAG
    keys, counts = (np.concatenate([x[i] for x in kept]) for i in range(2))
    at = np.argsort(keys)
    return keys[at], counts[at]


class Trie:
    """Nodes as sorted codes; for each, and for each context, what coding needs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys = keys
        context = keys >> _SYM
        at = np.flatnonzero(np.diff(context, prepend=~context[:1])) if len(keys) else np.zeros(0, np.int64)
        self.contexts = context[at]
        self.node_count = counts.astype(np.float64)
        total, kinds = np.add.reduceat(counts, at).astype(np.float64) if len(at) else np.zeros(0), np.diff(np.append(at, len(keys))).astype(np.float64)
        self.total, self.kinds = total, kinds
        # for each context: what its symbols make up in the next shorter one
        deep = (keys >> _TAG) > 0
        excluded = np.zeros(len(keys))
        excluded[deep] = counts[np.minimum(np.searchsorted(keys, _shorter(keys[deep])), len(keys) - 1)]
        self.shadow = np.add.reduceat(excluded, at) if len(at) else np.zeros(0)

    @classmethod
    def part(cls, low: Trie, keys: np.ndarray, counts: np.ndarray, contexts: np.ndarray, total: np.ndarray, kinds: np.ndarray, shadow: np.ndarray) -> Trie:
        """What some steps need: all of ``low``, and sorted codes and contexts of more than one byte (0: there is none)."""
        out, node, known = cls.__new__(cls), counts > 0, total > 0
        out.keys, out.node_count = np.append(low.keys, keys[node]), np.append(low.node_count, counts[node])
        out.contexts, out.total = np.append(low.contexts, contexts[known]), np.append(low.total, total[known])
        out.kinds, out.shadow = np.append(low.kinds, kinds[known]), np.append(low.shadow, shadow[known])
        return out

    def _find(self, table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        if not len(table):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return np.where(table[at] == wanted, at, -1)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """Log probability of each code's symbol in its context."""
        out, todo = np.zeros(len(code)), np.arange(len(code))
        above = np.full(len(code), -1)  # the context whose symbols are excluded
        code = code.copy()
        for k in range(ORDER, -1, -1):
            mine = todo[(code[todo] >> _TAG) == k]
            node, context = self._find(self.keys, code[mine]), self._find(self.contexts, code[mine] >> _SYM)
            known = context >= 0
            child = above[mine]
            less = np.where(child >= 0, self.shadow[child], 0.0) if len(self.shadow) else np.zeros(len(mine))
            fewer = np.where(child >= 0, self.kinds[child], 0.0) if len(self.kinds) else np.zeros(len(mine))
            total = np.where(known, self.total[context] - less, 0.0) if len(self.total) else np.zeros(len(mine))
            kinds = np.where(known, self.kinds[context] - fewer, 0.0) if len(self.total) else np.zeros(len(mine))
            hit = node >= 0
            out[mine[hit]] += np.log10(self.node_count[node[hit]] / (total[hit] + kinds[hit]))
            missed = ~hit & known & (total > 0)
            out[mine[missed]] += np.log10(kinds[missed] / (total[missed] + kinds[missed]))
            rest = mine[~hit]
            above[rest] = context[~hit]
            if k == 0:
                left = SYMBOLS - np.where(known[~hit], self.kinds[context[~hit]] if len(self.kinds) else 0, 0)
                out[rest] -= np.log10(np.maximum(left, 1))
            else:
                code[rest] = _shorter(code[rest])
            todo = np.setdiff1d(todo, mine[hit], assume_unique=True)
        return out

    def token_scores(self, t: Tokens) -> np.ndarray:
        code, token = _steps(t)
        distinct, place = np.unique(code, return_inverse=True)
        return np.bincount(token, self.log10(distinct)[place], len(t.sizes))


def _ask_tokens(blocks: DataFrame, buckets: int, training: Callable[[list], np.ndarray]) -> DataFrame:
    def rows(batches):
        for batch in batches:
            for block, ids, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                t = tokens(B.unpack_texts(value.as_py()), training(ids.as_py()))
                at = B.bucket_bounds(t.keys, buckets)
                some = np.flatnonzero(np.diff(at)).tolist()
                asks = [t.part(at[b], at[b + 1]).packed() for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(asks, pa.binary())], ["block", "bucket", "ask"])

    return blocks.select("block", "ids", "texts").mapInArrow(rows, B._ASK)


def _followed(texts: list[bytes]):
    """Of some texts: the fingerprints of all tokens, the number of each text's tokens, and for each token a key of its
    longest context (40 bits) and itself (24 bits), and 16 more bits of itself."""
    w, prints = _token_keys(texts)
    series = np.insert(prints, w.first[1:], _END_KEY)
    count = np.diff(w.first) + 1
    place = np.arange(len(series)) - np.repeat(np.cumsum(count) - count, count)
    before = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint64), series[:-k]])[: len(series)], np.uint64(0)) for k in (1, 2)]
    context, token = mix(mix(before[0], 21) ^ before[1], 22), mix(series, 23)
    return series, count, context >> np.uint64(24) << np.uint64(24) | token >> np.uint64(40), (token >> np.uint64(24)).astype(np.uint16)


def _packed_pairs(keys: np.ndarray, more: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted pairs as each context once with the number of its tokens, then 24 and 16 bits of each token."""
    context = keys >> np.uint64(24)
    at = np.flatnonzero(np.diff(context, prepend=~context[:1]))
    return B.squeezed_apart(context[at], np.diff(np.append(at, len(keys))).astype(np.uint32), (keys & np.uint64(0xFFFFFF)).astype(np.uint32), more, counts)


def _unpacked_pairs(context: np.ndarray, size: np.ndarray, token: np.ndarray, *beside: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.repeat(context << np.uint64(24), size) | token, *beside


def _by_value(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, frequent ones first, and the place of each number among them, in as few bytes as hold it."""
    distinct, place, count = np.unique(x, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.min_scalar_type(max(len(order) - 1, 0)))
    rank[order] = np.arange(len(order))
    return distinct[order], rank[place]


def _ask_followed(blocks: DataFrame, buckets: int, training: Callable[[list], np.ndarray]) -> DataFrame:
    """Distinct (context, token) of each block, with how often training documents have them."""

    def rows(batches):
        for batch in batches:
            for block, ids, value in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                texts, learnt, parts = B.unpack_texts(value.as_py()), training(ids.as_py()), []
                for a, b in chunks(texts):
                    _, count, keys, more = _followed(texts[a:b])
                    keys, more, place = B.distinct_pairs(keys, more)
                    parts.append((keys, more, np.bincount(place, np.repeat(learnt[a:b], count), len(keys))))
                keys, more, place = B.distinct_pairs(*(np.concatenate([p[k] for p in parts]) for k in range(2)))
                counts = np.bincount(place, np.concatenate([p[2] for p in parts]), len(keys)).astype(np.uint32)
                at = B.bucket_bounds(keys, buckets)
                some = np.flatnonzero(np.diff(at)).tolist()
                asks = [_packed_pairs(*(x[at[b] : at[b + 1]] for x in (keys, more, counts))) for b in some]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(asks, pa.binary())], ["block", "bucket", "ask"])

    return blocks.select("block", "ids", "texts").mapInArrow(rows, B._ASK)


def _answer_followed(asks: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    """For each key: log10 of the token in its context (below 0), or of the escape with its sign turned (0 for an unknown
    context), by distinct values."""
    pairs = [_unpacked_pairs(*a) for a in asks]
    keys, more, counts = (np.concatenate([a[k] for a in pairs]) for k in range(3))
    distinct, _, place = B.distinct_pairs(keys, more)
    follower = np.bincount(place, counts, len(distinct))
    context = distinct >> np.uint64(24)
    at = np.flatnonzero(np.diff(context, prepend=~context[:1]))
    size = np.diff(np.append(at, len(distinct)))
    total = np.repeat(np.add.reduceat(follower, at), size)
    kinds = np.repeat(np.add.reduceat((follower > 0).astype(np.float64), at), size)
    hit = follower > 0
    share = np.where(hit, follower, np.where(total > 0, kinds, 1.0)) / np.where(total > 0, total + kinds, 1.0)
    told = np.log10(share).astype(np.float32)
    told = np.where(hit, told, -told)[place]
    return [_by_value(x) for x in np.split(told, np.cumsum([len(a[0]) for a in pairs])[:-1])]


def _vocabulary(questions: DataFrame) -> DataFrame:
    """A row for each bucket: its tokens, the place of each block's tokens among them, and the training tokens' number."""

    def bucket(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        parts = [Tokens.unpacked(x, keyed=True) for x in group["ask"]]
        t, place = Tokens.merged(parts)
        cuts = np.split(place.astype(np.uint32), np.cumsum([len(p.keys) for p in parts])[:-1])
        places = [B.squeezed(x.astype(np.uint64)) for x in cuts]
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "tokens": [t.packed()], "blocks": [group["block"].tolist()], "places": [places], "n": [int(t.counts.sum())], "v": [int((t.counts > 0).sum())]})

    return questions.groupBy("bucket").applyInPandas(bucket, "bucket int, tokens binary, blocks array<long>, places array<binary>, n long, v long")


def _low_nodes(vocabulary: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of no and one byte of context, with their counts: 65,792 at most, whatever the input."""

    def rows(batches):
        for batch in batches:
            total = np.zeros(1 << 16, np.int64)
            for value in batch.column(0):
                t = Tokens.unpacked(value.as_py())
                code, token = _steps(t)
                np.add.at(total, (code & np.uint64(0xFFFF)).astype(np.int64), t.counts[token])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["code", "n"])

    total = np.zeros(1 << 16, np.int64)
    for r in vocabulary.select("tokens").mapInArrow(rows, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        total[r["code"]] = r["n"]
    none, one = total.reshape(256, 256).sum(0), np.flatnonzero(total)
    at = np.flatnonzero(none)
    return np.append(at.astype(np.uint64), one.astype(np.uint64) | np.uint64(1) << _TAG), np.append(none[at], total[one])


def _deep_codes(t: Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of two bytes of context and more, their counts and buckets. A context's bucket depends on its last two
    bytes, so that shorter contexts lie where the longer ones do."""
    keys, counts = _node_counts(t, every=True)
    deep = keys >> _TAG > 1
    keys, counts = keys[deep], counts[deep]
    return keys, counts, (mix(keys >> _SYM & np.uint64(0xFFFF), 24) % np.uint64(buckets)).astype(np.int64)


def _by_home(home: np.ndarray):
    """Each bucket with the places of its codes, in their order."""
    order = np.argsort(home, kind="stable")
    at = np.flatnonzero(np.diff(home[order], prepend=-1))
    return [(int(home[x[0]]), x) for x in np.split(order, at[1:])] if len(home) else []


def _low_scores(vocabulary: DataFrame, buckets: int) -> DataFrame:
    """``block, bucket, ask``: what the trie gives the tokens of each block, and how often training documents have them."""
    low = _low_nodes(vocabulary)

    def asks(batches):
        for batch in batches:
            for bucket, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, counts, home = _deep_codes(Tokens.unpacked(value.as_py()), buckets)
                for b, at in _by_home(home):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([b], pa.int32()), pa.array([B.squeezed(keys[at], counts[at])], pa.binary())], ["block", "bucket", "ask"])

    def answer(asked):
        keys, place = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([a[1] for a in asked]), len(keys)).astype(np.int64)
        some = counts > 0
        model = Trie(np.append(low[0], keys[some]), np.append(low[1], counts[some]))
        told = []
        for (mine, _), at in zip(asked, np.split(place, np.cumsum([len(a[0]) for a in asked])[:-1]), strict=True):
            context = model._find(model.contexts, np.unique(mine >> _SYM))
            of = [np.where(context >= 0, x[context], 0).astype(np.int64) for x in (model.total, model.kinds, model.shadow)] if len(model.contexts) else [np.zeros(len(context), np.int64)] * 3
            told.append((counts[at], *of))
        return told

    answers = B.answered(vocabulary.select("bucket", "tokens").mapInArrow(asks, B._ASK), answer)

    def reply(_bucket, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        t = Tokens.unpacked(row["tokens"])
        keys, _, home = _deep_codes(t, buckets)
        told = {int(b): B.unsqueezed(x) for b, x in zip(right["bucket"], right["ask"], strict=True)}
        counts, parts = np.zeros(len(keys), np.int64), [[np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3]]
        for b, at in _by_home(home):
            counts[at] = told[b][0]
            parts.append([np.unique(keys[at] >> _SYM), *told[b][1:]])
        contexts, *of = (np.concatenate([x[k] for x in parts]) for k in range(4))
        at = np.argsort(contexts)
        model = Trie.part(Trie(*low), keys, counts, contexts[at], *(x[at] for x in of))
        score = model.token_scores(t).astype(np.float32)
        places = [B.unsqueezed(x)[0].astype(np.int64) for x in row["places"]]
        return pd.DataFrame({"block": row["blocks"], "bucket": row["bucket"], "ask": [B.squeezed_apart(score[x], t.counts[x]) for x in places]})

    home = vocabulary.select("bucket", "tokens", "blocks", "places").groupBy(F.col("bucket").cast("long").alias("of"))
    return home.cogroup(answers.groupBy(F.col("block").alias("of"))).applyInPandas(reply, B._ASK)


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", training: Callable[[list], np.ndarray] | None = None) -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``score`` is the model's log10 probability of the whole text, A-Z lower-cased; ``base_score`` that of a unigram
    model with one added to each count and one unseen kind. ``training`` says of ids which documents are learnt from
    (default: all but those :func:`held_out`). Null and empty texts are one end token. Rows with the same or a null
    id are documents of their own. Without training documents all symbols are equally likely. An empty table gives no
    rows. Columns other than id and text are not read.
    """
    training = training or (lambda ids: ~held_out(ids))
    blocks = B.stored(df, id_col, text_col, level=12)
    buckets = B.bucket_count(blocks)
    vocabulary = written(_vocabulary(_ask_tokens(blocks, buckets, training)), "vocabulary")
    sums = vocabulary.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    answers = _low_scores(vocabulary, max(1, buckets // 4))
    followed = B.answered(_ask_followed(blocks, buckets, training), _answer_followed)
    both = answers.unionAll(followed.selectExpr("block", f"bucket + {buckets} AS bucket", "ask"))
    kind = df.schema[id_col].dataType.simpleString()

    def result(_block, texts, told, ids):
        parts = [_followed(texts[a:b]) for a, b in chunks(texts)]
        series, count, keys, more = (np.concatenate([p[k] for p in parts]) for k in range(4))
        later = told["bucket"] >= buckets
        low, known = B.told(told[~later], 2)
        top = np.concatenate([value[at] for value, at in map(B.unsqueezed, told[later].sort_values("bucket")["ask"])])
        token = np.searchsorted(np.unique(np.append(series, _END_KEY)), series)
        pair = B.distinct_pairs(keys, more)[2]
        begins = np.cumsum(count) - count
        summed = lambda x: np.add.reduceat(x.astype(np.float64), begins)
        return pd.DataFrame({
            id_col: pd.array(ids, "Int64") if kind == "bigint" else ids, "held_out": ~training(ids), "n_tokens": count, "n_known": summed(known[token] > 0).astype(np.int64),
            "train_tokens": n, "base_score": summed(np.log10((known[token] + 1.0) / (n + v + 1.0))), "score": summed(-np.abs(top[pair]) + np.where(top[pair] < 0, 0, low[token])),
        })

    return B.with_answers(blocks, both, result, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
