"""Best-fit packing of token sequences.

Documents are tokenized where they lie; only pieces without text travel on. They are dealt to groups of many
thousand pieces, and each group is packed best-fit decreasing: a segment tree over remaining capacities finds the
tightest open bin for a piece in logarithmic time. A group is large enough that its last, underfilled bins don't
count, and bounded, so that packing is as wide as the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewords
from .storage import written

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 4096, 1
#: Pieces that are packed together, about.
GROUP_PIECES = 100_000
#: Words that a Python worker keeps with their ids; beyond that it starts anew.
CACHE_WORDS = 1_500_000
_MARK = "\x01"  # no white space, so it is tokenized alone between two words
#: Words to a call of the tokenizer, and bytes of text taken together.
_TOGETHER, _CHUNK = 500, 1 << 20
_PUNCTUATION, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[np.frombuffer(b".,!?;:*#$%&|", np.uint8)] = True
_PLAIN[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
_MOST_PUNCTUATION = 4  # bytes of punctuation at a word's end that are taken off; words with more are whole
_PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long, deal long"


class WordIds:
    """Ids of texts by a tokenizer that drops white space and never joins across it: the ids of a text are those of
    its words, and each word is encoded once. Punctuation at a word's end is a token run of its own.

    Words are known by 64-bit fingerprints in sorted arrays: with CACHE_WORDS kept, a new word is taken for another
    with a chance of 1e-13."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used, self.bounds = np.zeros(1 << 16, np.uint32), 0, np.zeros(1, np.int64)

    def _encode(self, new: list[bytes]) -> list[np.ndarray]:
        """Ids of some words, many to a call; a mark between two words shows where the ids of one end."""
        text = f" {_MARK} ".encode().join(new).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        marks = np.flatnonzero(ids == self.mark[0])
        if len(self.mark) > 1 or len(marks) != len(new) - 1 or "<|" in text or text.count(_MARK) != len(new) - 1:
            parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
            return [np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(x) for x in parts])]
        return [np.delete(ids, marks), np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1]

    def _learn(self, keys: np.ndarray, words: list[bytes]) -> None:
        """Adds words with their (sorted, new) fingerprints."""
        parts = [self._encode(words[k : k + _TOGETHER]) for k in range(0, len(words), _TOGETHER)]
        ids, sizes = (np.concatenate([x[k] for x in parts]) for k in range(2))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, len(self.bounds) - 1 + np.arange(len(keys)))
        self.bounds = np.append(self.bounds, self.used + np.cumsum(sizes))
        self.used += len(ids)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text. Texts in which a special token could be meant go to the tokenizer as they are."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        whole = [k for k, x in enumerate(texts) if b"<|" in x]
        for k in whole:
            out[k] = np.array(self.tokenizer.encode(texts[k].decode(), add_special_tokens=False).ids, np.uint32)
        rest = sorted(set(range(len(texts))) - set(whole))
        for a, b in bytewords.chunks([texts[k] for k in rest], _CHUNK):
            for k, ids in zip(rest[a:b], self._chunk([texts[k] for k in rest[a:b]]), strict=True):
                out[k] = ids
        return out

    def _chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        # A-Z are lower-cased, which the tokenizer does too
        w = bytewords.words(texts)
        starts, ends, cuts = w.starts, w.ends, w.ends.copy()
        for _ in range(_MOST_PUNCTUATION):
            cuts -= _PUNCTUATION[w.data[cuts - 1]] & (cuts - starts > 1)
        split = (cuts < ends) & _PLAIN[w.data[cuts - 1]]
        # a word's end of punctuation follows it as a word of its own
        place = np.flatnonzero(split) + 1
        starts, ends = np.insert(starts, place, cuts[split]), np.insert(np.where(split, cuts, ends), place, ends[split])
        first = w.first + np.append(0, np.cumsum(split))[w.first]
        keys, at, inverse = np.unique(bytewords.Rolling(w.data)(starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        near = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[near] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            data = w.data.tobytes()
            self._learn(keys[new], [data[s:e] for s, e in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        slot = self.slots[np.searchsorted(self.keys, keys)][inverse] if len(keys) else np.zeros(0, np.int64)
        begin, sizes = self.bounds[slot], self.bounds[slot + 1] - self.bounds[slot]
        stops = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(begin - stops[:-1], sizes) + np.arange(stops[-1])]
        return np.split(ids, stops[first[1:-1]]) if len(texts) > 1 else [ids]


_LOADED: dict[str, WordIds] = {}


def _loaded(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _piece_rows(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end: int) -> Iterator[pa.RecordBatch]:
    ids_of, dealt = _loaded(path), 0
    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            part = batch.slice(k, 1024)
            docs, rows = part.column(0), []
            for doc, ids in enumerate(ids_of.encode([(x or "").encode() for x in part.column(1).to_pylist()])):
                whole = np.append(ids, end).astype("<u4")
                for piece, start in enumerate(range(0, len(whole), capacity)):
                    cut = whole[start : start + capacity]
                    rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), dealt))
                    dealt += 1
            doc, piece, start, length, crc, deal = map(list, zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [docs.take(pa.array(doc)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc, deal))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "deal"],
            )


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces of at most ``capacity`` tokens, without text: ``doc_id, piece, start, length, ids_crc32, deal``."""
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lambda it: _piece_rows(it, tokenizer, capacity, end), _PIECES.format(id=kind))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length. The tree's leaves are remaining capacities; a node holds the number of open
    bins below it, so the tightest bin that still fits is found, taken and put back in O(log capacity)."""
    leaves = 1 << capacity.bit_length()
    tree, open_bins = [0] * (2 * leaves), [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0

    def change(room: int, by: int) -> None:
        node = leaves + room
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """The least remaining capacity of at least ``need`` that an open bin has, else -1."""
        node = leaves + need
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:  # first bins to the right of the path upwards
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return -1

    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        room = tightest(need)
        if room < 0:
            bin_, room, made = made, capacity, made + 1
        else:
            bin_ = open_bins[room].pop()
            change(room, -1)
        bins[k], offsets[k] = bin_, capacity - room
        if room > need:
            open_bins[room - need].append(bin_)
            change(room - need, 1)
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: best-fit decreasing within groups of about ``group_pieces``.

    Pieces are dealt to the groups in turn, so groups are even whatever the ids; lengths must be 1 to ``capacity``.
    """
    parts = written(parts.withColumn("dealer", F.spark_partition_id()), "pieces")
    groups = max(1, -(-parts.count() // group_pieces))
    dealt = parts.withColumn("group", ((F.col("deal") + F.col("dealer")) % groups).cast("int"))
    keep = [c for c in parts.columns if c not in ("deal", "dealer")]
    schema = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in keep) + ", sequence_id long, offset long"

    def packed(key: tuple[int], group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(np.int64), capacity)
        return group[keep].assign(sequence_id=bins * groups + int(key[0]), offset=offsets)

    return dealt.groupBy("group").applyInPandas(packed, schema)


def packed_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of a document: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and then id 1; null or empty text is that one id. Documents longer than ``capacity`` are
    cut into full pieces and a last, shorter one; no other is cut. Rows with the same or a null id are documents of
    their own. An empty table gives no rows. Other columns of ``df`` are not read.
    """
    return pack(pieces(df, tokenizer, id_col, text_col, capacity), capacity)
