"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Only the first ``length`` bytes of a suffix count, and only suffixes that agree with another so far go on to the next
digit; what is left after the last digit are exactly the repeated windows. Three digits are taken:

1. A synchronised 32-byte digit. Every window holds 169 grams of 32 bytes; the one with the least fingerprint (the
   first of such) depends on the window alone, so equal windows share it and its place. Neighbouring windows with one
   gram form a run, and a window whose gram no other run has is settled.
2. A run's whole string. Runs with an equal string elsewhere are settled: all their windows repeat. Of equal runs one
   goes on, for the others.
3. The whole window, for windows of runs that share their gram with a different run.

Digits are fingerprints, counted over the whole corpus by :mod:`blocks`: 64 bits for a gram, 64 more for a run with that
gram, 96 for a window. Among 1e14 windows that are compared one is falsely called repeated with a chance of some 6 %.
Runs, windows and copies within one document count.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import blocks as B
from .bytewords import SECOND_BASE, Rolling, chunks, mix

LENGTH, GRAM = 200, 32
#: A long text's windows are taken so many at a time.
PIECE = 1 << 18
#: Bytes of text in a block, and for each bucket of runs.
BLOCK_BYTES, RUN_BUCKET_BYTES = 2 << 20, 32 << 20
_PLACE = 20  # bits for the place of a gram in a piece; its fingerprint's leading bits stand before them
#: Answers: settled and alone; repeated; repeated, and one of its kind for others; open.
ALONE, REPEATED, SHOWN, OPEN = range(4)  # windows of the last two are compared


class Runs(NamedTuple):
    gram: np.ndarray  # fingerprint of each run's gram, mixed: as it is the least of many, its own leading bits are near zero
    string: np.ndarray  # of its whole string and the gram's place in it
    text: np.ndarray  # number of its text in the block
    first: np.ndarray  # first window of the run, as a byte of its text
    count: np.ndarray  # windows


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: of prefixes and suffixes of pieces of that width."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _pieces(texts: list[bytes], length: int):
    """Joined bytes of some texts, or a part of a long one; the text of each, its limits there and place in the text."""
    for a, b in chunks(texts, PIECE):
        if b - a == 1 and len(texts[a]) > 2 * PIECE:
            for start in range(0, len(texts[a]) - length + 1, PIECE):
                part = texts[a][start : start + PIECE + length - 1]
                yield np.frombuffer(part, np.uint8), np.array([a]), np.array([0, len(part)]), start
        else:
            yield np.frombuffer(b"".join(texts[a:b]), np.uint8), np.arange(a, b), np.append(0, np.cumsum([len(x) for x in texts[a:b]])), 0


def runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, windows: bool = False):
    """Runs of all texts, piece by piece; with ``windows``, also each piece's fingerprints of all windows and the first
    window of each run there."""
    width = length - gram + 1
    for data, numbers, limits, base in _pieces(texts, length):
        if len(data) < length:
            continue
        rolling = Rolling(data)
        grams = rolling.fixed(gram)
        place = np.uint64((1 << _PLACE) - 1)
        least = _least(grams & ~place | np.arange(len(grams), dtype=np.uint64), width) & place
        least = least.astype(np.int64)
        n = len(data) - length + 1
        text = np.searchsorted(limits, np.arange(n), "right") - 1
        inside = np.arange(n) + length <= limits[text + 1]
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        starts = np.flatnonzero(change & inside)
        # a run ends where the next begins, or its text has no more windows
        stops = np.minimum(np.append(np.flatnonzero(change), n)[np.searchsorted(np.flatnonzero(change), starts, "right")], limits[text[starts] + 1] - length + 1)
        at = least[starts]
        string = mix(rolling(starts, stops + length - 1) ^ mix((at - starts).astype(np.uint64), 5), 6)
        found = Runs(mix(grams[at], 8), string, numbers[text[starts]], base + starts - limits[text[starts]], stops - starts)
        if windows:
            # the digit of a window has 96 bits: two fingerprints of different bases
            yield found, mix(rolling.fixed(length), 7), (Rolling(data, SECOND_BASE).fixed(length) >> np.uint64(32)).astype(np.uint32), starts
        else:
            yield found


def _joined(parts: list[Runs]) -> Runs:
    if not parts:
        return Runs(*(np.zeros(0, np.uint64),) * 2, *(np.zeros(0, np.int64),) * 3)
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _distinct(gram: np.ndarray, string: np.ndarray):
    """Distinct (gram, string) in order; how many rows each has, and each row's place among them."""
    order = np.lexsort((string, gram))
    g, s = gram[order], string[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1])
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return g[at], s[at], np.diff(np.append(at, len(g))), place


def _ask_runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    found = _joined(list(runs(texts)))
    gram, string, count, _ = _distinct(found.gram, found.string)
    return gram, string, (count > 1).astype(np.uint8)


def _answer_runs(asks: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    sizes = [len(a[0]) for a in asks]
    gram, string, many = (np.concatenate([a[k] for a in asks]) for k in range(3))
    g, _, count, place = _distinct(gram, string)
    total = np.bincount(place, many.astype(np.int64) + 1, len(g))
    # strings of each gram
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    kinds = np.diff(np.append(np.flatnonzero(new), len(g)))[np.cumsum(new) - 1]
    code = np.where(total > 1, REPEATED, np.where(kinds > 1, OPEN, ALONE)).astype(np.uint8)[place]
    # of equal strings among different ones, the first to ask shows its windows to the others
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True
    code[first & (total > 1)[place] & (kinds > 1)[place]] = SHOWN
    return [(x,) for x in np.split(code, np.cumsum(sizes)[:-1])]


def _codes(texts: list[bytes], answers: pd.DataFrame) -> tuple[Runs, np.ndarray]:
    """The block's runs and the answer to each."""
    found = _joined(list(runs(texts)))
    _, _, _, place = _distinct(found.gram, found.string)
    return found, B.told(answers, 1)[0][place] if len(place) else np.zeros(0, np.uint8)


def _open_windows(texts: list[bytes], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints (two arrays) of the windows of open and shown runs, and the run of each, piece by piece."""
    prints, more, owner, start = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
    for part, windows, second, starts in runs(texts, windows=True):
        mine = np.flatnonzero(code[start : start + len(starts)] >= SHOWN)
        count = part.count[mine]
        at = np.repeat(starts[mine] - np.cumsum(count) + count, count) + np.arange(count.sum())
        prints.append(windows[at])
        more.append(second[at])
        owner.append(np.repeat(mine + start, count))
        start += len(starts)
    return np.concatenate(prints), np.concatenate(more), np.concatenate(owner)


def _answer_windows(asks: list[list[np.ndarray]]) -> list[tuple[np.ndarray, ...]]:
    keys, more, counts = (np.concatenate([a[k] for a in asks]) for k in range(3))
    distinct, _, place = B.distinct_pairs(keys, more)
    many = np.bincount(place, counts, len(distinct)) > 1
    return [(x,) for x in np.split(many[place].astype(np.uint8), np.cumsum([len(a[0]) for a in asks])[:-1])]


def _marked(texts: list[bytes], runs_told: pd.DataFrame, windows_told: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All repeated windows of a block: their texts and first bytes."""
    found, code = _codes(texts, runs_told)
    whole = np.flatnonzero((code == REPEATED) | (code == SHOWN))
    count = found.count[whole]
    text = [np.repeat(found.text[whole], count)]
    first = [np.repeat(found.first[whole] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    prints, more, owner = _open_windows(texts, code)
    if len(prints):
        _, _, place = B.distinct_pairs(prints, more)
        yes = B.told(windows_told, 1)[0][place].astype(bool) & (code[owner] == OPEN)
        # windows of a run follow each other in order
        begin = np.flatnonzero(np.diff(owner, prepend=-1))
        within = np.arange(len(owner)) - np.repeat(begin, np.diff(np.append(begin, len(owner))))
        text.append(found.text[owner[yes]])
        first.append(found.first[owner[yes]] + within[yes])
    return np.concatenate(text), np.concatenate(first)


def spans(texts: list[bytes], text: np.ndarray, first: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """Maximal covered ranges of each text, as rows of first byte and end."""
    size = np.array([len(x) for x in texts], np.int64)
    base = np.append(0, np.cumsum(size))
    turn = np.zeros(base[-1] + 1, np.int32)
    np.add.at(turn, base[text] + first, 1)
    np.add.at(turn, base[text] + first + length, -1)
    covered = np.cumsum(turn[:-1]) > 0
    out = []
    for k in range(len(texts)):
        edges = np.flatnonzero(np.diff(covered[base[k] : base[k + 1]], prepend=False, append=False))
        out.append(edges.reshape(-1, 2))
    return out


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``spans`` (byte ranges covered by a 200-byte string that also starts
    elsewhere in the corpus, the same document included) and ``kept``, the other bytes.

    Null text counts as empty. Texts under 200 bytes have no spans. Rows with the same or a null id are documents of
    their own, and copies of each other. Matches never cross documents; all strings are judged on the input. An empty
    table gives no rows. Columns other than id and text are not read.
    """
    blocks = B.stored(df, id_col, text_col, BLOCK_BYTES)
    # runs are some 85 bytes apart, so a bucket of them stands for more text than one of windows
    few, buckets = B.bucket_count(blocks, RUN_BUCKET_BYTES), B.bucket_count(blocks)
    first = B.written(B.answered(B.asked(blocks, few, _ask_runs), _answer_runs), "runs")

    def ask_windows(block, texts, answers, _ids):
        _, code = _codes(texts, answers)
        prints, more, owner = _open_windows(texts, code)
        keys, more, place = B.distinct_pairs(prints, more)
        # one window of a shown run stands for the two or more it has
        count = np.bincount(place, 1 + (code[owner] == SHOWN), len(keys))
        return B.questions(block, buckets, keys, more, np.minimum(count, 2).astype(np.uint8)).to_pandas()

    second = B.answered(B.with_answers(blocks, first, ask_windows, B._ASK), _answer_windows)
    # the windows' answers follow the runs' in one table
    both = first.unionAll(second.selectExpr("block", f"bucket + {few} AS bucket", "ask"))
    kind = df.schema[id_col].dataType.simpleString()

    def result(_block, texts, answers, ids):
        later = answers["bucket"] >= few
        text, start = _marked(texts, answers[~later], answers[later])
        rows = []
        for data, found in zip(texts, spans(texts, text, start), strict=True):
            ends = np.append(0, found.ravel().tolist() + [len(data)]).astype(int).reshape(-1, 2)
            rows.append((len(data), found.tolist(), b"".join(data[a:b] for a, b in ends.tolist())))
        n, ranges, kept = zip(*rows, strict=True)
        return pd.DataFrame({id_col: pd.array(ids, "Int64") if kind == "bigint" else ids, "n_bytes": n, "spans": ranges, "kept": kept})

    return B.with_answers(blocks, both, result, f"`{id_col}` {kind}, n_bytes long, spans array<array<long>>, kept binary")
