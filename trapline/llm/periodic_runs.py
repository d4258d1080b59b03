"""Periodic runs of words: long stretches that repeat with a period, found exactly in each whole text.

Words are what blanks (20, 09-0D) separate. A run of period q is a stretch of words that are identical q words apart, at least
``max(LEAST, TIMES * q)`` long, that no neighbouring word extends, where q is the smallest period of the stretch.

A run of period q holds at least ``max(LEAST - q, (TIMES - 1) * q)`` neighbouring places whose word returns q words later. So for each q
the places of a grid with that step are compared with the words q later, which is a harmonic sum of places over all q. A place whose
neighbourhood matches too asks for its longest common extension with the place q words later in both directions. That comes from a
difference cover: only the suffixes that begin at places of the cover modulo V are sorted, any two places reach sampled ones by the same
shift of less than V words, and a sparse table of range minima over the sorted suffixes gives the rest in one step.

Null and empty texts have no words, no runs and an empty ``collapsed``. Rows of equal or null ids are judged each for itself. Other
columns of the input play no part. A task holds some 200 bytes for each word of its longest text.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.words import row_slices, utf8

#: Least length of a run in words, and in periods.
LEAST, TIMES = 24, 3
#: Bytes of texts that are searched together.
CHUNK_BYTES = 1_500_000
#: Places of the grid that are compared at once.
AT_ONCE = 1_000_000
#: A perfect difference set modulo V, in which every shift between two places occurs.
V, COVER = 31, (1, 5, 11, 24, 25, 27)
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def shifts() -> np.ndarray:
    """The least shift that takes places of residues a and b both into the cover, as a table of V x V."""
    inside = np.zeros(V, bool)
    inside[list(COVER)] = True
    moved = inside[(np.arange(V)[:, None] + np.arange(V)) % V]  # residue x shift
    return (moved[:, None, :] & moved[None, :, :]).argmax(axis=2)


class Extensions:
    """Longest common prefixes of suffixes of ``words``, whose last value must be unique."""

    def __init__(self, words: np.ndarray):
        size = len(words)
        self.words, self.shift = words, shifts()
        self.slot = np.full(V, -1, np.int64)
        self.slot[list(COVER)] = np.arange(len(COVER))
        places = (np.arange(0, size, V)[:, None] + np.array(COVER)).ravel()
        places = places[places < size]
        padded = np.concatenate([words, np.full(V, -1, words.dtype)]).astype(np.int32)
        blocks = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, V)[places])
        count = len(places)
        order = np.argsort(blocks.view(f"S{4 * V}").ravel(), kind="stable")
        levels = [self._numbered(order, (blocks[order[1:]] != blocks[order[:-1]]).any(axis=1))]
        step = len(COVER)  # samples from a place to the one V words later
        while count and levels[-1].max() < count - 1:
            beyond = np.zeros(count, np.int64)
            beyond[: max(0, count - step)] = levels[-1][step:] + 1
            keys = levels[-1] * (count + 1) + beyond
            order = np.argsort(keys, kind="stable")
            levels.append(self._numbered(order, keys[order[1:]] != keys[order[:-1]]))
            step *= 2
        self.rank = levels[-1]
        self.minima = self._table(self._neighbours(order, levels, blocks))

    @staticmethod
    def _numbered(order: np.ndarray, differs: np.ndarray) -> np.ndarray:
        rank = np.zeros(len(order), np.int64)
        rank[order[1:]] = np.cumsum(differs)
        return rank

    @staticmethod
    def _neighbours(order: np.ndarray, levels: list[np.ndarray], blocks: np.ndarray) -> np.ndarray:
        """Common words of each sampled suffix with the next in order."""
        a, b = order[:-1].copy(), order[1:].copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = len(COVER) << k
            inside = np.flatnonzero(np.maximum(a, b) < len(order))
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            out[same] += V << k
            a[same] += step
            b[same] += step
        inside = np.flatnonzero(np.maximum(a, b) < len(order))
        out[inside] += (blocks[a[inside]] != blocks[b[inside]]).argmax(axis=1)
        return out

    @staticmethod
    def _table(values: np.ndarray) -> list[np.ndarray]:
        table, width = [values], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from places i and j on, i < j."""
        shift = self.shift[i % V, j % V]
        out, open_ = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(V):
            open_ = open_[shift[open_] > t]
            open_ = open_[self.words[i[open_] + t] == self.words[j[open_] + t]]
            if not len(open_):
                break
            out[open_] += 1
        full = np.flatnonzero(out == shift)
        x, y = (self.rank[(p // V) * len(COVER) + self.slot[p % V]] for p in (i[full] + shift[full], j[full] + shift[full]))
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level):
            own = level == k
            out[full[own]] += np.minimum(self.minima[k][low[own]], self.minima[k][high[own] - (1 << k)])
        return out


def grid_hits(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, period) of every grid place around which as many words as any run needs return after the period."""
    texts = np.repeat(np.arange(len(sizes)), sizes // TIMES)
    period = np.arange(len(texts)) - np.repeat(np.cumsum(sizes // TIMES) - sizes // TIMES, sizes // TIMES) + 1
    enough = sizes[texts] >= LEAST
    texts, period = texts[enough], period[enough]
    step = np.maximum(LEAST - period, (TIMES - 1) * period)
    places = -(-(sizes[texts] - period) // step)
    ends = np.cumsum(places)
    least = min(max(LEAST - p, (TIMES - 1) * p) for p in range(1, LEAST))
    found, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        own = np.repeat(np.arange(at, end), places[at:end])
        k = np.arange(len(own)) - np.repeat(np.cumsum(places[at:end]) - places[at:end], places[at:end])
        i, p = begins[texts[own]] + k * step[own], period[own]
        hit = np.flatnonzero(words[i] == words[i + p])
        own, i, p = own[hit], i[hit], p[hit]
        around = np.ones(len(i), np.int64)
        for direction in (1, -1):
            open_ = np.arange(len(i))
            for t in range(1, least):
                open_ = open_[words[i[open_] + direction * t] == words[i[open_] + p[open_] + direction * t]]
                if not len(open_):
                    break
                around[open_] += 1
        kept = around >= least
        found.append((texts[own[kept]], i[kept], p[kept]))
        at = end
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[n] for f in found] or [empty]) for n in range(3))


def joined(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in a row with a value of its own before the first and after each, and where each text begins."""
    top = max((int(c.max()) for c in codes if len(c)), default=-1) + 1
    parts = [np.array([top], np.int32)]
    for n, c in enumerate(codes, 1):
        parts += [c, np.array([top + n], np.int32)]
    sizes = np.array([len(c) for c in codes], np.int64)
    return np.concatenate(parts).astype(np.int32), np.cumsum(sizes + 1) - sizes


def runs_of(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period. ``codes`` holds the word numbers of each text."""
    words, begins = joined(codes)
    text, place, period = grid_hits(words, begins, np.array([len(c) for c in codes], np.int64))
    named = np.unique(text)
    if not len(named):
        return text, place, place, period
    words, own = joined([codes[t] for t in named])  # only texts with a hit are indexed
    begin = own[np.searchsorted(named, text)]
    place = place - begins[text] + begin
    ahead = Extensions(words).at(place, place + period)
    back = Extensions(words[::-1].copy()).at(len(words) - place - period, len(words) - place)
    start, length = place - back - begin, back + ahead + period
    kept = length >= np.maximum(LEAST, TIMES * period)
    text, start, length, period = (x[kept] for x in (text, start, length, period))
    order = np.lexsort((period, length, start, text))
    text, start, length, period = (x[order] for x in (text, start, length, period))
    first = np.ones(len(text), bool)  # the smallest period of each stretch
    first[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    text, start, length, period = (x[first] for x in (text, start, length, period))
    order = np.lexsort((period, start, text))
    return tuple(x[order] for x in (text, start, length, period))


def looped(words: list[bytes], seed: int | None) -> list[bytes]:
    """``words`` whose end repeats one stretch: from place ``seed % n`` on, with the period 1 + (n - place) // (3 + seed % 8)."""
    if seed is None or not words:
        return words
    at = seed % len(words)
    period = 1 + (len(words) - at) // (3 + seed % 8)
    return words[:at] + list(itertools.islice(itertools.cycle(words[at : at + period]), len(words) - at))


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", loop: Column | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row: runs by start and period, and the words that are left, joined by one blank, when of
    each run only the words outside and its first period stay. A row with a ``loop`` number is judged with its words ``looped`` by it."""

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                yield searched(batch.slice(a, b - a))

    seed = (F.lit(None) if loop is None else loop).cast("long").alias("loop")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), seed).mapInArrow(run, SCHEMA)


def searched(rows: pa.RecordBatch) -> pa.RecordBatch:
    number = defaultdict(itertools.count().__next__)
    texts = [looped((t or b"").split(), seed) for t, seed in zip(rows.column(1).cast(pa.binary()).to_pylist(), rows.column(2).to_pylist())]
    codes = [np.fromiter(map(number.__getitem__, words), np.int32, len(words)) for words in texts]
    text, start, length, period = runs_of(codes)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for d in np.unique(text):
        own = slice(bounds[d], bounds[d + 1])
        edges = np.zeros(len(texts[d]) + 1, np.int64)
        np.add.at(edges, start[own] + period[own], 1)
        np.add.at(edges, start[own] + length[own], -1)
        texts[d] = list(itertools.compress(texts[d], (np.cumsum(edges)[:-1] == 0).tolist()))
    found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
    columns = [
        rows.column(0),
        pa.array([len(c) for c in codes], pa.int64()),
        pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), found),
        pa.array([b" ".join(words) for words in texts], pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])
