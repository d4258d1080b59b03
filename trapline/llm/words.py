"""Words and word windows of many texts at once, as numpy arrays over the bytes of an Arrow column.

Whole texts are read. Hashes are 64 bits wide and the same in every process; callers that need certainty compare bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
#: Bytes that are hashed in one go; bounds the size of the temporary arrays.
SLICE_BYTES = 2_000_000


def mixed(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over all 64 bits, one to one."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offsets of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of ``utf8``."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def row_slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(end, rows)
        at = min(end, rows)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte unchanged."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def blank_separated() -> np.ndarray:
    """Bytes of words between blanks: all but 20 and 09-0D."""
    table = np.ones(256, bool)
    table[[0x20, 9, 10, 11, 12, 13]] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Bytes of lower-case words: 0-9, a-z and every byte of a character beyond ASCII."""
    table = np.zeros(256, bool)
    table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


class Words:
    """The words of a run of texts.

    ``starts`` and ``ends`` are byte positions, ``first[d]:first[d + 1]`` are the words of text ``d`` and ``doc`` is the text of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        within = inside[data]
        opens, closes = within.copy(), within.copy()
        opens[1:] &= ~within[:-1]
        closes[:-1] &= ~within[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        opens[edges] = within[edges]
        closes[edges - 1] = within[edges - 1]
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """One 64-bit hash for each word, over its bytes."""
        out = np.empty(len(self), np.uint64)
        letters = mixed(np.arange(1, 257, dtype=np.uint64))
        for a, b in row_slices(self.offsets, SLICE_BYTES):
            low, high = self.offsets[a], self.offsets[b]
            own = slice(self.first[a], self.first[b])
            out[own] = spans_hash(letters[self.data[low:high]], self.starts[own] - low, self.ends[own] - low)
        return out

    def bytes_of(self, at: int, count: int) -> bytes:
        """``count`` words from ``at`` on, joined by one blank."""
        return b" ".join(self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + count))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span values[start:end]: a polynomial over its members, shifted to the span's start, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    weights = np.full(len(values), MULTIPLIER, np.uint64)
    weights[:1] = 1
    weights = np.cumprod(weights)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * weights, out=total[1:])
    weights[:] = INVERSE
    weights[:1] = 1
    weights = np.cumprod(weights)
    return mixed((total[ends] - total[starts]) * weights[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def windows(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words that lies in one text."""
    last = len(hashes) - size
    if last < 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(words.doc[: last + 1] == words.doc[size - 1 :])
    out = np.empty(len(at), np.uint64)
    for low in range(0, len(at), SLICE_BYTES // 4):
        own = at[low : low + SLICE_BYTES // 4]
        base = own[0]
        out[low : low + SLICE_BYTES // 4] = spans_hash(hashes[base : own[-1] + size], own - base, own - base + size)
    return at, out


def packed(values: np.ndarray) -> bytes:
    """Unsigned 64-bit values as byte planes, without the planes that are zero throughout; high planes of small values compress well."""
    values = np.ascontiguousarray(values, np.uint64)
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(blob: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    if count and blob:
        planes = np.frombuffer(blob, np.uint8).reshape(-1, count)
        out[:, : len(planes)] = planes.T
    return out.reshape(-1).view(np.uint64)


def packed_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpacked_bits(blob: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=count).astype(bool)
