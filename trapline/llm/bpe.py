"""Byte-level BPE over the pair occurrences of many words, and its inverse.

The distinct words of a run of texts lie in one row of symbols. An index maps every adjacent pair with a merge rank to all its places;
active ranks are applied in ascending order, and each merge adds the pairs it makes to the lists of their ranks. Texts are encoded whole;
null and empty texts have no tokens. Added tokens of the vocabulary are found in texts and stand for themselves. Other columns of the
input play no part.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.words import row_slices, text_array, utf8

CHUNK_BYTES = 3_000_000
#: Most merges of a vocabulary that may be broadcast.
LARGEST = 2_000_000

#: Fixed value: the pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(0x100)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A byte-level vocabulary as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
        if len(merges) > LARGEST:
            raise ValueError(f"{len(merges)} merges are more than {LARGEST}")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        characters = byte_characters()
        value = {c: b for b, c in enumerate(characters)}
        self.byte_ids = np.array([ids[c] for c in characters], np.int64)
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        contents = {i: bytes(value[c] for c in t) for t, i in ids.items()} | {i: t.encode() for t, i in self.added.items()}
        lengths = np.zeros(max(contents) + 2, np.int64)
        for i, content in contents.items():
            lengths[i + 1] = len(content)
        self.offsets = np.cumsum(lengths)
        self.contents = np.frombuffer(b"".join(contents[i] for i in sorted(contents)), np.uint8)
        keys = self.left << 32 | self.right
        _, first = np.unique(keys, return_index=True)
        self.pair_keys, self.pair_ranks = keys[first], first

    @classmethod
    def of(cls, fields: dict) -> Vocabulary:
        """From the fields of another one. They are plain, so a worker can open them without this package."""
        vocabulary = cls.__new__(cls)
        vars(vocabulary).update(fields)
        return vocabulary

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair; -1 without one."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], -1)


class PairIndex:
    """Rank of a pair -> all its places, with the ranks that are active in a heap."""

    def __init__(self):
        self.places: dict[int, list] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, places: np.ndarray) -> None:
        order = np.argsort(ranks)
        ranks, places = ranks[order], places[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [int(np.searchsorted(ranks, 0)), *cuts[ranks[cuts] > 0].tolist()] if len(ranks) else []
        bounds = sorted({b for b in bounds if b < len(ranks)})
        for a, b in zip(bounds, [*bounds[1:], len(ranks)]):
            rank = int(ranks[a])
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.active, rank)
            self.places[rank].append(places[a:b])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        lists = self.places.pop(rank)
        return rank, lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))


def merge_words(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row, and where each word's begin."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), np.uint8)
    symbols = vocabulary.byte_ids[data]
    size = len(symbols)
    after = np.arange(1, size + 1)
    before = np.arange(-1, size - 1)
    if size:
        after[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
    index = PairIndex()
    at = np.flatnonzero(after >= 0)
    index.add(vocabulary.ranks(symbols[at], symbols[after[at]]), at)
    while index.active:
        rank, at = index.pop()
        a, b, made = vocabulary.left[rank], vocabulary.right[rank], vocabulary.made[rank]
        at = at[(symbols[at] == a) & (after[at] >= 0)]
        at = at[symbols[after[at]] == b]
        if a == b and len(at):
            at = every_other(np.unique(at), after)
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        symbols[at], symbols[gone], after[at] = made, -1, beyond
        inner = beyond >= 0
        before[beyond[inner]] = at[inner]
        lead = before[at]
        lead = lead[lead >= 0]
        trail = at[inner]
        places = np.concatenate([lead, trail])
        if len(places):
            ranks = vocabulary.ranks(symbols[places], symbols[after[places]])
            found = ranks >= 0
            if found.any():
                index.add(ranks[found], places[found])
    kept = symbols >= 0
    return symbols[kept], np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])]


def every_other(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places of a pair of equal symbols, those that a merge from the left takes: in each chain of neighbours the 1st, 3rd, ..."""
    linked = np.zeros(len(at), bool)
    linked[1:] = after[at[:-1]] == at[1:]
    heads = np.flatnonzero(~linked)
    step = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    return at[step % 2 == 0]


class Encoder:
    """Encodes and decodes runs of texts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(SPLIT)
        names = sorted(vocabulary.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> list:
        """Words of a text; added tokens are ids."""
        if self.special is None or not self.special.search(text):
            return self.split.findall(text)
        out = []
        for part in self.special.split(text):
            out.extend([self.vocabulary.added[part]] if part in self.vocabulary.added else self.split.findall(part))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        number = defaultdict(itertools.count().__next__)
        parts = [np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)) for pieces in map(self.pieces, texts)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        text_ends = np.cumsum([0, *(len(p) for p in parts)])
        ids, begins = merge_words([b"" if isinstance(w, int) else w.encode("utf-8") for w in number], self.vocabulary)
        fixed = [(n, w) for w, n in number.items() if isinstance(w, int)]
        if fixed:
            where = np.array([n for n, _ in fixed])
            ids = np.insert(ids, begins[where], [w for _, w in fixed])
            extra = np.zeros(len(begins), np.int64)
            extra[where + 1] = 1
            begins = begins + np.cumsum(extra)
        out, ends = gathered(ids, begins, flat)
        return out, ends[text_ends]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in a row, and where each text's begin."""
        data, ends = gathered(self.vocabulary.contents, self.vocabulary.offsets, ids)
        return data, ends[bounds]


def gathered(values: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked spans of ``values`` in a row, and where each begins."""
    lengths = (offsets[1:] - offsets[:-1])[pick]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    place = np.repeat(offsets[:-1][pick] - ends[:-1], lengths)
    place += np.arange(len(place))
    return values[place], ends


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) for each row: ``ids`` are little-endian unsigned 32-bit numbers. ``decoded`` adds the text that the ids give back."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(Vocabulary(vocabulary_path)))

    def run(batches):
        encoder = Encoder(Vocabulary.of(shared.value))
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                ids, bounds = encoder.encode(texts)
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
                columns = [batch.column(0).slice(a, b - a), pa.array(np.diff(bounds)), blob.cast(pa.binary())]
                if decoded:
                    columns.append(valid_text(*encoder.decode(ids, bounds)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(tokens: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give an empty text. Bytes that are no UTF-8 become U+FFFD."""
    shared = tokens.sparkSession.sparkContext.broadcast(vars(Vocabulary(vocabulary_path)))

    def run(batches):
        encoder = Encoder(Vocabulary.of(shared.value))
        for batch in batches:
            lists = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column(1).to_pylist()]
            bounds = np.cumsum([0, *map(len, lists)])
            yield pa.RecordBatch.from_arrays([batch.column(0), valid_text(*encoder.decode(np.concatenate([np.zeros(0, np.int64), *lists]), bounds))], ["doc_id", "text"])

    return tokens.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("binary").alias("ids")).mapInArrow(run, "doc_id long, text string")


def valid_text(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts of UTF-8 bytes."""
    try:
        texts = text_array(data, offsets)
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
