"""Token counts of a byte-level BPE vocabulary by merging in a heap and a linked list, without token identifiers.

The bytes of a word are linked in a list; a heap holds the adjacent pairs that have a merge rank, the lowest rank first and the leftmost
place among equal ranks. The lowest pair is popped and merged until the heap is empty, and the word's tokens are its bytes minus its
merges. Texts are counted whole. Null and empty texts have no tokens. Added tokens of the vocabulary that a text holds count as one token
each, as the vocabulary's library does by default. Repeated rows and null ids are counted like any other; further columns play no part.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.bpe import LARGEST, SPLIT, byte_characters

#: A text is over the limit with more tokens than this.
LIMIT = 512
#: Counts of at most so many short words are remembered by a task; then it starts anew. Bounds memory only.
REMEMBERED, SHORT = 500_000, 40
#: Longer texts are split word by word instead of into one list.
LONG = 1_000_000


def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Keys of the pairs in the order of their ranks, the symbol that each makes, the symbol of each byte, and the added tokens."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids, merges = spec["model"]["vocab"], spec["model"]["merges"]
    if len(merges) > LARGEST:
        raise ValueError(f"{len(merges)} merges are more than {LARGEST}")
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
    made = np.array([ids[a + b] for a, b in pairs], np.int64)
    return keys, made, np.array([ids[c] for c in byte_characters()], np.int64), [t["content"] for t in spec["added_tokens"]]


class WordSizes(dict):
    """Word -> number of its tokens, worked out when it is first asked for."""

    def __init__(self, keys: np.ndarray, made: np.ndarray, symbols: np.ndarray):
        super().__init__()
        self.ranks = dict(zip(keys.tolist()[::-1], range(len(keys) - 1, -1, -1)))  # of a pair listed twice the first rank counts
        self.made, self.symbols = made.tolist(), symbols.tolist()

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8")
        size = len(data) - self.merges([self.symbols[b] for b in data])
        if len(word) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = size
        return size

    def merges(self, symbols: list[int]) -> int:
        """How many merges a row of symbols takes."""
        ranks, made = self.ranks, self.made
        after, before = [*range(1, len(symbols)), -1], [*range(-1, len(symbols) - 1)]
        heap = [(ranks[pair], at) for at, pair in enumerate(a << 32 | b for a, b in zip(symbols, symbols[1:])) if pair in ranks]
        heapq.heapify(heap)
        done = 0
        while heap:
            rank, at = heapq.heappop(heap)
            gone = after[at]
            if gone < 0 or symbols[at] < 0 or ranks.get(symbols[at] << 32 | symbols[gone]) != rank:
                continue  # one of its symbols has been merged meanwhile
            done += 1
            beyond = after[gone]
            symbols[at], symbols[gone], after[at] = made[rank], -1, beyond
            if beyond >= 0:
                before[beyond] = at
                new = ranks.get(symbols[at] << 32 | symbols[beyond])
                if new is not None:
                    heapq.heappush(heap, (new, at))
            lead = before[at]
            if lead >= 0:
                new = ranks.get(symbols[lead] << 32 | symbols[at])
                if new is not None:
                    heapq.heappush(heap, (new, lead))
        return done


def counter(keys: np.ndarray, made: np.ndarray, symbols: np.ndarray, added: list[str]):
    """A function from a text to the number of its tokens."""
    sizes, split = WordSizes(keys, made, symbols), regex.compile(SPLIT)
    special = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def plain(text: str) -> int:
        words = split.findall(text) if len(text) <= LONG else (m.group() for m in split.finditer(text))
        return sum(map(sizes.__getitem__, words))

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return plain(text)
        total, at = 0, 0
        for found in special.finditer(text):
            total, at = total + plain(text[at : found.start()]) + 1, found.end()
        return total + plain(text[at:])

    return count


def count_tokens(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each row of ``docs``; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(merge_table(vocabulary_path))

    def run(batches):
        count = counter(*shared.value)
        for batch in batches:
            sizes = pa.array([count(t.as_py()) if t.is_valid else 0 for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes], ["doc_id", "n_bytes", "n_tokens"])

    own = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(own), F.lit(0)).cast("long").alias("n_bytes"), own.alias("text"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
