"""Substring de-duplication by fixed-block anchors.

Words are runs without blanks. Each document's non-overlapping blocks of ``(window + 1) // 2`` words are the index: every run of
``window`` words holds one of them whole, wherever it begins. Every rolling run of that many words probes the index. Where a probe meets a
block of another document, the hit is extended to all windows around it, and those are compared between documents by a key of 64 bits and
a check of 32 more, both made of two hashes that together cover the window: a window is removed where its words also begin in a document
with a smaller id.

Windows are judged on the input. Null and empty texts, and texts with fewer words than a window, lose nothing. Rows of equal id are one
document here, so none is smaller; a row with a null id loses nothing and is no reference. Other columns play no part.

Texts identical to one with a smaller id are found first by a digest and need no probing: all their windows go. The batches of documents
are shuffled once and read three times: to probe, to extend and to cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.llm.exchange import SENT, answered, buckets_for, filled, sent
from trapline.llm.shared import batch_count, salted_join, with_batch
from trapline.llm.words import Words, blank_separated, mixed, packed, packed_bits, text_array, unpacked, unpacked_bits, utf8, windows

WINDOW = 13
#: Bits of a probe; a chance match only means one more window to compare.
PROBE_BITS = 48
NEVER = np.iinfo(np.int64).max
NEWS = "batch int, kind int, bucket int, doc_id long, reply binary"
COPY, HIT, EARLIER = 0, 1, 2


class Batch:
    """The words of one batch and the keys it sends, the same whenever it is built again."""

    def __init__(self, rows: pa.Table, news: pa.Table, window: int, buckets: int):
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.ids = rows.column("doc_id").combine_chunks()
        self.order = self.ids.fill_null(NEVER).to_numpy(zero_copy_only=False)
        data, offsets = utf8(rows.column("text"))
        self.words = Words(data, offsets, blank_separated())
        self.counts = np.diff(self.words.first)
        kinds, buckets_ = (news.column(c).to_numpy() for c in ("kind_in", "bucket_in"))
        ids = news.column("doc_id_in").fill_null(NEVER).to_numpy()  # with nulls numpy would round ids to floats
        replies = news.column("reply_in").to_pylist()
        self.replies = {(k, b): r for k, b, r in zip(kinds.tolist(), buckets_.tolist(), replies) if k != COPY}
        self.copy = np.isin(self.order, ids[kinds == COPY])
        self.judged = (self.counts >= window) & ~self.copy & (self.order != NEVER)

    def probes(self) -> None:
        """Rolling blocks: word they begin at and hash; the distinct probes in ascending order, and which of them each block is."""
        at, hashes = windows(self.words, self.words.hashes(), self.block)
        own = self.judged[self.words.doc[at]]
        self.at, self.hashes = at[own], hashes[own]
        doc = self.words.doc[self.at]
        keys = self.hashes >> np.uint64(64 - PROBE_BITS)
        order = np.argsort(keys)
        keys, doc = keys[order], doc[order]
        heads = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[heads]
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
        if len(heads):
            whole = (self.at[order] - self.words.first[doc]) % self.block == 0
            self.anchor = np.logical_or.reduceat(whole, heads)
            self.shared = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
        else:
            self.anchor = self.shared = np.zeros(0, bool)

    def answers(self, kind: int, keys: np.ndarray, bits: int) -> np.ndarray:
        """The bit that came back for each key."""
        out = np.zeros(len(keys), bool)
        for bucket, own in filled(keys, self.buckets, bits):
            if (kind, bucket) in self.replies:
                out[own] = unpacked_bits(self.replies[kind, bucket], own.stop - own.start)
        return out

    def extended(self) -> None:
        """Windows around hits: word they begin at, key and check; the distinct ones with the smallest id that has them here."""
        self.probes()
        hit, place = np.zeros(len(self.words) + 1, np.int64), np.zeros(len(self.words) + 1, np.uint64)
        hit[self.at] = self.answers(HIT, self.keys, PROBE_BITS)[self.inverse]
        place[self.at] = self.hashes
        reach, total = self.window - self.block, np.concatenate([[0], np.cumsum(hit)])
        start = self.at[self.at + self.window <= self.words.first[self.words.doc[self.at] + 1]]
        start = start[total[start + reach + 1] > total[start]]
        keys = mixed(place[start] * np.uint64(0xD6E8FEB86659FD93) + place[start + reach])
        checks = mixed(place[start] + place[start + reach] * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)
        self.start = start
        first, self.window_inverse = distinct(keys, checks)
        self.window_keys, self.window_checks = keys[first], checks[first]
        self.smallest = np.full(len(self.window_keys), NEVER, np.int64)
        np.minimum.at(self.smallest, self.window_inverse, self.order[self.words.doc[start]])

    def covered(self) -> np.ndarray:
        """Which words go."""
        self.extended()
        gone = self.answers(EARLIER, self.window_keys, 64)[self.window_inverse] | (self.order[self.words.doc[self.start]] > self.smallest[self.window_inverse])
        step = np.zeros(len(self.words) + 1, np.int64)
        step[self.start[gone]] += 1
        np.subtract.at(step, self.start[gone] + self.window, 1)
        return (np.cumsum(step[:-1]) > 0) | (self.copy & (self.counts >= self.window) & (self.order != NEVER))[self.words.doc]


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct pair of key and check is, in ascending order, and which of them each entry is."""
    order = np.argsort(keys)
    again = np.diff(keys[order]) == 0
    if (again & (np.diff(checks[order]) != 0)).any():  # two windows with one key
        order = np.lexsort((checks, keys))
        again = (np.diff(keys[order]) == 0) & (np.diff(checks[order]) == 0)
    heads = np.flatnonzero(np.concatenate([[True], ~again])) if len(keys) else np.zeros(0, np.int64)
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(keys))))
    return order[heads], inverse


def repeated_probes(keys: list, flags: list) -> list:
    """A bit for each probe: it is a block somewhere and occurs in two documents at least."""
    bits = [unpacked_bits(f, 2 * len(k)).reshape(2, -1) for k, f in zip(keys, flags)]
    every = np.concatenate(keys)
    order = np.argsort(every)
    row = every[order]
    heads = np.flatnonzero(np.diff(row, prepend=row[:1] + np.uint64(1)))
    anchor = np.logical_or.reduceat(np.concatenate([b[0] for b in bits])[order], heads)
    several = np.logical_or.reduceat(np.concatenate([b[1] for b in bits])[order], heads) | (np.diff(np.append(heads, len(row))) > 1)
    hits = row[heads[anchor & several]]
    if not len(hits):
        return [None] * len(keys)
    out = []
    for k in keys:
        found = hits[np.minimum(np.searchsorted(hits, k), len(hits) - 1)] == k
        out.append(packed_bits(found) if found.any() else None)
    return out


def earlier_windows(keys: list, extras: list) -> list:
    """A bit for each window: it also begins in a document with a smaller id than any of the batch's own."""
    checks = np.concatenate([np.frombuffer(x, np.uint32, len(k)) for k, x in zip(keys, extras)])
    ids = [unpacked(x[4 * len(k) :], len(k)).view(np.int64) for k, x in zip(keys, extras)]
    places, inverse = distinct(np.concatenate(keys), checks)
    first = np.full(len(places), NEVER, np.int64)
    np.minimum.at(first, inverse, np.concatenate(ids))
    bits = np.split(first[inverse] < np.concatenate(ids), np.cumsum([len(k) for k in keys])[:-1])
    return [packed_bits(b) if b.any() else None for b in bits]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row: ``spans`` are the removed runs {start, end} in words, ``kept`` the words that
    stay joined by one blank."""
    parts = batch_count(docs, text)
    buckets = buckets_for(parts)
    batches = with_batch(docs, doc_id, text, parts)
    digests = batches.filter("doc_id is not null and length(text) > 0").select("doc_id", "batch", F.unhex(F.md5(F.col("text").cast("binary"))).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    copies = salted_join(digests, first, "digest", "doc_id").filter("doc_id > first_id").select("batch", F.lit(COPY).alias("kind"), F.lit(0).alias("bucket"), "doc_id", F.lit(None).cast("binary").alias("reply"))

    def news(replies: DataFrame, kind: int) -> DataFrame:
        return replies.select("batch", F.lit(kind).alias("kind"), "bucket", F.lit(None).cast("long").alias("doc_id"), "reply")

    def probe(rows: pa.Table, more: pa.Table) -> pa.Table:
        batch = Batch(rows, more, window, buckets)
        batch.probes()
        number = rows.column("batch")[0].as_py() if rows.num_rows else -1
        return sent(number, batch.keys, buckets, PROBE_BITS, lambda own: packed_bits(np.concatenate([batch.anchor[own], batch.shared[own]])))

    def extend(rows: pa.Table, more: pa.Table) -> pa.Table:
        batch = Batch(rows, more, window, buckets)
        batch.extended()
        number = rows.column("batch")[0].as_py() if rows.num_rows else -1
        return sent(number, batch.window_keys, buckets, 64, lambda own: batch.window_checks[own].astype(np.uint32).tobytes() + packed(batch.smallest[own].view(np.uint64)))

    def cut(rows: pa.Table, more: pa.Table) -> pa.Table:
        batch = Batch(rows, more, window, buckets)
        return kept_rows(batch.ids, batch.words, batch.covered())

    def together(right: DataFrame, work, schema: str) -> DataFrame:
        fresh = right.select(*[F.col(c).alias(f"{c}_in") for c in right.columns])  # else Spark takes the two sides' columns for the same
        return batches.groupBy("batch").cogroup(fresh.groupBy("batch_in")).applyInArrow(work, schema)

    hits = answered(together(copies, probe, SENT), buckets, PROBE_BITS, repeated_probes)
    known = copies.unionByName(news(hits, HIT))
    earlier = answered(together(known, extend, SENT), buckets, 64, earlier_windows)
    return together(known.unionByName(news(earlier, EARLIER)), cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def kept_rows(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
    """Rows of the result: the bytes of the words that stay, each but a text's last followed by one blank."""
    size, stay = len(words.data), np.flatnonzero(~gone)
    mask = np.zeros(size + 1, np.int8)
    mask[words.starts[stay]] += 1
    np.subtract.at(mask, words.ends[stay], 1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    joint = stay[:-1][words.doc[stay[1:]] == words.doc[stay[:-1]]]
    data[words.ends[joint]] = 0x20
    mask[words.ends[joint]] = True
    bounds = np.concatenate([[0], np.cumsum(mask)])[words.offsets]
    removed = np.bincount(words.doc[gone], minlength=len(ids))
    opens, closes = gone.copy(), gone.copy()
    same = words.doc[1:] == words.doc[:-1]
    opens[1:] &= ~(gone[:-1] & same)
    closes[:-1] &= ~(gone[1:] & same)
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = words.doc[start]
    runs = pa.StructArray.from_arrays([pa.array(start - words.first[doc]), pa.array(end - words.first[doc])], ["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)), pa.int32()), runs)
    return pa.table([ids, pa.array(np.diff(words.first)), pa.array(removed), spans, text_array(data[mask], bounds)], ["doc_id", "n_words", "n_removed", "spans", "kept"])
