"""Exact de-duplication: a two-pass Bloom filter finds texts that may repeat, and only their digests are shuffled.

Equal texts are those that are identical after lower-casing A-Z. A null text counts as empty, so null and empty texts are one group.
Of equal texts the row with the largest id stays; a null id is smaller than any other. Rows that repeat an id and its text count as
members of the group each, and all of them stay if their id is the largest. Other columns of the input play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm.shared import free_name, salted_join, stored
from trapline.llm.words import utf8

#: Counters of the filter for each row, rounded up to a power of two, at which one single digest in 70 at most may repeat.
ROOM = 16
#: Most counters. The filter that is broadcast has a bit for each, so 256 MiB at most; beyond some 130 million rows more and more
#: rows without a copy are shuffled too, and results stay the same.
MOST_SLOTS = 1 << 31
#: Counters that one group of the first pass adds up.
SEGMENT = 1 << 20


def text_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the lower-cased text's UTF-8 bytes."""

    def digest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha256_of(batch.column(1)), pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(digest, "doc_id long, digest binary")


def sha256_of(column: pa.Array) -> list[bytes]:
    """Digest of each text in lower case; null counts as empty."""
    data, offsets = utf8(column)
    return [hashlib.sha256(data[a:b].tobytes().lower()).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def slots_of(digests: list[bytes], slots: int) -> np.ndarray:
    """Two counters for each digest, as an array of two rows."""
    if not digests:
        return np.zeros((2, 0), np.int64)
    values = np.frombuffer(b"".join(digests), np.uint64).reshape(len(digests), 4)
    return (values[:, :2].T % np.uint64(slots)).astype(np.int64)


def slots_for(rows: int) -> int:
    """Counters for so many rows."""
    return min(MOST_SLOTS, max(SEGMENT, 1 << (ROOM * max(rows, 1) - 1).bit_length()))


def repeat_filter(digests: DataFrame, slots: int) -> np.ndarray:
    """First pass: a bit for each counter that two or more entries meet in. At most ``slots`` / 8 bytes come to the driver. A batch
    sends a counter twice at most, so a text with very many copies is two entries for each batch."""
    segment = min(SEGMENT, slots)

    def own(batches):
        for batch in batches:
            hit, times = np.unique(slots_of(batch.column(0).to_pylist(), slots), return_counts=True)
            hit = np.repeat(hit, np.minimum(times, 2))
            kinds, at = np.unique(hit // segment, return_index=True)
            parts = np.split(hit % segment, at[1:])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in parts], pa.binary())], ["segment", "hit"])

    def tally(_, rows):
        seen = np.zeros(segment, np.uint8)
        for blob in rows.column("hit").to_pylist():
            at, n = np.unique(np.frombuffer(blob, np.int32), return_counts=True)
            seen[at] = np.minimum(2, seen[at] + np.minimum(n, 2))
        return pa.table({"segment": pa.array([rows.column("segment")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(seen >= 2).tobytes()], pa.binary())})

    filled = digests.select("digest").mapInArrow(own, "segment int, hit binary").groupBy("segment").applyInArrow(lambda key, rows: tally(key, rows), "segment int, bits binary")
    bits = np.zeros(-(-slots // 8), np.uint8)
    for row in filled.toLocalIterator():
        found = np.frombuffer(bytes(row.bits), np.uint8)
        bits[row.segment * (segment // 8) :][: len(found)] = found
    return bits


def may_repeat(digests: list[bytes], bits: np.ndarray, slots: int) -> np.ndarray:
    """Second pass: whether each digest may repeat."""
    at = slots_of(digests, slots)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def marked(digests: DataFrame, bits: np.ndarray, slots: int) -> DataFrame:
    shared = digests.sparkSession.sparkContext.broadcast(bits)

    def flag(batches):
        for batch in batches:
            hit = may_repeat(batch.column(1).to_pylist(), shared.value, slots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], ["doc_id", "digest", "maybe"])

    rows = digests.mapInArrow(flag, "doc_id long, digest binary, maybe boolean")
    repeats = rows.filter("maybe").drop("maybe")
    groups = repeats.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"]
    settled = salted_join(repeats, groups, "digest", "doc_id").select(columns)
    single = rows.filter(~F.col("maybe")).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")}).select(columns)
    return single.unionByName(settled)


def mark_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int | None = None) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest), a row for each row of ``docs``. ``slots`` goes by the number of rows unless given."""
    digests = stored(text_digests(docs, doc_id, text))
    slots = slots or slots_for(digests.count())
    return marked(digests, repeat_filter(digests, slots), slots)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", slots: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rows that the filter lets through are not shuffled."""
    digests = stored(text_digests(docs, doc_id, text))
    slots = slots or slots_for(digests.count())
    bits = repeat_filter(digests, slots)
    gone, of, own, maybe = (free_name(docs, name) for name in ("dropped_id", "dropped_digest", "own_digest", "may_repeat"))
    dropped = marked(digests, bits, slots).filter(~F.col("kept")).select(F.col("doc_id").alias(gone), F.col("digest").alias(of)).distinct()
    at, names = docs.columns.index(text), [*docs.columns, own, maybe]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def flag(batches):
        for batch in batches:
            found = sha256_of(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary()), pa.array(may_repeat(found, shared.value, slots))], names)

    rows = docs.mapInArrow(flag, T.StructType([*docs.schema, T.StructField(own, T.BinaryType()), T.StructField(maybe, T.BooleanType())]))
    through = rows.filter(~F.col(maybe)).select(docs.columns)
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(gone)) & (F.col(own) == F.col(of))
    rest = rows.filter(F.col(maybe)).join(dropped, same, "left_anti").select(docs.columns)
    return through.unionByName(rest)
