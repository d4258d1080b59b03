"""Key exchange: batches of documents send the distinct 64-bit keys they hold, packed, and get an answer for each key.

A batch splits its ascending keys into equal ranges of the key space, the buckets, and sends one row for each that it reaches: the steps
between the keys as byte planes, and whatever else belongs to them. A task then holds one bucket of all batches. Keys are distinct within a
batch, so a key that every document holds is at most one entry for each batch, and as there are as many buckets as batches, no task grows
with the input. Buckets without keys cost nothing, so a batch never sends more rows than it has distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trapline.llm.words import packed, unpacked

SENT = "bucket int, batch int, n long, keys binary, extra binary"
ANSWER = "batch int, bucket int, reply binary"


def buckets_for(batches: int) -> int:
    """How many buckets go with so many batches: the next power of two, 2 at least."""
    return 1 << max(1, (batches - 1).bit_length())


def width(buckets: int, bits: int) -> int:
    """Bits of a key below the number of its bucket."""
    return bits - (buckets.bit_length() - 1)


def filled(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, slice]]:
    """The buckets that ascending ``keys`` below 2**bits reach, each with its part of them."""
    number = keys >> np.uint64(width(buckets, bits))
    heads = np.flatnonzero(np.diff(number, prepend=number[:1] + np.uint64(1)))
    return [(n, slice(a, b)) for n, a, b in zip(number[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(keys)])]


def sent(batch: int, keys: np.ndarray, buckets: int, bits: int, extra: Callable[[slice], bytes]) -> pa.Table:
    """Rows of one batch. ``extra`` packs what belongs to a slice of the keys."""
    columns = [[], [], [], [], []]
    for bucket, own in filled(keys, buckets, bits):
        steps = np.diff(keys[own], prepend=np.uint64(bucket << width(buckets, bits)))
        for column, value in zip(columns, (bucket, batch, own.stop - own.start, packed(steps), extra(own))):
            column.append(value)
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "batch", "n", "keys", "extra"])


def opened(table: pa.Table, buckets: int, bits: int) -> list[np.ndarray]:
    """The keys of each row of one bucket."""
    base = np.uint64(table.column("bucket")[0].as_py() << width(buckets, bits))
    return [np.cumsum(unpacked(blob, n), dtype=np.uint64) + base for blob, n in zip(table.column("keys").to_pylist(), table.column("n").to_pylist())]


def answered(rows: DataFrame, buckets: int, bits: int, answer: Callable[[list, list], list]) -> DataFrame:
    """(batch, bucket, reply): ``answer`` gets the keys and the extras of each row of a bucket and gives a reply, or None, for each."""

    def reduce(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        replies = answer(opened(table, buckets, bits), table.column("extra").to_pylist())
        kept = [i for i, r in enumerate(replies) if r is not None]
        batches = table.column("batch").to_pylist()
        return pa.table([pa.array([batches[i] for i in kept], pa.int32()), pa.array([bucket] * len(kept), pa.int32()), pa.array([replies[i] for i in kept], pa.binary())], ["batch", "bucket", "reply"])

    return rows.groupBy("bucket").applyInArrow(reduce, ANSWER)
