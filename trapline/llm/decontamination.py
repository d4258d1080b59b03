"""Benchmark decontamination: windows of benchmark words are looked up in every position of the training texts and compared in full.

Words are runs of 0-9, a-z and characters beyond ASCII after lower-casing A-Z. A window is ``size`` consecutive words of an item; an
item of fewer words is one window. Null and empty texts have no words, items without words have no window, and equal windows of several
items count for each of them. An item id that is null is left out of item lists. Other columns of the inputs are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.llm.shared import free_name, stored
from trapline.llm.words import Words, letters_and_digits, lowered, row_slices, text_array, utf8, windows

SIZE = 10
#: Windows that are broadcast at once. A larger benchmark is searched in several passes of at most about this many.
WINDOWS_AT_ONCE = 1_000_000
CHUNK_BYTES = 4_000_000


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(words, hash, content, items): the distinct windows with their words joined by blanks and the ids of their items."""

    def cut(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            words = Words(lowered(data), offsets, letters_and_digits())
            hashes, ids, rows = words.hashes(), batch.column(0).to_pylist(), []
            counts = np.diff(words.first)
            for length in np.unique(np.minimum(counts, size)):
                if not length:
                    continue
                at, found = windows(words, hashes, int(length))
                own = np.minimum(counts, size)[words.doc[at]] == length
                rows += [(int(length), int(h.view(np.int64)), words.bytes_of(i, int(length)), ids[words.doc[i]]) for i, h in zip(at[own], found[own])]
            names, kinds = ["words", "hash", "content", "item"], [pa.int32(), pa.int64(), pa.binary(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    cuts = items.mapInArrow(cut, "words int, hash long, content binary, item long")
    return cuts.groupBy("words", "hash", "content").agg(F.collect_set("item").alias("items"))


def window_index(rows: list) -> dict[int, tuple]:
    """Some windows by their number of words: sorted hashes, which beginnings of hashes occur, contents and item ids in a row each, and
    where those of a window begin. Plain arrays, so that a worker can open them without this package."""
    index = {}
    for length in sorted({r.words for r in rows}):
        own = sorted((np.int64(r.hash).view(np.uint64), bytes(r.content), sorted(r.items)) for r in rows if r.words == length)
        keys = np.array([k for k, _, _ in own], np.uint64)
        near = np.zeros(1 << 20, bool)
        near[(keys >> np.uint64(44)).astype(np.int64)] = True
        begins = [np.cumsum([0, *map(len, column)]) for column in ([c for _, c, _ in own], [i for _, _, i in own])]
        index[length] = (keys, near, b"".join(c for _, c, _ in own), begins[0], np.array([i for _, _, ids in own for i in ids], np.int64), begins[1])
    return index


def matches(index: dict[int, tuple], words: Words) -> tuple[np.ndarray, list[set]]:
    """Which words are hit, and the items found in each text. Windows of equal hash are told apart by their content."""
    step, items = np.zeros(len(words) + 1, np.int64), [set() for _ in words.offsets[1:]]
    hashes = words.hashes()
    for length, (keys, near, contents, content_at, owners, owner_at) in index.items():
        at, found = windows(words, hashes, length)
        maybe = np.flatnonzero(near[(found >> np.uint64(44)).astype(np.int64)])
        low, high = (np.searchsorted(keys, found[maybe], side) for side in ("left", "right"))
        same = high > low
        for i, p, end in zip(at[maybe[same]].tolist(), low[same].tolist(), high[same].tolist()):
            content = words.bytes_of(i, length)
            while p < end and contents[content_at[p] : content_at[p + 1]] != content:
                p += 1
            if p < end:
                step[i] += 1
                step[i + length] -= 1
                items[words.doc[i]].update(owners[owner_at[p] : owner_at[p + 1]].tolist())
    return np.cumsum(step[:-1]) > 0, items


def indexes(benchmark: DataFrame, item_id: str, text: str, size: int, at_once: int):
    """Broadcast indexes one after another, each of about ``at_once`` windows, and whether it is the last."""
    found = item_windows(benchmark, item_id, text, size)
    parts = max(1, -(-found.count() // at_once))
    context = benchmark.sparkSession.sparkContext
    for part in range(parts):
        yield context.broadcast(window_index(found.filter(F.pmod(F.xxhash64("content"), F.lit(parts)) == part).collect())), part == parts - 1


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """(doc_id, n_words, spans, items): a row for each document.

    ``spans`` are the hit runs of words as {start, end} in words and {from, to} in characters of the text; ``items`` the ids of the
    benchmark items of which a window occurs, ascending. Every pass but the last stores its rows, so that one index is held at a time.
    """
    spans_of = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "from", "to")]))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    for index, last in indexes(benchmark, item_id, item_text, size, at_once):

        def scan(batches, index=index, last=last):
            for part, words in word_chunks(batches):
                hit, items = matches(index.value, words)
                if "spans" in part.schema.names:  # of earlier passes
                    for d, (runs_, known) in enumerate(zip(part.column("spans").to_pylist(), part.column("items").to_pylist())):
                        items[d].update(known)
                        for x in runs_:
                            hit[words.first[d] + x["start"] : words.first[d] + x["end"]] = True
                spans = [[] for _ in items]
                for d, start, end in runs(hit, words):
                    low = words.offsets[d]
                    from_, to = (characters(words.data[low : words.starts[start]]), characters(words.data[low : words.ends[end - 1]]))
                    spans[d].append({"start": start - words.first[d], "end": end - words.first[d], "from": from_, "to": to})
                found = {"n_words": pa.array(np.diff(words.first), pa.int64()), "spans": pa.array(spans, spans_of), "items": pa.array([sorted(x) for x in items], pa.list_(pa.int64()))}
                given = {n: part.column(n) for n in (("doc_id",) if last else ("doc_id", "text"))}
                yield pa.RecordBatch.from_pydict({**given, **found})

        kind = "n_words long, spans array<struct<start:long,end:long,from:long,to:long>>, items array<long>"
        rows = rows.mapInArrow(scan, f"doc_id long, {kind}" if last else f"doc_id long, text string, {kind}")
        rows = rows if last else stored(rows)
    return rows


def word_chunks(batches, at: int = 1):
    """(rows, words) of runs of rows with a bounded number of bytes; ``at`` is the column of texts."""
    for batch in batches:
        data, offsets = utf8(batch.column(at))
        for a, b in row_slices(offsets, CHUNK_BYTES):
            yield batch.slice(a, b - a), Words(lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], letters_and_digits())


def runs(hit: np.ndarray, words: Words):
    """(text, first word, end) of each run of hit words in one text; neighbouring windows give one run."""
    if not hit.any():
        return
    opens, closes = hit.copy(), hit.copy()
    opens[1:] &= ~(hit[:-1] & (words.doc[1:] == words.doc[:-1]))
    closes[:-1] &= ~(hit[1:] & (words.doc[1:] == words.doc[:-1]))
    for start, last in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist()):
        yield int(words.doc[start]), start, last + 1


def characters(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(((data & 0xC0) != 0x80).sum())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns. Nothing is shuffled."""
    at = docs.columns.index(text)
    for index, last in indexes(benchmark, item_id, item_text, size, at_once):

        def clean(batches, index=index):
            for rows, words in word_chunks(batches, at):
                found, _ = matches(index.value, words)
                hit = np.zeros(rows.num_rows, bool)
                hit[words.doc[found]] = True
                yield rows.filter(pa.array(~hit))

        docs = docs.mapInArrow(clean, docs.schema)
        docs = docs if last else stored(docs)
    return docs


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, at_once: int = WINDOWS_AT_ONCE) -> DataFrame:
    """``docs`` with every hit run of words cut out of the text, with all other columns. Rows are judged each for itself, whatever their
    ids; a null text stays null. Hits of all passes are found in the given text before anything is cut."""
    at, schema = docs.columns.index(text), docs.schema
    marks = T.StructType([*schema, T.StructField(free_name(docs, "hit_words"), T.ArrayType(T.LongType()))])
    for index, last in indexes(benchmark, item_id, item_text, size, at_once):

        def cut(batches, index=index, last=last):
            for rows, words in word_chunks(batches, at):
                hit, _ = matches(index.value, words)
                if rows.num_columns > len(schema):  # of earlier passes
                    known = [words.first[d] + np.array(places, np.int64) for d, places in enumerate(rows.column(len(schema)).to_pylist())]
                    hit[np.concatenate(known)] = True
                columns = rows.columns[: len(schema)]
                if last:
                    columns[at] = without(rows.column(at), words, hit)
                    yield pa.RecordBatch.from_arrays(columns, schema.names)
                else:
                    own = [np.flatnonzero(hit[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.list_(pa.int64()))], marks.names)

        docs = docs.mapInArrow(cut, schema if last else marks)
        docs = docs if last else stored(docs)
    return docs


def without(column: pa.Array, words: Words, hit: np.ndarray) -> pa.Array:
    """Texts without their hit runs of words."""
    data, offsets = utf8(column)
    gone = np.zeros(len(data) + 1, np.int64)
    for _, start, end in runs(hit, words):
        gone[words.starts[start]] += 1
        gone[words.ends[end - 1]] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[offsets]
    texts = text_array(data[kept], bounds)
    return texts if not column.null_count else pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
