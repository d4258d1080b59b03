"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to ``ORDER`` bytes holds how often each next byte followed. A text's code length under a
language is the sum over its bytes of -log2 of the byte's probability: n / (t + q) in the longest context known, where t is what followed
that context in all and q how many different bytes did; a byte that is new there costs an escape q / (t + q) and goes to the next shorter
context, at last to 1/256. Statistics are frozen: scoring changes nothing. A-Z is lower-cased, and a text begins after ``ORDER`` blanks.

A text that is null or has no letter is ``und`` with score 0; without any training text every text is. Of equal code lengths the first
language in alphabetical order wins. Training rows with null or empty text or null language are passed over.
"""

from __future__ import annotations

from collections.abc import Collection

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.llm.shared import stored
from trapline.llm.words import lowered, mixed, row_slices, utf8

ORDER = 3
#: Most bytes of training text for each language, and half of them at least where it has so many: a hash of text and position picks pieces
#: of its distinct texts. The trees stay small with it.
SAMPLE_BYTES = 1_500_000
PIECE = 1024
#: Most tree nodes that are broadcast; languages above their share of them learn from half the bytes until all fit.
NODES = 4_000_000
UNDETERMINED = "und"
#: Code length beyond which a text is in no language: bits for each byte, and bits on top. Prose of a learnt language takes 1.3 to 3 bits a
#: byte in the given tables, text in an unknown alphabet or at random 6 to 8.
MOST_BITS, ALLOWANCE = 4.0, 256.0
CHUNK_BYTES = 2_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the number made of the ``ORDER`` bytes before it in its text, blanks before the first, and itself."""
    code = data.astype(np.uint32)
    for back in range(1, ORDER + 1):
        earlier = np.full(len(data), 0x20, np.uint32)
        earlier[back:] = data[:-back] if len(data) > back else 0x20
        for step in range(back):
            at = offsets[:-1] + step
            earlier[at[at < offsets[1:]]] = 0x20
        code |= earlier << np.uint32(8 * back)
    return code


def train(docs: DataFrame, lang: str = "lang", text: str = "text", learn: Column | None = None, sample_bytes: int = SAMPLE_BYTES, nodes: int = NODES) -> dict[str, tuple]:
    """Frozen trees of each language. ``learn`` says which rows may be learnt from."""
    rows = docs.filter(F.lit(True) if learn is None else learn)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and length(text) > 0")
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    if not sizes:
        return {}
    pieces = sampled(rows, sizes, sample_bytes)
    allowed = dict.fromkeys(sizes, sample_bytes)
    while True:
        most = F.create_map(*[F.lit(x) for pair in sorted(allowed.items()) for x in pair])
        taken = pieces.filter((F.col("upto") <= most[F.col("lang")]) | (F.col("upto") == F.col("size")))
        counts = taken.select("lang", "piece", "at").mapInArrow(gram_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
        kinds = {r["lang"]: r["count"] for r in counts.groupBy("lang").count().collect()}
        above = [name for name, n in kinds.items() if n * len(kinds) > nodes and allowed[name] > PIECE]
        if sum(kinds.values()) <= nodes or not above:
            break
        allowed |= {name: allowed[name] // 2 for name in above}
    found = counts.toPandas()
    return {name: tree(own["code"].to_numpy(np.uint32), own["n"].to_numpy(np.int64)) for name, own in sorted(found.groupby("lang"), key=lambda x: x[0])}


def sampled(rows: DataFrame, sizes: dict[str, int], sample_bytes: int) -> DataFrame:
    """(lang, piece, at, size, upto): pieces of each language's distinct texts with the ``ORDER`` bytes before them, from the smallest hash;
    ``upto`` are the bytes so far. Where copies leave less than half of ``sample_bytes``, more is picked until nothing is left out."""
    share = {name: min(1.0, sample_bytes / size) for name, size in sizes.items()}
    keyed = rows.select("lang", "text", F.xxhash64("text", F.lit(7)).alias("key"))
    while True:
        picked = stored(keyed.mapInArrow(picker(dict(share)), "lang string, key long, at long, place double, size long, piece binary").dropDuplicates())
        held = {r["lang"]: r["held"] for r in picked.groupBy("lang").agg(F.sum("size").alias("held")).collect()}
        short = [name for name in share if share[name] < 1 and 2 * held.get(name, 0) < sample_bytes]
        if not short:
            break
        share |= {name: min(1.0, 4 * share[name]) for name in short}
    return picked.withColumn("upto", F.sum("size").over(Window.partitionBy("lang").orderBy("place", "key", "at", "piece").rowsBetween(Window.unboundedPreceding, 0)))


def picker(share: dict[str, float]):
    """Pieces of ``PIECE`` bytes whose hash is below their language's share."""

    def run(batches):
        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(2).to_numpy().view(np.uint64)
            data, offsets = utf8(batch.column(1))
            parts = -(-np.diff(offsets) // PIECE)
            doc = np.repeat(np.arange(len(names)), parts)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            place = (mixed(keys[doc] + mixed(at + 1)) >> np.uint64(11)) / 2.0**53
            own = np.flatnonzero(place < np.array([share[n] for n in names])[doc]) if names else np.zeros(0, np.int64)
            doc, at, place = doc[own], at[own], place[own]
            begin = offsets[doc] + at * PIECE
            end = np.minimum(begin + PIECE, offsets[doc + 1])
            pieces = [data[b:e].tobytes() for b, e in zip(begin - ORDER * (at > 0), end)]
            columns = [pa.array([names[i] for i in doc], pa.string()), pa.array(keys[doc].view(np.int64)), pa.array(at), pa.array(place), pa.array(end - begin), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "key", "at", "place", "size", "piece"])

    return run


def gram_counts(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        sizes, later = np.diff(offsets), batch.column(2).to_numpy() > 0
        own = np.arange(len(data)) - np.repeat(offsets[:-1], sizes) >= np.repeat(ORDER * later, sizes)  # not what only is the context
        codes, names = grams(lowered(data), offsets)[own], batch.column(0).to_pylist()
        owner = np.repeat(np.array(names, object), sizes)[own] if names else np.array([], object)
        for name in sorted(set(names)):
            code, n = np.unique(codes[owner == name], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "code", "n"])


def tree(codes: np.ndarray, counts: np.ndarray) -> tuple:
    """For each order from the longest: symbols' codes and counts; contexts, what followed them and how many different bytes did."""
    out = []
    for order in range(ORDER, -1, -1):
        own, at = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
        n = np.bincount(at, counts).astype(np.int64)
        contexts, inverse, distinct = np.unique(own >> np.uint32(8), return_inverse=True, return_counts=True)
        out.append((own, n, contexts, np.bincount(inverse, n).astype(np.int64), distinct))
    return tuple(out)


def code_lengths(codes: np.ndarray, levels: tuple) -> np.ndarray:
    """Bits of each byte, given as context and byte, under one language."""
    bits, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
    for order, (own, n, contexts, total, distinct) in zip(range(ORDER, -1, -1), levels):
        code = codes & np.uint32((1 << 8 * (order + 1)) - 1)
        at = np.minimum(np.searchsorted(contexts, code >> np.uint32(8)), len(contexts) - 1)
        known = open_ & (contexts[at] == code >> np.uint32(8))
        place = np.minimum(np.searchsorted(own, code), len(own) - 1)
        seen = known & (own[place] == code)
        whole = np.log2(total[at] + distinct[at])
        bits += np.where(seen, whole - np.log2(n[place]), 0)
        bits += np.where(known & ~seen, whole - np.log2(distinct[at]), 0)
        open_ &= ~seen
    return bits + 8 * open_


def text_lengths(data: np.ndarray, offsets: np.ndarray, trees: dict[str, tuple]) -> np.ndarray:
    """Code length of each text under each language."""
    distinct, at = np.unique(grams(lowered(data), offsets), return_inverse=True)
    out, filled = np.zeros((len(offsets) - 1, len(trees))), np.flatnonzero(np.diff(offsets))
    if len(filled):
        for k, levels in enumerate(trees.values()):
            out[filled, k] = np.add.reduceat(code_lengths(distinct, levels)[at], offsets[:-1][filled])
    return out


def identify(docs: DataFrame, trees: dict[str, tuple], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits): the language of the shortest code, its share of the probability when all are equally likely
    beforehand, and the code length."""
    predict = predictor(docs, trees)

    def run(batches):
        for batch in batches:
            names, scores, bits = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], ["doc_id", "lang_pred", "score", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double")


def drop_undetermined(docs: DataFrame, trees: dict[str, tuple], text: str = "text", wanted: Collection[str] | None = None, most_bits: float = MOST_BITS, allowance: float = ALLOWANCE) -> DataFrame:
    """The rows of ``docs`` whose text is in a ``wanted`` language (null: any that was learnt), with all their columns. A text whose
    shortest code is longer than ``most_bits`` for each byte and ``allowance`` bits on top is in none of them: no tree foresees it. The
    allowance keeps short texts of names and numbers. Where nothing could be learnt, every text with a letter stays."""
    predict, at, trees = predictor(docs, trees), docs.columns.index(text), bool(trees)

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            data, offsets = utf8(column)
            if trees:
                names, _, bits = predict(column)
                most = (most_bits * np.diff(offsets) + allowance).tolist()
                kept = [n != UNDETERMINED and b <= m and (wanted is None or n in wanted) for n, b, m in zip(names, bits, most)]
            else:
                kept = has_letter(data, offsets, column)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predictor(docs: DataFrame, trees: dict[str, tuple]):
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(column: pa.Array) -> tuple[list, list, list]:
        known, languages = shared.value, list(shared.value)
        data, offsets = utf8(column)
        names, scores, bits = [], [], []
        for a, b in row_slices(offsets, CHUNK_BYTES):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            letters = has_letter(part, bounds, column.slice(a, b - a))
            lengths = text_lengths(part, bounds, known) if languages else np.zeros((b - a, 0))
            for own, lettered in zip(lengths, letters):
                if not lettered or not languages:
                    names.append(UNDETERMINED), scores.append(0.0), bits.append(None)
                    continue
                best = int(own.argmin())
                names.append(languages[best])
                scores.append(1 / sum(2.0 ** max(-1000.0, own[best] - x) for x in own))
                bits.append(float(own[best]))
        return names, scores, bits

    return predict


def has_letter(data: np.ndarray, offsets: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which texts have a letter of any alphabet."""
    lower = data | 0x20
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122) & (data < 128))])
    out = plain[offsets[1:]] > plain[offsets[:-1]]
    beyond = np.concatenate([[0], np.cumsum(data >= 128)])
    for i in np.flatnonzero(~out & (beyond[offsets[1:]] > beyond[offsets[:-1]])):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out
