"""Quality classifier: nearest labelled texts by cosine in a latent space vote, each with the fourth power of its similarity times the weight
of its label, which makes both labels weigh the same in all.

A text's features are how often each of ``BUCKETS`` hashed byte trigrams occurs (logarithm, times inverse document frequency in the
sample) and some shares of its form: distinct trigrams, capitals, digits, punctuation, blanks, breaks, words equal
to the one before. A truncated singular value decomposition of the sample's features gives ``RANK`` directions; the sample's texts in that space are broadcast, and the cosine products of every document
with all of them are computed in blocks. The ``NEIGHBOURS`` most similar vote; ties in similarity go to the first in sample order.

Null and empty texts have no features: their score is the share of label 1 in the sample, as is that of every text if there is no
labelled one (then 0.5). Labels that are null are passed over; a text labelled twice counts with both labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.words import Words, blank_separated, mixed, row_slices, utf8

BUCKETS = 2048
RANK = 64
NEIGHBOURS = 25
#: Labelled texts learnt from, as an expected value for each label: a hash picks them. Bounds what is broadcast, about 1 MB.
PER_LABEL = 1500
CHUNK_BYTES = 2_000_000
FORM = 7


def features(column: pa.Array) -> np.ndarray:
    """Raw counts of hashed trigrams, then the shares of form, for a run of texts."""
    data, offsets = utf8(column)
    out, sizes = np.zeros((len(column), BUCKETS + FORM), np.float32), np.diff(offsets)
    if len(data) < 3:
        return out
    wide = data.astype(np.uint64)
    code = mixed(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:])
    bucket = (code >> np.uint64(53)).astype(np.int64)
    row = np.repeat(np.arange(len(column)), sizes)
    whole = row[:-2] == row[2:]
    out[:, :BUCKETS] = np.bincount(row[:-2][whole] * BUCKETS + bucket[whole], minlength=len(column) * BUCKETS).reshape(-1, BUCKETS)
    total = np.maximum(sizes, 1).astype(np.float64)
    share = lambda mask: np.bincount(row[mask], minlength=len(column)) / total
    lower = data | 0x20
    letters = ((lower >= 97) & (lower <= 122)) | (data >= 128)
    digits, blanks, breaks = (data >= 48) & (data <= 57), data == 32, data == 10
    words = Words(data, offsets, blank_separated())
    hashes = words.hashes()
    again = words.doc[1:][(hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])]
    repeats = np.bincount(again, minlength=len(column)) / np.maximum(1, np.diff(words.first))
    form = [(out[:, :BUCKETS] > 0).sum(1) / np.maximum(1, np.minimum(total, BUCKETS)), share((data >= 65) & (data <= 90)), share(digits), share(~letters & ~digits & ~blanks & ~breaks), share(blanks), share(breaks), repeats]
    out[:, BUCKETS:] = np.stack(form, 1)
    return out


def weighted(raw: np.ndarray, idf: np.ndarray, form: np.ndarray) -> np.ndarray:
    """Unit vectors of trigrams beside the shares of form in units of their spread."""
    grams = np.log1p(raw[:, :BUCKETS]) * idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-12)
    return np.concatenate([grams, np.clip((raw[:, BUCKETS:] - form[0]) / form[1], -4, 4) * 0.3], axis=1).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", label: str = "quality", learn: Column | None = None, per_label: int = PER_LABEL) -> dict:
    """The latent space and the labelled vectors in it. ``learn`` says which rows of ``docs`` may be learnt from."""
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and id is not null")
    rows = docs.filter(F.lit(True) if learn is None else learn).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, per_label / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_label / max(1, sizes.get(0, 0))))
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30))
    picked = known.filter(place < share * (1 << 30))
    widest = max([min(1.0, per_label / max(1, n)) for n in sizes.values()], default=0.0)
    rows = rows.filter(place < widest * (1 << 30))  # before the join, so that few texts are shuffled

    def measure(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                raw = features(batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.astype(np.float16).tobytes() for x in np.log1p(raw)], pa.binary())], ["label", "raw"])

    sample = rows.join(picked, "id").filter("length(text) > 2").select("label", "text").mapInArrow(measure, "label int, raw binary").orderBy(F.xxhash64("raw"), "label").collect()
    if not sample:
        return {}
    raw = np.expm1(np.stack([np.frombuffer(bytes(r.raw), np.float16) for r in sample]).astype(np.float32))
    votes = np.array([r.label for r in sample], np.float32)
    idf = np.log((1 + len(raw)) / (1 + (raw[:, :BUCKETS] > 0).sum(0))).astype(np.float32) + 1
    form = (raw[:, BUCKETS:].mean(0), raw[:, BUCKETS:].std(0) + 1e-6)
    spread = weighted(raw, idf, form)
    values, vectors = np.linalg.eigh(spread.T.astype(np.float64) @ spread)
    space = vectors[:, ::-1][:, : min(RANK, len(values))].astype(np.float32)
    # Each label gets the same weight in all, times its share among the labelled rows.
    share_of = {k: (votes == k).sum() / max(1, sizes.get(k, 0)) for k in (0, 1)}
    weight = np.where(votes == 1, 1 / max(share_of[1], 1e-9), 1 / max(share_of[0], 1e-9)).astype(np.float32)
    return {"idf": idf, "form": form, "space": space, "vectors": unit(spread @ space), "votes": votes, "weight": weight / weight.max(), "share": float((votes * weight).sum() / weight.sum())}


def nearest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest values of each row; of equal values the first."""
    if k == near.shape[1]:
        return np.tile(np.arange(k), (len(near), 1))
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    tied = (near >= np.take_along_axis(near, best, 1).min(1, keepdims=True)).sum(1) > k
    best[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
    return best


def vote(column: pa.Array, model: dict) -> np.ndarray:
    """Score of each text."""
    if not model:
        return np.full(len(column), 0.5)
    raw = features(column)
    vectors = unit(weighted(raw, model["idf"], model["form"]) @ model["space"])
    near = vectors @ model["vectors"].T
    k = min(NEIGHBOURS, near.shape[1])
    best = nearest(near, k)
    own = np.maximum(np.take_along_axis(near, best, 1), 0) ** 4 * model["weight"][best]
    score = (own * model["votes"][best]).sum(1) / np.maximum(own.sum(1), 1e-12)
    return np.where((raw[:, :BUCKETS].sum(1) == 0) | (own.sum(1) <= 1e-12), model["share"], score).astype(np.float64)


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.clip(vote(batch.column(1).slice(a, b - a), shared.value), 0, 1))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
