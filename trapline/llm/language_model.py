"""Hidden Markov language model: latent states emit word classes, and classes emit words.

Tokens are runs without blanks after lower-casing A-Z, then one end for each text; null and empty texts are an end alone. A word's class
is a hash of its first two and last three bytes into ``CLASSES`` - 1, the end has the last class to itself. The model's probability of a
text is the sum over state paths of the product of start, transition and P(class | state), times P(word | class) of each token:

* Baum-Welch trains the states: ``ROUNDS`` rounds from a fixed beginning, each over all training texts at every size of input. Long texts
  are worked on in stretches of ``LONG`` tokens that take the states before and the tokens after them into account, so counts are those
  of whole texts. Each task adds up its expected counts, Spark adds them over all tasks, and a model of fixed size comes back.
* P(word | class) is its share of the class in training, less the share u of words unseen, which one unknown word for each class gets;
  u is the share of tokens whose word occurs once in training. A class without training tokens has only its unknown word.
* Scoring runs the scaled forward recursion over whole texts, so the likelihood is exact under the model.

Word counts of the whole corpus reach the texts through the key exchange: batches send the distinct words they hold and get their counts
back. Without any training text every word is unknown and every class equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.llm.exchange import SENT, answered, buckets_for, filled, opened, sent
from trapline.llm.shared import batch_count, stored, with_batch
from trapline.llm.words import Words, blank_separated, lowered, mixed, packed, row_slices, unpacked, utf8

STATES = 6
CLASSES = 1 << 15
END = CLASSES - 1
#: Tokens of a whole text that are worked on in a row; no result depends on it.
LONG = 1024
#: Rounds of Baum-Welch over all texts.
ROUNDS = 15
#: Weight of the overall class shares, in tokens, in each state's emissions.
PRIOR = 50.0
CHUNK_BYTES = 4_000_000
#: Tokens, and stretches, that are worked on side by side.
TOGETHER = 1 << 20
ABREAST = 4096
END_KEY = np.uint64(0xE4D0000000000001)


def tokenised(column: pa.Array | pa.ChunkedArray) -> Words:
    data, offsets = utf8(column)
    return Words(lowered(data), offsets, blank_separated())


def classes_of(words: Words) -> np.ndarray:
    """Class of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    at = lambda place: words.data[place].astype(np.uint64)
    last = words.ends - 1
    code = at(words.starts) | at(np.minimum(words.starts + 1, last)) << np.uint64(8)
    for back in range(3):
        code |= at(np.maximum(last - back, words.starts)) << np.uint64(16 + 8 * back)
    return (mixed(code + np.uint64(1)) % np.uint64(END)).astype(np.int64)


def with_ends(values: np.ndarray, words: Words, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all tokens, ends included, and where each text's begin."""
    return np.insert(values, words.first[1:], end), words.first + np.arange(len(words.first))


def sequences(docs: DataFrame, text: str) -> DataFrame:
    """(classes): for each text its tokens' classes as 16-bit numbers."""

    def run(batches):
        for batch in batches:
            _, offsets = utf8(batch.column(0))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                words = tokenised(batch.column(0).slice(a, b - a))
                values, bounds = with_ends(classes_of(words).astype(np.uint16), words, np.uint16(END))
                blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int64) * 2), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([blob.cast(pa.binary())], ["classes"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "classes binary")


class Model:
    """Start, transition and emission probabilities; emissions are a row for each class. Its arrays are broadcast, not itself, so that a
    worker can open them without this package."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray):
        self.start, self.step, self.emit, self.tokens = start, step, emit, tokens

    @classmethod
    def first(cls) -> Model:
        """States that differ a little and tend to stay."""
        wobble = 0.5 + (mixed(np.arange(CLASSES * STATES, dtype=np.uint64)) >> np.uint64(11)).astype(np.float64).reshape(CLASSES, STATES) / 2**53
        step = np.full((STATES, STATES), 0.02 / (STATES - 1))
        np.fill_diagonal(step, 0.98)
        return cls(np.full(STATES, 1 / STATES), step, wobble / wobble.sum(0), np.zeros(CLASSES))

    @classmethod
    def from_counts(cls, start: np.ndarray, step: np.ndarray, emit: np.ndarray, tokens: np.ndarray) -> Model:
        share = (tokens + 0.01) / (tokens.sum() + 0.01 * CLASSES)
        emit = emit + PRIOR * share[:, None]
        step, start = step + 1e-3, start + 1e-3
        return cls(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0), tokens)


def longest_first(length: np.ndarray):
    """Stretches from the longest, some at a time: which ones, and how many of them reach each place."""
    order, low = np.argsort(-length, kind="stable"), 0
    while low < len(order):
        own = order[low : low + min(ABREAST, max(1, TOGETHER // int(length[order[low]])))]
        size = length[own]
        low += len(own)
        yield own, np.searchsorted(-size, -np.arange(size[0]), "left").tolist()


def by_state(table: np.ndarray) -> np.ndarray:
    """A row for each state, so that steps run along many stretches at once."""
    return np.ascontiguousarray(table.T, np.float32)


def transfers(classes: np.ndarray, begin: np.ndarray, length: np.ndarray, model: Model) -> np.ndarray:
    """For each stretch and each state of its first token the probability of its tokens and the state of the last, up to a factor a stretch."""
    found = np.empty((len(begin), STATES, STATES))
    back, emit = by_state(model.step), by_state(model.emit / np.maximum(model.emit.sum(1, keepdims=True), 1e-300))
    for own, live in longest_first(length):
        now = np.repeat(np.eye(STATES, dtype=np.float32)[:, :, None], len(own), 2)  # state of the first token, of this one, stretch
        for t, n in enumerate(live):
            now = (back @ now[:, :, :n] if t else now) * emit.take(classes[begin[own[:n]] + t], axis=1)
            if t % 2:  # emission shares go down to PRIOR / tokens, so two of them stay far above the least float
                now /= now.sum((0, 1))
            done = live[t + 1] if t + 1 < len(live) else 0
            if done < n:
                found[own[done:n]] = now[:, :, done:].transpose(2, 0, 1)
    return found


def borders(classes: np.ndarray, begin: np.ndarray, length: np.ndarray, parts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch the states' shares before its first token is seen and, up to a factor, the probability of all tokens after it given
    the state of its last; and the expected steps between stretches of a text. ``parts`` is the number of stretches of each text."""
    before, after, steps = np.repeat(model.start[None, :], len(begin), 0), np.ones((len(begin), STATES)), np.zeros((STATES, STATES))
    cut = np.flatnonzero(np.repeat(parts, parts) > 1)
    if not len(cut):
        return before, after, steps
    ended, at = np.empty((len(begin), STATES)), np.empty(len(begin), np.int64)
    at[cut] = np.arange(len(cut))
    through = transfers(classes, begin[cut], length[cut], model)
    order = np.argsort(-parts, kind="stable")
    first, most = (np.cumsum(parts) - parts)[order], parts[order]
    later = [first[: np.searchsorted(-most, -k, "left")] + k for k in range(1, most[0])]  # the second stretch of each text, the third and so on
    for own in later:
        end = np.einsum("ns,nst->nt", before[own - 1], through[at[own - 1]])
        ended[own - 1] = end / end.sum(1, keepdims=True)
        before[own] = ended[own - 1] @ model.step
    for own in reversed(later):
        ahead = np.einsum("nst,nt->ns", through[at[own]], after[own])
        ahead /= (before[own] * ahead).sum(1, keepdims=True)
        steps += model.step * (ended[own - 1].T @ ahead)
        after[own - 1] = ahead @ model.step.T
    return before, after, steps


def expected(classes: np.ndarray, bounds: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, steps and (class, state) over whole texts."""
    parts = -(-np.diff(bounds) // LONG)
    place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(bounds[:-1], parts) + LONG * place
    length = np.minimum(LONG, np.repeat(bounds[1:], parts) - begin)
    before, after, steps = borders(classes, begin, length, parts, model)
    starts, emits = np.zeros(STATES), np.zeros((STATES, CLASSES))
    step, back, emit = model.step.astype(np.float32), by_state(model.step), by_state(model.emit)
    for own, live in longest_first(length):
        symbols = classes[np.concatenate([begin[own[:n]] + t for t, n in enumerate(live)])]
        edges = np.cumsum([0, *live]).tolist()
        outs = emit.take(symbols, axis=1)
        alphas, now = np.empty_like(outs), by_state(before[own])
        for t, n in enumerate(live):
            out = outs[:, edges[t] : edges[t + 1]]
            now = (back @ now[:, :n] if t else now) * out
            total = now.sum(0)
            now /= total
            out /= total
            alphas[:, edges[t] : edges[t + 1]] = now
        rest, ahead, done = by_state(after[own]), None, 0
        for t in range(len(live) - 1, -1, -1):
            n, alpha = live[t], alphas[:, edges[t] : edges[t + 1]]
            beta = rest[:, :n].copy()
            if done < n:
                beta[:, done:] /= (alpha[:, done:] * beta[:, done:]).sum(0)
            if done:
                steps += step * (alpha[:, :done] @ ahead.T)
                beta[:, :done] = step @ ahead
            ahead, done = outs[:, edges[t] : edges[t + 1]] * beta, n
            alpha *= beta
        alphas /= alphas.sum(0)
        starts += alphas[:, : live[0]][:, place[own] == 0].sum(1, dtype=np.float64)
        for k in range(STATES):
            emits[k] += np.bincount(symbols, alphas[k], minlength=CLASSES)
    return starts, steps, emits.T


def one_round(texts: DataFrame, model: Model) -> Model:
    """Baum-Welch counts of all tasks added up, and the model they give. Without texts the model stays."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(vars(model))

    def count(batches):
        now, total = Model(**shared.value), None
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in row_slices(offsets, CHUNK_BYTES):
                bounds = (offsets[a : b + 1] - offsets[a]) // 2
                classes = np.frombuffer(data[offsets[a] : offsets[b]].tobytes(), np.uint16)
                found = [*expected(classes, bounds, now), np.bincount(classes, minlength=CLASSES).astype(np.float64)]
                total = found if total is None else [x + y for x, y in zip(total, found)]
        if total is not None:
            starts, steps, emits, tokens = total
            own = np.flatnonzero(tokens)
            place = np.concatenate([own, CLASSES + np.arange(STATES + 1)])  # after the classes the steps from each state, then the starts
            values = np.concatenate([emits[own], steps, starts[None, :]])
            seen = np.concatenate([tokens[own], np.zeros(STATES + 1)])
            yield pa.RecordBatch.from_arrays([pa.array(place), *map(pa.array, values.T.copy()), pa.array(seen)], ["place", *names])

    names = [*(f"state_{k}" for k in range(STATES)), "tokens"]
    counted = texts.mapInArrow(count, ", ".join(["place long", *(f"{n} double" for n in names)]))
    rows = counted.groupBy("place").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    shared.unpersist()
    if not rows.num_rows:
        return model
    table = np.zeros((CLASSES + STATES + 1, STATES + 1))
    table[rows.column("place").to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names], 1)
    return Model.from_counts(table[-1, :STATES], table[CLASSES:-1, :STATES], table[:CLASSES, :STATES], table[:CLASSES, STATES])


def train(docs: DataFrame, text: str = "text", learn: Column | None = None) -> Model:
    """The states' model from all texts that may be learnt from."""
    texts = stored(sequences(docs.filter(F.lit(True) if learn is None else learn), text))
    model = Model.first()
    for _ in range(ROUNDS):
        model = one_round(texts, model)
    return model


def forward(classes: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """log10 probability of each text's classes: the forward recursion over whole texts, scaled at each token."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    begin, size = bounds[:-1][order], sizes[order]
    live = np.searchsorted(-size, -np.arange(size[0]), "left") if len(size) else []
    out, now = np.zeros(len(size)), model.start[None, :]
    scale = np.ones(len(size))
    for t, n in enumerate(live):
        now = (now if t == 0 else now[:n] @ model.step) * model.emit[classes[begin[:n] + t]]
        total = now.sum(1)
        now = now / total[:, None]
        scale[:n] *= total
        if t % 16 == 15:
            out += np.log10(scale)
            scale[:] = 1
    out += np.log10(scale)
    back = np.empty(len(size))
    back[order] = out
    return back


class Counted:
    """The words of one batch and the keys it sends, the same whenever it is built again."""

    def __init__(self, rows: pa.Table):
        self.ids, held = rows.column("doc_id").combine_chunks(), rows.column("held").combine_chunks()
        self.held = held.fill_null(False).to_numpy(zero_copy_only=False)
        self.words = tokenised(rows.column("text"))
        tokens, self.bounds = with_ends(self.words.hashes(), self.words, END_KEY)
        self.keys, self.inverse = np.unique(tokens, return_inverse=True)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.bounds))

    def training_counts(self) -> np.ndarray:
        return np.bincount(self.inverse[~self.held[self.doc]], minlength=len(self.keys)).astype(np.uint64)


def counted_over(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a bucket's distinct keys over all batches, and which of them each entry is."""
    numbers = np.concatenate([unpacked(c, len(k)) for k, c in zip(keys, counts)])
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return np.bincount(inverse, numbers.astype(np.float64), minlength=len(distinct)).astype(np.uint64), inverse


def add_counts(keys: list, counts: list) -> list:
    """For each row the counts of its keys over all batches."""
    total, inverse = counted_over(keys, counts)
    return [packed(t) for t in np.split(total[inverse], np.cumsum([len(k) for k in keys])[:-1])]


def totals(rows: DataFrame, buckets: int) -> DataFrame:
    """One row with ``totals``: training tokens, distinct words and words that occur once, over all buckets."""

    def count(table: pa.Table) -> pa.Table:
        total, _ = counted_over(opened(table, buckets, 64), table.column("extra").to_pylist())
        return pa.table({"tokens": [int(total.sum())], "distinct": [int((total > 0).sum())], "once": [int((total == 1).sum())]})

    names = ("tokens", "distinct", "once")
    each = rows.groupBy("bucket").applyInArrow(count, ", ".join(f"{n} long" for n in names))
    return each.agg(F.array(*[F.coalesce(F.sum(n), F.lit(0)) for n in names]).alias("totals"))


def score(docs: DataFrame, model: Model, held: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row. Words are counted in rows that are not ``held``."""
    batches = batch_count(docs, text)
    buckets = buckets_for(batches)
    flagged = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    dealt = with_batch(flagged, "doc_id", "text", batches, "held")
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def send(rows: pa.Table) -> pa.Table:
        batch = Counted(rows)
        counts = batch.training_counts()
        return sent(rows.column("batch")[0].as_py(), batch.keys, buckets, 64, lambda own: packed(counts[own]))

    def measure(rows: pa.Table, news: pa.Table) -> pa.Table:
        batch, now = Counted(rows), Model(**shared.value)
        counts, own = np.zeros(len(batch.keys), np.int64), dict(filled(batch.keys, buckets, 64))
        for bucket, reply in zip(news.column("bucket_in").to_pylist(), news.column("reply_in").to_pylist()):
            counts[own[bucket]] = unpacked(reply, own[bucket].stop - own[bucket].start).view(np.int64)
        tokens, distinct, once = news.column("totals_in")[0].as_py()
        seen = counts[batch.inverse]
        classes, _ = with_ends(classes_of(batch.words), batch.words, END)
        texts = len(batch.ids)
        add = lambda values: np.bincount(batch.doc, values, minlength=texts)
        base = add(np.log10((seen + 0.1) / (tokens + 0.1 * (distinct + 1))))
        of_class, known = now.tokens[classes], seen > 0
        unseen = min(max(once / max(tokens, 1), 1 / (tokens + 1)), 0.5)
        within = np.where(known, np.log10((1 - unseen) * np.maximum(seen, 1) / np.maximum(of_class, 1)), np.where(of_class > 0, np.log10(unseen), 0.0))
        within[classes == END] = 0.0
        scores = forward(classes, batch.bounds, now) + add(within)
        columns = [batch.ids, pa.array(batch.held), pa.array(np.diff(batch.bounds)), pa.array(add(known).astype(np.int64)), pa.array(np.full(texts, tokens)), pa.array(base), pa.array(scores)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    words = dealt.groupBy("batch").applyInArrow(send, SENT)
    counted = answered(words, buckets, 64, add_counts).withColumn("totals", totals(words, buckets).scalar())
    counted = counted.select(*[F.col(c).alias(f"{c}_in") for c in counted.columns])
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("batch").cogroup(counted.groupBy("batch_in")).applyInArrow(measure, kind)
