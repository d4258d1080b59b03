"""Near-duplicate documents by an inverted join over MinHash coordinates, confirmed on full shingle sets.

Words are runs without blanks after lower-casing A-Z; a document's set holds its distinct shingles of ``size`` words, or with fewer words
the whole sequence as one. Documents with equal sets are one class, represented by the smallest id. Each class has a signature of
``COORDINATES`` minima and is posted under each (coordinate, value) pair.

* Values that one class alone has are dropped. Of the rest each class skips its most frequent ones: a pair that agrees in at least
  ``matches`` coordinates also meets in the ``COORDINATES - matches + 1`` rarest of either, in an order common to all.
* In each posting list the classes are first paired with the list's smallest id only. Confirmed pairs form components.
* Lists that still hold several components are merged in blocks that fit a task: signatures of different components are compared. Classes
  that agree in ``matches`` coordinates with one of another component, and components that such pairs join to groups, are kept, not pairs.
* The kept classes of each group are compared on full sets, in blocks again; a block gives links enough to join what its links join.
* Components are found by alternating stars, with a stored table each round.

Every pair that is compared has either met in a posting list or lies in one group; work in a group is quadratic in the classes that are
still apart from others there, and no task holds more than two blocks of it.

``matches`` is the largest count that a pair at the similarity misses with a probability below ``MISS``. Empty and null texts have no set
and are linked with nothing, like rows with a null id. Rows of equal id are judged each. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm.shared import free_name, stored
from trapline.llm.words import Words, blank_separated, lowered, mixed, packed, row_slices, unpacked, utf8, windows

SIMILARITY = 0.8
COORDINATES = 48
MISS = 1e-7
#: Classes of a posting list that are compared with each other in one task.
BLOCK = 512
CHUNK_BYTES = 2_000_000
#: Bits of a shingle's hash in the sets that are compared.
SET_BITS = 48


def matches_at(similarity: float, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of agreeing coordinates that a pair of this similarity has but for a probability of ``miss``."""
    below, count = 0.0, 0
    while True:
        below += math.comb(coordinates, count) * similarity**count * (1 - similarity) ** (coordinates - count)
        if below > miss or count == coordinates:
            return max(1, count)
        count += 1


def shingle_sets(column: pa.Array, size: int):
    """For each text its distinct shingle hashes, ascending."""
    data, offsets = utf8(column)
    for a, b in row_slices(offsets, CHUNK_BYTES):
        words = Words(lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], blank_separated())
        hashes, counts = words.hashes(), np.diff(words.first)
        at, found = windows(words, hashes, size)
        bounds = np.searchsorted(words.doc[at], np.arange(b - a + 1))
        short = {}
        for length in range(1, size):
            for start, value in zip(*windows(words, hashes, length)):
                if counts[words.doc[start]] == length:
                    short[int(words.doc[start])] = np.array([value], np.uint64)
        yield [short[d] if d in short else np.unique(found[bounds[d] : bounds[d + 1]]) for d in range(b - a)]


def signatures_of(sets: list[np.ndarray]) -> np.ndarray:
    """A row of minima for each set; sets without shingles have a row of zeros."""
    out, filled = np.zeros((len(sets), COORDINATES), np.uint32), [i for i, s in enumerate(sets) if len(s)]
    if not filled:
        return out
    values = np.concatenate([sets[i] for i in filled])
    starts = np.cumsum([0, *(len(sets[i]) for i in filled[:-1])])
    turns, factors = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64)), mixed(np.arange(1001, COORDINATES + 1001, dtype=np.uint64)) | np.uint64(1)
    for c in range(COORDINATES):
        out[filled, c] = np.minimum.reduceat((((values ^ turns[c]) * factors[c]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, n_shingles, digest, signature); ``digest`` stands for the set and is null without shingles."""

    def run(batches):
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(1), size):
                rows = signatures_of(sets)
                digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    ["doc_id", "n_shingles", "digest", "signature"],
                )
                done += len(sets)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, signature binary")


def postings(classes: DataFrame) -> DataFrame:
    """(key, id): a row for each coordinate of each class."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint64)
            keys = mixed(rows | np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32))
            ids = np.repeat(batch.column(0).to_numpy(), COORDINATES)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return classes.select("id", "signature").mapInArrow(run, "key long, id long")


def prefixes(posted: DataFrame, matches: int) -> DataFrame:
    """(key, id, n): the rarest coordinates of each class, without values that it alone has and without the ``matches - 1`` most frequent."""
    common = posted.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    known = posted.join(common, "key")
    own = Window.partitionBy("id")
    ranked = known.withColumns({"rank": F.row_number().over(own.orderBy("n", "key")), "all": F.count("*").over(own)})
    return ranked.filter(F.col("rank") <= F.col("all") - (matches - 1)).select("key", "id", "n")


def in_blocks(rows: DataFrame, key: str, id_: str) -> DataFrame:
    """``rows`` once for each pair of blocks (low, high) of its group that it belongs to; ``own`` is its block. Groups of up to ``BLOCK`` rows
    are one block, larger ones are cut by a hash."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, key).withColumn("own", F.pmod(F.xxhash64(id_, key), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("blocks", "other")


class Joined:
    """Labels that have been joined so far, in one task."""

    def __init__(self):
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while self.above.get(x, x) != x:
            self.above[x] = self.above.get(self.above[x], self.above[x])
            x = self.above[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether this was new."""
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def candidates(lists: DataFrame, classes: DataFrame, matches: int, similarity: float) -> DataFrame:
    """(a, b, touched): what posting lists show about classes of different components that agree in ``matches`` coordinates and whose sizes
    allow the similarity. Rows with ``touched`` null join two components, at most one row for each component of a block; the others name a
    class that has such a partner."""
    rows = in_blocks(lists, "key", "id").join(classes.select("id", "n_shingles", "signature"), "id").select("key", "low", "high", "own", "id", "component", "n_shingles", "signature")

    def compare(key, table):
        _, low, high = (k.as_py() for k in key)
        ids, component, size, own = (table.column(c).to_numpy() for c in ("id", "component", "n_shingles", "own"))
        rows = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
        first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
        touched, joined, edges = np.zeros(len(ids), bool), Joined(), []
        for i in first:
            with_ = second[(component[second] != component[i]) & (size[second] >= similarity * size[i]) & (size[i] >= similarity * size[second])]
            with_ = with_[(rows[with_] == rows[i]).sum(axis=1) >= matches]
            if len(with_):
                touched[i] = touched[with_] = True
                edges += [(int(component[i]), int(c)) for c in np.unique(component[with_]) if joined.join(int(component[i]), int(c))]
        found = ids[touched]
        a, b = [x for x, _ in edges], [y for _, y in edges]
        return pa.table({"a": pa.array(a + [None] * len(found), pa.int64()), "b": pa.array(b + [None] * len(found), pa.int64()), "touched": pa.array([None] * len(edges) + found.tolist(), pa.int64())})

    return rows.groupBy("key", "low", "high").applyInArrow(compare, "a long, b long, touched long").distinct()


def confirmed_in_groups(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between classes of different components in each group, on full sets; of all links of a block, enough to join what they join.

    ``members`` has group, id, component, n and packed.
    """
    rows = in_blocks(members, "group", "id").select("group", "low", "high", "own", "id", "component", "n", "packed")
    per_cent = round(similarity * 100)

    def compare(key, table):
        _, low, high = (k.as_py() for k in key)
        ids, component, size, own = (table.column(c).to_numpy() for c in ("id", "component", "n", "own"))
        sets = [np.cumsum(unpacked(blob, n), dtype=np.uint64) for blob, n in zip(table.column("packed").to_pylist(), size.tolist())]
        first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
        both = intersections(sets, first, second)
        close = (100 * both >= per_cent * (size[first][:, None] + size[second][None, :] - both)) & (component[first][:, None] != component[second][None, :])
        joined = Joined()
        links = [(int(ids[first[i]]), int(ids[second[j]])) for i, j in zip(*np.nonzero(close)) if joined.join(int(component[first[i]]), int(component[second[j]]))]
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return rows.groupBy("group", "low", "high").applyInArrow(compare, "a long, b long")


def intersections(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each of the ``first`` sets with each of the ``second``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    renumbered = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], renumbered[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width, total = np.zeros((len(first), len(second)), np.float64), 8192, int((counts > 1).sum())
    for low in range(0, total, width):
        a, b = np.searchsorted(column, [low, low + width])
        part = np.zeros((len(sets), min(width, total - low)), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        out += part[first] @ part[second].T
    return out


def set_table(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, n, packed): the shingle sets of the documents named in ``ids``."""

    def run(batches):
        for batch in batches:
            done = 0
            for sets in shingle_sets(batch.column(1), size):
                short = [np.unique(s >> np.uint64(64 - SET_BITS)) for s in sets]
                blobs = [packed(np.diff(s, prepend=np.uint64(0))) for s in short]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(sets)), pa.array([len(s) for s in short], pa.int64()), pa.array(blobs, pa.binary())], ["id", "n", "packed"])
                done += len(sets)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")
    return rows.mapInArrow(run, "id long, n long, packed binary")


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked for."""
    per_cent = round(similarity * 100)

    def run(batches):
        for batch in batches:
            a, b, n, m, left, right = (c.to_pylist() for c in batch.columns)
            kept = []
            for i in range(batch.num_rows):
                x, y = (np.cumsum(unpacked(blob, k), dtype=np.uint64) for blob, k in ((left[i], n[i]), (right[i], m[i])))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= per_cent * (n[i] + m[i] - both))
            keep = pa.array(kept, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    left = sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("packed").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("packed").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b): the smallest id that can be reached. Alternating large and small stars."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    while True:
        # Large star: every larger neighbour of a node points to the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours and itself point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        then = stored(small)
        sums = [d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first() for d in (now, then)]
        now = then
        if sums[0] == sums[1]:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``."""
    matches = matches_at(similarity)
    signed = stored(signatures(docs, doc_id, text, size))
    filled = signed.filter("digest is not null and doc_id is not null")
    first = filled.groupBy("digest").agg(F.min("doc_id").alias("id"))
    classes = stored(filled.join(first, (filled.digest == first.digest) & (filled.doc_id == first.id)).select("id", "n_shingles", "signature").dropDuplicates(["id"]))
    lists = stored(prefixes(postings(classes), matches))

    heads = lists.groupBy("key").agg(F.min("id").alias("a"))
    stars = lists.join(heads, "key").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    sizes = classes.select("id", "n_shingles")
    stars = stars.join(sizes.select(F.col("id").alias("a"), F.col("n_shingles").alias("n")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n_shingles").alias("m")), "b")
    stars = stored(stars.filter((F.col("n") >= similarity * F.col("m")) & (F.col("m") >= similarity * F.col("n"))).select("a", "b"))
    sets = stored(set_table(docs, lists.select("id").distinct(), doc_id, text, size).dropDuplicates(["id"]))
    links = stored(confirmed(stars, sets, similarity))

    found = components(links)
    placed = lists.select("key", "id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("key")
    near = stored(candidates(placed.join(several, "key"), classes, matches, similarity))
    groups = components(near.filter("touched is null").select("a", "b"))
    touched = near.filter("touched is not null").select(F.col("touched").alias("id")).distinct().join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = touched.join(groups.select(F.col("id").alias("component"), F.col("component").alias("group")), "component").join(sets, "id")
    links = links.unionByName(stored(confirmed_in_groups(members, similarity)))
    found = components(links)

    members = filled.select("doc_id", "digest").distinct().join(first, "digest").join(found, "id", "left")
    placed = members.select(F.col("doc_id").alias("member"), F.col("digest").alias("member_digest"), F.coalesce("component", "id").alias("component"))
    rows = signed.join(placed, (signed.doc_id == F.col("member")) & (signed.digest == F.col("member_digest")), "left")
    component = F.coalesce("component", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns. Rows that share an id stay or go together."""
    gone = free_name(docs, "dropped_id")
    dropped = near_duplicates(docs, doc_id, text, size, similarity).filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(doc_id).cast("long") == F.col(gone), "left_anti")
