"""Merkle manifest of a data set: a tree of digests for each group of rows, a tree over the groups, and a proof for every row.

Nodes are swept in the order of their labels (time-forward processing). A node sends its digest as a message to its parent's label; a
priority queue hands each node the messages for its label. Inside a block of ``BLOCK`` neighbouring nodes the queue is a heap of a few
entries; messages that leave a block are rows of a stored table, which the next exchange sorts by label (Spark's sort, which spills), so
the queue as a whole is external and no task holds more than one block. A second sweep runs the labels backwards: a parent's message
carries the siblings on the way from it to the root, and each leaf ends with its whole proof.

Leaves of a group are ordered by id, equal ids by their digest; a null id comes first, and rows that are equal throughout are leaves of
their own. Groups are ordered by name, null first, bytewise. Null fields count as ``-``, which no value is written as. An empty table has
no leaves, no root and no rows. Further columns play no part unless they are named in ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.functions.ordered import ranked
from trapline.llm.shared import stored

#: Children of a node, levels that one sweep climbs, and nodes of a block.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, ``-`` if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(total: int) -> int:
    """Levels that a sweep climbs over a block of a group of ``total`` nodes."""
    levels = 0
    while total > 1 and levels < LEVELS:
        total, levels = -(-total // FAN), levels + 1
    return levels


class Block:
    """One block's nodes. The label of a node is (the last place it covers, its level), so children come before their parents."""

    def __init__(self, digests: list[str], total: int):
        self.digests, self.levels = digests, levels_of(total)

    def labels(self) -> Iterator[tuple[int, int, int]]:
        """(last place, level, number in its level) of all nodes in ascending order."""
        last = len(self.digests) - 1
        for place in range(last + 1):
            for level in range(self.levels + 1):
                width = FAN**level
                if (place + 1) % width and place != last:
                    break
                yield place, level, place // width

    def parent(self, level: int, number: int) -> tuple[int, int]:
        """Label of a node's parent."""
        return min((number // FAN + 1) * FAN ** (level + 1), len(self.digests)) - 1, level + 1

    def sweep(self) -> tuple[str, dict[tuple[int, int], list[str]]]:
        """Digest of the block's top, and the messages that each inner node got, in order."""
        queue: list[tuple[tuple[int, int], int, str]] = []
        got: dict[tuple[int, int], list[str]] = {}
        top = ""
        for place, level, number in self.labels():
            if level:
                parts = []
                while queue and queue[0][0] == (place, level):
                    parts.append(heapq.heappop(queue)[2])
                got[level, number], top = parts, digest(parts)
            else:
                top = self.digests[place]
            if level < self.levels:
                heapq.heappush(queue, (self.parent(level, number), number, top))
        return top, got

    def proofs(self, path: list[dict]) -> list[list[dict]]:
        """Siblings on the way from each of the block's nodes to the root; ``path`` is the way from the block's top."""
        _, got = self.sweep()
        ways: list[list[dict]] = [path] * len(self.digests)
        queue = [((-(len(self.digests) - 1), -self.levels), 0, path)] if self.digests else []
        while queue:
            (_, level), number, way = heapq.heappop(queue)
            if not level:
                ways[number] = way
                continue
            parts = got[-level, number]
            for n, _ in enumerate(parts):
                child = number * FAN + n
                last = min((child + 1) * FAN ** (-level - 1), len(self.digests)) - 1
                own = {"left": "".join(parts[:n]), "right": "".join(parts[n + 1 :])}
                heapq.heappush(queue, ((-last, level + 1), child, [own, *way]))
        return ways


def blocks(batches) -> Iterator[pa.Table]:
    """The rows of each block from batches sorted by (team, block)."""
    waiting, last = [], None
    for batch in batches:
        begin = 0
        labels = list(zip(batch.column("team").to_pylist(), batch.column("block").to_pylist()))
        for at, label in enumerate(labels):
            if label != last and (waiting or at > begin):
                if at > begin:
                    waiting.append(batch.slice(begin, at - begin))
                yield pa.Table.from_batches(waiting)
                waiting, begin = [], at
            last = label
        if len(labels) > begin:
            waiting.append(batch.slice(begin))
    if waiting:
        yield pa.Table.from_batches(waiting)


def by_label(nodes: DataFrame) -> DataFrame:
    """Whole blocks in a task, their rows in order."""
    return nodes.repartition("team", "block").sortWithinPartitions("team", "block", "place")


def climbed(nodes: DataFrame) -> DataFrame:
    """(team, place, total, digest) of the blocks' tops."""

    def run(batches):
        for rows in blocks(batches):
            total = rows.column("total")[0].as_py()
            top, _ = Block([d.hex() for d in rows.column("digest").to_pylist()], total).sweep()
            first = rows.slice(0, 1)
            values = [first.column("team"), first.column("block"), pa.array([-(-total // BLOCK)]), pa.array([bytes.fromhex(top)], pa.binary())]
            yield from pa.table(values, names=["team", "place", "total", "digest"]).to_batches()

    tops = by_label(nodes.select("team", block(), "place", "total", "digest"))
    return tops.mapInArrow(run, T.StructType([nodes.schema["team"], *T.StructType.fromDDL("place long, total long, digest binary")]))


def block() -> Column:
    return F.floor(F.col("place") / F.lit(BLOCK)).cast("long").alias("block")


def tree(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes (team, place, total, digest), from the given ones up to one node for each team; at least two."""
    rounds = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1 or len(rounds) == 1:
        rounds.append(stored(climbed(rounds[-1])))
        most = -(-most // BLOCK)
    return rounds


def proven(nodes: DataFrame, tops: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``nodes`` with ``path`` and ``top``, from ``tops`` (team, place, path, top): the path of each block's top and its tree's digest."""
    kept = nodes.select(*keep).schema
    nothing = {"total": "long", "digest": "binary", **{f.name: f.dataType for f in kept}}
    sent = tops.withColumns({"block": F.col("place"), "place": F.lit(-1).cast("long"), **{name: F.lit(None).cast(kind) for name, kind in nothing.items()}})
    own = nodes.select("team", block(), "place", "total", "digest", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("binary").alias("top"), *keep)
    fields = ["team", "place", "digest", *[f.name for f in kept]]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def run(batches):
        for rows in blocks(batches):
            (path, top), rows = (rows.column(c)[0].as_py() for c in ("path", "top")), rows.slice(1)
            ways = Block([d.hex() for d in rows.column("digest").to_pylist()], rows.column("total")[0].as_py()).proofs(path)
            columns = [*[rows.column(name) for name in fields], pa.array(ways, kind), pa.array([top] * len(ways), pa.binary())]
            yield from pa.table(columns, names=[*fields, "path", "top"]).to_batches()

    return by_label(own.unionByName(sent)).mapInArrow(run, T.StructType([*nodes.select(*fields).schema, *T.StructType.fromDDL(f"path {PATH}, top binary")]))


def descended(rounds: list[DataFrame], tops: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The first table of ``rounds`` with each node's path and ``top``, from ``tops`` (team, place 0, path, top) of the last one's nodes."""
    for level in range(len(rounds) - 2, -1, -1):
        tops = proven(rounds[level], tops, keep if level == 0 else ())
    return tops


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) and the columns of ``keep`` for each row. Digests are lower-case hexadecimal; ``proof`` lists the
    siblings to the left and to the right of the node on the way, level by level from the leaf through its group's tree to the root."""
    own = F.unhex(leaf(*[F.col(c) for c in fields])).alias("digest")
    kept = F.struct(F.lit(0).alias("k"), *[F.col(c).alias(f"k{n}") for n, c in enumerate(keep)]).alias("kept")
    rows = stored(docs.select(F.col(group).cast("string").alias("team"), F.col(order).cast("long").alias("doc_id"), own, kept, F.monotonically_increasing_id().alias("row")))
    low = tree(placed(rows, ["doc_id", "digest", "row"]))
    subroots = low[-1].select(F.lit(None).cast("string").alias("team"), "digest", F.col("team").alias("name"), F.col("digest").alias("subroot"))
    high = tree(placed(subroots, ["name"]))
    start = high[-1].select("team", "place", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("top"))
    groups = descended(high, start, ["name", "subroot"]).select(F.col("name").alias("team"), F.lit(0).cast("long").alias("place"), "path", F.col("subroot").alias("top"))
    root = high[-1].select("digest").first()
    hexed = lambda c: F.lower(F.hex(c))
    shown = [hexed("digest").alias("leaf"), hexed("top").alias("subroot"), F.lit(root and root.digest.hex()).cast("string").alias("root"), F.col("path").alias("proof")]
    return descended(low, groups, ["doc_id", "kept"]).select("doc_id", *shown, *[F.col("kept")[f"k{n}"].alias(c) for n, c in enumerate(keep)])


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with the number of each in its team, from 0, and the team's rows."""
    return ranked(rows, ["team"], order, "place", "total").withColumn("place", F.col("place") - 1)


def siblings(proof: Column) -> Column:
    """All digests of a proof in a row."""
    return F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), "")


def folded(own: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof give."""
    return F.aggregate(proof, own, lambda below, x: F.sha2(F.concat(x["left"], below, x["right"]), 256))
