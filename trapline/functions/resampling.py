"""Reproducible draws with replacement. Plain 64-bit integer steps, so numpy and SQL give the same numbers.

A sample of n out of n members is drawn in two steps, so that no task draws or holds all of them. Members lie in slices of ``SLICE``.
First every place of the sample draws its slice; ranges of places are worked on apart, and only the number of places that fell in each
slice is kept. Then each slice draws that many of its own members. Together that is two draws for each place, however many slices there
are; a group of one slice needs the second step alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.pairing import spread

# Members of a slice, places of a sample whose slices one task draws, and iterations of a task.
SLICE = 2_000
PLACES = 100_000
ITERATION_BLOCK = 1_000
# Draws that are held at once.
AT_ONCE = 4_000_000

# Fixed values of the mixer.
MODULUS = 2147483647
START = (48271, 69621, 16807)
ROUNDS = (40692, 48271, 69621)
# What is added to the seed for the draws of slices, and to the key for the members of each further slice.
SLICE_SEED, SLICE_KEY = 1000003, 7919


def draw_key(*parts: Column | str) -> Column:
    """Whole number below 2^28 from the text of a group, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 7), 16, 10).cast("bigint")


def mixed(key: int, iteration: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A number for every (iteration, place)."""
    x = (key * START[0] + iteration * START[1] + place * START[2] + seed) % MODULUS
    for a in ROUNDS:
        x = ((x * x) % MODULUS + (a * x) % MODULUS + place + iteration) % MODULUS
    return x


def slice_sizes(key: int, iterations: np.ndarray, n: int, seed: int, low: int, high: int, width: int) -> np.ndarray:
    """How many of the places low..high-1 fall in each slice of ``width`` of the n members: iterations x slices."""
    slices = -(-n // width)
    out = np.zeros((len(iterations), slices), np.int64)
    step = max(1, AT_ONCE // max(high - low, 1))
    for at in range(0, len(iterations), step):
        own = iterations[at : at + step].astype(np.int64)[:, None]
        picked = mixed(key, own, np.arange(low, high, dtype=np.int64)[None, :], seed + SLICE_SEED) % n // width
        flat = (np.arange(len(own))[:, None] * slices + picked).ravel()
        out[at : at + step] = np.bincount(flat, minlength=len(own) * slices).reshape(len(own), slices)
    return out


def member_counts(key: int, iterations: np.ndarray, sizes: np.ndarray, number: int, members: int, seed: int) -> np.ndarray:
    """How often each of the ``members`` of slice ``number`` is drawn, where ``sizes`` places of each iteration fall in it: iterations x members."""
    counts = np.zeros((len(iterations), members))
    ends = np.cumsum(sizes)
    at = 0
    while at < len(iterations):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        row = np.repeat(np.arange(end - at), sizes[at:end])
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes[at:end]) - sizes[at:end], sizes[at:end])
        picked = mixed(key + SLICE_KEY * number, iterations[at:end].astype(np.int64)[row], place, seed) % members
        counts[at:end] = np.bincount(row * members + picked, minlength=(end - at) * members).reshape(end - at, members)
        at = end
    return counts


def block_of(number: int, iterations: int, size: int) -> np.ndarray:
    """The iterations of a block."""
    return np.arange(number * size, min((number + 1) * size, iterations))


def slice_table(groups: DataFrame, keys: Sequence[str], iterations: int, seed: int, width: int, block_size: int) -> DataFrame:
    """(keys, slice, block, drawn): how many places of each iteration of a block fall in each slice, for the groups (keys, key, members)
    with more than one slice. The ranges of places are added up."""
    blocks = math.ceil(iterations / block_size)
    task = [*keys, "block", "part"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in groups.select(*keys).schema]
    rows = (
        groups.where(F.col("members") > width)
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("members") / PLACES) - 1)))
    )
    places = PLACES

    def fall(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        n, low = int(head["members"]), int(head["part"]) * places
        sizes = slice_sizes(int(head["key"]), block_of(int(head["block"]), iterations, block_size), n, seed, low, min(low + places, n), width)
        fixed = {k: head[k] for k in (*keys, "block")}
        return pd.DataFrame({**fixed, "slice": np.arange(sizes.shape[1]), "drawn": list(sizes.T)})

    found = spread(rows, *task).groupBy(*task).applyInPandas(fall, ", ".join([*kinds, "block int", "slice bigint", "drawn array<bigint>"]))
    return found.groupBy(*keys, "slice", "block").agg(added("drawn"))


def added(name: str) -> Column:
    """Arrays of whole numbers added up element by element."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.max(F.size(name)))
    return F.aggregate(F.collect_list(name), zeros, lambda total, part: F.zip_with(total, part, lambda x, y: x + y)).alias(name)
