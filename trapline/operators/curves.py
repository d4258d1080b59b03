"""Daily activity curves, their bootstrap bands and the overlap between species."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.ordered import ranked
from trapline.functions.pairing import spread
from trapline.functions.resampling import ITERATION_BLOCK, SLICE, block_of, draw_key, member_counts, slice_table
from trapline.operators.activity import total_effort
from trapline.operators.filters import qc_exclude
from trapline.session import cut_lineage

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
GRID = 128
RAW_BANDWIDTH = 0.001
# Times whose kernels one task works out.
TIMES_TOGETHER = 20_000


def detection_times(verified: DataFrame) -> DataFrame:
    """Verified series per species, site and time of day (``us``: microseconds since midnight), with their number."""
    at = F.timestamp_diff("MICROSECOND", F.date_trunc("day", "series_start_time").cast("timestamp_ntz"), F.col("series_start_time"))
    return verified.groupBy("species_id", "location_id", at.alias("us")).agg(F.count(F.lit(1)).alias("n"))


def detection_hours(verified: DataFrame) -> DataFrame:
    """One row per verified series: species, site and decimal hour."""
    at = F.timestamp_diff("MICROSECOND", F.date_trunc("day", "series_start_time").cast("timestamp_ntz"), F.col("series_start_time"))
    return verified.select("species_id", "location_id", (at / HOUR_US).alias("decimal_hour"))


def _enough(times: DataFrame, least: int) -> DataFrame:
    """Number of detections of the species that have at least ``least`` of them."""
    return times.groupBy("species_id").agg(F.sum("n").alias("total")).where(F.col("total") >= least)


def _effort(effort: DataFrame | None, mode: str) -> Column:
    if mode != "rai":
        return F.lit(None)
    return F.greatest(F.lit(1), effort.agg(F.max("effort_days")).scalar())


def raw_curve(times: DataFrame, mode: str, effort: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Histogram over the 24 hours: per 100 days of effort (``rai``) or in percent."""
    totals = _enough(times, least)
    counts = times.groupBy("species_id", F.floor(F.col("us") / HOUR_US).cast("int").alias("i")).agg(F.sum("n").alias("n"))
    grid = totals.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(23))))
    base = _effort(effort, mode) if mode == "rai" else F.greatest(F.lit(1), F.col("total"))
    return grid.join(counts, ["species_id", "i"], "left").select(
        "species_id",
        "i",
        F.col("i").cast("double").alias("hour"),
        (F.coalesce("n", F.lit(0)) * 100.0 / base).alias("mean"),
    )


def _hours(us: Column) -> Column:
    return us / HOUR_US


def smooth_curve(times: DataFrame, mode: str, bandwidth: float, effort: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Gaussian density on the clock: every time counts a day earlier and a day later as well, 128 points from 0 to 24.

    The bandwidth is the factor times the sample deviation of the tripled times. Equal times are merged first, so the
    number of kernel terms depends on the clock, not on the rows.
    """
    hour = _hours(F.col("us"))
    merged = times.groupBy("species_id", "us").agg(F.sum("n").alias("n"))
    moments = (
        merged.groupBy("species_id")
        .agg(F.sum("n").alias("total"), F.sum(F.col("n") * hour).alias("_s1"), F.sum(F.col("n") * hour * hour).alias("_s2"))
        .where(F.col("total") >= max(least, 2))
    )
    squares = F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("total")
    deviation = F.sqrt((3 * squares + 2 * 24.0 * 24.0 * F.col("total")) / (3 * F.col("total") - 1))
    widths = moments.select("species_id", "total", (deviation * bandwidth).alias("h"))
    kernels = (
        spread(merged.join(widths, "species_id"), "species_id", "us")
        .withColumn("shift", F.explode(F.array(*[F.lit(s) for s in (-24.0, 0.0, 24.0)])))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))))
    )
    z = (F.col("i") * (24.0 / (GRID - 1)) - (hour + F.col("shift"))) / F.col("h")
    scale = F.col("total") * 100.0 / _effort(effort, mode) if mode == "rai" else F.lit(100.0)
    return (
        kernels.groupBy("species_id", "i", "total", "h")
        .agg(F.sum(F.col("n") * F.exp(-z * z / 2)).alias("_sum"))
        .select(
            "species_id",
            "i",
            (F.col("i") * (24.0 / (GRID - 1))).alias("hour"),
            (F.col("_sum") / (F.col("total") * F.col("h") * math.sqrt(2 * math.pi)) * scale).alias("mean"),
        )
    )


def activity_curve(
    times: DataFrame, mode: str = "rai", bandwidth: float = 0.1, effort: DataFrame | None = None, least: int = 2
) -> DataFrame:
    """Curve per species: (species_id, i, hour, mean). A bandwidth of zero gives the raw histogram."""
    if bandwidth <= RAW_BANDWIDTH:
        return raw_curve(times, mode, effort, least)
    return smooth_curve(times, mode, bandwidth, effort, least)


# Points of the bandwidth range at which kernels are worked out; a replicate's kernel is the polynomial through them. Its error is
# below 1e-10 of the kernel's height, as bandwidths of a species differ by less than a third of their mean.
NODES = 12


class _Resampling:
    """Times with their site's number in its species, and how many places of each replicate fall in each slice of the sites."""

    def __init__(self, times: DataFrame, replicates: int, seed: int, least: int):
        kept = times.join(_enough(times, least).select("species_id"), "species_id", "left_semi")
        sites = ranked(kept.select("species_id", "location_id").distinct(), ["species_id"], ["location_id"], "site", "members")
        numbers = {"site": F.col("site") - 1, "key": draw_key(F.col("species_id").cast("string")), "slice": F.floor((F.col("site") - 1) / SLICE)}
        sites = sites.withColumns(numbers)
        self.replicates, self.seed = replicates, seed
        self.times = kept.join(sites, ["species_id", "location_id"]).select("species_id", "slice", "key", "members", "site", "us", "n")
        self.falls = slice_table(sites.where("site = 0").select("species_id", "key", "members"), ["species_id"], replicates, seed, SLICE, ITERATION_BLOCK)

    def tasks(self, rows: DataFrame, *more: str) -> DataFrame:
        """``rows`` of species and slices for each block of replicates, dealt out with ``more`` columns."""
        blocks = math.ceil(self.replicates / ITERATION_BLOCK)
        return spread(rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), "species_id", "slice", "block", *more)

    def run(self, rows: DataFrame, facts: DataFrame, work, schema: str, *more: str) -> DataFrame:
        """``work`` on each task of ``rows`` beside its row of ``facts`` (species_id, slice, block and more), if there is one."""
        task = ["species_id", "slice", "block", *more]
        dealt = self.tasks(rows, *more)
        for_task = dealt.select(*task).distinct().join(facts, ["species_id", "slice", "block"])
        renamed = for_task.select(*[F.col(c).alias(f"{c}_of") for c in task], *[c for c in facts.columns if c not in task])
        return dealt.groupBy(*task).cogroup(renamed.groupBy(*[f"{c}_of" for c in task])).applyInPandas(work, schema)

    def drawn(self):
        """A function from a task's rows and its facts to how often each site of the slice is drawn, and the sites' rows in it."""
        replicates, seed, width, size = self.replicates, self.seed, SLICE, ITERATION_BLOCK

        def counts(pdf: pd.DataFrame, fall: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            head = pdf.iloc[0]
            number, members = int(head["slice"]), int(head["members"])
            iteration = block_of(int(head["block"]), replicates, size)
            split = len(fall) and fall["drawn"].iloc[0] is not None
            sizes = np.asarray(fall["drawn"].iloc[0], np.int64) if split else np.full(len(iteration), members)
            return member_counts(int(head["key"]), iteration, sizes, number, min(width, members - number * width), seed), pdf["site"].to_numpy() - number * width

        return counts


def _sums(pdf: pd.DataFrame, **arrays: np.ndarray) -> pd.DataFrame:
    """One row of a task: its species, block of replicates and arrays."""
    return pd.DataFrame({"species_id": [pdf["species_id"].iloc[0]], "block": [pdf["block"].iloc[0]], **{k: [v] for k, v in arrays.items()}})


def _widths(sample: _Resampling, bandwidth: float) -> DataFrame:
    """(species_id, block, points, h): the number of times and the bandwidth of every replicate, 0 with fewer than two times.
    Numbers, sums and sums of squares of each site are added over the sites drawn and over the slices."""
    drawn = sample.drawn()

    def moments(pdf: pd.DataFrame, fall: pd.DataFrame) -> pd.DataFrame:
        counts, site = drawn(pdf, fall)
        table = np.zeros((counts.shape[1], 3))
        table[site] = pdf[["_s0", "_s1", "_s2"]].to_numpy(float)
        return _sums(pdf, moments=(counts @ table).ravel())

    def widths(pdf: pd.DataFrame) -> pd.DataFrame:
        points, total, squares = np.sum(np.stack(pdf["moments"].to_list()), axis=0).reshape(-1, 3).T
        many = np.maximum(points, 2)
        spread_ = np.maximum(squares - total * total / np.maximum(points, 1), 0)
        h = bandwidth * np.sqrt((3 * spread_ + 2 * 24.0 * 24.0 * many) / (3 * many - 1))
        return _sums(pdf, points=points, h=np.where(points >= 2, h, 0.0))

    hour = _hours(F.col("us"))
    powers = [F.sum(F.col("n") * p).alias(f"_s{k}") for k, p in enumerate((F.lit(1), hour, hour * hour))]
    sites = sample.times.groupBy("species_id", "slice", "key", "members", "site").agg(*powers)
    partial = sample.run(sites, sample.falls, moments, "species_id bigint, block int, moments array<double>")
    return partial.groupBy("species_id", "block").applyInPandas(widths, "species_id bigint, block int, points array<double>, h array<double>")


def _long(partial: DataFrame, width: int) -> DataFrame:
    """Curves of all replicates from what the tasks have added up: (species_id, replicate, points, i, hour, value)."""
    hours = np.linspace(0, 24, width) if width == GRID else np.arange(width, dtype=float)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        value = np.sum(np.stack(pdf["value"].to_list()), axis=0)
        points = np.round(pdf["points"].iloc[0]).astype(np.int64) if width == GRID else np.round(value.reshape(-1, width).sum(axis=1)).astype(np.int64)
        if width != GRID:
            value = np.round(value) * 100.0 / np.repeat(np.maximum(points, 1), width)
        first = int(pdf["block"].iloc[0]) * ITERATION_BLOCK
        return pd.DataFrame(
            {
                "species_id": pdf["species_id"].iloc[0],
                "replicate": np.repeat(first + np.arange(len(points)), width),
                "points": np.repeat(points, width),
                "i": np.tile(np.arange(width, dtype=np.int32), len(points)),
                "hour": np.tile(hours, len(points)),
                "value": value,
            }
        )

    schema = "species_id bigint, replicate bigint, points bigint, i int, hour double, value double"
    return partial.groupBy("species_id", "block").applyInPandas(finish, schema)


def _raw_replicates(sample: _Resampling) -> DataFrame:
    drawn = sample.drawn()

    def count(pdf: pd.DataFrame, fall: pd.DataFrame) -> pd.DataFrame:
        counts, site = drawn(pdf, fall)
        bins = np.bincount(site * 24 + pdf["hour"].to_numpy(), pdf["n"].to_numpy().astype(float), counts.shape[1] * 24).reshape(-1, 24)
        return _sums(pdf, value=(counts @ bins).ravel())

    hour = F.floor(F.col("us") / HOUR_US).cast("int").alias("hour")
    binned = sample.times.groupBy("species_id", "slice", "key", "members", "site", hour).agg(F.sum("n").alias("n"))
    return _long(sample.run(binned, sample.falls, count, "species_id bigint, block int, value array<double>"), 24)


def _smooth_replicates(sample: _Resampling, bandwidth: float) -> DataFrame:
    """Each task gets the replicates' bandwidths and adds its own times' kernels; only sums leave it. A slice with very many times is
    split by parts of the day, so that a task holds about ``TIMES_TOGETHER`` of them; the parts repeat the draws of the slice."""
    drawn = sample.drawn()
    sized = sample.times.groupBy("species_id", "slice").agg(F.least(F.lit(24), F.ceil(F.count(F.lit(1)) / TIMES_TOGETHER)).alias("parts"))
    part = F.floor(F.floor(F.col("us") / HOUR_US) * F.col("parts") / 24).cast("int").alias("part")
    timed = sample.times.join(sized, ["species_id", "slice"]).select("species_id", "slice", "key", "members", "site", "us", "n", part)
    slices = sized.select("species_id", "slice")
    facts = _widths(sample, bandwidth).join(slices, "species_id").join(sample.falls, ["species_id", "slice", "block"], "left")

    def kernels(pdf: pd.DataFrame, more: pd.DataFrame) -> pd.DataFrame:
        counts, site = drawn(pdf, more)
        points, h = (np.asarray(more[c].iloc[0], float) for c in ("points", "h"))
        used, value = h > 0, np.zeros((len(h), GRID))
        if used.any():
            inverse = 1 / h[used] ** 2
            low, high = inverse.min(), inverse.max()
            places = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
            nodes = (low + high) / 2 + max(high - low, 1e-6 * high) / 2 * places
            for node, weight in zip(nodes, lagrange(nodes, inverse)):
                value[used] += weight[:, None] * (counts[used] @ site_kernels(pdf, site, counts.shape[1], node))
            value[used] *= 100.0 / (points[used] * h[used] * math.sqrt(2 * math.pi))[:, None]
        return _sums(pdf, points=points, value=value.ravel())

    partial = sample.run(timed, facts, kernels, "species_id bigint, block int, points array<double>, value array<double>", "part")
    return _long(partial, GRID).where("points >= 2")


def lagrange(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weight of each node in the polynomial through all of them, at every x."""
    out = np.ones((len(nodes), len(x)))
    for i, own in enumerate(nodes):
        for other in np.delete(nodes, i):
            out[i] *= (x - other) / (own - other)
    return out


def site_kernels(pdf: pd.DataFrame, site: np.ndarray, sites: int, inverse: float) -> np.ndarray:
    """Kernel sums of each site at every grid point, with 1 / bandwidth squared given."""
    grid, hours, n = np.linspace(0, 24, GRID), pdf["us"].to_numpy() / HOUR_US, pdf["n"].to_numpy().astype(float)
    out = np.zeros((sites, GRID))
    for at in range(0, len(hours), 20_000):  # bounded memory per step
        part = slice(at, at + 20_000)
        away = hours[part, None] - grid[None, :]
        kernel = sum(np.exp(-0.5 * inverse * (away + shift) ** 2) for shift in (-24.0, 0.0, 24.0)) * n[part, None]
        np.add.at(out, site[part], kernel)
    return out


def resampled_curves(times: DataFrame, bandwidth: float = 0.1, replicates: int = 1_000, seed: int = 1, least: int = 5) -> DataFrame:
    """Percent curve of every replicate: (species_id, replicate, points, i, hour, value), the sites of a species drawn with
    replacement. Smoothed replicates with fewer than two points are left out, and the rest is numbered without holes.

    Moments and kernel sums are additive: a task holds the times of one species, slice of sites and block of replicates, draws the
    sites of its slice alone, and only its sums are shuffled. ``times`` is read several times and should be a stored table.
    """
    sample = _Resampling(times, replicates, seed, least)
    if bandwidth <= RAW_BANDWIDTH:
        return _raw_replicates(sample)
    curves = _smooth_replicates(sample, bandwidth)
    order = Window.partitionBy("species_id", "i").orderBy("replicate")
    return curves.withColumn("replicate", (F.row_number().over(order) - 1).cast("bigint"))


def curve_band(curves: DataFrame, mode: str = "percent", effort: DataFrame | None = None) -> DataFrame:
    """Mean and 2.5/97.5 percentiles of the replicates at every grid point."""
    value = F.col("value")
    if mode == "rai":
        value = value * F.col("points") / _effort(effort, mode)
    return curves.groupBy("species_id", "i", "hour").agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.025)).alias("ci_lower"),
        F.percentile(value, F.lit(0.975)).alias("ci_upper"),
    )


# The fewest detections of a charted species, with and without a band.
LEAST_WITH_BAND, LEAST_PLAIN = 5, 2
MODES = ("rai", "percent")


def activity_report(
    times: DataFrame, effort: DataFrame, bandwidth: float = 0.1, replicates: int = 0, seed: int = 1, replicated: DataFrame | None = None
) -> DataFrame:
    """Curves of every species with enough detections in both modes: (mode, species_id, i, hour, mean, ci_lower, ci_upper).
    With ``replicates`` the mean and the band come from resampled sites (``replicated``, where the caller has them already),
    otherwise there is no band. ``times`` is read several times and should be a stored table."""
    parts = []
    if replicated is None and replicates:
        replicated = resampled_curves(times, bandwidth, replicates, seed, LEAST_WITH_BAND)
    for mode in MODES:
        if replicated is not None:
            curves = curve_band(replicated, mode, effort)
        else:
            unknown = F.lit(None).cast("double")
            curves = activity_curve(times, mode, bandwidth, effort, LEAST_PLAIN).withColumns({"ci_lower": unknown, "ci_upper": unknown})
        parts.append(curves.select(F.lit(mode).alias("mode"), "species_id", "i", "hour", "mean", "ci_lower", "ci_upper"))
    return parts[0].unionByName(parts[1])


def _shares(curves: DataFrame, value: str, keys: list[str]) -> DataFrame:
    area = F.sum(value).over(Window.partitionBy(*keys))
    return curves.select(*keys, "i", F.coalesce(F.try_divide(F.col(value), area), F.lit(0.0)).alias("share"))


def _pairs(shares: DataFrame, on: list[str]) -> DataFrame:
    """Sum of the pointwise minima per ordered pair of species; each unordered pair is worked out once."""
    left = shares.withColumnRenamed("species_id", "species_a").withColumnRenamed("share", "_a")
    right = shares.withColumnRenamed("species_id", "species_b").withColumnRenamed("share", "_b")
    keys = ["species_a", "species_b", *[k for k in on if k != "i"]]
    half = (
        left.join(right, on)
        .where("species_a < species_b")
        .groupBy(*keys)
        .agg(F.sum(F.least("_a", "_b")).alias("overlap"))
    )
    rest = [k for k in keys if not k.startswith("species_")]
    swapped = half.select(F.col("species_b").alias("species_a"), F.col("species_a").alias("species_b"), *rest, "overlap")
    return half.unionByName(swapped)


def _diagonal(curves: DataFrame) -> DataFrame:
    unknown = F.lit(None).cast("double")
    return curves.select("species_id").distinct().select(
        F.col("species_id").alias("species_a"), F.col("species_id").alias("species_b"),
        F.lit(1.0).alias("mean"), unknown.alias("lower"), unknown.alias("upper"),
    )


def overlap_matrix(curves: DataFrame) -> DataFrame:
    """Overlap coefficient of every two curves (percent mode), 1 on the diagonal, 0 where a curve has no area."""
    unknown = F.lit(None).cast("double")
    pairs = _pairs(_shares(curves, "mean", ["species_id"]), ["i"])
    listed = pairs.select("species_a", "species_b", F.col("overlap").alias("mean"), unknown.alias("lower"), unknown.alias("upper"))
    return listed.unionByName(_diagonal(curves))


def overlap_band(replicates: DataFrame) -> DataFrame:
    """Overlap of the replicates of two species with the same number: mean and 2.5/97.5 percentiles."""
    shares = _shares(replicates, "value", ["species_id", "replicate"])
    listed = (
        _pairs(shares, ["replicate", "i"])
        .groupBy("species_a", "species_b")
        .agg(
            F.avg("overlap").alias("mean"),
            F.percentile("overlap", F.lit(0.025)).alias("lower"),
            F.percentile("overlap", F.lit(0.975)).alias("upper"),
        )
    )
    return listed.unionByName(_diagonal(replicates))


class SiteReport(NamedTuple):
    """Effort, curves and overlap of one report."""

    effort: DataFrame
    curves: DataFrame
    overlap: DataFrame


def site_report(
    verified: DataFrame,
    days: DataFrame,
    species_ids: Iterable[int],
    sites: DataFrame | None = None,
    deployments: DataFrame | None = None,
    flags: Iterable[str] = (),
    bandwidth: float = 0.1,
    replicates: int = 0,
    seed: int = 1,
) -> SiteReport:
    """The report over chosen species and sites (``sites``: id; all if None).

    Effort counts the photo ``days`` of the same sites. Series on days of a deployment that raises one of ``flags`` are left
    out of the curves, never out of the effort. The overlap comes from the replicates of the curves, and is empty with fewer
    than two charted species.
    """
    if sites is not None:
        inside = sites.select(F.col("id").alias("location_id"))
        verified, days = verified.join(inside, "location_id", "left_semi"), days.join(inside, "location_id", "left_semi")
    shown = verified.where(F.col("species_id").isin(*species_ids))
    if deployments is not None:
        shown = qc_exclude(shown, deployments, flags)
    times, effort = cut_lineage(detection_times(shown)), total_effort(days)
    if replicates:
        replicated = cut_lineage(resampled_curves(times, bandwidth, replicates, seed, LEAST_WITH_BAND))
        curves = activity_report(times, effort, bandwidth, replicates, seed, replicated)
        matrix, charted = overlap_band(replicated), replicated
    else:
        curves = activity_report(times, effort, bandwidth)
        charted = activity_curve(times, "percent", bandwidth, least=LEAST_PLAIN)
        matrix = overlap_matrix(charted)
    several = charted.agg(F.count_distinct("species_id")).scalar() > 1
    return SiteReport(effort, curves, matrix.where(several))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: overlap coefficient of two single curves (columns i, mean)."""
    sums = [c.agg(F.sum("mean")).scalar() for c in (a, b)]
    left = a.select("i", F.coalesce(F.try_divide(F.col("mean"), sums[0]), F.lit(0.0)).alias("_a"))
    right = b.select("i", F.coalesce(F.try_divide(F.col("mean"), sums[1]), F.lit(0.0)).alias("_b"))
    return left.join(right, "i").agg(F.coalesce(F.sum(F.least("_a", "_b")), F.lit(0.0)).alias("overlap"))


def curve_wide(curves: DataFrame, species: DataFrame, name: Column) -> DataFrame:
    """Text table for the file: one row per grid hour, three columns per species in the order of their ids. The curves are
    worked out once, for the titles and for the table."""
    curves = cut_lineage(curves)
    named = species.select(F.col("id").alias("species_id"), name.alias("_name"))
    # column titles: one short row per charted species
    charted = curves.select("species_id").distinct().join(named, "species_id", "left").orderBy("species_id")
    ids = [(r["species_id"], r["_name"] or f"Species {r['species_id']}") for r in charted.toLocalIterator()]
    text = [F.format_string("%.4f", F.col(c)) for c in ("mean", "ci_lower", "ci_upper")]
    aggregates = [
        F.max(F.when(F.col(c).isNotNull(), t)).alias(title)
        for c, t, title in zip(("mean", "ci_lower", "ci_upper"), text, ("mean", "lower", "upper"))
    ]
    hour = F.when(F.col("hour") == F.floor("hour"), F.format_string("%.0f", "hour")).otherwise(F.format_string("%.2f", "hour"))
    for missing in ("ci_lower", "ci_upper"):
        if missing not in curves.columns:
            curves = curves.withColumn(missing, F.lit(None).cast("double"))
    wide = curves.groupBy("i", "hour").pivot("species_id", [i for i, _ in ids]).agg(*aggregates).orderBy("i")
    titles = (("mean", "Mean"), ("lower", "Lower CI"), ("upper", "Upper CI"))
    columns = [
        F.coalesce(F.col(f"`{i}_{short}`"), F.lit("")).alias(f"{label} ({long})") for i, label in ids for short, long in titles
    ]
    return wide.select(hour.alias("Hour"), *columns)
