"""Yearly detection rates with bootstrap bands, and the trend test over them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from trapline.functions.ordered import ranked
from trapline.functions.pairing import spread
from trapline.functions.resampling import ITERATION_BLOCK, SLICE, added, block_of, draw_key, member_counts, slice_table

SCOPE = ["species_id", "scope_type", "scope_id"]
SITES_OF = SCOPE[1:]
# Species that share the draws of a task.
SPECIES_TOGETHER = 32


def yearly_sums(activity: DataFrame) -> DataFrame:
    """Detections and trap days per species, site and year."""
    return activity.groupBy("species_id", "location_id", "year").agg(
        F.sum("detection_count").alias("detections"), F.sum("trap_days").alias("trap_days")
    )


def _scoped_sites(yearly: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, location_id, site, members, key, slice): the sites of each scope that have data, numbered by id."""
    present = scopes.select(*SITES_OF, "location_id").distinct().join(yearly.select("location_id").distinct(), "location_id", "left_semi")
    placed = ranked(present, SITES_OF, ["location_id"], "site", "members").withColumn("site", F.col("site") - 1)
    return placed.withColumns({"key": draw_key(*SITES_OF), "slice": F.floor(F.col("site") / SLICE)})


def resampled_years(yearly: DataFrame, scopes: DataFrame, iterations: int = 10_000, seed: int = 1) -> DataFrame:
    """Detections and trap days of every iteration, species, scope and year, with the sites of a scope drawn with replacement: one row
    per block of iterations, with ``sums`` holding (detections, trap_days) of each iteration.

    A task holds one slice of the sites of a scope, one block of iterations and some species, which share its draws; a species without
    rows at a site has nothing there. The slices are added up afterwards, so a scope of very many sites never has to fit into one task,
    and the work grows with the sites.
    """
    blocks = math.ceil(iterations / ITERATION_BLOCK)
    sites = _scoped_sites(yearly, scopes)
    falls = slice_table(sites.where("site = 0").select(*SITES_OF, "key", "members"), SITES_OF, iterations, seed, SLICE, ITERATION_BLOCK)
    teams = F.ceil(yearly.agg(F.count_distinct("species_id")).scalar() / SPECIES_TOGETHER)
    task = [*SITES_OF, "slice", "block", "team"]
    rows = (
        yearly.withColumn("team", F.pmod(F.xxhash64("species_id"), F.greatest(F.lit(1), teams)))
        .join(sites, "location_id")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .select(*task, "key", "members", "site", "species_id", "year", "detections", "trap_days")
    )
    for_task = rows.select(*task).distinct().join(falls, [*SITES_OF, "slice", "block"])
    renamed = for_task.select(*[F.col(c).alias(f"{c}_of") for c in task], "drawn")
    block_size, width = ITERATION_BLOCK, SLICE

    def resample(pdf: pd.DataFrame, fall: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        number, members = int(head["slice"]), int(head["members"])
        own = min(width, members - number * width)
        iteration = block_of(int(head["block"]), iterations, block_size)
        sizes = np.asarray(fall["drawn"].iloc[0], np.int64) if len(fall) else np.full(len(iteration), members)
        drawn = member_counts(int(head["key"]), iteration, sizes, number, own, seed)
        column = pdf.groupby(["species_id", "year"], sort=False).ngroup().to_numpy()
        first = np.unique(column, return_index=True)[1]
        sums = {}
        for name in ("detections", "trap_days"):
            table = np.zeros((own, len(first)))
            table[pdf["site"].to_numpy() - number * width, column] = pdf[name].to_numpy()
            sums[name] = list((drawn @ table).T.astype(np.int64))
        fixed = {name: head[name] for name in (*SITES_OF, "block")}
        return pd.DataFrame({**fixed, "species_id": pdf["species_id"].to_numpy()[first], "year": pdf["year"].to_numpy()[first], **sums})

    schema = "scope_type string, scope_id string, block int, species_id bigint, year int, detections array<bigint>, trap_days array<bigint>"
    together = spread(rows, *task).groupBy(*task).cogroup(renamed.groupBy(*[f"{c}_of" for c in task]))
    partial = together.applyInPandas(resample, schema)
    return partial.groupBy(*SCOPE, "block", "year").agg(added("detections"), added("trap_days"))


def yearly_trend(yearly: DataFrame, scopes: DataFrame, iterations: int = 10_000, seed: int = 1) -> DataFrame:
    """Mean and 2.5/97.5 percentiles of 100 * detections / trap days per species, scope and year. Iterations without trap
    days in a year do not count for it. Means keep nine digits so that they do not depend on the order of summation."""
    rates = F.zip_with(F.col("detections"), F.col("trap_days"), lambda d, t: F.when(t > 0, d * 100 / t))
    return (
        resampled_years(yearly, scopes, iterations, seed)
        .select(*SCOPE, "year", F.explode(rates).alias("rate"))
        .where("rate IS NOT NULL")
        .groupBy(*SCOPE, "year")
        .agg(
            F.round(F.avg("rate"), 9).alias("mean_dr_index"),
            F.percentile("rate", F.lit(0.025)).alias("lower_ci"),
            F.percentile("rate", F.lit(0.975)).alias("upper_ci"),
        )
    )


# Fixed values of the trend test.
MIN_YEARS = 5
ALPHA = 0.05
EXACT_UP_TO = 33


def _exact_tail(n: int, c: int) -> float:
    """Two-sided exact p of Kendall's statistic without ties: c is the smaller of discordant and concordant pairs."""
    if 4 * c == n * (n - 1):
        return 1.0
    if c == 0:
        return 2.0 / math.factorial(n) if n > 2 else 1.0
    if c == 1:
        return 2.0 / math.factorial(n - 1) if n > 2 else 1.0
    counts = np.ones(1, dtype=object)
    for j in range(2, n + 1):  # permutations of j values by number of inversions
        counts = np.array([sum(counts[max(0, k - j + 1) : k + 1]) for k in range(len(counts) + j - 1)], dtype=object)
    return float(2 * sum(counts[: c + 1]) / math.factorial(n))


@pandas_udf(DoubleType())
def kendall_p(n: pd.Series, concordant: pd.Series, discordant: pd.Series, ties: pd.Series, tie_weight: pd.Series) -> pd.Series:
    """Two-sided p: exact without ties for short series, else the normal approximation. ``tie_weight`` is the sum of
    t(t-1)(2t+5) over groups of t equal values."""
    exact: dict[tuple[int, int], float] = {}
    result = []
    for size, up, down, tied, weight in zip(n, concordant, discordant, ties, tie_weight):
        pairs = size * (size - 1) // 2
        if tied == pairs:
            result.append(1.0)
            continue
        smaller = min(down, pairs - down)
        if tied == 0 and (size <= EXACT_UP_TO or smaller <= 1):
            key = (int(size), int(smaller))
            if key not in exact:
                exact[key] = _exact_tail(*key)
            result.append(exact[key])
        else:
            variance = (size * (size - 1) * (2 * size + 5) - weight) / 18
            result.append(math.erfc(abs(up - down) / math.sqrt(variance) / math.sqrt(2)))
    return pd.Series(result, dtype="float64")


def trend_test(trends: DataFrame, min_years: int = MIN_YEARS, alpha: float = ALPHA) -> DataFrame:
    """Mann-Kendall tau-b and p with the Theil-Sen slope per species and scope; shorter series give no row.

    The years of a scope are one short array (a value per calendar year), compared inside the row without a join.
    """
    point = F.struct(F.col("year").alias("y"), F.col("mean_dr_index").alias("v"))
    series = (
        trends.where("year IS NOT NULL AND mean_dr_index IS NOT NULL")
        .groupBy(*SCOPE)
        .agg(F.array_sort(F.collect_list(point)).alias("p"))
        .withColumn("n_years", F.size("p"))
        .where(F.col("n_years") >= min_years)
    )
    slopes = F.flatten(
        F.transform(
            F.col("p"),
            lambda a, i: F.transform(
                F.slice(F.col("p"), i + 2, F.size("p")), lambda b: (b["v"] - a["v"]) / (b["y"] - a["y"])
            ),
        )
    )
    values = F.transform("p", lambda a: a["v"])
    groups = F.transform(F.array_distinct(values), lambda u: F.size(F.filter(values, lambda w: w == u)))
    tied = F.aggregate(groups, F.lit(0), lambda acc, t: acc + (t * (t - 1) / 2).cast("int"))
    weight = F.aggregate(groups, F.lit(0), lambda acc, t: acc + t * (t - 1) * (2 * t + 5))
    pairs = (F.col("n_years") * (F.col("n_years") - 1) / 2).cast("int")
    counted = (
        series.withColumn("s", F.array_sort(slopes))
        .withColumn("up", F.size(F.filter("s", lambda x: x > 0)))
        .withColumn("down", F.size(F.filter("s", lambda x: x < 0)))
        .withColumn("tied", tied)
        .withColumn("weight", weight)
        .withColumn("flat", F.col("tied") == pairs)
    )
    m = F.size("s")
    middle = (F.get("s", F.floor((m - 1) / 2).cast("int")) + F.get("s", F.floor(m / 2).cast("int"))) / 2
    loose = F.when(F.col("flat"), 1.0).otherwise(pairs - F.col("tied"))
    tau = (F.col("up") - F.col("down")) / F.sqrt(pairs) / F.sqrt(loose)
    tested = counted.select(
        *SCOPE,
        "n_years",
        F.when(F.col("flat"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), tau))).alias("mk_tau"),
        kendall_p("n_years", "up", "down", "tied", "weight").alias("mk_p"),
        F.when(F.col("flat"), 0.0).otherwise(middle).alias("sen_slope"),
    )
    verdict = (
        F.when((F.col("mk_p") < alpha) & (F.col("mk_tau") > 0), "increasing")
        .when((F.col("mk_p") < alpha) & (F.col("mk_tau") < 0), "decreasing")
        .otherwise("no_trend")
    )
    return tested.withColumn("trend", verdict)
