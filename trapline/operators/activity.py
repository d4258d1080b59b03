"""Effort and activity facts: trap days, detections, zero-filled months, gap-aware effort, coverage calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.pairing import with_every
from trapline.operators.consensus import DONE, series_votes
from trapline.operators.filters import covered_days

# The longest step between photo days that still counts as a working camera, and the calendar limits.
EFFORT_GAP_DAYS = 15
COVERAGE_GAP_DAYS = 10
COVERAGE_GOOD_PHOTOS = 1
FIRST_COVERAGE_YEAR = 2010

MONTH_KEY = ["location_id", "year", "month"]


def _sited(photos: DataFrame, observations: DataFrame) -> DataFrame:
    """Photos with the site of their series and the calendar parts of their capture day."""
    sites = observations.select(F.col("id").alias("observation_id"), "location_id")
    day = F.to_date("captured_at")
    return (
        photos.select(F.col("id").alias("photo_id"), "observation_id", "captured_at")
        .join(sites, "observation_id")
        .withColumn("day", day)
        .withColumn("year", F.year(day))
        .withColumn("month", F.month(day))
    )


def _done(observations: DataFrame, sites: DataFrame | None) -> DataFrame:
    done = observations.where(F.col("status").isin(*DONE))
    if sites is not None:
        done = done.join(sites.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    return done


def trap_days(photos: DataFrame, observations: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """Distinct photo days of verified series per site and month. ``sites`` restricts the sites (their ``id``)."""
    return (
        _sited(photos, _done(observations, sites))
        .groupBy(*MONTH_KEY)
        .agg(F.count_distinct("day").alias("trap_days"))
    )


def detection_days(
    identifications: DataFrame, photos: DataFrame, observations: DataFrame, sites: DataFrame | None = None
) -> DataFrame:
    """Distinct days with any vote for a species per site and month, whether or not the species won its series."""
    votes = identifications.where("species_id > 0").select("photo_id", "species_id")
    return (
        votes.join(_sited(photos, _done(observations, sites)), "photo_id")
        .groupBy("species_id", *MONTH_KEY)
        .agg(F.count_distinct("day").alias("detection_count"))
    )


def monthly_activity(
    identifications: DataFrame,
    photos: DataFrame,
    observations: DataFrame,
    species: DataFrame,
    sites: DataFrame | None = None,
) -> DataFrame:
    """Every species at every active site-month, with zero where it was not seen."""
    active = trap_days(photos, observations, sites)
    seen = detection_days(identifications, photos, observations, sites)
    kinds = species.where("id > 0").select(F.col("id").alias("species_id"))
    return (
        with_every(active, kinds)
        .join(seen, ["species_id", *MONTH_KEY], "left")
        .withColumn("detection_count", F.coalesce("detection_count", F.lit(0)))
        .select("species_id", *MONTH_KEY, "detection_count", "trap_days")
    )


def photo_days(photos: DataFrame, observations: DataFrame) -> DataFrame:
    """Distinct (location_id, day) with photos."""
    return _sited(photos, observations).select("location_id", "day").distinct()


def effort_by_location(days: DataFrame, max_gap: int = EFFORT_GAP_DAYS) -> DataFrame:
    """Working days per site: the first day counts 1, a step of at most ``max_gap`` days counts in full, a longer one 1."""
    step = F.date_diff("day", F.lag("day").over(Window.partitionBy("location_id").orderBy("day")))
    worked = F.when(step <= max_gap, step).otherwise(1)
    return days.withColumn("_worked", worked).groupBy("location_id").agg(F.sum("_worked").alias("effort_days"))


def total_effort(days: DataFrame, max_gap: int = EFFORT_GAP_DAYS) -> DataFrame:
    """One row: effort over all sites, 0 without any photo day."""
    return effort_by_location(days, max_gap).agg(F.coalesce(F.sum("effort_days"), F.lit(0)).alias("effort_days"))


def _filled_days(counts: DataFrame, max_gap: int) -> DataFrame:
    """Photo days plus the days of every gap short enough to be bridged."""
    following = F.lead("day").over(Window.partitionBy("location_id").orderBy("day"))
    last = F.when(F.date_diff(following, "day").between(2, max_gap + 1), F.date_sub(following, 1)).otherwise(F.col("day"))
    return counts.withColumn("_until", last).select("location_id", F.explode(F.sequence("day", "_until")).alias("day"))


def coverage_days(
    photos: DataFrame,
    observations: DataFrame,
    deployments: DataFrame,
    max_gap: int = COVERAGE_GAP_DAYS,
    first_year: int = FIRST_COVERAGE_YEAR,
) -> DataFrame:
    """(location_id, day, covered, photos): days of deployments, photo days and short gaps between photo days."""
    counts = (
        _sited(photos.where(F.col("captured_at") >= F.lit(f"{first_year}-01-01").cast("timestamp_ntz")), observations)
        .groupBy("location_id", "day")
        .agg(F.count(F.lit(1)).alias("photos"))
    )
    deployed = covered_days(deployments)
    covered = deployed.unionByName(_filled_days(counts, max_gap)).distinct().withColumn("covered", F.lit(True))
    return (
        covered.join(counts, ["location_id", "day"], "full")
        .withColumn("covered", F.coalesce("covered", F.lit(False)))
        .withColumn("photos", F.coalesce("photos", F.lit(0)))
    )


def _level(good_photos: int):
    return (
        F.when(~F.col("covered"), "missing").when(F.col("photos") >= good_photos, "good").otherwise("partial").alias("level")
    )


def _graded(cells: DataFrame) -> DataFrame:
    """Add the min-max intensity of covered cells per site; equal values give 0 over a span of one."""
    bounds = cells.where("covered").groupBy("location_id").agg(F.min("photos").alias("_lo"), F.max("photos").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    scaled = (F.col("photos") - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span.cast("double"))
    return (
        cells.join(bounds, "location_id", "left")
        .withColumn("intensity", F.when(F.col("covered"), scaled))
        .drop("_lo", "_hi")
    )


def coverage_calendar(days: DataFrame, good_photos: int = COVERAGE_GOOD_PHOTOS) -> DataFrame:
    """Every day from the first to the last month of a site, with its level and intensity."""
    months = days.groupBy("location_id").agg(
        F.trunc(F.min("day"), "month").alias("_from"), F.last_day(F.max("day")).alias("_to")
    )
    grid = months.select("location_id", F.explode(F.sequence("_from", "_to")).alias("day"))
    cells = (
        grid.join(days, ["location_id", "day"], "left")
        .withColumn("covered", F.coalesce("covered", F.lit(False)))
        .withColumn("photos", F.coalesce("photos", F.lit(0)))
        .withColumn("level", _level(good_photos))
    )
    return _graded(cells)


def coverage_folded(days: DataFrame, good_photos: int = COVERAGE_GOOD_PHOTOS) -> DataFrame:
    """All years folded on one leap year: every (month, day) of a site, with the number of years that have data."""
    folded = days.groupBy("location_id", F.month("day").alias("month"), F.dayofmonth("day").alias("day_of_month")).agg(
        F.bool_or("covered").alias("covered"), F.sum("photos").alias("photos"), F.count_distinct(F.year("day")).alias("years")
    )
    leap = F.explode(F.sequence(F.lit("2000-01-01").cast("date"), F.lit("2000-12-31").cast("date"))).alias("_d")
    grid = days.select("location_id").distinct().select("location_id", leap)
    grid = grid.select("location_id", F.month("_d").alias("month"), F.dayofmonth("_d").alias("day_of_month"))
    cells = (
        grid.join(folded, ["location_id", "month", "day_of_month"], "left")
        .withColumn("covered", F.coalesce("covered", F.lit(False)))
        .withColumn("photos", F.coalesce("photos", F.lit(0)))
        .withColumn("years", F.coalesce("years", F.lit(0)))
        .withColumn("level", _level(good_photos))
    )
    return _graded(cells)


def coverage_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("location_id").agg(
        F.sum("photos").alias("total_photos"),
        F.count_if("covered").alias("active_camera_days"),
        F.count_if(F.col("photos") > 0).alias("days_with_photos"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def needs_recompute(observations: DataFrame, log: DataFrame, source: str = "completed_observations") -> DataFrame:
    """One row (current_count, last_count, changed): verified series now against the last logged run."""
    last = log.where(F.col("source_name") == source).agg(F.max("last_count")).scalar()
    return (
        observations.where(F.col("status").isin(*DONE))
        .agg(F.count(F.lit(1)).alias("current_count"))
        .withColumn("last_count", F.coalesce(last, F.lit(-1)).cast("bigint"))
        .withColumn("changed", F.col("current_count") != F.col("last_count"))
    )


def _voted(identifications: DataFrame, photos: DataFrame, observations: DataFrame) -> DataFrame:
    done = _done(observations, None).select(F.col("id").alias("observation_id"))
    return series_votes(identifications, photos).join(done, "observation_id", "left_semi")


def species_ranking(identifications: DataFrame, photos: DataFrame, observations: DataFrame) -> DataFrame:
    """Verified series with a vote for the species, per species."""
    return (
        _voted(identifications.where("species_id > 0"), photos, observations)
        .groupBy("species_id")
        .agg(F.count_distinct("observation_id").alias("series"))
    )


def behaviour_ranking(
    identifications: DataFrame, identification_behaviors: DataFrame, photos: DataFrame, observations: DataFrame
) -> DataFrame:
    """Verified series with the behaviour tag, per behaviour."""
    tagged = identifications.select(F.col("id").alias("identification_id"), "photo_id").join(
        identification_behaviors, "identification_id"
    )
    return (
        _voted(tagged, photos, observations)
        .groupBy("behavior_type_id")
        .agg(F.count_distinct("observation_id").alias("series"))
    )
