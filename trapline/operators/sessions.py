"""Grouping photos into series by time gap, and upload bookkeeping around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.ordered import UNIT, attach, collapse, keyed, number_gaps, ranked, with_unit

COUNTED_STATUSES = ("pending", "completed", "needs_review")


def _units(photos: DataFrame, keys: Sequence[str], gap_seconds: int) -> DataFrame:
    return number_gaps(collapse(photos, keys, "captured_at"), keys, gap_seconds, "series_idx")


def series_table(photos: DataFrame, keys: Sequence[str] = ("upload_batch_id",), gap_seconds: int = 60) -> DataFrame:
    """One row per series: start, end and photo count. A new series starts when the gap to the previous photo is longer
    than ``gap_seconds``. Photos without a key or a time belong to no series."""
    timed = keyed(photos.where("captured_at IS NOT NULL").select(*keys, "id", "captured_at"), keys)
    return _units(timed, keys, gap_seconds).groupBy(*keys, "series_idx").agg(
        F.min("_first").alias("series_start_time"),
        F.max("_last").alias("series_end_time"),
        F.sum("_n").alias("photo_count"),
    )


def sessionise(photos: DataFrame, keys: Sequence[str] = ("upload_batch_id",), gap_seconds: int = 60) -> DataFrame:
    """Photos with ``series_idx`` per key and ``sequence_number`` inside the series. Photos without a key or a time are left out."""
    timed = keyed(photos.where("captured_at IS NOT NULL"), keys)
    labels = _units(timed, keys, gap_seconds).select(
        *keys, UNIT, "series_idx", (F.col("_before") - F.col("_start")).alias("_before")
    )
    placed = attach(with_unit(timed, "captured_at"), labels, keys, "captured_at", "id", "sequence_number")
    return placed.select(*photos.columns, "series_idx", "sequence_number")


def series_id(batch: str = "upload_batch_id", index: str = "series_idx"):
    """Stable series id from (batch, index), so a re-run writes the same ids."""
    return F.xxhash64(F.col(batch), F.col(index))


def ungrouped_batches(photos: DataFrame, batches: DataFrame) -> DataFrame:
    """Photos of batches that are not completed, reset for a new grouping run."""
    todo = batches.where("status <> 'completed'").select(F.col("id").alias("upload_batch_id"))
    return (
        photos.join(todo, "upload_batch_id", "left_semi")
        .withColumn("observation_id", F.lit(None).cast("bigint"))
        .withColumn("status", F.lit("uploaded"))
    )


def emptied_series(photos: DataFrame, batches: DataFrame) -> DataFrame:
    """Series whose photos all belong to the batches being grouped again; they are removed before the new run."""
    todo = batches.where("status <> 'completed'").select(F.col("id").alias("upload_batch_id"), F.lit(1).alias("_again"))
    return (
        photos.where(F.col("observation_id").isNotNull())
        .join(todo, "upload_batch_id", "left")
        .groupBy("observation_id")
        .agg(F.min(F.coalesce("_again", F.lit(0))).alias("_all"))
        .where("_all = 1")
        .select("observation_id")
    )


def location_photo_counts(photos: DataFrame, observations: DataFrame) -> DataFrame:
    """Photos per location in the counted statuses."""
    return (
        photos.where(F.col("status").isin(*COUNTED_STATUSES))
        .groupBy("observation_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(observations.select(F.col("id").alias("observation_id"), "location_id"), "observation_id")
        .groupBy("location_id")
        .agg(F.sum("n").alias("photo_count"))
    )


DUPLICATE_KEY = ["location_id", "original_filename", "captured_at"]


def dedupe_uploads(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """First copy (smallest id) of each (location, filename, time) that is not stored yet."""
    first = F.min_by(F.struct(*[F.col(c) for c in incoming.columns]), F.col("id"))
    fresh = incoming.groupBy(*DUPLICATE_KEY).agg(first.alias("r")).select("r.*")
    return fresh.join(stored.select(*DUPLICATE_KEY), DUPLICATE_KEY, "left_anti")


def stored_photo_keys(photos: DataFrame, observations: DataFrame, batches: DataFrame) -> DataFrame:
    """Duplicate keys of stored photos, located through their series and through their batch."""
    by_series = photos.join(observations.select(F.col("id").alias("observation_id"), "location_id"), "observation_id")
    by_batch = photos.join(batches.select(F.col("id").alias("upload_batch_id"), "location_id"), "upload_batch_id")
    return by_series.select(*DUPLICATE_KEY).unionByName(by_batch.select(*DUPLICATE_KEY))


def system_filenames(uploads: DataFrame, locations: DataFrame) -> DataFrame:
    """Stored name of each upload: coordinates, time, batch prefix and a two-digit counter for equal names."""
    spots = locations.select(F.col("id").alias("location_id"), "latitude", "longitude")
    dotted = [F.translate(F.col(c).cast("string"), ".", "_") for c in ("latitude", "longitude")]
    stamp = F.date_format("captured_at", "yyyyMMdd_HHmmss_SSSSSS")
    ending = F.regexp_extract("original_filename", r"[^.](\.[^./\\]+)$", 1)
    stems = (
        uploads.join(spots, "location_id")
        .withColumn("_stem", F.concat_ws("_", *dotted, stamp, F.substring("upload_batch_id", 1, 8)))
        .withColumn("_ending", F.when(ending == "", ".jpg").otherwise(ending))
    )
    return (
        ranked(keyed(stems, ["_stem", "_ending"]), ["_stem", "_ending"], ["id"], "_copy")
        .withColumn("system_filename", F.concat("_stem", F.lit("_"), F.format_string("%02d", F.col("_copy")), "_ending"))
        .drop("_stem", "_ending", "_copy", "latitude", "longitude")
    )


def uploaded_files(photos: DataFrame) -> DataFrame:
    """Files already received, per batch, for resuming an upload."""
    return photos.where(F.col("upload_batch_id").isNotNull()).select("upload_batch_id", "original_filename", "captured_at")


def batch_accounting(photos: DataFrame, batches: DataFrame) -> DataFrame:
    """Received files per batch against the declared total."""
    received = photos.groupBy(F.col("upload_batch_id").alias("id")).agg(F.count(F.lit(1)).alias("received"))
    return (
        batches.join(received, "id", "left")
        .withColumn("received", F.coalesce("received", F.lit(0)))
        .select("id", "total_files", "received", (F.col("total_files") - F.col("received")).alias("missing"))
    )
