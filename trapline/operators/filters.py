"""Row filters and small projections shared by the reports."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.names import bracketed_label
from trapline.functions.ordered import keyed, neighbours, ranked
from trapline.operators.scope import Viewer
from trapline.sources.starschema import QC_BOOLEAN_FLAGS, QC_TEXT_FLAG


def _flag_raised(flags: Iterable[str]) -> Column | None:
    """True when any known flag is raised; the text flag counts when it is not empty. Unknown names are ignored."""
    raised = None
    for flag in flags:
        if flag in QC_BOOLEAN_FLAGS:
            one = F.coalesce(F.col(flag), F.lit(False))
        elif flag == QC_TEXT_FLAG:
            one = F.coalesce(F.col(flag) != "", F.lit(False))
        else:
            continue
        raised = one if raised is None else raised | one
    return raised


def covered_days(deployments: DataFrame) -> DataFrame:
    """Distinct (location_id, day) inside closed deployment intervals. Of the intervals of a site that start on one day only
    the longest is unrolled, so the work is bounded by the calendar."""
    closed = deployments.where("location_id IS NOT NULL AND start_date <= end_date")
    longest = closed.groupBy("location_id", "start_date").agg(F.max("end_date").alias("end_date"))
    return longest.select("location_id", F.explode(F.sequence("start_date", "end_date")).alias("day")).distinct()


def flagged_days(deployments: DataFrame, flags: Iterable[str]) -> DataFrame | None:
    """Distinct (location_id, day) covered by a deployment that raises a flag; open-ended intervals cover nothing."""
    raised = _flag_raised(flags)
    if raised is None:
        return None
    return covered_days(deployments.where(raised)).withColumnRenamed("day", "_on")


def qc_exclude(observations: DataFrame, deployments: DataFrame, flags: Iterable[str]) -> DataFrame:
    """Series without an overlapping flagged deployment at their site. Joining on (site, day) keeps a site with many series
    spread over its days."""
    bad = flagged_days(deployments, flags)
    if bad is None:
        return observations
    dated = observations.withColumn("_on", F.to_date("series_start_time"))
    return dated.join(bad, ["location_id", "_on"], "left_anti").select(*observations.columns)


def _midnight(day: str) -> Column:
    return F.lit(day).cast("date").cast("timestamp_ntz")


def _midnight_after(last: str) -> Column:
    return F.date_add(F.lit(last).cast("date"), 1).cast("timestamp_ntz")


def started_between(observations: DataFrame, first: str, last: str) -> DataFrame:
    """Series started on a calendar day from first to last, both included. Compared on the column itself, so that the filter
    reaches the file scan."""
    at = F.col("series_start_time")
    return observations.where((at >= _midnight(first)) & (at < _midnight_after(last)))


def taken_between(first: str, last: str) -> Column:
    """Whether a photo was taken from the start of the first day to the start of the last day: the last day itself is left out,
    but for its very first moment."""
    return F.col("captured_at").between(_midnight(first), _midnight(last))


def captured_between(photos: DataFrame, first: str, last: str) -> DataFrame:
    """Photos that were ``taken_between``."""
    return photos.where(taken_between(first, last))


def captured_through(photos: DataFrame, first: str, last: str) -> DataFrame:
    """Photos from the start of the first day up to, but not including, the day after the last."""
    at = F.col("captured_at")
    return photos.where((at >= _midnight(first)) & (at < _midnight_after(last)))


def begun_through(first: str, last: str) -> Column:
    """Whether a series began from the start of the first day to the midnight after the last day, that midnight included."""
    return F.col("series_start_time").between(_midnight(first), _midnight_after(last))


def started_through(observations: DataFrame, first: str, last: str) -> DataFrame:
    """Series that were ``begun_through``."""
    return observations.where(begun_through(first, last))


@dataclass(frozen=True)
class TaxonFilter:
    """The narrowest rank given decides: species, genus, family, order, class."""

    species_ids: tuple[int, ...] = ()
    genus: str | None = None
    family: str | None = None
    order: str | None = None
    class_name: str | None = None
    species_only: bool = True


def taxon_filter(species: DataFrame, taxon: TaxonFilter) -> DataFrame:
    if taxon.species_only:
        species = species.where("id > 0")
    if taxon.species_ids:
        return species.where(F.col("id").isin(*taxon.species_ids))
    for column, wanted in (
        ("genus", taxon.genus),
        ("family", taxon.family),
        ("order_rank", taxon.order),
        ("class_name", taxon.class_name),
    ):
        if wanted:
            return species.where(F.col(column) == wanted)
    return species


def in_biotopes(df: DataFrame, location_biotopes: DataFrame, biotope_ids: Iterable[int], key: str = "location_id") -> DataFrame:
    """Rows at sites that have any of the biotopes, each row once; an empty selection filters nothing."""
    ids = list(biotope_ids)
    if not ids:
        return df
    sites = location_biotopes.where(F.col("biotope_id").isin(*ids)).select(F.col("location_id").alias(key))
    return df.join(sites, key, "left_semi")


# The plausible range of a camera clock and the placeholder day.
OLDEST_CAPTURE = "2010-01-01"
PLACEHOLDER_DAY = "1900-01-01"
CAPTURE_FORMAT = "yyyy:MM:dd HH:mm:ss"


def clean_capture_time(uploads: DataFrame, now: str) -> DataFrame:
    """``captured_at`` from camera text (``taken_text``, ``subsecond_text``). Implausible or unreadable times become a
    placeholder: the fixed day plus the number of the file in its batch, in seconds."""
    digits = F.trim("subsecond_text")
    fraction = F.when(digits.rlike("^[0-9]+$"), F.rpad(digits, 6, "0").cast("bigint")).otherwise(0)
    taken = F.try_to_timestamp(F.col("taken_text"), F.lit(CAPTURE_FORMAT)).cast("timestamp_ntz")
    exact = taken + F.make_dt_interval(secs=(fraction / 1_000_000).cast("decimal(18,6)"))
    latest = F.lit(now).cast("timestamp_ntz") + F.expr("INTERVAL '24' HOUR")
    plausible = (exact >= F.lit(OLDEST_CAPTURE).cast("timestamp_ntz")) & (exact <= latest)
    placeholder = F.lit(PLACEHOLDER_DAY).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("file_number"))
    counted = ranked(keyed(uploads, ["upload_batch_id"]), ["upload_batch_id"], ["id"], "file_number")
    return counted.withColumn("captured_at", F.when(plausible, exact).otherwise(placeholder))


def allowed_extension(files: DataFrame, column: str = "original_filename", allowed: Iterable[str] = ("jpg", "jpeg")) -> DataFrame:
    """Files whose extension is allowed; a name that only starts with a dot has none."""
    ending = F.lower(F.regexp_extract(F.col(column), r"[^./\\]\.([^./\\]*)$", 1))
    return files.where(ending.isin(*[a.lower() for a in allowed]))


def taxonomy_options(species: DataFrame, chosen: TaxonFilter = TaxonFilter(), lang: str = "uk") -> DataFrame:
    """(level, value, species_id) choices of a cascading picker; every list is narrowed by the levels above it."""
    rows = species.where("id > 0") if chosen.species_only else species
    levels = [
        ("class", "class_name", None),
        ("order", "order_rank", chosen.class_name),
        ("family", "family", chosen.order),
        ("genus", "genus", chosen.family),
    ]
    lists, column_above, narrowed = [], None, rows
    for level, column, wanted in levels:
        if wanted:
            narrowed = narrowed.where(F.col(column_above) == wanted)
        values = narrowed.where(F.col(column).isNotNull()).select(
            F.lit(level).alias("level"), F.col(column).alias("value"), F.lit(None).cast("bigint").alias("species_id")
        )
        lists.append(values.distinct())
        column_above = column
    if chosen.genus:
        narrowed = narrowed.where(F.col("genus") == chosen.genus)
    lists.append(narrowed.select(F.lit("species").alias("level"), bracketed_label(lang).alias("value"), F.col("id").cast("bigint").alias("species_id")))
    result = lists[0]
    for more in lists[1:]:
        result = result.unionByName(more)
    return result


def review_filters(identifications: DataFrame, users: DataFrame, species: DataFrame, lang: str = "uk") -> DataFrame:
    """(kind, id, name): users who voted and species that were voted for."""
    people = users.join(identifications.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    voted = species.join(identifications.select(F.col("species_id").alias("id")).distinct(), "id", "left_semi")
    return people.select(F.lit("user").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("username").alias("name")).unionByName(
        voted.select(F.lit("species").alias("kind"), F.col("id").cast("bigint").alias("id"), bracketed_label(lang).alias("name"))
    )


def any_of(*values: Column) -> Column:
    """Three-valued OR: true wins, otherwise an unknown value makes the result unknown."""
    result = values[0]
    for value in values[1:]:
        result = result | value
    return result


def both(a: Column, b: Column) -> Column:
    """Three-valued AND: false wins, otherwise an unknown value makes the result unknown."""
    return a & b


def location_register(
    locations: DataFrame, location_institutions: DataFrame, location_biotopes: DataFrame, viewer: Viewer
) -> DataFrame:
    """Sites of the viewer's institutions (all for admins) with their institution and biotope ids."""
    if viewer.admin:
        own = locations
    else:
        mine = location_institutions.where(
            F.col("institution_id").isin(*viewer.institution_ids) if viewer.institution_ids else F.lit(False)
        )
        own = locations.join(mine.select(F.col("location_id").alias("id")), "id", "left_semi")
    institutions = location_institutions.groupBy(F.col("location_id").alias("id")).agg(
        F.array_sort(F.collect_set("institution_id")).alias("institution_ids")
    )
    biotopes = location_biotopes.groupBy(F.col("location_id").alias("id")).agg(
        F.array_sort(F.collect_set("biotope_id")).alias("biotope_ids")
    )
    return (
        own.join(institutions, "id", "left")
        .join(biotopes, "id", "left")
        .select(
            "id",
            "name",
            F.col("latitude").cast("double").alias("latitude"),
            F.col("longitude").cast("double").alias("longitude"),
            F.coalesce("institution_ids", F.array().cast("array<int>")).alias("institution_ids"),
            F.coalesce("biotope_ids", F.array().cast("array<int>")).alias("biotope_ids"),
            F.coalesce("is_valid", F.lit(False)).alias("is_valid"),
            F.coalesce("invalid_note", F.lit("")).alias("invalid_note"),
        )
        .orderBy("name")
    )


def site_point() -> list[Column]:
    """Coordinates rounded to five places, as join keys."""
    return [F.round(F.col(c).cast("decimal(20,10)"), 5).alias(f"_{c}") for c in ("latitude", "longitude")]


def duplicate_sites(new: DataFrame, locations: DataFrame) -> DataFrame:
    """New sites beside the stored site at the same rounded coordinates (``existing_id`` is NULL for a new point)."""
    stored = locations.select(*site_point(), "id").groupBy("_latitude", "_longitude").agg(F.min("id").alias("existing_id"))
    return new.select("*", *site_point()).join(stored, ["_latitude", "_longitude"], "left").drop("_latitude", "_longitude")


def series_positions(photos: DataFrame) -> DataFrame:
    """0-based chronological index of each photo in its series, with the neighbouring photos. Photos without a series are left out."""
    placed = neighbours(photos.select("id", "observation_id", "captured_at"), ["observation_id"], "captured_at", "id")
    return placed.select(
        "id",
        "observation_id",
        (F.col("position") - 1).alias("photo_index"),
        F.col("previous").alias("previous_id"),
        F.col("next").alias("next_id"),
    )


def clean_visits(raw: DataFrame) -> DataFrame:
    """Service visit rows from text input: true/false words, optional whole numbers, empty text as NULL."""
    said = F.col("is_camera_operational")
    return raw.select(
        F.col("location_id").try_cast("int").alias("location_id"),
        F.try_to_timestamp("visit_datetime").cast("timestamp_ntz").alias("visit_datetime"),
        F.col("visit_purpose_id").try_cast("int").alias("visit_purpose_id"),
        F.nullif("battery_type_id", F.lit("")).try_cast("int").alias("battery_type_id"),
        F.when(said == "true", True).when(said == "false", False).alias("is_camera_operational"),
        F.nullif("photos_on_card", F.lit("")).try_cast("int").alias("photos_on_card"),
        F.nullif(F.trim("comments"), F.lit("")).alias("comments"),
    ).where("location_id IS NOT NULL AND visit_datetime IS NOT NULL AND visit_purpose_id IS NOT NULL")


def deployment_register(
    deployments: DataFrame, locations: DataFrame, location_institutions: DataFrame, viewer: Viewer, full_access: bool = False
) -> DataFrame:
    """Deployments at the viewer's sites; rows without a site show up only with full access."""
    if viewer.admin or full_access:
        sites = locations.select(F.col("id").alias("location_id"))
        kept = deployments.join(sites, "location_id", "left_semi").unionByName(deployments.where("location_id IS NULL"))
    else:
        mine = location_institutions.where(
            F.col("institution_id").isin(*viewer.institution_ids) if viewer.institution_ids else F.lit(False)
        )
        kept = deployments.join(mine.select("location_id"), "location_id", "left_semi")
    return kept.orderBy(F.col("location_id").asc_nulls_last(), "start_date", "id")


def study_years(register: DataFrame) -> DataFrame:
    return register.where("study_year <> 0").select("study_year").distinct().orderBy(F.desc("study_year"))
