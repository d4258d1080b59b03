"""Quality of deployments: derived flags, filters, figures and the register export."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.operators.filters import any_of, both
from trapline.sources.starschema import QC_BOOLEAN_FLAGS, QC_TEXT_FLAG

# The shortest useful season.
SEASON_DAYS = {"Winter": 100, "Summer": 60}
DERIVED_FLAGS = ("qc_no_gps_coordinates", "qc_data_not_usable", "qc_summary", "qc_min_days_not_reached")


def first_institutions(location_institutions: DataFrame, institutions: DataFrame) -> DataFrame:
    """The institution with the smallest id of every site."""
    first = location_institutions.groupBy("location_id").agg(F.min("institution_id").alias("_institution"))
    named = institutions.select(
        F.col("id").alias("_institution"), F.col("code").alias("study_area_id"), F.col("name").alias("study_area"),
        F.col("ecoregion").alias("region"),
    )
    return first.join(named, "_institution", "left").drop("_institution")


def assess(deployments: DataFrame, locations: DataFrame, first_institution: DataFrame) -> DataFrame:
    """Deployments with derived flags; an unknown flag leaves a derived one unknown unless another decides it."""
    sites = locations.select(F.col("id").alias("location_id"), "latitude", "longitude")
    flag = F.col
    no_gps = flag("latitude").isNull() | flag("longitude").isNull()
    no_species = flag("qc_no_species_captured")
    unusable = any_of(
        flag("qc_data_not_usable"),
        no_gps,
        flag("qc_feeding_location"),
        flag("qc_hardware_issue"),
        both(flag("qc_installation_incorrect"), no_species),
        both(flag("qc_placement_incorrect"), no_species),
        both(flag("qc_poor_placement"), no_species),
    )
    summary = any_of(
        flag("_unusable"), flag("qc_no_data_uploaded_by_pa"), flag("qc_sd_issue"), flag("qc_stolen"), flag("qc_non_functional")
    )
    days = F.date_diff("end_date", "start_date")
    too_short = None
    for season, least in SEASON_DAYS.items():
        met = F.col("study_season") == season
        short = F.col("n_days_working") < least
        too_short = F.when(met, short) if too_short is None else too_short.when(met, short)
    status = (
        F.when(F.col("qc_summary"), "issue").when(F.col("study_season") == "Summer", "normal_summer").otherwise("normal_winter")
    )
    return (
        deployments.join(sites, "location_id", "left")
        .join(first_institution, "location_id", "left")
        .withColumn("n_days_working", days)
        .withColumn("_unusable", unusable)
        .withColumn("qc_summary", summary)
        .withColumn("qc_no_gps_coordinates", no_gps)
        .withColumn("qc_data_not_usable", F.col("_unusable"))
        .withColumn("qc_min_days_not_reached", too_short)
        .withColumn("status", status)
        .drop("_unusable", "latitude", "longitude")
    )


def quality_filter(assessed: DataFrame, equals: dict[str, str] | None = None, raised: Iterable[str] = ()) -> DataFrame:
    """Rows whose categories equal the chosen texts and that raise any of the chosen flags."""
    for column, wanted in (equals or {}).items():
        assessed = assessed.where(F.col(column).cast("string") == wanted)
    flags = [F.coalesce(F.col(f), F.lit(False)) for f in raised]
    return assessed.where(any_of(*flags)) if flags else assessed


def quality_kpis(assessed: DataFrame) -> DataFrame:
    unusable = F.count_if("qc_data_not_usable")
    total = F.count(F.lit(1))
    return assessed.agg(
        total.alias("total"),
        F.round(F.try_divide(100 * (total - unusable), total)).cast("bigint").alias("usable_percent"),
        F.count_if("qc_summary").alias("issues"),
        F.count_if("qc_min_days_not_reached").alias("short_deployments"),
        F.coalesce(F.sum("n_photos"), F.lit(0)).alias("photos"),
        F.coalesce(F.round(F.avg("n_days_working")).cast("bigint"), F.lit(0)).alias("mean_days"),
    )


def flag_counts(assessed: DataFrame) -> DataFrame:
    """Raised, clear and unknown deployments per flag."""
    flags = list(dict.fromkeys([*QC_BOOLEAN_FLAGS, *DERIVED_FLAGS]))
    long = assessed.select(*flags).unpivot([], flags, "flag", "value")
    return long.groupBy("flag").agg(
        F.count_if("value").alias("raised"), F.count_if(~F.col("value")).alias("clear"), F.count_if(F.col("value").isNull()).alias("unknown")
    )


def status_counts(assessed: DataFrame) -> DataFrame:
    """(kind, value, deployments) by status and by year; years of zero or unknown are left out."""
    by_status = assessed.groupBy("status").agg(F.count(F.lit(1)).alias("deployments"))
    by_year = assessed.where("study_year <> 0").groupBy("study_year").agg(F.count(F.lit(1)).alias("deployments"))
    return by_status.select(F.lit("status").alias("kind"), F.col("status").alias("value"), "deployments").unionByName(
        by_year.select(F.lit("study_year").alias("kind"), F.col("study_year").cast("string").alias("value"), "deployments")
    )


def filter_options(assessed: DataFrame, columns: Iterable[str] = ("region", "study_area", "study_year", "study_season")) -> DataFrame:
    """(field, value) choices of the category filters."""
    names = list(columns)
    long = assessed.select(*[F.col(c).cast("string").alias(c) for c in names]).unpivot([], names, "field", "value")
    return long.where("value <> '' AND NOT (field = 'study_year' AND value = '0')").distinct()


def export_deployments(
    deployments: DataFrame,
    locations: DataFrame,
    first_institution: DataFrame,
    sites: DataFrame | None = None,
    year: int | None = None,
) -> DataFrame:
    """Register rows for the file: institution, campaign, coordinates and all flags. ``sites`` (id) limits the sites."""
    kept = deployments if sites is None else deployments.join(sites.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    if year:
        kept = kept.where(F.col("study_year") == year)
    points = locations.select(
        F.col("id").alias("location_id"),
        F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"),
    )
    # Columns of the register file.
    general = (
        "study_area_id", "study_area_name_EN", "region_name_EN", "study_year", "study_season", "study_design", "camera_id",
        "latitude", "longitude", "start_date", "start_time", "end_date", "end_time", "n_days_working", "n_photos",
        "camera_model", "serial_number", "deployment_id",
    )
    flags = (*QC_BOOLEAN_FLAGS[:21], QC_TEXT_FLAG, *QC_BOOLEAN_FLAGS[21:], "qc_comment")
    spelled = {"qc_no_data_uploaded_by_pa": "qc_no_data_uploaded_by_PA", "qc_no_gps_coordinates": "qc_no_GPS_coordinates"}
    rows = (
        kept.join(points, "location_id")
        .join(first_institution, "location_id", "left")
        .withColumnsRenamed({"study_area": "study_area_name_EN", "region": "region_name_EN", "name": "deployment_id"})
        .withColumn("start_date", F.date_format("start_date", "yyyy-MM-dd"))
        .withColumn("end_date", F.date_format("end_date", "yyyy-MM-dd"))
    )
    for missing in (*general, *flags):
        if missing not in rows.columns:
            rows = rows.withColumn(missing, F.lit(None).cast("string"))
    columns = [F.col(c) for c in general] + [F.col(c).alias(spelled.get(c, c)) for c in flags]
    return rows.orderBy("study_year", "location_id", "deployment_id").select(*columns)
