"""Row scopes: validity of a site, what a viewer may see, selected institutions and named scopes."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Viewer:
    """Who asks. Only admins see every site; a viewer without institutions sees the public ones."""

    admin: bool = False
    institution_ids: tuple[int, ...] = ()
    signed_in: bool = True


def valid_locations(locations: DataFrame, strict: bool = False) -> DataFrame:
    """Sites not flagged invalid. Strict keeps only a TRUE flag, lenient also keeps an unset one."""
    flag = F.col("is_valid")
    return locations.where(flag.eqNullSafe(F.lit(True)) if strict else ~flag.eqNullSafe(F.lit(False)))


def _keep(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(F.col("id").alias(key)), key, "left_semi")


def at_valid_locations(df: DataFrame, locations: DataFrame, strict: bool = False, key: str = "location_id") -> DataFrame:
    return _keep(df, valid_locations(locations, strict), key)


def member_locations(location_institutions: DataFrame, institution_ids: Iterable[int]) -> DataFrame:
    """Sites that belong to any of the institutions."""
    chosen = location_institutions.where(F.col("institution_id").isin(*institution_ids) if institution_ids else F.lit(False))
    return chosen.select(F.col("location_id").alias("id")).distinct()


def accessible_locations(locations: DataFrame, location_institutions: DataFrame, viewer: Viewer) -> DataFrame:
    if viewer.admin:
        return locations.select("id")
    public = locations.where("visibility_level = 0").select("id")
    if not viewer.institution_ids:
        return public
    own = _keep(locations.select("id"), member_locations(location_institutions, viewer.institution_ids), "id")
    return public.union(own).distinct()


def accessible(
    df: DataFrame, locations: DataFrame, location_institutions: DataFrame, viewer: Viewer, key: str = "location_id"
) -> DataFrame:
    """Rows at sites the viewer may see. A row whose site is unknown is never visible."""
    return _keep(df, accessible_locations(locations, location_institutions, viewer), key)


def parse_ids(selected: str | int | Iterable | None) -> list[int]:
    """Ids of a list, a number or a comma-separated text; anything that is not a whole number is ignored."""
    if selected is None:
        return []
    if isinstance(selected, str):
        selected = selected.split(",")
    elif isinstance(selected, (int, float)):
        selected = [int(selected)]
    return [int(str(i).strip()) for i in selected if str(i).strip().lstrip("-").isdigit()]


def in_institutions(df: DataFrame, location_institutions: DataFrame, selected, key: str = "location_id") -> DataFrame:
    """Rows at sites of the selected institutions; an empty selection filters nothing."""
    ids = parse_ids(selected)
    return _keep(df, member_locations(location_institutions, ids), key) if ids else df


def scope_locations(
    scope: str, locations: DataFrame, institutions: DataFrame, location_institutions: DataFrame, default: str = ""
) -> DataFrame:
    """Site ids of ``global:``, ``institution:<id>`` or ``ecoregion:<key>``.

    An explicit ecoregion without institutions gives no rows. The default applies to an empty scope only, and a default
    ecoregion that does not exist falls back to all sites.
    """
    asked, by_default = (scope or "").strip(), False
    if not asked and default.strip():
        asked, by_default = default.strip(), True
    kind, _, key = asked.partition(":")
    everywhere = locations.select("id")
    if kind == "institution" and key.isdigit():
        return member_locations(location_institutions, [int(key)])
    if kind != "ecoregion" or not key:
        return everywhere
    named = institutions.where(F.col("ecoregion") == key)
    inside = location_institutions.join(named.select(F.col("id").alias("institution_id")), "institution_id", "left_semi")
    inside = inside.select(F.col("location_id").alias("id")).distinct()
    if not by_default:
        return inside
    known = F.coalesce(named.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    return inside.union(everywhere.where(known == 0))


def all_scopes(available: DataFrame, institutions: DataFrame, location_institutions: DataFrame) -> DataFrame:
    """(scope_type, scope_id, location_id) of every scope, over the sites that have data."""
    sites = available.select("location_id").distinct()
    linked = location_institutions.join(sites, "location_id", "left_semi")
    regions = institutions.where(F.col("ecoregion").isNotNull()).select(F.col("id").alias("institution_id"), "ecoregion")
    everywhere = sites.select(F.lit("global").alias("scope_type"), F.lit("").alias("scope_id"), "location_id")
    by_institution = linked.select(
        F.lit("institution").alias("scope_type"), F.col("institution_id").cast("string").alias("scope_id"), "location_id"
    )
    by_region = (
        linked.join(regions, "institution_id")
        .select(F.lit("ecoregion").alias("scope_type"), F.col("ecoregion").alias("scope_id"), "location_id")
        .distinct()
    )
    return everywhere.unionByName(by_institution).unionByName(by_region)


def photo_sites(photos: DataFrame, observations: DataFrame, batches: DataFrame) -> DataFrame:
    """Photos with the site of their series, or of their upload batch while they are not grouped."""
    by_series = observations.select(F.col("id").alias("observation_id"), F.col("location_id").alias("_series_site"))
    by_batch = batches.select(F.col("id").alias("upload_batch_id"), F.col("location_id").alias("_batch_site"))
    return (
        photos.join(by_series, "observation_id", "left")
        .join(by_batch, "upload_batch_id", "left")
        .withColumn("location_id", F.coalesce("_series_site", "_batch_site"))
        .drop("_series_site", "_batch_site")
    )


def viewable_photos(
    photos: DataFrame,
    observations: DataFrame,
    batches: DataFrame,
    locations: DataFrame,
    location_institutions: DataFrame,
    viewer: Viewer,
) -> DataFrame:
    """Photos the viewer may open. Photos without a known site are open to admins only."""
    if viewer.admin and viewer.signed_in:
        return photos
    seen_as = viewer if viewer.signed_in else Viewer(signed_in=False)
    placed = photo_sites(photos, observations, batches)
    return accessible(placed, locations, location_institutions, seen_as).drop("location_id")
