"""Service forecasts, archiving, cleanup candidates, the gallery and the identification queue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.names import common_name, plural_form, species_label, user_label
from trapline.functions.rounding import half_even
from trapline.operators.consensus import series_votes, winners
from trapline.operators.scope import Viewer, accessible

# Visit purposes after which a camera is not working, and the warning levels of the forecast.
INACTIVE_PURPOSES = (3, 4)
DAYS_WARNING, DAYS_CRITICAL = 180, 300
PHOTOS_WARNING, PHOTOS_CRITICAL = 5_000, 10_000


def _severity(value, warning: int, critical: int):
    return F.when(value >= critical, 2).when(value >= warning, 1).otherwise(0)


def service_forecast(
    locations: DataFrame, visits: DataFrame, stats: DataFrame, today: date, inactive: tuple[int, ...] = INACTIVE_PURPOSES
) -> DataFrame:
    """State of every site from its last visit: the worse of days since then and predicted photos, days on a tie."""
    newest = F.max_by(F.struct("visit_datetime", "visit_purpose_id"), F.struct("visit_datetime", "id")).alias("v")
    last = visits.groupBy("location_id").agg(newest).select("location_id", "v.*")
    rows = (
        locations.select(F.col("id").alias("location_id"), "name")
        .join(last, "location_id", "left")
        .join(stats.select("location_id", "avg_photos_per_day"), "location_id", "left")
        .withColumn("days_since_visit", F.date_diff(F.lit(today.isoformat()).cast("date"), F.to_date("visit_datetime")))
    )
    off = F.col("visit_purpose_id").isin(*inactive)
    predicted = F.when(
        ~F.coalesce(off, F.lit(False)) & (F.col("avg_photos_per_day") > 0),
        F.floor(F.col("days_since_visit") * F.col("avg_photos_per_day")),
    )
    by_days = _severity(F.col("days_since_visit"), DAYS_WARNING, DAYS_CRITICAL)
    by_photos = F.coalesce(_severity(F.col("predicted_photos"), PHOTOS_WARNING, PHOTOS_CRITICAL), F.lit(0))
    names = F.array(*[F.lit(n) for n in ("ok", "warning", "critical")])
    status = (
        F.when(F.col("visit_datetime").isNull(), "unknown").when(off, "inactive").otherwise(F.get(names, F.greatest(by_days, by_photos)))
    )
    reason = (
        F.when(F.col("visit_datetime").isNull(), "no visits").when(off, "purpose").when(by_photos > by_days, "photos").otherwise("days")
    )
    return rows.withColumn("predicted_photos", predicted).select(
        "location_id", "name", status.alias("status"), reason.alias("reason"), "visit_datetime", "days_since_visit", "predicted_photos"
    )


def visit_history(
    visits: DataFrame, purposes: DataFrame, batteries: DataFrame, users: DataFrame, newest: int = 20
) -> DataFrame:
    """The newest visits of every site with their lookups spelled out."""
    order = Window.partitionBy("location_id").orderBy(F.desc("visit_datetime"), F.desc("id"))
    return (
        visits.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= newest)
        .join(purposes.select(F.col("id").alias("visit_purpose_id"), F.col("name").alias("purpose")), "visit_purpose_id", "left")
        .join(batteries.select(F.col("id").alias("battery_type_id"), F.col("name").alias("battery")), "battery_type_id", "left")
        .join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
        .select(
            "location_id", "place", "id", "visit_datetime", "purpose",
            F.coalesce("battery", F.lit("not replaced")).alias("battery"),
            user_label().alias("visitor"),
            "is_camera_operational",
        )
    )


# Fixed value: the "other" category, never archived.
OTHER = -2


def archivable_series(
    observations: DataFrame, photos: DataFrame, identifications: DataFrame, now: str, days: int = 30, keep: int = OTHER
) -> DataFrame:
    """Completed series without an "other" vote, with a photo to archive, whose newest vote is older than ``days``."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    done = observations.where("status = 'completed'").select(F.col("id").alias("observation_id"))
    voted = (
        series_votes(identifications, photos)
        .groupBy("observation_id")
        .agg(F.max("created_at").alias("newest"), F.max(F.coalesce(F.col("species_id") == keep, F.lit(False))).alias("_other"))
        .where((F.col("newest") < limit) & ~F.col("_other"))
    )
    ready = photos.where("status = 'completed' AND NOT is_favorite").select("observation_id")
    return (
        done.join(voted.select("observation_id", "newest"), "observation_id").join(ready, "observation_id", "left_semi")
    )


def archive_photos(photos: DataFrame, archivable: DataFrame) -> DataFrame:
    """Photo snapshot: completed photos of the archivable series that are no favourites become archived."""
    chosen = archivable.select("observation_id", F.lit(True).alias("_go"))
    due = F.col("_go") & (F.col("status") == "completed") & ~F.col("is_favorite")
    return (
        photos.join(chosen, "observation_id", "left")
        .withColumn("status", F.when(F.coalesce(due, F.lit(False)), "archived").otherwise(F.col("status")))
        .drop("_go")
    )


def archive_series(observations: DataFrame, archived_photos: DataFrame, archivable: DataFrame) -> DataFrame:
    """Series snapshot: an archivable series is archived when all its photos are archived or favourites."""
    finished = (
        archived_photos.join(archivable.select("observation_id"), "observation_id", "left_semi")
        .groupBy(F.col("observation_id").alias("id"))
        .agg(F.bool_and((F.col("status") == "archived") | F.col("is_favorite")).alias("_all"))
        .where("_all")
    )
    return (
        observations.join(finished, "id", "left")
        .withColumn("status", F.when(F.col("_all"), "archived").otherwise(F.col("status")))
        .drop("_all")
    )


def archive_estimate(photos: DataFrame, archivable: DataFrame, files: DataFrame) -> DataFrame:
    """One row: series, photos and megabytes that archiving would free. ``files`` (name, length) lists every stored copy."""
    due = photos.where("status = 'completed' AND NOT is_favorite").join(
        archivable.select("observation_id"), "observation_id", "left_semi"
    )
    sizes = files.groupBy(F.col("name").alias("system_filename")).agg(F.sum("length").alias("bytes"))
    per_series = (
        due.join(sizes, "system_filename", "left")
        .groupBy("observation_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    )
    return per_series.agg(
        F.count(F.lit(1)).alias("observations_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("photos_count"),
        half_even(F.coalesce(F.sum("bytes"), F.lit(0)) / (1024 * 1024), 1).alias("estimated_size_mb"),
    )


# Batch states.
ACTIVE_STATES = ("uploading", "processing", "ready_to_group", "grouping")
SHORT_STATES = ("ready_to_group", "grouping")
CLEANUP_STATES = (*ACTIVE_STATES, "failed")


def active_batches(before: DataFrame, after: DataFrame, now: str, short_minutes: int = 60) -> DataFrame:
    """Ids of batches that received files between two snapshots, or entered a short-lived state recently."""
    seen = before.where(F.col("status").isin(*ACTIVE_STATES)).select("id", F.coalesce("processed_files", F.lit(0)).alias("_then"))
    current = after.where(F.col("status").isin(*ACTIVE_STATES))
    grown = current.join(seen, "id").where(F.coalesce("processed_files", F.lit(0)) != F.col("_then")).select("id")
    since = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(short_minutes))
    recent = current.where(F.col("status").isin(*SHORT_STATES) & (F.col("created_at") > since)).select("id")
    return grown.union(recent).distinct()


def stale_batches(batches: DataFrame, active: DataFrame, now: str, hours: int = 0) -> DataFrame:
    """Open or failed batches created before the threshold that are not active."""
    limit = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    old = batches.where(F.col("status").isin(*CLEANUP_STATES) & (F.col("created_at") <= limit))
    return old.join(active.select("id"), "id", "left_anti")


def stranded_photos(photos: DataFrame, batches: DataFrame, stale: DataFrame, active: DataFrame) -> DataFrame:
    """Uploaded photos without series, not favourites, whose batch is gone, closed or stale and not active."""
    states = batches.select(F.col("id").alias("upload_batch_id"), F.col("status").alias("_state"))
    old = stale.select(F.col("id").alias("upload_batch_id"), F.lit(True).alias("_stale"))
    loose = photos.where("status = 'uploaded' AND observation_id IS NULL AND NOT is_favorite")
    closed = F.col("upload_batch_id").isNull() | F.col("_state").isin("completed", "failed") | F.col("_stale")
    return (
        loose.join(states, "upload_batch_id", "left")
        .join(old, "upload_batch_id", "left")
        .where(closed)
        .drop("_state", "_stale")
        .join(active.select(F.col("id").alias("upload_batch_id")), "upload_batch_id", "left_anti")
    )


def orphan_files(files: DataFrame, photos: DataFrame, now: str, safety_seconds: int = 300) -> DataFrame:
    """Files no photo row knows, unchanged for the safety time."""
    limit = F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(safety_seconds))
    known = photos.select(F.col("system_filename").alias("name"))
    return files.where(F.col("modificationTime") <= limit).join(known, "name", "left_anti")


def cleanup_totals(active: DataFrame, stale: DataFrame, stranded: DataFrame, files: DataFrame, orphans: DataFrame) -> DataFrame:
    """(metric, value) of the cleanup report."""
    lost = files.join(stranded.select(F.col("system_filename").alias("name")), "name", "left_semi")

    def metric(name: str, df: DataFrame, value) -> DataFrame:
        return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")

    one = F.count(F.lit(1))
    parts = [
        metric("active_protected", active, one),
        metric("stale_batches", stale, one),
        metric("stranded_photos", stranded, one),
        metric("stranded_files", lost, one),
        metric("stranded_bytes", lost, F.sum("length")),
        metric("orphan_files", orphans, one),
        metric("orphan_bytes", orphans, F.sum("length")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    freed = rows.where(F.col("metric").endswith("_bytes")).agg(F.sum("value").alias("value"))
    return rows.unionByName(freed.select(F.lit("freed_bytes").alias("metric"), "value"))


def sample(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """The first rows by key, shown in the report beside the full counts."""
    return rows.orderBy(key).limit(size)


def flagged_series(observations: DataFrame, locations: DataFrame, photos: DataFrame) -> DataFrame:
    """Flagged series, newest first, with the site and the first photo."""
    flagged = observations.where("flagged")
    first = (
        photos.join(flagged.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
        .groupBy(F.col("observation_id").alias("id"))
        .agg(F.min_by("system_filename", F.struct("captured_at", "id")).alias("thumb"))
    )
    sites = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"))
    return (
        flagged.join(sites, "location_id", "left")
        .join(first, "id", "left")
        .select("id", F.coalesce("location_name", F.lit("")).alias("location_name"), "series_start_time", "flag_note", "thumb")
        .orderBy(F.desc("series_start_time"), "id")
    )


# Photo states the gallery shows.
GALLERY_STATES = ("completed", "pending", "archived")


def gallery(
    photos: DataFrame,
    observations: DataFrame,
    locations: DataFrame,
    location_institutions: DataFrame,
    identifications: DataFrame,
    species: DataFrame,
    users: DataFrame,
    viewer: Viewer,
    manager: bool = False,
    species_id: int = 0,
    lang: str = "uk",
) -> DataFrame:
    """Favourite photos under the consensus species of their series. Only managers see special categories and the first
    voter of a photo; ``species_id`` 0 shows all species."""
    visible = accessible(observations, locations, location_institutions, viewer).select(
        F.col("id").alias("observation_id"), "location_id"
    )
    shown = photos.where(F.col("is_favorite") & F.col("status").isin(*GALLERY_STATES)).select(
        F.col("id").alias("photo_id"), "observation_id", "system_filename", "captured_at"
    )
    shown = shown.join(visible, "observation_id")
    series = shown.select(F.col("observation_id").alias("id")).distinct()
    won = winners(identifications, photos, null_species=False, quantity="unknown_zero", within=series)
    won = won.select("observation_id", "species_id")
    if not manager:
        won = won.where("species_id > 0")
    if species_id:
        won = won.where(F.col("species_id") == species_id)
    named = species.select(F.col("id").alias("species_id"), species_label(lang).alias("species_name"))
    sites = locations.select(F.col("id").alias("location_id"), F.col("name").alias("location_name"))
    rows = shown.join(won, "observation_id").join(named, "species_id").join(sites, "location_id")
    if manager:
        first = (
            identifications.join(shown.select("photo_id"), "photo_id", "left_semi")
            .groupBy("photo_id")
            .agg(F.min_by("user_id", F.struct("created_at", "id")).alias("user_id"))
        )
        rows = rows.join(first, "photo_id", "left").join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
        rows = rows.withColumnRenamed("username", "added_by")
    else:
        rows = rows.withColumn("added_by", F.lit(None).cast("string"))
    return rows.select(
        "photo_id", "observation_id", "species_id", "species_name", "location_name", "system_filename", "captured_at", "added_by"
    )


def unfavoured_photos(photos: DataFrame) -> DataFrame:
    """Photos that are no favourites: candidates for dropping the raw file."""
    return photos.where(~F.col("is_favorite"))


# --- identification queue -----------------------------------------------------------------------------------------------
def remaining_series(
    observations: DataFrame,
    photos: DataFrame,
    identifications: DataFrame,
    locations: DataFrame,
    location_institutions: DataFrame,
    users: DataFrame,
    user_institutions: DataFrame,
) -> DataFrame:
    """Pending series every user may still vote on, and those of them that others voted on already.

    ``users``: id, is_admin; ``user_institutions``: user_id, institution_id. Counted as all visible series minus the ones
    the user has touched, so no user is paired with every series.
    """
    pending = observations.where("status = 'pending'").select(F.col("id").alias("observation_id"), "location_id")
    votes = series_votes(identifications.select("photo_id", "user_id"), photos).select("observation_id", "user_id")
    voted = votes.select("observation_id").distinct().withColumn("_voted", F.lit(1))
    public = locations.select(F.col("id").alias("location_id"), (F.col("visibility_level") == 0).alias("_public"))
    known = pending.join(public, "location_id", "left")
    per_site = (
        known.join(voted, "observation_id", "left")
        .groupBy("location_id", "_public")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("_voted", F.lit(0))).alias("voted"))
    )
    everywhere = per_site.agg(F.sum("n").alias("n"), F.sum("voted").alias("voted"))
    open_sites = per_site.where("_public").agg(F.sum("n").alias("n"), F.sum("voted").alias("voted"))
    base = {
        name: F.coalesce(
            F.when(F.col("is_admin"), everywhere.select(name).scalar()).otherwise(open_sites.select(name).scalar()), F.lit(0)
        )
        for name in ("n", "voted")
    }
    member_sites = (
        user_institutions.join(location_institutions, "institution_id").select("user_id", "location_id").distinct()
    )
    own = (
        member_sites.join(per_site.where("NOT _public"), "location_id")
        .groupBy("user_id")
        .agg(F.sum("n").alias("_own"), F.sum("voted").alias("_own_voted"))
    )
    touched = (
        votes.join(known, "observation_id")
        .select("user_id", "observation_id", "location_id", "_public")
        .distinct()
        .groupBy("user_id", "location_id", "_public")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    people = users.select(F.col("id").alias("user_id"), "is_admin")
    mine = member_sites.withColumn("_member", F.lit(True))
    done = (
        touched.join(people, "user_id")
        .join(mine, ["user_id", "location_id"], "left")
        .where(F.col("is_admin") | F.col("_public") | F.col("_member"))
        .groupBy("user_id")
        .agg(F.sum("n").alias("_touched"))
    )
    none = F.lit(0)
    extra = {c: F.when(F.col("is_admin"), none).otherwise(F.coalesce(c, none)) for c in ("_own", "_own_voted")}
    return (
        people.join(own, "user_id", "left")
        .join(done, "user_id", "left")
        .select(
            "user_id",
            (base["n"] + extra["_own"] - F.coalesce("_touched", none)).alias("remaining_count"),
            (base["voted"] + extra["_own_voted"] - F.coalesce("_touched", none)).alias("already_identified_count"),
        )
    )


def remaining_in_scope(
    observations: DataFrame,
    photos: DataFrame,
    identifications: DataFrame,
    locations: DataFrame,
    location_institutions: DataFrame,
    users: DataFrame,
    user_institutions: DataFrame,
    chosen: DataFrame,
) -> DataFrame:
    """``remaining_series`` inside the ``chosen`` institutions (institution_id): the one selected, or those of an ecoregion.

    Admins count over all of them, members over those they belong to. For everyone else the selection is ignored, and for
    admins too when it names no institution.
    """
    linked = location_institutions.join(chosen, "institution_id", "left_semi")
    own = user_institutions.join(chosen, "institution_id", "left_semi")
    members = own.select(F.col("user_id").alias("id")).distinct().withColumn("_member", F.lit(True))
    known = chosen.agg(F.count(F.lit(1))).scalar() > 0
    marked = users.join(members, "id", "left").withColumn("_inside", F.when(F.col("is_admin"), known).otherwise(F.col("_member").isNotNull()))
    inside = observations.join(linked.select("location_id").distinct(), "location_id", "left_semi")
    by_membership = locations.withColumn("visibility_level", F.lit(1))
    scoped = remaining_series(inside, photos, identifications, by_membership, linked, marked.where("_inside"), own)
    others = marked.where("NOT _inside")
    return scoped.unionByName(
        remaining_series(observations, photos, identifications, locations, location_institutions, others, user_institutions)
    )


# The fewest open series worth a reminder, and the forms of the noun beside the number.
REMINDER_LEAST = 10
SERIES_FORMS = ("серія", "серії", "серій")


def reminders(remaining: DataFrame, least: int = REMINDER_LEAST) -> DataFrame:
    """Users with enough open series to be reminded, with the noun form that fits the number."""
    word = plural_form(F.col("remaining_count"), *SERIES_FORMS)
    return remaining.where(F.col("remaining_count") >= least).withColumn("series_word", word)


def untouched_series(observations: DataFrame, photos: DataFrame, identifications: DataFrame, user_id: int) -> DataFrame:
    """Series the user has not voted on."""
    own = series_votes(identifications.where(F.col("user_id") == user_id), photos)
    return observations.join(own.select(F.col("observation_id").alias("id")), "id", "left_anti")


def queue_order(
    series: DataFrame, photos: DataFrame, identifications: DataFrame, sort: str = "priority_random", seed: int = 0
) -> DataFrame:
    """Series in the order they are offered. ``priority_random`` puts voted series first, the larger ones before the
    smaller, and the rest in a seeded random order."""
    sized = photos.groupBy(F.col("observation_id").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    rows = series.join(sized, "id", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    shuffled = F.xxhash64("id", F.lit(seed))
    orders = {
        "date_desc": [F.desc("series_start_time"), F.col("id")],
        "date_asc": [F.col("series_start_time"), F.col("id")],
        "photo_count_desc": [F.desc("size"), F.col("id")],
        "photo_count_asc": [F.col("size"), F.col("id")],
        "random": [shuffled],
    }
    if sort in orders:
        return rows.orderBy(*orders[sort])
    votes = (
        series_votes(identifications.select("photo_id", "user_id"), photos)
        .groupBy(F.col("observation_id").alias("id"))
        .agg(F.count_distinct("user_id").alias("votes"))
    )
    ranked = rows.join(votes, "id", "left").withColumn("votes", F.coalesce("votes", F.lit(0)))
    return ranked.orderBy(F.desc("votes"), F.when(F.col("votes") > 0, F.col("size")).desc_nulls_first(), shuffled)


def next_series(ordered: DataFrame) -> DataFrame:
    return ordered.limit(1)


def review_series(
    observations: DataFrame,
    photos: DataFrame,
    identifications: DataFrame,
    user_id: int | None = None,
    species_id: int | None = None,
) -> DataFrame:
    """Pending or completed series with a vote, optionally of one user and for one species."""
    kept = observations.where(F.col("status").isin("pending", "completed"))
    conditions = [F.lit(True)]
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if species_id is not None:
        conditions.append(F.col("species_id") == species_id)
    for condition in conditions:
        hits = series_votes(identifications.where(condition).select("photo_id"), photos)
        kept = kept.join(hits.select(F.col("observation_id").alias("id")), "id", "left_semi")
    return kept


def earliest_votes(identifications: DataFrame, photos: DataFrame, species: DataFrame, users: DataFrame, lang: str = "uk") -> DataFrame:
    """The vote of every user on the earliest photo of a series that carries one."""
    shot = photos.where("observation_id IS NOT NULL").select(F.col("id").alias("photo_id"), "observation_id", "captured_at")
    details = F.struct("species_id", "quantity", "created_at")
    first = (
        identifications.join(shot, "photo_id")
        .groupBy("observation_id", "user_id")
        .agg(F.min_by(details, F.struct("captured_at", "photo_id")).alias("v"))
        .select("observation_id", "user_id", "v.*")
    )
    named = species.select(F.col("id").alias("species_id"), F.coalesce(common_name(lang), F.col("scientific_name")).alias("species_name"))
    return (
        first.join(named, "species_id", "left")
        .join(users.select(F.col("id").alias("user_id"), "username"), "user_id", "left")
        .select(
            "observation_id", "user_id", user_label().alias("username"),
            F.coalesce("species_name", F.lit("Unknown")).alias("species_name"), "quantity", "created_at",
        )
    )
