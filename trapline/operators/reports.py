"""Dashboard, contributor, species and site reports."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.rounding import half_even
from trapline.operators.activity import effort_by_location, photo_days
from trapline.operators.consensus import DONE, series_votes, verified_series
from trapline.operators.filters import begun_through, captured_between, started_between, taken_between


def top_species(verified: DataFrame, species: DataFrame, limit: int = 15) -> DataFrame:
    """Most often verified species, ties by Latin name."""
    counted = verified.where("species_id > 0").groupBy("species_id").agg(F.count(F.lit(1)).alias("observation_count"))
    named = species.select(F.col("id").alias("species_id"), "scientific_name", "common_name_ua", "common_name_en")
    return counted.join(named, "species_id").orderBy(F.desc("observation_count"), "scientific_name").limit(limit)


def photos_per_location(photos: DataFrame, observations: DataFrame, locations: DataFrame) -> DataFrame:
    sites = locations.select(
        F.col("id").alias("location_id"),
        "name",
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
    )
    return (
        photos.groupBy("observation_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(observations.select(F.col("id").alias("observation_id"), "location_id"), "observation_id")
        .groupBy("location_id")
        .agg(F.sum("_n").alias("photo_count"))
        .join(sites, "location_id")
    )


def _metric(name: str, df: DataFrame, value: Column) -> DataFrame:
    return df.agg(F.coalesce(value, F.lit(0)).cast("bigint").alias("value")).select(F.lit(name).alias("metric"), "value")


def unvoted(observations: DataFrame, photos: DataFrame, identifications: DataFrame) -> DataFrame:
    """Series without a single vote."""
    voted = series_votes(identifications.select("photo_id"), photos).select(F.col("observation_id").alias("id"))
    return observations.join(voted.distinct(), "id", "left_anti")


KPIS = ("photos", "locations", "capture_days", "observations", "species", "unvoted_series")


def dashboard_kpis(
    photos: DataFrame, identifications: DataFrame, observations: DataFrame, first: str, last: str
) -> DataFrame:
    """(metric, value) rows over the series of the caller's scope. Photos of the last day are left out, series are not.

    Every table is read once: photos and votes meet in one grouping by photo, then become one row for each (series, day, species)
    and one for each series, which says what it adds to each metric. Only distinct (metric, value) pairs are shuffled after that."""
    shots = photos.where(F.col("observation_id").isNotNull()).select(
        F.col("id").alias("photo_id"), "observation_id", F.when(taken_between(first, last), F.to_date("captured_at")).alias("day")
    )
    named = identifications.select("photo_id", F.col("species_id").cast("long").alias("species_id"), F.lit(True).alias("voted"))
    each = (
        shots.unionByName(named, allowMissingColumns=True)
        .groupBy("photo_id")
        .agg(
            F.max("observation_id").alias("observation_id"),
            F.max("day").alias("day"),
            F.collect_set(F.when(F.col("species_id") > 0, F.col("species_id"))).alias("named"),
            F.count("voted").alias("votes"),
        )
        .where(F.col("observation_id").isNotNull())
        .select("observation_id", "day", "votes", F.posexplode_outer("named").alias("place", "species_id"))
    )
    one = F.when(F.coalesce("place", F.lit(0)) == 0, 1)  # a photo counts at its first species
    daily = each.groupBy("observation_id", "day", "species_id").agg(F.sum(one).alias("_n"), F.max("votes").alias("votes"))
    shown = F.col("day").isNotNull()
    series = daily.groupBy("observation_id").agg(
        F.sum(F.when(shown, F.col("_n"))).alias("_n"),
        F.collect_set(F.unix_date("day").cast("long")).alias("days"),
        F.collect_set(F.when(shown, F.col("species_id"))).alias("named"),
        F.max("votes").alias("votes"),
    )
    sites = observations.select(
        F.col("id").alias("observation_id"), F.col("location_id").cast("long"), "status", begun_through(first, last).alias("begun")
    )
    nothing = F.lit(None).cast("long")

    def adds(metric: str, value: Column, count: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), value.cast("long").alias("value"), count.cast("long").alias("count"))

    def members(metric: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<bigint>")), lambda v: adds(metric, v, nothing))

    seen, done = F.size("days") > 0, F.col("status").isin(*DONE)
    unvoted = F.col("begun") & (F.coalesce("votes", F.lit(0)) == 0)
    parts = F.concat(
        members("locations", F.when(seen, F.array("location_id"))),
        members("capture_days", F.col("days")),
        members("species", F.when(done, F.col("named"))),
        F.array(
            adds("photos", nothing, F.col("_n")),
            adds("observations", nothing, F.when(F.size("named") > 0, 1)),
            adds("unvoted_series", nothing, F.when(unvoted, 1)),
        ),
    )
    pairs = sites.join(series, "observation_id", "left").select(F.inline(parts)).where("value IS NOT NULL OR count IS NOT NULL")
    found = pairs.groupBy("metric", "value").agg(F.sum("count").alias("count"))
    sums = [F.sum(F.when(F.col("metric") == m, F.coalesce("count", F.lit(1)))) for m in KPIS]
    rows = [F.struct(F.lit(m).alias("metric"), F.coalesce(n, F.lit(0)).alias("value")) for m, n in zip(KPIS, sums)]
    return found.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def top_contributors(
    photos: DataFrame, identifications: DataFrame, observations: DataFrame, users: DataFrame, first: str, last: str, limit: int = 10
) -> DataFrame:
    """Users with the most voted series among photos of the range."""
    pairs = (
        series_votes(identifications.select("photo_id", "user_id"), captured_between(photos, first, last))
        .join(observations.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
        .select("user_id", "observation_id")
        .distinct()
    )
    ranked = pairs.groupBy("user_id").agg(F.count(F.lit(1)).alias("observation_count"))
    names = users.select(F.col("id").alias("user_id"), "username")
    return ranked.join(names, "user_id", "left").orderBy(F.desc("observation_count"), "user_id").limit(limit)


def window_starts(today: date) -> dict[str, Column]:
    """Starts of the rolling windows that end on ``today``; month and year steps are clipped to the month end."""
    day = F.lit(today.isoformat()).cast("date")
    starts = {"d_today": day, "d_week": F.date_sub(day, 6), "d_month": F.add_months(day, -1), "d_year": F.add_months(day, -12)}
    return {name: start.cast("timestamp_ntz") for name, start in starts.items()}


def _rolling(newest: DataFrame, key: str, today: date) -> DataFrame:
    """Windows over rows that carry the newest vote of a series; a series is inside a window when its newest vote is."""
    windows = [F.count_if(F.col("_at") >= start).alias(name) for name, start in window_starts(today).items()]
    return newest.groupBy(key).agg(*windows, F.count(F.lit(1)).alias("total"))


def contributor_stats(
    identifications: DataFrame, photos: DataFrame, observations: DataFrame, today: date, species_id: int | None = None
) -> DataFrame:
    """Series per user in rolling windows by vote time, optionally for votes on one species."""
    votes = identifications if species_id is None else identifications.where(F.col("species_id") == species_id)
    newest = (
        series_votes(votes, photos)
        .join(observations.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
        .groupBy("user_id", "observation_id")
        .agg(F.max("created_at").alias("_at"))
    )
    return _rolling(newest, "user_id", today)


def institution_stats(
    identifications: DataFrame, photos: DataFrame, observations: DataFrame, location_institutions: DataFrame, today: date
) -> DataFrame:
    """The same windows per institution; a site of several institutions counts for each."""
    newest = series_votes(identifications, photos).groupBy("observation_id").agg(F.max("created_at").alias("_at"))
    sited = newest.join(observations.select(F.col("id").alias("observation_id"), "location_id"), "observation_id")
    # counts per site first: the join to the bridge then works on a handful of rows
    starts = window_starts(today)
    per_site = sited.groupBy("location_id").agg(
        *[F.count_if(F.col("_at") >= start).alias(name) for name, start in starts.items()], F.count(F.lit(1)).alias("total")
    )
    return (
        per_site.join(location_institutions, "location_id")
        .groupBy("institution_id")
        .agg(*[F.sum(name).alias(name) for name in [*starts, "total"]])
    )


def series_progress(
    observations: DataFrame, photos: DataFrame, identifications: DataFrame, location_institutions: DataFrame
) -> DataFrame:
    """Series per institution: total, verified, without votes, and percentages that add up to 100."""
    waiting = unvoted(observations, photos, identifications).groupBy("location_id").agg(F.count(F.lit(1)).alias("pending"))
    per_site = observations.groupBy("location_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*DONE)).alias("completed")
    )
    counts = (
        per_site.join(waiting, "location_id", "left")
        .join(location_institutions, "location_id")
        .groupBy("institution_id")
        .agg(
            F.sum("total").alias("total"),
            F.sum("completed").alias("completed"),
            F.sum(F.coalesce("pending", F.lit(0))).alias("pending"),
        )
    )
    share = {n: half_even(F.col(n) * 100.0 / F.col("total"), 1) for n in ("completed", "pending")}
    return counts.select(
        "*", share["completed"].alias("pct_verified"), share["pending"].alias("pct_pending")
    ).withColumn("pct_in_progress", half_even(F.lit(100.0) - F.col("pct_verified") - F.col("pct_pending"), 1))


def system_totals(observations: DataFrame, photos: DataFrame, identifications: DataFrame) -> DataFrame:
    """(metric, value) over all series of the caller's scope."""
    sized = photos.groupBy(F.col("observation_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    kept = sized.join(observations.select("id"), "id", "left_semi")
    parts = [
        _metric("photos", kept, F.sum("_n")),
        _metric("series", observations, F.count(F.lit(1))),
        _metric("completed", observations.where(F.col("status").isin(*DONE)), F.count(F.lit(1))),
        _metric("pending", unvoted(observations, photos, identifications), F.count(F.lit(1))),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    left = F.when(F.col("metric") == "series", F.col("value")).when(F.col("metric") != "photos", -F.col("value"))
    rest = rows.agg(F.sum(left).alias("value")).select(F.lit("in_progress").alias("metric"), "value")
    return rows.unionByName(rest)


def upload_events(photos: DataFrame, observations: DataFrame, batches: DataFrame) -> DataFrame:
    """Grouped photos with uploader and upload time: from the batch, else from the series."""
    series = observations.select(
        F.col("id").alias("observation_id"), F.col("uploaded_by_id").alias("_by"), F.col("created_at").alias("_at")
    )
    sent = batches.select(
        F.col("id").alias("upload_batch_id"), F.col("uploaded_by_id").alias("_batch_by"), F.col("created_at").alias("_batch_at")
    )
    return (
        photos.select("observation_id", "upload_batch_id")
        .join(series, "observation_id")
        .join(sent, "upload_batch_id", "left")
        .select(F.coalesce("_batch_by", "_by").alias("user_id"), F.coalesce("_batch_at", "_at").alias("uploaded_at"))
    )


def upload_stats(events: DataFrame, today: date) -> DataFrame:
    """Photos per uploader in rolling windows by upload time."""
    return _rolling(events.withColumnRenamed("uploaded_at", "_at"), "user_id", today)


def upload_daily(events: DataFrame, today: date, days: int = 30) -> DataFrame:
    """Photos per day of the last ``days`` days, zero where nothing came in."""
    first = today - timedelta(days=days - 1)
    spark = events.sparkSession
    counted = (
        events.where(F.col("uploaded_at") >= F.lit(first.isoformat()).cast("timestamp_ntz"))
        .groupBy(F.to_date("uploaded_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    calendar = spark.range(days).select(F.date_add(F.lit(first.isoformat()).cast("date"), F.col("id").cast("int")).alias("day"))
    return calendar.join(counted, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("photos"))


def seasonality(activity: DataFrame, species_id: int, first_year: int, last_year: int) -> DataFrame:
    """Detections of a species per month."""
    return (
        activity.where((F.col("species_id") == species_id) & F.col("year").between(first_year, last_year))
        .groupBy("year", "month")
        .agg(F.sum("detection_count").alias("observation_count"))
    )


def seasonality_wide(monthly: DataFrame) -> DataFrame:
    """One row per year and a column per month."""
    months = monthly.groupBy("year").pivot("month", list(range(1, 13))).agg(F.sum("observation_count"))
    return months.select("year", *[F.col(f"`{m}`").alias(f"m{m:02d}") for m in range(1, 13)])


def trend_lookup(trends: DataFrame, species_id: int, first_year: int, last_year: int, scope_type: str, scope_id: str) -> DataFrame:
    chosen = (F.col("species_id") == species_id) & (F.col("scope_type") == scope_type) & (F.col("scope_id") == scope_id)
    return trends.where(chosen & F.col("year").between(first_year, last_year)).orderBy("year")


def activity_heatmap(verified: DataFrame, species_id: int) -> DataFrame:
    """Dense (hour, month, count) grid of a species' verified series."""
    counts = (
        verified.where(F.col("species_id") == species_id)
        .groupBy(F.hour("series_start_time").alias("hour"), F.month("series_start_time").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = verified.sparkSession.range(24 * 12).select(
        F.expr("CAST(id DIV 12 AS INT)").alias("hour"), F.expr("CAST(id % 12 + 1 AS INT)").alias("month")
    )
    return grid.join(counts, ["hour", "month"], "left").select("hour", "month", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_totals(heatmap: DataFrame) -> DataFrame:
    return heatmap.agg(F.max("n").alias("max_count"), F.sum("n").alias("total"))


def verified_range(observations: DataFrame) -> DataFrame:
    """First and last day of verified series."""
    day = F.to_date("series_start_time")
    return observations.where(F.col("status").isin(*DONE)).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def frequent_species(verified: DataFrame, least: int = 30) -> DataFrame:
    """Species that won at least ``least`` verified series."""
    won = verified.where("species_id > 0").groupBy("species_id")
    return won.agg(F.count(F.lit(1)).alias("series")).where(F.col("series") >= least)


def location_stats(
    photos: DataFrame, observations: DataFrame, identifications: DataFrame, species: DataFrame
) -> DataFrame:
    """Photo pace and verified counts of every site that has photos."""
    sized = photos.groupBy("observation_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("captured_at").alias("_a"), F.max("captured_at").alias("_z")
    )
    sites = observations.select(F.col("id").alias("observation_id"), "location_id")
    paced = (
        sized.join(sites, "observation_id")
        .groupBy("location_id")
        .agg(F.sum("_n").alias("total_photos"), F.min("_a").alias("_a"), F.max("_z").alias("_z"))
    )
    span = F.timestamp_diff("MICROSECOND", "_a", "_z") / 1e6 / 86400
    pace = F.when(span >= 1, F.col("total_photos") / span).otherwise(F.col("total_photos").cast("double"))
    known = species.select(F.col("id").alias("species_id"))
    won = verified_series(observations, identifications, photos, quantity="ignored").join(known, "species_id")
    per_species = won.groupBy("location_id", "species_id").agg(F.count(F.lit(1)).alias("_n"))
    counts = per_species.groupBy("location_id").agg(
        F.count_if(F.col("species_id") > 0).alias("total_species"),
        F.sum(F.when(F.col("species_id") > 0, F.col("_n"))).alias("animal_observations"),
        F.sum(F.when(F.col("species_id") == -1, F.col("_n"))).alias("empty_observations"),
        F.sum(F.when(F.col("species_id") < -1, F.col("_n"))).alias("other_observations"),
    )
    names = ["total_species", "animal_observations", "empty_observations", "other_observations"]
    return paced.join(counts, "location_id", "left").select(
        "location_id",
        "total_photos",
        half_even(pace, 2).alias("avg_photos_per_day"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in names],
    )


def distribution_map(
    verified: DataFrame,
    photos: DataFrame,
    observations: DataFrame,
    locations: DataFrame,
    species_id: int,
    first: str,
    last: str,
) -> DataFrame:
    """Sites where the species was verified: detections, effort and detections per effort day (4 digits)."""
    found = (
        started_between(verified.where(F.col("species_id") == species_id), first, last)
        .groupBy("location_id")
        .agg(F.count(F.lit(1)).alias("detections"))
    )
    here = observations.join(found.select("location_id"), "location_id", "left_semi")
    effort = effort_by_location(photo_days(captured_between(photos, first, last), here))
    worked = F.coalesce("effort_days", F.lit(0))
    sites = locations.select(F.col("id").alias("location_id"), "name")
    return (
        found.join(sites, "location_id")
        .join(effort, "location_id", "left")
        .select(
            "location_id",
            "name",
            "detections",
            worked.alias("effort"),
            F.when(worked > 0, half_even(F.col("detections") / worked, 4)).otherwise(0.0).alias("rai"),
        )
    )


def distribution_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.coalesce(F.sum("detections"), F.lit(0)).alias("total_detections"),
        F.count(F.lit(1)).alias("total_locations"),
        F.coalesce(half_even(F.sum("rai") / F.count(F.lit(1)), 4), F.lit(0.0)).alias("avg_rai"),
    )


def behaviour_base(
    identifications: DataFrame, photos: DataFrame, observations: DataFrame, species_id: int, first: str, last: str
) -> DataFrame:
    """Votes for one species in verified series, with series and capture time. The four behaviour reports start here."""
    done = observations.where(F.col("status").isin(*DONE)).select(F.col("id").alias("observation_id"))
    shot = captured_between(photos, first, last).select(F.col("id").alias("photo_id"), "observation_id", "captured_at")
    votes = identifications.where(F.col("species_id") == species_id)
    return (
        votes.select(F.col("id").alias("identification_id"), "photo_id", "quantity")
        .join(shot, "photo_id")
        .join(done, "observation_id", "left_semi")
    )


def behaviour_distribution(base: DataFrame, tags: DataFrame) -> DataFrame:
    return base.join(tags, "identification_id").groupBy("behavior_type_id").agg(F.count_distinct("observation_id").alias("series"))


def behaviour_seasons(base: DataFrame, tags: DataFrame) -> DataFrame:
    return (
        base.join(tags, "identification_id")
        .groupBy(F.month("captured_at").alias("month"), "behavior_type_id")
        .agg(F.count_distinct("observation_id").alias("series"))
    )


def group_sizes(base: DataFrame) -> DataFrame:
    """Histogram of the largest quantity voted for a series."""
    largest = base.where("quantity > 0").groupBy("observation_id").agg(F.max("quantity").alias("quantity"))
    return largest.groupBy("quantity").agg(F.count(F.lit(1)).alias("frequency"))


def untagged_votes(base: DataFrame, tags: DataFrame) -> DataFrame:
    """One row: votes, and votes without any behaviour tag."""
    marked = tags.select("identification_id", F.lit(True).alias("_tagged")).distinct()
    return base.join(marked, "identification_id", "left").agg(
        F.count(F.lit(1)).alias("total_identifications"), F.count_if(F.col("_tagged").isNull()).alias("untagged")
    )


def species_with_behaviours(identifications: DataFrame, tags: DataFrame, species: DataFrame) -> DataFrame:
    tagged = identifications.join(tags.select(F.col("identification_id").alias("id")), "id", "left_semi")
    return species.join(tagged.select(F.col("species_id").alias("id")).distinct(), "id", "left_semi")


def user_stats(identifications: DataFrame, photos: DataFrame) -> DataFrame:
    """Votes, series and species of every user."""
    votes = series_votes(identifications, photos)
    per_pair = votes.groupBy("user_id", "observation_id").agg(F.count(F.lit(1)).alias("_n"))
    series = per_pair.groupBy("user_id").agg(F.sum("_n").alias("identifications"), F.count(F.lit(1)).alias("series"))
    kinds = (
        votes.where("species_id > 0").select("user_id", "species_id").distinct()
        .groupBy("user_id").agg(F.count(F.lit(1)).alias("species"))
    )
    return series.join(kinds, "user_id", "left").withColumn("species", F.coalesce("species", F.lit(0)))


def user_top_species(identifications: DataFrame, photos: DataFrame, top: int = 5) -> DataFrame:
    """Most voted species of every user by series, ties by id."""
    counted = (
        series_votes(identifications.where("species_id > 0"), photos)
        .groupBy("user_id", "species_id")
        .agg(F.count_distinct("observation_id").alias("series"))
    )
    order = Window.partitionBy("user_id").orderBy(F.desc("series"), "species_id")
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


# Species listed in the domestic group, and the groups of the picker.
DOMESTIC_SPECIES = (8, 39, -19, -11, -10, -7)
PICKER_GROUPS = ("mammals", "domestic", "birds", "other")


def picker_groups(species: DataFrame, ranking: DataFrame, domestic: tuple[int, ...] = DOMESTIC_SPECIES) -> DataFrame:
    """Group and place of every species in the identification picker, most used first, ties by id."""
    bucket = (
        F.when(F.col("id") == -1, "empty")
        .when(F.col("id").isin(*domestic), "domestic")
        .when(F.col("category").isin(*PICKER_GROUPS), F.col("category"))
        .otherwise("other")
    )
    ranked = species.join(ranking.select(F.col("species_id").alias("id"), "series"), "id", "left").select(
        "id", bucket.alias("picker_group"), F.coalesce("series", F.lit(0)).alias("series")
    )
    order = Window.partitionBy("picker_group").orderBy(F.desc("series"), "id")
    return ranked.withColumn("place", F.row_number().over(order))


def batch_statistics(photos: DataFrame, batches: DataFrame, now: str) -> DataFrame:
    """(metric, name, value): batches per status, photos without series, age in hours of the oldest open batch."""
    by_status = batches.groupBy("status").agg(F.count(F.lit(1)).cast("double").alias("value"))
    orphans = photos.where("observation_id IS NULL AND status = 'uploaded'").agg(F.count(F.lit(1)).cast("double").alias("value"))
    age = F.timestamp_diff("MICROSECOND", F.col("o.created_at"), F.lit(now).cast("timestamp_ntz")) / 1e6 / 3600
    oldest = (
        batches.where(F.col("status").isin("uploading", "processing"))
        .agg(F.min(F.struct("created_at", "id")).alias("o"))
        .where("o IS NOT NULL")
    )
    return (
        by_status.select(F.lit("status").alias("metric"), F.col("status").alias("name"), "value")
        .unionByName(orphans.select(F.lit("orphaned_photos").alias("metric"), F.lit("").alias("name"), "value"))
        .unionByName(oldest.select(F.lit("oldest_open_hours").alias("metric"), F.col("o.id").alias("name"), age.alias("value")))
    )


def deployment_photo_counts(deployments: DataFrame, photos: DataFrame, observations: DataFrame) -> DataFrame:
    """Photos at the site inside each deployment; a missing bound is open. A photo without a time lies inside only where both
    bounds are missing.

    Photos are first counted per site and day and summed up along the calendar of the site, so a deployment needs the
    running total at two days instead of a join to every photo day.
    """
    sites = observations.select(F.col("id").alias("observation_id"), "location_id")
    daily = (
        photos.join(sites, "observation_id")
        .groupBy("location_id", F.to_date("captured_at").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    held = deployments.select("id", "location_id", "start_date", "end_date")
    marks = held.where("start_date IS NOT NULL").select("location_id", F.date_sub("start_date", 1).alias("day")).unionByName(
        held.where("end_date IS NOT NULL").select("location_id", F.col("end_date").alias("day"))
    )
    known = daily.where("day IS NOT NULL").unionByName(marks.distinct().withColumn("n", F.lit(0).cast("bigint")))
    running = Window.partitionBy("location_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (
        known.groupBy("location_id", "day").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(running)).select("location_id", "day", "upto")
    )
    whole = daily.groupBy("location_id").agg(
        F.sum("n").alias("_all"), F.sum(F.when(F.col("day").isNotNull(), F.col("n"))).alias("_timed")
    )
    start = upto.select("location_id", F.date_add("day", 1).alias("start_date"), F.col("upto").alias("_before"))
    end = upto.select("location_id", F.col("day").alias("end_date"), F.col("upto").alias("_until"))
    counted = F.when(
        F.col("start_date") > F.col("end_date"), F.lit(0)
    ).when(
        F.col("start_date").isNull() & F.col("end_date").isNull(), F.coalesce("_all", F.lit(0))
    ).otherwise(F.coalesce("_until", "_timed", F.lit(0)) - F.coalesce("_before", F.lit(0)))
    return (
        held.join(whole, "location_id", "left")
        .join(start, ["location_id", "start_date"], "left")
        .join(end, ["location_id", "end_date"], "left")
        .select("id", "location_id", counted.cast("bigint").alias("photo_count"))
    )


def deployments_per_location(deployments: DataFrame) -> DataFrame:
    return deployments.groupBy("location_id").agg(F.count(F.lit(1)).alias("deployment_count"))
