"""Merging classifier results, verified results, deployment sheets and landcover into the survey tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.operators.consensus import quorum, series_of_photos
from trapline.sources.sheets import FIELDS

# Labels that are no animals, and the year of placeholder times.
NOT_ANIMALS = ("empty", "human", "vehicle")
PLACEHOLDER_YEAR = 1900


# --- classifier results ---------------------------------------------------------------------------------------------------
def photo_index(photos: DataFrame, observations: DataFrame) -> DataFrame:
    """(location_id, file_key, second) to photo and series; of several photos with one key the largest id counts."""
    sites = observations.select(F.col("id").alias("observation_id"), "location_id")
    keyed = (
        photos.where("original_filename <> '' AND captured_at IS NOT NULL")
        .join(sites, "observation_id")
        .select(
            "location_id",
            F.lower(F.trim("original_filename")).alias("file_key"),
            F.date_trunc("second", "captured_at").cast("timestamp_ntz").alias("second"),
            F.col("id").alias("photo_id"),
            "observation_id",
        )
    )
    # two numbers instead of one struct: a hash aggregation holds them
    newest = (F.max("photo_id").alias("photo_id"), F.max_by("observation_id", "photo_id").alias("observation_id"))
    return keyed.groupBy("location_id", "file_key", "second").agg(*newest)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file_key", F.lower(F.trim("original_filename"))).withColumn(
        "second", F.date_trunc("second", "captured_at").cast("timestamp_ntz")
    )


KEY = ["location_id", "file_key", "second"]
DETECTION = ["base_label", "base_score", "top1_label", "animal_count", "human_count"]


def match_detections(rows: DataFrame, index: DataFrame) -> DataFrame:
    """File rows beside the photo they describe. ``rows``: location_id, line_no and the parsed columns."""
    return _keyed(rows).join(index, KEY)


def last_per_photo(matched: DataFrame) -> DataFrame:
    """The last row of the file for every photo."""
    row = F.max_by(F.struct("observation_id", *DETECTION), F.col("line_no")).alias("r")
    return matched.groupBy("photo_id").agg(row).select("photo_id", "r.*")


def match_preview(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Per site: file rows, known photos, matched photos, unmatched rows, duplicate rows, photos without a row, and photos
    with a placeholder time. Rows are counted per key first, so a repeated key does not multiply anything."""
    per_key = _keyed(rows).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    both = per_key.join(index.withColumn("_known", F.lit(True)), KEY, "full")
    n, known = F.coalesce("n", F.lit(0)), F.col("_known").isNotNull()
    hit = known & (n > 0)
    return both.groupBy("location_id").agg(
        F.sum(n).alias("csv_rows"),
        F.count_if(known).alias("location_photos"),
        F.count_if(hit).alias("matched"),
        F.sum(F.when(~known, n).otherwise(0)).alias("csv_unmatched"),
        F.sum(F.when(hit, n - 1).otherwise(0)).alias("csv_duplicate_keys"),
        F.count_if(known & (n == 0)).alias("db_without_prediction"),
        F.count_if(known & (F.year("second") == PLACEHOLDER_YEAR)).alias("location_placeholder_photos"),
    )


def upsert_predictions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Prediction snapshot of the incoming model rows merged into the stored ones by (photo, model). An incoming row wins
    where nothing is stored, the stored score is missing or its own score is higher. ``change`` says what happened."""
    columns = ["photo_id", "model_id", "observation_id", *DETECTION]
    a = stored.select("photo_id", "model_id", F.struct(*columns[2:]).alias("old"))
    b = incoming.select("photo_id", "model_id", F.struct(*columns[2:]).alias("new"))
    merged = a.join(b, ["photo_id", "model_id"], "full")
    better = F.col("old.base_score").isNull() | (F.col("new.base_score") > F.col("old.base_score"))
    change = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "kept")
        .when(better, "updated")
        .otherwise("skipped")
    )
    taken = F.when(F.col("change").isin("added", "updated"), F.col("new")).otherwise(F.col("old"))
    return merged.withColumn("change", change).select("photo_id", "model_id", taken.alias("r"), "change").select(
        "photo_id", "model_id", "r.*", "change"
    )


def change_counts(merged: DataFrame) -> DataFrame:
    return merged.where("change <> 'kept'").groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def series_labels(predictions: DataFrame, label_map: DataFrame) -> DataFrame:
    """Label of every (series, model): the best animal, else human, else vehicle, else empty, with its score and species.
    Equal animal scores go to the alphabetically first label. Photos are counted together per label first, so that a series with
    very many photos is a row for each of its labels, and all aggregates are hashed."""
    label, score = F.col("base_label"), F.col("base_score")
    animal = label.isNotNull() & ~label.isin(*NOT_ANIMALS) & (label != "")
    best = predictions.groupBy("observation_id", "model_id", "base_label").agg(
        F.max(F.coalesce(score, F.lit(0.0))).alias("_score"), F.max("base_score").alias("base_score")
    )
    rated = F.struct((-F.col("_score")).alias("minus_score"), label)
    found = best.groupBy("observation_id", "model_id").agg(
        F.array_min(F.collect_list(F.when(animal, rated))).alias("animal"),
        F.bool_or(F.coalesce(label == "human", F.lit(False))).alias("human"),
        F.max(F.when(label == "human", score)).alias("human_score"),
        F.bool_or(F.coalesce(label == "vehicle", F.lit(False))).alias("vehicle"),
    )
    named = (
        F.when(F.col("animal").isNotNull(), F.col("animal.base_label"))
        .when(F.col("human"), "human")
        .when(F.col("vehicle"), "vehicle")
        .otherwise("empty")
    )
    rating = (
        F.when(F.col("animal").isNotNull(), -F.col("animal.minus_score")).when(F.col("human"), F.coalesce("human_score", F.lit(1.0))).otherwise(1.0)
    )
    species = label_map.select(
        F.lower(F.trim("label")).alias("prediction_label"), F.col("species_id").alias("prediction_species_id")
    )
    return (
        found.select("observation_id", "model_id", named.alias("prediction_label"), rating.alias("prediction_score"))
        .join(species, "prediction_label", "left")
        .select("observation_id", "model_id", "prediction_label", "prediction_score", "prediction_species_id")
    )


def write_series_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """Prediction snapshot with the series label on every row of its (series, model)."""
    kept = [c for c in predictions.columns if not c.startswith("prediction_")]
    return predictions.select(*kept).join(labels, ["observation_id", "model_id"], "left")


# --- verified results -------------------------------------------------------------------------------------------------------
def modal_species(matched: DataFrame, label_map: DataFrame, observations: DataFrame) -> DataFrame:
    """Species of every pending series from its matched rows: most rows, then real species, higher summed score, smaller id.
    Species is NULL where no label is known; ``ambiguous`` marks a tie on rows."""
    pending = observations.where(~F.col("status").isin("completed", "archived")).select(F.col("id").alias("observation_id"))
    names = label_map.where("species_id IS NOT NULL").select(F.lower(F.trim("label")).alias("base_label"), "species_id")
    counted = (
        matched.join(pending, "observation_id", "left_semi")
        .join(names, "base_label", "left")
        .groupBy("observation_id", "species_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("base_score", F.lit(0.0))).alias("score"))
    )
    # scores are summed in no fixed order; nine digits keep the tie rule stable
    order = F.struct(F.col("species_id").isNull(), -F.col("n"), F.col("species_id") <= 0, -F.round("score", 9), F.col("species_id"))
    known = F.col("species_id").isNotNull()
    top = F.max(F.when(known, F.col("n"))).over(Window.partitionBy("observation_id"))
    return (
        counted.withColumn("_top", top)
        .groupBy("observation_id")
        .agg(
            F.min_by(F.struct("species_id"), order).alias("w"),
            (F.count_if(known & (F.col("n") == F.col("_top"))) > 1).alias("ambiguous"),
        )
        .select("observation_id", F.col("w.species_id").alias("species_id"), "ambiguous")
    )


def verification_preview(matched: DataFrame, modal: DataFrame, observations: DataFrame) -> DataFrame:
    """(metric, value) of a verified file before it is imported."""
    statuses = observations.select(F.col("id").alias("observation_id"), F.col("status").isin("completed", "archived").alias("done"))
    series = matched.groupBy("observation_id").agg(F.count(F.lit(1)).alias("n")).join(statuses, "observation_id")
    counts = series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("matched_photos"),
        F.coalesce(F.sum(F.when(~F.col("done"), F.col("n"))), F.lit(0)).alias("matched_photos_pending"),
        F.count_if(~F.col("done")).alias("pending_series"),
        F.count_if("done").alias("skipped_consensus_series"),
    )
    chosen = modal.agg(
        F.count_if("ambiguous").alias("ambiguous_series"), F.count_if(F.col("species_id").isNull()).alias("no_species_series")
    )
    wide = [df.unpivot([], df.columns, "metric", "value") for df in (counts, chosen)]
    return wide[0].unionByName(wide[1])


def import_verified(identifications: DataFrame, photos: DataFrame, modal: DataFrame, verifier_id: int) -> DataFrame:
    """Votes of the verifier: the modal species on all photos of its series. ``change`` is added, updated or same; an
    existing vote keeps its quantity."""
    own = identifications.where(F.col("user_id") == verifier_id).select(
        "photo_id", F.col("species_id").alias("_old"), F.col("quantity").alias("_quantity"), F.lit(True).alias("_present")
    )
    decided = modal.where("species_id IS NOT NULL").select("observation_id", "species_id")
    rows = series_of_photos(photos).join(decided, "observation_id").join(own, "photo_id", "left")
    change = (
        F.when(F.col("_present").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("species_id")), "same").otherwise("updated")
    )
    return rows.select(
        "photo_id", "observation_id", F.lit(verifier_id).cast("bigint").alias("user_id"), "species_id",
        F.col("_quantity").alias("quantity"), change.alias("change"),
    )


def merged_votes(identifications: DataFrame, imported: DataFrame) -> DataFrame:
    """Vote snapshot after the import."""
    columns = ["photo_id", "user_id", "species_id", "quantity"]
    rest = identifications.join(imported.select("photo_id", "user_id"), ["photo_id", "user_id"], "left_anti")
    return rest.select(*columns).unionByName(imported.select(*columns))


def verified_decisions(
    observations: DataFrame, identifications: DataFrame, photos: DataFrame, imported: DataFrame, min_votes: int = 3
) -> DataFrame:
    """Series of the import that reach the quorum with the new votes."""
    touched = observations.join(imported.select(F.col("observation_id").alias("id")), "id", "left_semi")
    return quorum(touched, merged_votes(identifications, imported), photos, min_votes)


# --- deployment sheets -------------------------------------------------------------------------------------------------------
def _sheet_order() -> Column:
    return F.struct("sheet_no", "row_no")


def resolve_deployments(rows: DataFrame, locations: DataFrame, create_missing: bool = False) -> DataFrame:
    """Sheet rows with their site and outcome (``accepted`` or the reason a row is skipped).

    A site named like the deployment comes first. Without coordinates the row stays without a site. Otherwise the site at
    the same rounded coordinates is taken when only one exists, or, with ``create_missing``, a new site is to be made:
    append ``new_sites`` to the sites and resolve again, and the rows find them by name.
    """
    given = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    finite = given & ~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) < float("inf")) & (F.abs(lon) < float("inf"))
    unreadable = given & (lat.isNull() | lon.isNull())

    def point(column: Column) -> Column:
        return F.round(column.cast("decimal(20,10)"), 5)

    by_name = locations.where("name IS NOT NULL").groupBy("name").agg(F.max("id").alias("_named"))
    by_point = (
        locations.select(point(F.col("latitude")).alias("_lat"), point(F.col("longitude")).alias("_lon"), "id")
        .where("_lat IS NOT NULL AND _lon IS NOT NULL")
        .groupBy("_lat", "_lon")
        .agg(F.min("id").alias("_at"), F.count(F.lit(1)).alias("_sites"))
    )
    known = F.coalesce(finite, F.lit(False))
    placed = (
        rows.withColumn("_finite", known)
        .withColumn("_unreadable", F.coalesce(unreadable, F.lit(False)))
        .withColumn("_lat", F.when(known, point(lat)))
        .withColumn("_lon", F.when(known, point(lon)))
        .join(by_name, "name", "left")
        .join(by_point, ["_lat", "_lon"], "left")
    )
    named, has_name = F.col("_named").isNotNull(), F.col("name").isNotNull()
    outcome = F.when(F.col("_unreadable"), "bad_coordinates")
    if create_missing:
        outcome = outcome.when(~has_name, "no_name")
        site = F.col("_named")
        new_site = ~named & F.col("_finite")
    else:
        outcome = (
            outcome.when(~named & F.col("_finite") & (F.col("_sites") > 1), "ambiguous_location")
            .when(~named & F.col("_finite") & F.col("_at").isNull(), "no_location")
            .when(~has_name, "no_name")
        )
        site = F.coalesce("_named", F.when(F.col("_finite"), F.col("_at")))
        new_site = F.lit(False)
    return (
        placed.withColumn("outcome", outcome.otherwise("accepted"))
        .withColumn("location_id", site)
        .withColumn("new_site", new_site & (F.col("outcome") == "accepted"))
        .drop("_finite", "_unreadable", "_lat", "_lon", "_named", "_at", "_sites")
    )


def new_sites(resolved: DataFrame, institutions: DataFrame) -> DataFrame:
    """Sites to create: name, coordinates and institution of the first row of each deployment without a site.
    ``institutions``: name, id."""
    first = F.min_by(F.struct("latitude", "longitude", "park"), _sheet_order()).alias("r")
    sites = resolved.where("new_site").groupBy("name").agg(first).select("name", "r.*")
    parks = institutions.select(F.lower(F.trim("name")).alias("_park"), F.col("id").alias("institution_id"))
    return (
        sites.withColumn("_park", F.lower(F.trim("park")))
        .join(parks, "_park", "left")
        .select(
            "name",
            F.round(F.col("latitude").cast("double"), 5).alias("latitude"),
            F.round(F.col("longitude").cast("double"), 5).alias("longitude"),
            "institution_id",
        )
    )


def with_new_sites(locations: DataFrame, new: DataFrame) -> DataFrame:
    """The sites with the created ones after them. An id comes from the name, so a repeated import creates the same site."""
    made = new.select(F.xxhash64("name").alias("id"), "name", "latitude", "longitude")
    kinds = dict(locations.dtypes)
    typed = made.select("id", *[F.col(c).cast(kinds[c]).alias(c) for c in ("name", "latitude", "longitude")])
    return locations.withColumn("id", F.col("id").cast("bigint")).unionByName(typed, allowMissingColumns=True)


def with_new_links(location_institutions: DataFrame, new: DataFrame) -> DataFrame:
    """(location_id, institution_id) with the links of the created sites whose institution is known."""
    made = new.where("institution_id IS NOT NULL").select(F.xxhash64("name").alias("location_id"), "institution_id")
    return location_institutions.select("location_id", "institution_id").union(made).distinct()


MERGED = [f for f in FIELDS if f not in ("name", "latitude", "longitude")]


def upsert_deployments(stored: DataFrame, resolved: DataFrame) -> DataFrame:
    """Register snapshot by deployment name: later rows overwrite earlier ones field by field, missing values overwrite
    nothing, and the site of the last row counts. ``change`` is added, updated or kept."""
    order = _sheet_order()
    accepted = resolved.where("outcome = 'accepted'")
    latest = accepted.groupBy("name").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in MERGED],
        F.max_by(F.struct("location_id"), order).alias("_site"),
        F.lit(True).alias("_new"),
    )
    present = [c for c in MERGED if c in stored.columns]
    old = stored.select(
        "name", F.lit(True).alias("_old"), F.col("location_id").alias("_old_site"), *[F.col(c).alias(f"_old_{c}") for c in present]
    )
    both = old.join(latest, "name", "full")
    change = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "added").otherwise("updated")
    return both.select(
        "name",
        F.when(F.col("_new"), F.col("_site.location_id")).otherwise(F.col("_old_site")).alias("location_id"),
        *[(F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in present else F.col(c)).alias(c) for c in MERGED],
        change.alias("change"),
    )


def deployment_counters(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """(metric, value): rows per outcome, and accepted rows split into the first of a new name and updates."""
    outcomes = resolved.where("outcome <> 'accepted'").groupBy(F.col("outcome").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    known = stored.select("name", F.lit(True).alias("_known")).distinct()
    per_name = resolved.where("outcome = 'accepted'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counted = per_name.join(known, "name", "left").agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.coalesce(F.sum(F.col("n") - F.when(F.col("_known").isNull(), 1).otherwise(0)), F.lit(0)).alias("updated"),
    )
    without = resolved.where("outcome IN ('accepted', 'no_name') AND location_id IS NULL AND NOT new_site")
    spots = without.agg(F.count(F.lit(1)).alias("without_site"))
    return outcomes.unionByName(counted.unpivot([], counted.columns, "metric", "value")).unionByName(
        spots.unpivot([], spots.columns, "metric", "value")
    )


# --- landcover ----------------------------------------------------------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8


def _distance(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(F.radians(lon_b - lon_a) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), half)))


def _row_cells(row: Column, step: float) -> Column:
    """Number of cells around the globe in a latitude row, each at least ``step`` degrees wide at its poleward edge."""
    edge = F.least(F.greatest(F.abs(row * step), F.abs((row + 1) * step)), F.lit(89.9))
    return F.greatest(F.floor(360.0 / (step / F.cos(F.radians(edge)))), F.lit(1))


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells)


def landcover_histogram(locations: DataFrame, pixels: DataFrame, radius_m: float) -> DataFrame:
    """Pixels per class within the radius of every site. ``pixels``: class, lat, lon. Sites visit the nine grid cells around
    them, so a site meets only the pixels nearby."""
    step = radius_m / 111_000.0
    # equal points are merged on both sides, so a crowded cell costs no more than its distinct points
    counted = pixels.groupBy("class", "lat", "lon").agg(F.count(F.lit(1)).alias("_n"))
    gridded = counted.withColumn("_row", F.floor(F.col("lat") / step)).withColumn(
        "_cell", _cell(F.col("lon"), _row_cells(F.col("_row"), step))
    )
    sites = locations.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(
        F.col("id").alias("location_id"), F.col("latitude").cast("double").alias("_lat"), F.col("longitude").cast("double").alias("_lon")
    )
    rows = F.explode(F.array(*[F.floor(F.col("_lat") / step) + d for d in (-1, 0, 1)]))
    cells = F.array(*[F.pmod(_cell(F.col("_lon"), F.col("_n_cells")) + d, F.col("_n_cells")) for d in (-1, 0, 1)])
    near = (
        sites.select("_lat", "_lon")
        .distinct()
        .withColumn("_row", rows)
        .withColumn("_n_cells", _row_cells(F.col("_row"), step))
        .withColumn("_cell", F.explode(F.array_distinct(cells)))
    )
    found = (
        gridded.join(near, ["_row", "_cell"])
        .where(_distance(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")) <= radius_m)
        .groupBy("_lat", "_lon", "class")
        .agg(F.sum("_n").alias("pixels"))
    )
    return sites.join(found, ["_lat", "_lon"]).select("location_id", "class", "pixels")


def choose_biotopes(histogram: DataFrame, class_map: DataFrame, top: int = 3) -> DataFrame:
    """The most frequent biotopes of every site: classes without a biotope are skipped, a biotope counts with its most
    frequent class, ties go to the smaller class."""
    mapped = histogram.join(class_map.select(F.col("landcover_class").alias("class"), "biotope_id"), "class")
    best = mapped.groupBy("location_id", "biotope_id").agg(F.min(F.struct(-F.col("pixels"), F.col("class"))).alias("o"))
    order = Window.partitionBy("location_id").orderBy("o", "biotope_id")
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("o")


def add_biotopes(links: DataFrame, chosen: DataFrame, locations: DataFrame, only_untagged: bool = False) -> DataFrame:
    """New (location_id, biotope_id) links; existing ones are never removed."""
    fresh = chosen.select("location_id", "biotope_id").join(locations.select(F.col("id").alias("location_id")), "location_id", "left_semi")
    keys = ["location_id"] if only_untagged else ["location_id", "biotope_id"]
    return fresh.join(links.select(*keys), keys, "left_anti")


def assignment_counters(locations: DataFrame, chosen: DataFrame, added: DataFrame) -> DataFrame:
    """(metric, value) of a landcover run over the given sites."""

    def metric(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value")

    spots = locations.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.col("id").alias("location_id"))
    return (
        metric("locations_processed", spots)
        .unionByName(metric("locations_updated", added.select("location_id").distinct()))
        .unionByName(metric("links_added", added))
        .unionByName(metric("locations_no_data", spots.join(chosen.select("location_id"), "location_id", "left_anti")))
    )


def upsert_class_map(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Class map after the changes; a change without a biotope clears its class."""
    rest = stored.join(changes.select("landcover_class"), "landcover_class", "left_anti")
    return rest.unionByName(changes.where("biotope_id IS NOT NULL").select(*rest.columns))
