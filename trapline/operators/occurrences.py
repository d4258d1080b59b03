"""Occurrence export: one row per verified, disputed or predicted species of a series, in Darwin-Core-like columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.ordered import collapse, number_gaps
from trapline.functions.rounding import half_even
from trapline.operators.consensus import DONE, series_votes
from trapline.operators.filters import TaxonFilter, qc_exclude, started_between, taxon_filter
from trapline.operators.scope import in_institutions, valid_locations

MODES = ("consensus", "human_any", "human_ai")


@dataclass(frozen=True)
class OccurrenceSpec:
    """What to export. ``allowed_institutions`` None means no restriction; an empty tuple allows nothing."""

    first: str
    last: str
    mode: str = "consensus"
    aggregation: str = "none"
    minutes: object = 5
    max_minutes: int = 60
    qc_flags: tuple[str, ...] = ()
    taxon: TaxonFilter = field(default_factory=TaxonFilter)
    institutions: tuple[int, ...] = ()
    allowed_institutions: tuple[int, ...] | None = None

    @property
    def kind(self) -> str:
        return self.mode if self.mode in MODES else "consensus"

    @property
    def grouping(self) -> str:
        """Series are only merged where each has exactly one species."""
        return self.aggregation if self.kind == "consensus" else "none"

    @property
    def window_minutes(self) -> int:
        try:
            wanted = int(self.minutes)
        except (TypeError, ValueError):
            wanted = 5
        return max(1, min(wanted, self.max_minutes))

    def narrowed_institutions(self) -> tuple[int, ...] | None:
        """Institutions to filter on: the allowed part of the request, all allowed ones when nothing remains."""
        if self.allowed_institutions is None:
            return self.institutions or None
        wanted = tuple(i for i in self.institutions if i in self.allowed_institutions)
        return wanted or self.allowed_institutions


def ballots(identifications: DataFrame, photos: DataFrame | None, users: DataFrame, within: DataFrame) -> DataFrame:
    """Candidates of the given series with their voters: vote_count, max_quantity, and (id, name) of every voter. Names are joined
    to one row for each voter of a candidate, not to every vote."""
    votes = identifications.select("observation_id" if photos is None else "photo_id", "user_id", "species_id", "quantity")
    names = users.select(F.col("id").alias("user_id"), "full_name")
    voter = F.struct(
        F.col("user_id").cast("string").alias("id"),
        F.coalesce("full_name", F.concat(F.lit("User #"), F.col("user_id").cast("string"))).alias("name"),
    )
    return (
        series_votes(votes, photos, within)
        .groupBy("observation_id", "species_id", "user_id")
        .agg(F.max("quantity").alias("_quantity"))
        .join(names, "user_id", "left")
        .groupBy("observation_id", "species_id")
        .agg(F.array_sort(F.collect_set(voter)).alias("voters"), F.max("_quantity").alias("max_quantity"))
        .withColumn("vote_count", F.size("voters"))
    )


def best_prediction(predictions: DataFrame, models: DataFrame, levels: DataFrame) -> DataFrame:
    """Per series the prediction with a species from the most accurate model, then the best score, then the first id."""
    graded = models.join(levels.select(F.col("id").alias("level_id"), "code", "accuracy_rank"), "level_id", "left").select(
        F.col("id").alias("model_id"), "name", "version", "code", F.coalesce("accuracy_rank", F.lit(0)).alias("_rank")
    )
    order = F.struct(
        -F.col("_rank"), F.col("prediction_score").isNull(), -F.coalesce("prediction_score", F.lit(0.0)), F.col("id")
    )
    level = F.coalesce(F.concat(F.lit(" ("), F.col("code"), F.lit(")")), F.lit(""))
    kept = F.struct(
        F.col("prediction_species_id").alias("species_id"),
        F.col("prediction_score").alias("ai_confidence"),
        F.coalesce("animal_count", F.lit(1)).alias("max_quantity"),
        F.concat("name", F.lit(" "), "version", level).alias("ai_model_name"),
    )
    return (
        predictions.where("prediction_species_id IS NOT NULL")
        .join(graded, "model_id")
        .groupBy("observation_id")
        .agg(F.min_by(kept, order).alias("p"))
        .select("observation_id", "p.*")
    )


@dataclass(frozen=True)
class OccurrenceTables:
    observations: DataFrame
    photos: DataFrame | None
    identifications: DataFrame
    species: DataFrame
    locations: DataFrame
    location_institutions: DataFrame
    deployments: DataFrame
    users: DataFrame
    ai_predictions: DataFrame
    ai_models: DataFrame
    ai_model_levels: DataFrame


def _scoped_series(tables: OccurrenceTables, spec: OccurrenceSpec) -> DataFrame:
    """Series of the date range at valid sites of the wanted institutions, without the excluded deployments."""
    sites = valid_locations(tables.locations).select(F.col("id").alias("location_id"))
    kept = started_between(tables.observations, spec.first, spec.last).join(sites, "location_id", "left_semi")
    wanted = spec.narrowed_institutions()
    if wanted is not None:
        kept = in_institutions(kept, tables.location_institutions, wanted) if wanted else kept.where(F.lit(False))
    return qc_exclude(kept, tables.deployments, spec.qc_flags)


def occurrences(tables: OccurrenceTables, spec: OccurrenceSpec) -> DataFrame:
    """Records of the chosen mode and grouping, before they are shaped for the file."""
    scoped = _scoped_series(tables, spec)
    done, pending = F.col("status").isin(*DONE), F.col("status") == "pending"
    if spec.kind == "consensus":
        scoped = scoped.where(done)
    elif spec.kind == "human_any":
        scoped = scoped.where(done | pending)
    series = scoped.select(F.col("id").alias("observation_id"), "location_id", "series_start_time", "status")
    voted = ballots(tables.identifications, tables.photos, tables.users, scoped)
    order = Window.partitionBy("observation_id").orderBy(
        F.desc("vote_count"), F.col("max_quantity").desc_nulls_first(), F.col("species_id").asc_nulls_last()
    )
    ranked = voted.withColumn("_rn", F.row_number().over(order))
    if spec.kind == "consensus":
        ranked = ranked.where("_rn = 1")
    # one pass over the votes: verified series keep the winner, open ones every candidate, the others have no vote
    rows = series.join(ranked, "observation_id", "left" if spec.kind == "human_ai" else "inner")
    agreed, disputed, silent = done & (F.col("_rn") == 1), pending & F.col("_rn").isNotNull(), F.col("_rn").isNull()
    rows = rows.where(agreed | disputed | silent).withColumn(
        "row_kind", F.when(silent, "ai").when(agreed, "human_consensus").otherwise("human_conflict")
    )
    if spec.kind == "human_ai":
        guessed = best_prediction(
            tables.ai_predictions.join(series.select("observation_id"), "observation_id", "left_semi"),
            tables.ai_models,
            tables.ai_model_levels,
        ).select("observation_id", F.struct("species_id", "max_quantity", "ai_confidence", "ai_model_name").alias("g"))
        human = F.col("row_kind") != "ai"
        rows = rows.join(guessed, "observation_id", "left").withColumns(
            {
                "species_id": F.when(human, F.col("species_id")).otherwise(F.col("g.species_id")),
                "max_quantity": F.when(human, F.col("max_quantity")).otherwise(F.col("g.max_quantity")),
                "ai_confidence": F.when(~human, F.col("g.ai_confidence")),
                "ai_model_name": F.when(~human, F.col("g.ai_model_name")),
            }
        )
    else:
        rows = rows.withColumns({"ai_confidence": F.lit(None).cast("double"), "ai_model_name": F.lit(None).cast("string")})
    rows = rows.select(
        "observation_id", "location_id", "series_start_time", "species_id", "max_quantity", "voters", "row_kind", "ai_confidence",
        "ai_model_name",
    )

    taxa = taxon_filter(tables.species, spec.taxon).select(
        F.col("id").alias("species_id"),
        "scientific_name", "kingdom", "phylum", "class_name", "order_rank", "family", "genus", "establishment_means",
    )
    sites = tables.locations.select(
        F.col("id").alias("location_id"), F.col("name").alias("location_name"), "latitude", "longitude", "state_province"
    )
    # only the names travel through the grouping; the other dimension columns are added to the records that remain
    rows = rows.join(taxa.select("species_id", "scientific_name"), "species_id")
    rows = rows.join(sites.select("location_id", "location_name"), "location_id")
    if spec.grouping == "location_day":
        rows = best_of_day(rows)
    elif spec.grouping == "location_timewindow":
        rows = best_of_event(rows, spec.window_minutes)
    return rows.join(taxa.drop("scientific_name"), "species_id").join(sites.drop("location_name"), "location_id")


def _preference() -> Column:
    """Largest quantity first, an unknown one before any number; then the earliest series."""
    return F.struct(
        F.col("max_quantity").isNotNull(), -F.coalesce("max_quantity", F.lit(0)), F.col("series_start_time"), F.col("observation_id")
    )


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in df.columns])


def best_of_day(records: DataFrame) -> DataFrame:
    """One record per species, site and day."""
    best = F.min_by(_row(records), _preference()).alias("r")
    return records.groupBy("scientific_name", "location_name", F.to_date("series_start_time")).agg(best).select("r.*")


def best_of_event(records: DataFrame, minutes: int) -> DataFrame:
    """One record per independent event: a longer pause than ``minutes`` between series of a species at a site opens a new
    one. Only the best record of each second travels on, so a busy site does not gather in one task."""
    keys = ["scientific_name", "location_name"]
    best = F.min_by(_row(records), _preference()).alias("r")
    units = number_gaps(collapse(records, keys, "series_start_time", best), keys, minutes * 60, "event_id")
    order = F.struct(
        F.col("r.max_quantity").isNotNull(), -F.coalesce("r.max_quantity", F.lit(0)), F.col("r.series_start_time"), F.col("r.observation_id")
    )
    return units.groupBy(*keys, "event_id").agg(F.min_by("r", order).alias("r")).select("r.*")


def total_count(records: DataFrame) -> DataFrame:
    return records.agg(F.count(F.lit(1)).alias("total_count"))


def preview(records: DataFrame, limit: int = 10) -> DataFrame:
    """The first records by start time, for a look before the export."""
    return records.orderBy("series_start_time", "observation_id", "species_id").limit(limit)


# Texts and constants of the exported columns.
VERIFIED = "verified by human"
VERIFIED_REMARK = "Verified by expert consensus"
DISPUTED = "competing human identifications (unresolved)"
DISPUTED_REMARK = (
    "Competing identification — series has not reached expert consensus. Group rows by observationID to see all candidates."
)
PREDICTED = "unverified (AI)"


def in_time_order(records: DataFrame) -> DataFrame:
    """Records by start of their series, as files list them."""
    return records.orderBy("series_start_time", "observation_id", F.col("species_id").asc_nulls_last())


def shape(records: DataFrame, institution_code: str = "CT", urn: str = "URN:survey", country: str = "UA") -> DataFrame:
    """The 30 exported columns."""
    kind = F.col("row_kind")
    names = F.array_join(F.transform("voters", lambda v: v["name"]), " | ")
    human = F.coalesce(F.nullif(names, F.lit("")), F.lit("Human Expert"))
    by = F.when(kind == "ai", F.coalesce("ai_model_name", F.lit("AI model"))).otherwise(human)
    surely = F.col("ai_confidence").isNotNull()
    remark = F.concat(
        F.lit("Automatic detection by "),
        by,
        F.when(surely, F.concat(F.lit(", confidence: "), half_even(F.col("ai_confidence"), 2).cast("string"))).otherwise(""),
    )
    epithet = F.get(F.split("scientific_name", " ", 2), 1)
    urn_text = F.concat(F.lit(f"{urn}:{institution_code}:observation:"), F.col("observation_id").cast("string"))
    taxon = F.when(kind == "human_conflict", F.concat(F.lit(":taxon:"), F.col("species_id").cast("string"))).otherwise("")
    return records.select(
        F.concat(urn_text, taxon).alias("occurrenceID"),
        F.col("observation_id").alias("observationID"),
        F.lit("MachineObservation").alias("basisOfRecord"),
        F.when(kind == "ai", PREDICTED).when(kind == "human_conflict", DISPUTED).otherwise(VERIFIED)
        .alias("identificationVerificationStatus"),
        by.alias("identifiedBy"),
        F.when((kind == "ai") & surely, half_even(F.col("ai_confidence"), 3).cast("string")).otherwise("")
        .alias("identificationConfidence"),
        F.when(kind == "ai", remark).when(kind == "human_conflict", DISPUTED_REMARK).otherwise(VERIFIED_REMARK)
        .alias("identificationRemarks"),
        F.lit(institution_code).alias("institutionCode"),
        F.col("scientific_name").alias("scientificName"),
        "kingdom",
        "phylum",
        F.col("class_name").alias("class"),
        F.col("order_rank").alias("order"),
        "family",
        "genus",
        epithet.alias("specificEpithet"),
        F.col("establishment_means").alias("establishmentMeans"),
        F.lit("present").alias("occurrenceStatus"),
        F.date_format("series_start_time", "yyyy-MM-dd").alias("eventDate"),
        F.col("max_quantity").alias("individualCount"),
        F.date_format("series_start_time", "HH:mm:ss").alias("eventTime"),
        F.lit(country).alias("countryCode"),
        F.col("state_province").alias("stateProvince"),
        F.col("location_name").alias("locality"),
        F.col("latitude").cast("double").alias("decimalLatitude"),
        F.col("longitude").cast("double").alias("decimalLongitude"),
        F.lit("WGS84").alias("geodeticDatum"),
        F.lit(20).alias("coordinateUncertaintyInMeters"),
        F.lit("GPS (smartphone)").alias("georeferenceSources"),
        F.lit("Automated camera trap").alias("recordedBy"),
    )
