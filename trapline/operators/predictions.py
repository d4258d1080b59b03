"""Classifier predictions: winners per series, backlog and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.names import prediction_label
from trapline.functions.rounding import half_even
from trapline.operators.consensus import series_votes

# Photo states a classifier can still read.
LIVE_STATES = ("grouped", "pending", "completed")


def ranked_models(models: DataFrame, levels: DataFrame) -> DataFrame:
    """Models with the accuracy rank of their level, 0 without one."""
    graded = levels.select(F.col("id").alias("level_id"), "accuracy_rank")
    return models.join(graded, "level_id", "left").select(
        F.col("id").alias("model_id"), F.coalesce("accuracy_rank", F.lit(0)).alias("rank"), "is_active"
    )


def winning_predictions(predictions: DataFrame, models: DataFrame) -> DataFrame:
    """Per series the species of the most accurate model (newest on a tie, then the first row); it may be unknown."""
    best = F.min_by(
        F.struct("prediction_species_id"), F.struct(-F.col("rank"), -F.col("model_id"), F.col("id"))
    )
    return (
        predictions.join(models.select("model_id", "rank"), "model_id")
        .groupBy("observation_id")
        .agg(best.alias("w"))
        .select("observation_id", F.col("w.prediction_species_id").alias("species_id"))
    )


def pending_by_species(
    predictions: DataFrame,
    models: DataFrame,
    series: DataFrame,
    species: DataFrame,
    photos: DataFrame,
    identifications: DataFrame,
    user_id: int | None = None,
    lang: str = "uk",
) -> DataFrame:
    """Open series per predicted species, without those the user voted on. ``series``: the pending series in scope."""
    ours = series.where("status = 'pending'").select(F.col("id").alias("observation_id"))
    if user_id is not None:
        own = series_votes(identifications.where(F.col("user_id") == user_id), photos).select("observation_id")
        ours = ours.join(own, "observation_id", "left_anti")
    won = winning_predictions(predictions.join(ours, "observation_id", "left_semi"), models)
    counted = won.groupBy(F.col("species_id").alias("id")).agg(F.count(F.lit(1)).alias("pending_count"))
    label = F.concat(prediction_label(lang), F.lit(" ("), F.col("pending_count").cast("string"), F.lit(")"))
    return counted.join(species, "id").select("id", "pending_count", label.alias("label"))


def best_predictions(predictions: DataFrame, models: DataFrame, species: DataFrame, lang: str = "uk") -> DataFrame:
    """Per series the row of the most accurate model with the best score, and the largest animal count of that model."""
    # a count per model first: the group of a series then holds one entry per model
    row = F.min_by(
        F.struct("prediction_species_id", "base_label", "prediction_score", "animal_count"),
        F.struct(F.col("prediction_score").isNull(), -F.coalesce("prediction_score", F.lit(0.0)), F.col("id")),
    )
    order = F.min(F.struct(F.col("prediction_score").isNull(), -F.coalesce("prediction_score", F.lit(0.0)), F.col("id")))
    per_model = (
        predictions.join(models.select("model_id", "rank"), "model_id")
        .groupBy("observation_id", "model_id", "rank")
        .agg(row.alias("r"), order.alias("o"), F.max("animal_count").alias("most"))
    )
    best = per_model.groupBy("observation_id").agg(
        F.min_by(F.struct("r", "most"), F.struct(-F.col("rank"), F.col("o"))).alias("b")
    )
    first, second = ("common_name_en", "common_name_ua") if lang == "en" else ("common_name_ua", "common_name_en")
    named = species.select(F.col("id").alias("species_id"), F.coalesce(first, second, "scientific_name").alias("_name"))
    return (
        best.select("observation_id", "b.r.*", "b.most")
        .withColumnRenamed("prediction_species_id", "species_id")
        .join(named, "species_id", "left")
        .select(
            "observation_id", "species_id", F.coalesce("_name", "base_label").alias("species_label"),
            F.col("prediction_score").alias("score"), F.coalesce("most", "animal_count").alias("animal_count"),
        )
    )


def series_predicted_as(predictions: DataFrame, models: DataFrame, species_id: int) -> DataFrame:
    return winning_predictions(predictions, models).where(F.col("species_id") == species_id).select("observation_id")


def backlog(predictions: DataFrame, models: DataFrame, observations: DataFrame, photos: DataFrame, model_id: int) -> DataFrame:
    """(classified, remaining) of one model: series it has seen, and pending series with a live photo that no model of
    equal or better rank has seen."""
    own_rank = models.where(F.col("model_id") == model_id).agg(F.max("rank")).scalar()
    good = models.where((F.col("model_id") == model_id) | (F.col("rank") >= own_rank)).select("model_id")
    covered = predictions.join(good, "model_id", "left_semi").select("observation_id")
    live = photos.where(F.col("status").isin(*LIVE_STATES)).select("observation_id")
    waiting = (
        observations.where("status = 'pending'")
        .select(F.col("id").alias("observation_id"))
        .join(covered, "observation_id", "left_anti")
        .join(live, "observation_id", "left_semi")
        .agg(F.count(F.lit(1)).alias("remaining"))
    )
    seen = predictions.where(F.col("model_id") == model_id).select("observation_id").distinct()
    return seen.agg(F.count(F.lit(1)).alias("classified")).withColumn("remaining", waiting.scalar())


def import_levels(levels: DataFrame, models: DataFrame) -> DataFrame:
    """Levels that no active model uses, most accurate last."""
    used = models.where("is_active AND level_id IS NOT NULL").select(F.col("level_id").alias("id"))
    return levels.join(used, "id", "left_anti").orderBy("accuracy_rank", "id")


def calibration(predictions: DataFrame, species: DataFrame, least: int = 1) -> DataFrame:
    """Checked predictions per species: sample, hits, accuracy in percent and mean scores of hits and misses."""
    hit = F.col("was_correct")
    score = F.col("prediction_score")
    checked = (
        predictions.where(hit.isNotNull() & F.col("prediction_species_id").isNotNull())
        .groupBy(F.col("prediction_species_id").alias("species_id"))
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(hit).alias("correct"),
            half_even(F.avg(F.when(hit, score)), 3).alias("mean_score_correct"),
            half_even(F.avg(F.when(~hit, score)), 3).alias("mean_score_wrong"),
        )
        .where(F.col("total") >= least)
    )
    named = species.select(F.col("id").alias("species_id"), "scientific_name")
    return (
        checked.join(named, "species_id")
        .withColumn("accuracy", half_even(F.col("correct") / F.col("total") * 100, 1))
        .orderBy(F.desc("total"), F.desc("correct"), "species_id")
    )
