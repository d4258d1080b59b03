"""Species consensus of a photo series from the votes of many users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.functions.ordered import positions

DONE = ("completed", "archived")


def series_of_photos(photos: DataFrame) -> DataFrame:
    """(photo_id, observation_id) of the photos that belong to a series."""
    return photos.where(F.col("observation_id").isNotNull()).select(F.col("id").alias("photo_id"), "observation_id")


def series_votes(identifications: DataFrame, photos: DataFrame | None, within: DataFrame | None = None) -> DataFrame:
    """Votes with the series of their photo. ``within`` restricts the series before anything is shuffled on them. Without
    ``photos`` the votes must carry their series, as those of ``series_ballots`` do."""
    linked = identifications if photos is None else series_of_photos(photos)
    if within is not None:
        linked = linked.join(within.select(F.col("id").alias("observation_id")), "observation_id", "left_semi")
    return linked if photos is None else identifications.join(linked, "photo_id")


def series_ballots(identifications: DataFrame, photos: DataFrame) -> DataFrame:
    """(observation_id, user_id, species_id, quantity): one row for each species a user names in a series, with the largest
    quantity. It stands for the votes wherever distinct users of a series are counted, without the photos: a vote copied to
    every photo of a series is one row, so a series with very many photos is no larger than its voters make it."""
    votes = identifications.select("photo_id", "user_id", "species_id", "quantity")
    return series_votes(votes, photos).groupBy("observation_id", "user_id", "species_id").agg(F.max("quantity").alias("quantity"))


def candidates(identifications: DataFrame, photos: DataFrame | None, within: DataFrame | None = None) -> DataFrame:
    """(observation_id, species_id, vote_count, max_quantity): distinct users per candidate, in the series of ``within`` if given."""
    return (
        series_votes(identifications, photos, within)
        .groupBy("observation_id", "species_id")
        .agg(F.count_distinct("user_id").alias("vote_count"), F.max("quantity").alias("max_quantity"))
    )


def _ranking(quantity: str) -> list[Column]:
    by_quantity = {
        "unknown_first": [F.col("max_quantity").desc_nulls_first()],
        "unknown_zero": [F.coalesce(F.col("max_quantity"), F.lit(0)).desc()],
        "ignored": [],
    }
    return [F.col("vote_count").desc(), *by_quantity[quantity], F.col("species_id").asc_nulls_last()]


def consensus(
    identifications: DataFrame,
    photos: DataFrame | None,
    *,
    null_species: bool = True,
    quantity: str = "unknown_first",
    within: DataFrame | None = None,
) -> DataFrame:
    """Candidates ranked inside their series (``rn`` 1 wins). ``null_species`` keeps "no species" as a candidate; ``quantity``
    is ``unknown_first``, ``unknown_zero`` or ``ignored``."""
    found = candidates(identifications, photos, within)
    if not null_species:
        found = found.where(F.col("species_id").isNotNull())
    order = Window.partitionBy("observation_id").orderBy(*_ranking(quantity))
    return found.withColumn("rn", F.row_number().over(order))


def winners(identifications: DataFrame, photos: DataFrame | None, **options) -> DataFrame:
    """The winning candidate of every series."""
    return consensus(identifications, photos, **options).where("rn = 1").drop("rn")


def verified_series(observations: DataFrame, identifications: DataFrame, photos: DataFrame | None, **options) -> DataFrame:
    """Completed or archived series beside their winning candidate."""
    done = observations.where(F.col("status").isin(*DONE))
    won = winners(identifications, photos, within=done, **options).withColumnRenamed("observation_id", "id")
    return done.join(won, "id")


def voters(identifications: DataFrame, photos: DataFrame | None) -> DataFrame:
    """Distinct voters of each candidate, as sorted text joined by a bar."""
    return (
        series_votes(identifications, photos)
        .groupBy("observation_id", "species_id")
        .agg(F.array_join(F.array_sort(F.collect_set(F.col("user_id").cast("string"))), "|").alias("voter_ids"))
    )


def quorum(observations: DataFrame, identifications: DataFrame, photos: DataFrame | None, min_votes: int = 3) -> DataFrame:
    """Pending series where one candidate holds more than half of at least ``min_votes`` distinct (user, species) pairs."""
    pending = observations.where("status = 'pending'").select(F.col("id").alias("observation_id"))
    tally = (
        series_votes(identifications, photos)
        .join(pending, "observation_id", "left_semi")
        .groupBy("observation_id", "species_id")
        .agg(F.count_distinct("user_id").alias("winner_votes"))
    )
    total = F.sum("winner_votes").over(Window.partitionBy("observation_id"))
    return (
        tally.withColumn("total_votes", total)
        .where((F.col("total_votes") >= min_votes) & (F.col("winner_votes") * 2 > F.col("total_votes")))
        .select("observation_id", F.col("species_id").alias("winner_species_id"), "winner_votes", "total_votes")
    )


def redecide(observations: DataFrame, identifications: DataFrame, photos: DataFrame | None, min_votes: int = 3) -> DataFrame:
    """Pending series that have a species with at least ``min_votes`` distinct users; most users win, then the smaller id."""
    pending = observations.where("status = 'pending'")
    enough = candidates(identifications, photos, pending).where(
        F.col("species_id").isNotNull() & (F.col("vote_count") >= min_votes)
    )
    best = F.min(F.struct((-F.col("vote_count")).alias("v"), F.col("species_id").alias("s")))
    return (
        enough.groupBy("observation_id")
        .agg(best.alias("b"))
        .select("observation_id", F.col("b.s").alias("winner_species_id"), (-F.col("b.v")).alias("winner_votes"))
    )


def complete_series(observations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Series snapshot after the decisions: decided series become completed."""
    decided = decisions.select(F.col("observation_id").alias("id"), F.lit(True).alias("_decided"))
    return (
        observations.join(decided, "id", "left")
        .withColumn("status", F.when(F.col("_decided"), "completed").otherwise(F.col("status")))
        .drop("_decided")
    )


def complete_photos(photos: DataFrame, decisions: DataFrame) -> DataFrame:
    """Photo snapshot after the decisions."""
    decided = decisions.select("observation_id", F.lit(True).alias("_decided"))
    return (
        photos.join(decided, "observation_id", "left")
        .withColumn("status", F.when(F.col("_decided"), "completed").otherwise(F.col("status")))
        .drop("_decided")
    )


def grade_predictions(predictions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Prediction snapshot: ``was_correct`` compares with the winner, unknown predictions stay NULL, undecided rows keep
    their value."""
    decided = decisions.where(F.col("winner_species_id").isNotNull()).select("observation_id", "winner_species_id")
    graded = F.when(
        F.col("winner_species_id").isNotNull(), F.col("prediction_species_id") == F.col("winner_species_id")
    ).otherwise(F.col("was_correct"))
    return predictions.join(decided, "observation_id", "left").withColumn("was_correct", graded).drop("winner_species_id")


def reopen(rows: DataFrame, observations: DataFrame, reopened: DataFrame, key: str = "id") -> DataFrame:
    """Rows (series, or photos with ``key='observation_id'``) with completed series of the list set back to pending."""
    listed = (
        observations.where("status = 'completed'")
        .select(F.col("id").alias(key))
        .join(reopened.select(F.col("observation_id").alias(key)).distinct(), key, "left_semi")
        .withColumn("_again", F.lit(True))
    )
    return (
        rows.join(listed, key, "left")
        .withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status")))
        .drop("_again")
    )


def append_votes(votes: DataFrame, photos: DataFrame, identifications: DataFrame) -> DataFrame:
    """New identification rows: one vote per series copied to all its photos, existing (photo, user) pairs kept.

    ``votes``: vote_id, observation_id, user_id, species_id, quantity, comment. The first vote of a user on a series counts.
    """
    details = F.struct("vote_id", "species_id", "quantity", "comment")
    first = votes.groupBy("observation_id", "user_id").agg(F.min_by(details, F.col("vote_id")).alias("v"))
    known = identifications.select("photo_id", "user_id")
    text = F.substring(F.trim("v.comment"), 1, 200)
    return (
        series_of_photos(photos)
        .join(first, "observation_id")
        .join(known, ["photo_id", "user_id"], "left_anti")
        .select(
            "photo_id",
            "user_id",
            F.col("v.species_id").alias("species_id"),
            F.col("v.quantity").alias("quantity"),
            F.nullif(text, F.lit("")).alias("comment"),
        )
    )


def mark_favourites(votes: DataFrame, photos: DataFrame) -> DataFrame:
    """Photo snapshot with the favourite flag of the photo each vote was cast on (``photo_index``; 0 when out of range).
    The last vote on a series decides when several name the same photo."""
    placed = positions(photos.where(F.col("observation_id").isNotNull()), ["observation_id"], "captured_at", "id")
    sizes = photos.groupBy("observation_id").agg(F.count(F.lit(1)).alias("_size"))
    aimed = (
        votes.join(sizes, "observation_id")
        .withColumn("position", F.when(F.col("photo_index") < F.col("_size"), F.col("photo_index")).otherwise(0) + 1)
        .groupBy("observation_id", "position")
        .agg(F.max_by("is_favorite", "vote_id").alias("_favourite"))
    )
    changed = placed.join(aimed, ["observation_id", "position"]).select("id", "_favourite")
    return (
        photos.join(changed, "id", "left")
        .withColumn("is_favorite", F.coalesce("_favourite", "is_favorite"))
        .drop("_favourite")
    )
