"""Diversity of a region and similarity between two regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trapline.functions.rounding import half_even
from trapline.operators.consensus import DONE, series_votes
from trapline.operators.filters import captured_through


def region_activity(activity: DataFrame, regions: DataFrame, first: str, last: str) -> DataFrame:
    """Activity rows of each region (``regions``: region, location_id) from the month of first to the month of last."""
    months = [F.lit(d).cast("date") for d in (first, last)]
    month_number = F.col("year") * 100 + F.col("month")
    low, high = [F.year(m) * 100 + F.month(m) for m in months]
    years = F.col("year").between(F.year(months[0]), F.year(months[1]))  # prunes the partitions of the stored table
    return activity.where(years & month_number.between(low, high)).join(regions, "location_id")


def region_totals(rows: DataFrame) -> DataFrame:
    """Trap days (the largest value of each site-month), active sites and detections per region."""
    months = rows.groupBy("region", "location_id", "year", "month").agg(
        F.max("trap_days").alias("_days"), F.sum(F.when(F.col("species_id") > 0, F.col("detection_count"))).alias("_seen")
    )
    sites = months.groupBy("region", "location_id").agg(F.sum("_days").alias("_days"), F.sum("_seen").alias("_seen"))
    return sites.groupBy("region").agg(
        F.sum("_days").alias("trap_days"), F.count(F.lit(1)).alias("active_locations"), F.sum("_seen").alias("total_detections")
    )


def region_rai(rows: DataFrame) -> DataFrame:
    """Detections per 100 trap days of every species and region; regions without trap days have none."""
    counts = rows.where("species_id > 0").groupBy("region", "species_id").agg(F.sum("detection_count").alias("detections"))
    days = region_totals(rows).where("trap_days > 0").select("region", "trap_days")
    return counts.join(days, "region").withColumn("rai", F.col("detections") / F.col("trap_days") * 100)


def diversity(rai: DataFrame) -> DataFrame:
    """Shannon, Simpson and Pielou per region (3 digits). Species without detections count for Pielou's species number."""
    totals = rai.groupBy("region").agg(F.sum("rai").alias("_sum"), F.count(F.lit(1)).alias("_kinds")).where("_sum > 0")
    p = F.col("rai") / F.col("_sum")
    sums = (
        rai.join(totals, "region")
        .groupBy("region", "_kinds")
        .agg(F.sum(F.when(p > 0, -p * F.ln(p)).otherwise(0.0)).alias("_h"), F.sum(p * p).alias("_p2"))
    )
    even = F.when(F.col("_kinds") > 1, F.col("_h") / F.ln(F.col("_kinds")))
    return sums.select(
        "region",
        half_even(F.col("_h"), 3).alias("shannon"),
        half_even(1 - F.col("_p2"), 3).alias("simpson"),
        half_even(even, 3).alias("pielou"),
    )


def region_species(
    identifications: DataFrame, photos: DataFrame, observations: DataFrame, regions: DataFrame, first: str, last: str
) -> DataFrame:
    """Distinct species with any vote in verified series of each region, over whole days."""
    sites = observations.where(F.col("status").isin(*DONE)).select(F.col("id").alias("observation_id"), "location_id")
    votes = identifications.where("species_id > 0").select("photo_id", "species_id")
    seen = (
        series_votes(votes, captured_through(photos, first, last))
        .join(sites, "observation_id")
        .select("location_id", "species_id")
        .distinct()
    )
    return seen.join(regions, "location_id").select("region", "species_id").distinct()


def presence(present: DataFrame, left: str, right: str) -> DataFrame:
    """(species_id, in_left, in_right) of the two regions."""
    return present.where(F.col("region").isin(left, right)).groupBy("species_id").agg(
        F.bool_or(F.col("region") == left).alias("in_left"), F.bool_or(F.col("region") == right).alias("in_right")
    )


def presence_similarity(pairs: DataFrame) -> DataFrame:
    """Jaccard and Sorensen with the sizes of the shared and the one-sided sets."""
    both = F.count_if(F.col("in_left") & F.col("in_right"))
    one, other = F.count_if("in_left"), F.count_if("in_right")
    return pairs.agg(
        both.alias("shared_count"),
        (one - both).alias("left_only_count"),
        (other - both).alias("right_only_count"),
        F.coalesce(half_even(F.try_divide(both, F.count(F.lit(1))), 3), F.lit(0.0)).alias("jaccard"),
        F.coalesce(half_even(F.try_divide(2 * both, one + other), 3), F.lit(0.0)).alias("sorensen"),
    )


def presence_names(pairs: DataFrame, species: DataFrame, name, limit: int = 20) -> DataFrame:
    """(side, name): the first names in order of the shared and the one-sided species."""
    side = F.when(F.col("in_left") & F.col("in_right"), "shared").when(F.col("in_left"), "left").otherwise("right")
    named = species.select(F.col("id").alias("species_id"), name.alias("_name"))
    labelled = pairs.join(named, "species_id", "left").select(
        side.alias("side"), F.coalesce("_name", F.concat(F.lit("Species "), F.col("species_id").cast("string"))).alias("name")
    )
    lists = [labelled.where(F.col("side") == s).orderBy("name").limit(limit) for s in ("shared", "left", "right")]
    return lists[0].unionByName(lists[1]).unionByName(lists[2])


def paired_counts(rai: DataFrame, left: str, right: str) -> DataFrame:
    """Detections and rates of every species on both sides, zero where a side has none."""

    def side(region: str, column: str):
        return F.sum(F.when(F.col("region") == region, F.col(column)).otherwise(0))

    return rai.where(F.col("region").isin(left, right)).groupBy("species_id").agg(
        side(left, "detections").alias("left_count"),
        side(right, "detections").alias("right_count"),
        side(left, "rai").alias("left_rai"),
        side(right, "rai").alias("right_rai"),
    )


def abundance_similarity(pairs: DataFrame) -> DataFrame:
    """Bray-Curtis and Morisita-Horn over detections (3 digits)."""
    a, b = F.col("left_count").cast("double"), F.col("right_count").cast("double")
    sums = pairs.agg(
        F.sum(F.least(a, b)).alias("_min"),
        F.sum(a + b).alias("_all"),
        F.sum(a).alias("_a"),
        F.sum(b).alias("_b"),
        F.sum(a * a).alias("_a2"),
        F.sum(b * b).alias("_b2"),
        F.sum(a * b).alias("_ab"),
    )
    na, nb = [F.when(F.col(c) != 0, F.col(c)).otherwise(1.0) for c in ("_a", "_b")]
    horn = F.try_divide(2 * F.col("_ab"), (F.col("_a2") / (na * na) + F.col("_b2") / (nb * nb)) * na * nb)
    return sums.select(
        F.coalesce(half_even(1 - F.try_divide(2 * F.col("_min"), F.col("_all")), 3), F.lit(0.0)).alias("bray_curtis"),
        F.coalesce(half_even(horn, 3), F.lit(0.0)).alias("morisita_horn"),
    )


def top_by_rai(pairs: DataFrame, limit: int = 30) -> DataFrame:
    """Species with the largest summed rate of both sides, ties by id."""
    return (
        pairs.orderBy((F.col("left_rai") + F.col("right_rai")).desc(), "species_id")
        .limit(limit)
        .select(
            "species_id", "left_count", "right_count",
            half_even(F.col("left_rai"), 3).alias("left_rai"), half_even(F.col("right_rai"), 3).alias("right_rai"),
        )
    )


INDICES = ("trap_days", "active_locations", "total_detections", "species_count", "shannon", "simpson", "pielou")


def compare_regions(rows: DataFrame, present: DataFrame, species: DataFrame, name, labels: dict[str, str], limit: int = 30) -> DataFrame:
    """The whole comparison of two regions as (section, side, item, metric, value).

    ``rows`` is ``region_activity`` over a stored table, ``present`` is ``region_species``, ``labels`` names both regions, the
    left one first. Sections: ``region`` (totals and diversity of each side, its label as item), ``similarity``, ``species``
    (counts and rates of the species with the largest rates) and ``names`` (of the shared and one-sided species).
    """
    (left, left_label), (right, right_label) = labels.items()
    rai, pairs = region_rai(rows), presence(present, left, right)
    paired = paired_counts(rai, left, right)
    found = present.groupBy("region").agg(F.count_distinct("species_id").alias("species_count"))
    sides = region_totals(rows).join(found, "region", "full").join(diversity(rai), "region", "left").where(F.col("region").isin(left, right))
    label = F.when(F.col("region") == left, left_label).otherwise(right_label)
    named = species.select(F.col("id").alias("species_id"), name.alias("_name"))
    title = F.coalesce("_name", F.concat(F.lit("Species "), F.col("species_id").cast("string")))
    nothing = F.lit(None).cast("string")

    def listed(section: str, table: DataFrame, metrics, side=nothing, item=nothing) -> DataFrame:
        ids = [F.lit(section).alias("section"), side.alias("side"), item.alias("item")]
        wide = table.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
        return wide.unpivot(["section", "side", "item"], list(metrics), "metric", "value")

    presences, abundances = presence_similarity(pairs), abundance_similarity(paired)
    top = top_by_rai(paired, limit).join(named, "species_id", "left")
    names = presence_names(pairs, species, name)
    parts = [
        listed("similarity", presences, presences.columns),
        listed("similarity", abundances, abundances.columns),
        listed("species", top, ("left_count", "right_count", "left_rai", "right_rai"), item=title),
        names.select(F.lit("names").alias("section"), "side", F.col("name").alias("item"), nothing.alias("metric"), F.lit(None).cast("double").alias("value")),
    ]
    report = listed("region", sides, INDICES, F.col("region"), label)
    for part in parts:
        report = report.unionByName(part)
    return report
