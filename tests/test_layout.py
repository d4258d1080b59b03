"""Facts stored by series: the plans over them, a hot series, and opening them again."""

import pytest
from pyspark.sql import functions as F

from trapline.operators import consensus as C
from trapline.operators import filters as L
from trapline.operators import imports as I
from trapline.operators import occurrences as X
from trapline.operators import reports as R
from trapline.plans import layout_queries as Q
from trapline.sources import layout


@pytest.fixture(scope="module")
def held(spark, survey):
    return Q.facts(survey)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled_joins(spark):
    """No broadcasts, as with large tables; small dimensions are broadcast by hand below."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_consensus_over_stored_facts_has_no_exchange(held, survey, shuffled_joins):
    assert plan_of(C.consensus(survey.identifications, survey.photos)).count("Exchange hashpartitioning") >= 2
    for df in (
        C.consensus(held.ballots, None),
        C.quorum(held.observations, held.ballots, None),
        C.redecide(held.observations, held.ballots, None),
        C.voters(held.ballots, None),
        C.verified_series(L.started_between(held.observations, "1996-01-01", "1997-12-31"), held.ballots, None),
    ):
        assert "Exchange" not in plan_of(df) and "Bucketed: true" in plan_of(df)


def test_first_aggregate_of_reports_and_exports_comes_before_any_exchange(held, survey, shuffled_joins):
    """Votes are counted by series where they lie; only counts by species are exchanged."""
    species = survey.spark.range(1).select(F.col("id"), *[F.lit("x").alias(c) for c in ("scientific_name", "common_name_ua", "common_name_en")])
    top = plan_of(R.top_species(C.verified_series(held.observations, held.ballots, None), F.broadcast(species)))
    assert top.count("hashpartitioning(") == top.count("hashpartitioning(species_id") == 1
    ballots = X.ballots(held.ballots, None, F.broadcast(survey.users), held.observations)
    assert "hashpartitioning(observation_id" not in plan_of(ballots)


def test_a_hot_series_is_one_row_for_each_voter_and_species(spark, tmp_path):
    photos = spark.range(2000).select("id", F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("observation_id"))
    photos = photos.withColumn("observation_id", F.when(F.col("id") == 1999, None).otherwise(F.col("observation_id")))
    votes = photos.select(
        F.col("id").alias("photo_id"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 2 == 0, 4).alias("species_id"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("quantity"),
    )
    series = photos.select(F.col("observation_id").alias("id"), F.lit("pending").alias("status")).distinct().where("id IS NOT NULL")
    held = layout.store_facts(series, votes, photos, str(tmp_path / "facts"), 5)
    assert held.ballots.where("observation_id = 7").count() == 6 and held.observations.count() == 500
    order = ["observation_id", "rn"]
    assert C.consensus(held.ballots, None).orderBy(order).collect() == C.consensus(votes, photos).orderBy(order).collect()
    again = layout.open_bucketed(spark, str(tmp_path / "facts" / "ballots"), held.ballots.schema, "observation_id", 5)
    assert sorted(map(str, again.collect())) == sorted(map(str, held.ballots.collect()))
    assert len(list((tmp_path / "facts" / "ballots").glob("*.parquet"))) <= 5
    nothing = layout.store_facts(series.limit(0), votes.limit(0), photos.limit(0), str(tmp_path / "nothing"), 5)
    assert C.consensus(nothing.ballots, None).count() == 0


def test_dashboard_reads_each_table_once(spark, survey, shuffled_joins):
    stamp = "timestamp_ntz"
    photos = spark.createDataFrame(
        [(1, 1, "2024-01-01 10:00:00"), (2, 1, "2024-01-01 10:00:05"), (3, 1, "2024-01-02 00:00:00"), (4, 2, "2024-01-03 00:00:01"), (5, None, "2024-01-01 00:00:00"),
         (6, 3, None), (7, 9, "2024-01-01 08:00:00"), (8, 4, "2024-01-01 09:00:00")], "id long, observation_id long, at string",
    ).select("id", "observation_id", F.col("at").cast(stamp).alias("captured_at"))
    votes = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5), (3, -1), (4, 7), (5, 8), (7, 8), (77, 8), (6, None)], "photo_id long, species_id int")
    series = spark.createDataFrame(
        [(1, 10, "completed", "2024-01-01 10:00:00"), (2, 11, "completed", "2024-01-03 00:00:01"), (3, 10, "pending", "2024-01-01 00:00:00"),
         (4, 12, "pending", "2024-01-01 09:00:00"), (5, 13, "pending", "2024-01-04 00:00:00"), (6, 13, "pending", "2024-01-04 00:00:01")],
        "id long, location_id int, status string, at string",
    ).select("id", "location_id", "status", F.col("at").cast(stamp).alias("series_start_time"))
    found = R.dashboard_kpis(photos, votes, series, "2024-01-01", "2024-01-03")
    assert dict(map(tuple, found.collect())) == {"photos": 4, "locations": 2, "capture_days": 2, "observations": 1, "species": 2, "unvoted_series": 2}
    nothing = R.dashboard_kpis(photos.limit(0), votes.limit(0), series.limit(0), "2024-01-01", "2024-01-03")
    assert sorted(map(tuple, nothing.collect())) == sorted((m, 0) for m in R.KPIS)
    whole = plan_of(R.dashboard_kpis(survey.photos, survey.identifications, survey.observations, "1996-01-01", "1997-01-01"))
    plain = sum(plan_of(t).count("FileScan") for t in (survey.photos, survey.identifications, survey.observations))
    assert whole.count("FileScan") <= plain


def test_numbers_and_labels_are_hashed(spark, survey, shuffled_joins):
    cached = spark.range(3).select("id", *[F.lit(c).alias(c) for c in ("base_label", "original_filename")])
    found = cached.select(F.lit(1).alias("observation_id"), F.lit(2).alias("model_id"), "base_label", F.col("id").cast("double").alias("base_score"))
    labels = I.series_labels(found, spark.range(1).select(F.lit("fox").alias("label"), F.lit(3).alias("species_id")))
    shots = cached.select("id", F.lit(1).alias("observation_id"), "original_filename", F.current_timestamp().cast("timestamp_ntz").alias("captured_at"))
    index = I.photo_index(shots, spark.range(2).select("id", F.lit(4).alias("location_id")))
    assert "SortAggregate" not in plan_of(labels) + plan_of(index)
    assert [tuple(r)[-2:] for r in index.collect()] == [(2, 1)]


def test_label_of_a_series_goes_by_score_then_name(spark):
    rows = [(1, 1, "wolf", 0.9), (1, 1, "fox", 0.9), (1, 1, "fox", None), (1, 1, "human", 0.99), (2, 1, "human", None), (2, 1, "vehicle", 0.5),
            (3, 1, None, 0.7), (3, 1, "", 0.9), (4, 1, "elk", None), (4, 1, "bear", -0.5), (5, 2, "vehicle", 0.2)]
    found = spark.createDataFrame(rows, "observation_id int, model_id int, base_label string, base_score double")
    labels = I.series_labels(found, spark.createDataFrame([(" Fox", 3)], "label string, species_id int"))
    expected = [(1, 1, "fox", 0.9, 3), (2, 1, "human", 1.0, None), (3, 1, "empty", 1.0, None), (4, 1, "elk", 0.0, None), (5, 2, "vehicle", 1.0, None)]
    assert sorted(map(tuple, labels.collect())) == expected
