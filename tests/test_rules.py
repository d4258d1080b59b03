"""Small inputs with results worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from trapline.operators import activity as A
from trapline.operators import community as M
from trapline.operators import consensus as C
from trapline.operators import curves as D
from trapline.operators import filters as L
from trapline.operators import imports as I
from trapline.operators import lifecycle as Y
from trapline.operators import occurrences as X
from trapline.operators import quality as Q
from trapline.operators import reports as R
from trapline.operators import sessions as G
from trapline.operators import trends as T
from trapline.sources.sheets import parse_sheet
from trapline.sources.starschema import QC_BOOLEAN_FLAGS

T0 = dt.datetime(2024, 5, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def votes(spark, rows):
    """rows: (series, user, species, quantity) with one photo per series."""
    ids = [(n, series, user, species, quantity) for n, (series, user, species, quantity) in enumerate(rows)]
    identifications = spark.createDataFrame(
        ids, "id long, photo_id long, user_id int, species_id int, quantity int"
    ).withColumn("created_at", F.lit(T0))
    photos = spark.createDataFrame(sorted({(r[0], r[0]) for r in rows}), "id long, observation_id long")
    return identifications, photos


def won(spark, rows, **options):
    identifications, photos = votes(spark, rows)
    return {r.observation_id: r.species_id for r in C.winners(identifications, photos, **options).collect()}


def test_most_users_win(spark):
    assert won(spark, [(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 2, 9)]) == {1: 1}


def test_unknown_quantity_wins_a_tie_unless_it_counts_as_zero(spark):
    rows = [(1, 1, 1, 3), (1, 2, 2, None)]
    assert won(spark, rows) == {1: 2}
    assert won(spark, rows, null_species=False, quantity="unknown_zero") == {1: 1}


def test_unknown_species_is_a_candidate(spark):
    rows = [(1, 1, None, 1), (1, 2, None, 1), (1, 3, 1, 1)]
    assert won(spark, rows) == {1: None}
    assert won(spark, rows, null_species=False) == {1: 1}


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(1, 1, 1), (1, 2, 1), (1, 3, 2)], [(1, 2, 3)]),
        ([(1, 1, 1), (1, 1, 2), (1, 2, 1)], [(1, 2, 3)]),
        ([(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2)], []),
        ([(1, 1, 1), (1, 2, 1)], []),
        ([(1, 1, None), (1, 2, None), (1, 3, 1)], [(None, 2, 3)]),
    ],
)
def test_quorum(spark, rows, expected):
    identifications, photos = votes(spark, [(s, u, sp, 1) for s, u, sp in rows])
    # several votes of a user on one series need several photos
    identifications = identifications.withColumn("photo_id", F.col("id"))
    photos = identifications.select("id", F.lit(1).cast("long").alias("observation_id"))
    observations = spark.createDataFrame([(1, "pending")], "id long, status string")
    found = C.quorum(observations, identifications, photos, 3).collect()
    assert [(r.winner_species_id, r.winner_votes, r.total_votes) for r in found] == expected


def test_series_gap(spark):
    photos = spark.createDataFrame([(n, "b", at(s)) for n, s in enumerate((0, 10, 70, 131, 400))], "id long, upload_batch_id string, captured_at timestamp_ntz")
    found = {r.id: (r.series_idx, r.sequence_number) for r in G.sessionise(photos, gap_seconds=60).collect()}
    assert found == {0: (1, 1), 1: (1, 2), 2: (1, 3), 3: (2, 1), 4: (3, 1)}
    sizes = sorted(r.photo_count for r in G.series_table(photos, gap_seconds=60).collect())
    assert sizes == [1, 1, 3]


def test_independent_events(spark):
    rows = [(n, "Fox", "site", at(s), q) for n, (s, q) in enumerate(((0, 1), (300, 5), (601, 2)))]
    records = spark.createDataFrame(rows, "observation_id long, scientific_name string, location_name string, series_start_time timestamp_ntz, max_quantity int")
    assert sorted(r.observation_id for r in X.best_of_event(records, 5).collect()) == [1, 2]
    assert [r.observation_id for r in X.best_of_event(records, 10_000).collect()] == [1]


@pytest.mark.parametrize("days, expected", [((0, 1, 10, 40), 12), ((0, 15), 16), ((0, 16), 2), ((3,), 1)])
def test_effort(spark, days, expected):
    frame = spark.createDataFrame([(1, day(d)) for d in days], "location_id int, day date")
    assert A.total_effort(frame).first().effort_days == expected


def test_effort_of_nothing(spark):
    assert A.total_effort(spark.createDataFrame([], "location_id int, day date")).first().effort_days == 0


@pytest.mark.parametrize("days, covered", [((1, 5, 20), 6), ((1, 12), 12), ((1, 13), 2)])
def test_coverage_gaps(spark, days, covered):
    photos = spark.createDataFrame(
        [(n, 1, dt.datetime.combine(day(d), dt.time(9))) for n, d in enumerate(days)], "id long, observation_id long, captured_at timestamp_ntz"
    )
    observations = spark.createDataFrame([(1, 7)], "id long, location_id int")
    deployments = spark.createDataFrame([], "location_id int, start_date date, end_date date")
    assert A.coverage_days(photos, observations, deployments).where("covered").count() == covered


def test_excluded_last_day(spark):
    rows = [(1, dt.datetime(2024, 1, 5, 10)), (2, dt.datetime(2024, 1, 4, 10)), (3, dt.datetime(2024, 1, 5))]
    photos = spark.createDataFrame(rows, "id long, captured_at timestamp_ntz")
    assert sorted(r.id for r in L.captured_between(photos, "2024-01-01", "2024-01-05").collect()) == [2, 3]


def _deployment(spark, **flags):
    columns = ", ".join(f"{f} boolean" for f in QC_BOOLEAN_FLAGS)
    row = (1, 5, day(0), day(100), "Winter", 3, *[flags.get(f, False) for f in QC_BOOLEAN_FLAGS], flags.get("text"))
    return spark.createDataFrame(
        [row], f"id int, location_id int, start_date date, end_date date, study_season string, n_photos int, {columns}, qc_local_datetime_issue string"
    )


@pytest.mark.parametrize("text, kept", [("", 1), ("clock off", 0), (None, 1)])
def test_text_flag_excludes_when_not_empty(spark, text, kept):
    observations = spark.createDataFrame([(1, 5, dt.datetime(2024, 1, 10))], "id long, location_id int, series_start_time timestamp_ntz")
    assert L.qc_exclude(observations, _deployment(spark, text=text), ["qc_local_datetime_issue"]).count() == kept


@pytest.mark.parametrize(
    "flags, unusable, summary, status",
    [
        ({"qc_stolen": None}, False, None, "normal_winter"),
        ({"qc_stolen": None, "qc_sd_issue": True}, False, True, "issue"),
        ({"qc_installation_incorrect": True, "qc_no_species_captured": None}, None, None, "normal_winter"),
        ({"qc_installation_incorrect": True, "qc_no_species_captured": True}, True, True, "issue"),
    ],
)
def test_derived_flags(spark, flags, unusable, summary, status):
    locations = spark.createDataFrame([(5, 1.0, 2.0)], "id int, latitude double, longitude double")
    first = spark.createDataFrame([], "location_id int, study_area_id string, study_area string, region string")
    row = Q.assess(_deployment(spark, **flags), locations, first).first()
    assert (row.qc_data_not_usable, row.qc_summary, row.status) == (unusable, summary, status)
    assert row.qc_min_days_not_reached is False and row.n_days_working == 100


def test_percentages_add_up(spark):
    observations = spark.createDataFrame([(n, 1, "completed" if n < 3 else "pending") for n in range(7)], "id long, location_id int, status string")
    photos = spark.createDataFrame([(n, n) for n in range(7)], "id long, observation_id long")
    identifications = spark.createDataFrame([(n, 1) for n in range(5)], "photo_id long, user_id int")
    bridge = spark.createDataFrame([(1, 9)], "location_id int, institution_id int")
    row = R.series_progress(observations, photos, identifications, bridge).first()
    assert (row.pct_verified, row.pct_pending, row.pct_in_progress) == (42.9, 28.6, 28.5)


def test_pace_of_less_than_a_day(spark):
    photos = spark.createDataFrame([(n, 1, at(n * 4000)) for n in range(10)], "id long, observation_id long, captured_at timestamp_ntz")
    observations = spark.createDataFrame([(1, 3, "pending")], "id long, location_id int, status string")
    empty = spark.createDataFrame([], "id long, photo_id long, user_id int, species_id int, quantity int")
    species = spark.createDataFrame([(1,)], "id int")
    assert R.location_stats(photos, observations, empty, species).first().avg_photos_per_day == 10.0


def test_month_window_is_clipped(spark):
    start = spark.range(1).select(R.window_starts(dt.date(2026, 3, 31))["d_month"].alias("m")).first().m
    assert start == dt.datetime(2026, 2, 28)


def _regions(spark, left, right):
    rows = [("left", s, n, float(n)) for s, n in left.items()] + [("right", s, n, float(n)) for s, n in right.items()]
    return spark.createDataFrame(rows, "region string, species_id int, detections long, rai double")


def test_diversity(spark):
    row = M.diversity(_regions(spark, {1: 4, 2: 4, 3: 0}, {})).first()
    assert (row.shannon, row.simpson, row.pielou) == (0.693, 0.5, 0.631)


def test_similarity(spark):
    pairs = M.presence(_regions(spark, {1: 1, 2: 1}, {1: 1, 3: 1}).select("region", "species_id"), "left", "right")
    row = M.presence_similarity(pairs).first()
    assert (row.jaccard, row.sorensen, row.shared_count) == (0.333, 0.5, 1)
    row = M.abundance_similarity(M.paired_counts(_regions(spark, {1: 4, 2: 4}, {1: 4, 3: 4}), "left", "right")).first()
    assert (row.bray_curtis, row.morisita_horn) == (0.5, 0.5)
    empty = M.presence_similarity(pairs.where("false")).first()
    assert (empty.jaccard, empty.sorensen) == (0.0, 0.0)


def test_overlap(spark):
    curves = [spark.createDataFrame(list(enumerate(map(float, c))), "i int, mean double") for c in ((1, 1, 2), (2, 1, 1), (0, 0, 0))]
    assert D.overlap(curves[0], curves[1]).first().overlap == 0.75
    assert D.overlap(curves[0], curves[2]).first().overlap == 0.0


def _times(spark, hours, species=1, location=1):
    return spark.createDataFrame([(species, location, round(h * D.HOUR_US), 1) for h in hours], "species_id int, location_id int, us long, n long")


def test_smooth_curve_against_the_plain_formula(spark):
    hours = (1.5, 2, 2.25, 13, 23)
    rows = {r.i: r.mean for r in D.smooth_curve(_times(spark, hours), "percent", 0.25).collect()}
    tripled = [h + s for h in hours for s in (-24, 0, 24)]
    mean = sum(tripled) / 15
    h = 0.25 * math.sqrt(sum((t - mean) ** 2 for t in tripled) / 14)
    assert h == pytest.approx(5.526761193114308, abs=1e-12)
    for i in (0, 40, 127):
        x = i * 24 / 127
        expected = sum(math.exp(-((x - t) ** 2) / (2 * h * h)) for t in tripled) / (15 * math.sqrt(2 * math.pi) * h) * 3 * 100
        assert rows[i] == pytest.approx(expected, abs=1e-10)
    area = sum((rows[i] + rows[i + 1]) / 2 for i in range(127)) * 24 / 127 / 100
    assert area == pytest.approx(0.9999985, abs=1e-6)


def test_single_detection_has_no_curve(spark):
    assert D.smooth_curve(_times(spark, (3,)), "percent", 0.25).count() == 0


def _trend(spark, values):
    rows = [(1, "global", "", 2000 + n, float(v)) for n, v in enumerate(values)]
    return T.trend_test(spark.createDataFrame(rows, "species_id int, scope_type string, scope_id string, year int, mean_dr_index double")).collect()


def test_rising_years(spark):
    row = _trend(spark, (1, 2, 3, 4, 5))[0]
    assert row.mk_tau == pytest.approx(1.0)
    assert (round(row.mk_p, 6), row.trend, row.sen_slope) == (0.016667, "increasing", 1.0)


def test_short_and_flat_series(spark):
    assert _trend(spark, (1, 2, 3, 4)) == []
    row = _trend(spark, (2, 2, 2, 2, 2, 2))[0]
    assert (row.mk_tau, row.mk_p, row.trend, row.sen_slope) == (0.0, 1.0, "no_trend", 0.0)


def test_one_discordant_pair(spark):
    row = _trend(spark, (1, 2, 3, 4, 6, 5))[0]
    assert row.mk_tau == pytest.approx(13 / 15) and round(row.mk_p, 6) == 0.016667


def test_ties_use_the_normal_tail(spark):
    row = _trend(spark, (1, 1, 2, 3, 4))[0]
    # S = 9, one tie of two: variance = (5*4*15 - 2*1*9) / 18
    z = 9 / math.sqrt((300 - 18) / 18)
    assert row.mk_p == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-12)
    assert row.mk_tau == pytest.approx(9 / math.sqrt(10) / math.sqrt(9))


def test_long_series_use_the_normal_tail(spark):
    row = _trend(spark, [n % 7 + n / 50 for n in range(40)])[0]
    assert row.n_years == 40 and 0 < row.mk_p < 1


def test_one_site_has_no_spread(spark):
    yearly = spark.createDataFrame([(1, 4, 2020, 2, 50)], "species_id int, location_id int, year int, detections long, trap_days long")
    scopes = spark.createDataFrame([("global", "", 4)], "scope_type string, scope_id string, location_id int")
    row = T.yearly_trend(yearly, scopes, 50).first()
    assert (row.mean_dr_index, row.lower_ci, row.upper_ci) == (4.0, 4.0, 4.0)


def test_slices_of_sites_give_the_same_band(spark, monkeypatch):
    rows = [(1, site, year, site % 3, 10 + site) for site in range(12) for year in (2020, 2021)]
    yearly = spark.createDataFrame(rows, "species_id int, location_id int, year int, detections long, trap_days long")
    scopes = spark.createDataFrame([("global", "", s) for s in range(12)], "scope_type string, scope_id string, location_id int")
    whole = T.yearly_trend(yearly, scopes, 2000).orderBy("year").collect()
    monkeypatch.setattr(T, "SLICE", 5)
    for one, many in zip(whole, T.yearly_trend(yearly, scopes, 2000).orderBy("year").collect()):
        assert list(one[4:]) == pytest.approx(list(many[4:]), abs=0.5) and one[:4] == many[:4]


def _labels(spark, rows):
    predictions = spark.createDataFrame([(n, 1, 1, *r) for n, r in enumerate(rows)], "photo_id long, observation_id long, model_id int, base_label string, base_score double")
    label_map = spark.createDataFrame([("Fox", 3), ("human", -5)], "label string, species_id int")
    row = I.series_labels(predictions, label_map).first()
    return row.prediction_label, row.prediction_score, row.prediction_species_id


def test_series_label(spark):
    assert _labels(spark, [("empty", 0.9), ("human", 0.8), ("fox", 0.3)]) == ("fox", 0.3, 3)
    assert _labels(spark, [("human", None), ("vehicle", 0.7)]) == ("human", 1.0, -5)
    assert _labels(spark, [("vehicle", 0.7), (None, 0.1)]) == ("vehicle", 1.0, None)
    assert _labels(spark, [(None, None)]) == ("empty", 1.0, None)


PREDICTION = "photo_id long, model_id int, observation_id long, base_label string, base_score double, top1_label string, animal_count int, human_count int"


@pytest.mark.parametrize("stored, new, change", [(0.7, 0.7, "skipped"), (0.7, 0.8, "updated"), (0.7, None, "skipped"), (None, None, "updated")])
def test_higher_score_wins(spark, stored, new, change):
    old = spark.createDataFrame([(1, 1, 1, "fox", stored, None, None, None)], PREDICTION)
    fresh = spark.createDataFrame([(1, 1, 1, "wolf", new, None, None, None), (2, 1, 1, "wolf", new, None, None, None)], PREDICTION)
    once = I.upsert_predictions(old, fresh)
    assert {r.photo_id: r.change for r in once.collect()} == {1: change, 2: "added"}
    twice = I.upsert_predictions(once.drop("change"), fresh)
    columns = ["photo_id", "base_label", "base_score"]
    if stored is not None or new is not None:
        assert sorted(twice.select(*columns).collect()) == sorted(once.select(*columns).collect())


def test_tied_species_of_a_verified_file(spark):
    matched = spark.createDataFrame([(n, 1, label, 0.5) for n, label in enumerate(("empty", "empty", "fox", "fox"))], "photo_id long, observation_id long, base_label string, base_score double")
    label_map = spark.createDataFrame([("empty", -1), ("fox", 4)], "label string, species_id int")
    observations = spark.createDataFrame([(1, "pending")], "id long, status string")
    row = I.modal_species(matched, label_map, observations).first()
    assert (row.species_id, row.ambiguous) == (4, True)


def test_sheet_values(spark):
    sheet = spark.createDataFrame(
        [("yes", "405.0", "2023-2024", " A1 ", "так", "abc")], ["data_usable", "camera_id", "study_year", "Deployment_ID", "qc_stolen", "n_photos"]
    ).withColumns({"sheet": F.lit("S"), "row_no": F.lit(1)})
    row = parse_sheet(sheet).first()
    assert (row.qc_data_not_usable, row.camera_id, row.study_year, row["name"], row.qc_stolen, row.n_photos) == (False, "0405", 2023, "A1", True, None)
    assert [(w.field, w.raw_value) for w in row.warnings] == [("n_photos", "abc")]


def test_biotope_choice(spark):
    histogram = spark.createDataFrame([(1, c, n) for c, n in ((10, 50), (50, 40), (30, 9), (20, 1))], "location_id int, class int, pixels long")
    class_map = spark.createDataFrame([(10, 1), (30, 2), (20, 3)], "landcover_class int, biotope_id int")
    assert sorted((r.place, r.biotope_id) for r in I.choose_biotopes(histogram, class_map, 2).collect()) == [(1, 1), (2, 2)]


def test_pixels_beside_the_date_line(spark):
    locations = spark.createDataFrame([(1, 10.0, 179.9999)], "id int, latitude double, longitude double")
    pixels = spark.createDataFrame([(10, 10.0, -179.9999), (10, 10.0, 179.9), (20, 10.0005, 179.9999)], "class int, lat double, lon double")
    found = {r["class"]: r.pixels for r in I.landcover_histogram(locations, pixels, 100).collect()}
    assert found == {10: 1, 20: 1}


@pytest.mark.parametrize("days, pace, status, reason", [(200, 60.0, "critical", "photos"), (300, 1.0, "critical", "days"), (10, 1.0, "ok", "days")])
def test_service_forecast(spark, days, pace, status, reason):
    locations = spark.createDataFrame([(1, "a")], "id int, name string")
    visits = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1, 8), 1)], "id int, location_id int, visit_datetime timestamp_ntz, visit_purpose_id int")
    stats = spark.createDataFrame([(1, pace)], "location_id int, avg_photos_per_day double")
    row = Y.service_forecast(locations, visits, stats, dt.date(2024, 1, 1) + dt.timedelta(days=days)).first()
    assert (row.status, row.reason, row.predicted_photos) == (status, reason, int(days * pace))


def test_capture_times(spark):
    rows = [(1, "b", "2009:12:31 23:59:59", None), (2, "b", "2024:05:01 10:00:00", "5"), (3, "b", "junk", "5")]
    uploads = spark.createDataFrame(rows, "id long, upload_batch_id string, taken_text string, subsecond_text string")
    found = {r.id: r.captured_at for r in L.clean_capture_time(uploads, "2024-06-01").collect()}
    assert found[1] == dt.datetime(1900, 1, 1, 0, 0, 1) and found[3] == dt.datetime(1900, 1, 1, 0, 0, 3)
    assert found[2] == dt.datetime(2024, 5, 1, 10, 0, 0, 500_000)


def test_epithet(spark):
    base = "observation_id long, species_id int, voters array<struct<id:string,name:string>>, row_kind string, ai_confidence double, ai_model_name string"
    rest = "scientific_name string, kingdom string, phylum string, class_name string, order_rank string, family string, genus string, establishment_means string"
    last = "series_start_time timestamp_ntz, max_quantity int, state_province string, location_name string, latitude double, longitude double"
    blank = (None,) * 7
    rows = [
        (1, 1, [("2", "Ann"), ("3", "Ben")], "human_consensus", None, None, "Canis lupus lupus", *blank, T0, 1, "p", "l", 1.0, 2.0),
        (2, 1, None, "ai", 0.6666, "M 1 (L)", "Canis", *blank, T0, 1, "p", "l", 1.0, 2.0),
    ]
    first, second = X.shape(spark.createDataFrame(rows, f"{base}, {rest}, {last}")).orderBy("observationID").collect()
    assert (first.specificEpithet, first.identifiedBy, first.identificationConfidence) == ("lupus lupus", "Ann | Ben", "")
    assert (second.specificEpithet, second.identificationConfidence) == (None, "0.667")
    assert second.identificationRemarks == "Automatic detection by M 1 (L), confidence: 0.67"
    assert len(first) == 30


def test_empty_permission_exports_nothing(spark):
    spec = X.OccurrenceSpec("2024-01-01", "2024-02-01", institutions=(1,), allowed_institutions=())
    assert spec.narrowed_institutions() == ()
    assert X.OccurrenceSpec("a", "b", institutions=(9,), allowed_institutions=(1,)).narrowed_institutions() == (1,)
    assert X.OccurrenceSpec("a", "b").narrowed_institutions() is None
    assert [X.OccurrenceSpec("a", "b", minutes=m).window_minutes for m in ("7", "x", None, 0, 600)] == [7, 5, 5, 1, 60]


def test_photos_without_a_time_count_only_between_open_bounds(spark):
    photos = spark.createDataFrame([(1, 1, at(0)), (2, 1, None)], "id long, observation_id long, captured_at timestamp_ntz")
    sites = spark.createDataFrame([(1, 7)], "id long, location_id int")
    day = at(0).date()
    held = spark.createDataFrame([(1, 7, None, None), (2, 7, None, day), (3, 7, day, None), (4, 7, day, day)], "id int, location_id int, start_date date, end_date date")
    assert {r.id: r.photo_count for r in R.deployment_photo_counts(held, photos, sites).collect()} == {1: 2, 2: 1, 3: 1, 4: 1}
