"""Named queries for effort, activity and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from trapline.operators import activity as A
from trapline.operators import consensus as C
from trapline.operators import filters as L
from trapline.operators import reports as R
from trapline.operators import scope as S
from trapline.plans.registry import query

TODAY = date(2001, 8, 2)
FIRST, LAST = "1996-02-01", "2000-08-15"


def verified(s):
    return C.verified_series(s.observations, s.identifications, s.photos)


def _strict(s):
    return S.valid_locations(s.locations, strict=True)


TRAP_SQL = """SELECT o.location_id, CAST(YEAR(p.captured_at) AS INT) AS year, CAST(MONTH(p.captured_at) AS INT) AS month,
    COUNT(DISTINCT CAST(p.captured_at AS DATE)) AS trap_days
    FROM photos p JOIN observations o ON o.id = p.observation_id
    WHERE o.status IN ('completed', 'archived') AND o.location_id IN (SELECT id FROM strict_locations) GROUP BY 1, 2, 3"""
SEEN_SQL = """SELECT i.species_id, o.location_id, CAST(YEAR(p.captured_at) AS INT) AS year, CAST(MONTH(p.captured_at) AS INT) AS month,
    COUNT(DISTINCT CAST(p.captured_at AS DATE)) AS detection_count
    FROM identifications i JOIN photos p ON p.id = i.photo_id JOIN observations o ON o.id = p.observation_id
    WHERE o.status IN ('completed', 'archived') AND i.species_id > 0 AND o.location_id IN (SELECT id FROM strict_locations)
    GROUP BY 1, 2, 3, 4"""
ACTIVITY_SQL = """SELECT s.id AS species_id, t.location_id, t.year, t.month, COALESCE(d.detection_count, 0) AS detection_count, t.trap_days
    FROM trap t CROSS JOIN species s LEFT JOIN seen d ON d.species_id = s.id AND d.location_id = t.location_id
        AND d.year = t.year AND d.month = t.month WHERE s.id > 0"""
ACTIVITY = {"trap": TRAP_SQL, "seen": SEEN_SQL, "activity": ACTIVITY_SQL}


def activity(s):
    return A.monthly_activity(s.identifications, s.photos, s.observations, s.species, _strict(s))


@query("a1_trap_days", TRAP_SQL)
def trap_days(s):
    return A.trap_days(s.photos, s.observations, _strict(s))


@query("a2_detection_days", SEEN_SQL)
def detection_days(s):
    return A.detection_days(s.identifications, s.photos, s.observations, _strict(s))


@query("a3_monthly_activity", "SELECT * FROM activity", **ACTIVITY)
def monthly_activity(s):
    return activity(s)


STEPS_SQL = """SELECT location_id, CAST(SUM(CASE WHEN step <= 15 THEN step ELSE 1 END) AS BIGINT) AS effort_days FROM (
    SELECT location_id, day - LAG(day) OVER (PARTITION BY location_id ORDER BY day) AS step FROM days) t GROUP BY location_id"""
DAYS_SQL = f"""SELECT DISTINCT o.location_id, CAST(p.captured_at AS DATE) AS day FROM photos p JOIN observations o ON o.id = p.observation_id
    WHERE p.captured_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"""


@query(
    "a4_total_effort",
    "SELECT CAST(COALESCE(SUM(effort_days), 0) AS BIGINT) AS effort_days FROM effort",
    effort=STEPS_SQL,
    days=DAYS_SQL + " AND o.location_id IN (SELECT id FROM strict_locations)",
)
def total_effort(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return A.total_effort(A.photo_days(L.captured_between(s.photos, FIRST, LAST), placed))


@query("a5_effort_by_location", "SELECT * FROM effort", effort=STEPS_SQL, days=DAYS_SQL)
def effort_by_location(s):
    return A.effort_by_location(A.photo_days(L.captured_between(s.photos, FIRST, LAST), s.observations))


MAP_SQL = f"""SELECT f.location_id, l.name, f.detections, COALESCE(e.effort_days, 0) AS effort,
    CASE WHEN COALESCE(e.effort_days, 0) > 0 THEN ROUND_EVEN(f.detections / e.effort_days, 4) ELSE 0.0 END AS rai
    FROM (SELECT location_id, COUNT(*) AS detections FROM verified WHERE species_id = 3
        AND CAST(series_start_time AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
        AND location_id IN (SELECT id FROM lenient_locations) GROUP BY location_id) f
    JOIN locations l ON l.id = f.location_id LEFT JOIN effort e ON e.location_id = f.location_id"""


def _map(s):
    placed = S.at_valid_locations(verified(s), s.locations)
    return R.distribution_map(placed, s.photos, s.observations, s.locations, 3, FIRST, LAST)


@query("a6_distribution_map", MAP_SQL, effort=STEPS_SQL, days=DAYS_SQL)
def distribution_map(s):
    return _map(s)


@query(
    "a6_distribution_summary",
    """SELECT CAST(SUM(detections) AS BIGINT) AS total_detections, COUNT(*) AS total_locations, ROUND_EVEN(SUM(rai) / COUNT(*), 4) AS avg_rai
    FROM map_rows""",
    map_rows=MAP_SQL,
    effort=STEPS_SQL,
    days=DAYS_SQL,
)
def distribution_summary(s):
    return R.distribution_summary(_map(s))


LOCATION_STATS_SQL = """SELECT t.location_id, t.total_photos,
    ROUND_EVEN(CASE WHEN t.secs / 86400 >= 1 THEN t.total_photos / (t.secs / 86400) ELSE t.total_photos END, 2) AS avg_photos_per_day,
    COALESCE(c.total_species, 0) AS total_species, COALESCE(c.animals, 0) AS animal_observations,
    COALESCE(c.empties, 0) AS empty_observations, COALESCE(c.others, 0) AS other_observations
    FROM (SELECT o.location_id, COUNT(*) AS total_photos, EPOCH(MAX(p.captured_at)) - EPOCH(MIN(p.captured_at)) AS secs
        FROM photos p JOIN observations o ON o.id = p.observation_id GROUP BY o.location_id) t
    LEFT JOIN (SELECT o.location_id, COUNT(DISTINCT s.id) FILTER (WHERE s.id > 0) AS total_species, COUNT(*) FILTER (WHERE s.id > 0) AS animals,
            COUNT(*) FILTER (WHERE s.id = -1) AS empties, COUNT(*) FILTER (WHERE s.id < -1) AS others
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id ORDER BY vote_count DESC, species_id ASC NULLS LAST) AS k FROM votes) r
        JOIN observations o ON o.id = r.observation_id JOIN species s ON s.id = r.species_id
        WHERE r.k = 1 AND o.status IN ('completed', 'archived') GROUP BY o.location_id) c ON c.location_id = t.location_id"""


@query("a7_location_stats", LOCATION_STATS_SQL)
def location_stats(s):
    return R.location_stats(s.photos, s.observations, s.identifications, s.species)


TOP_SQL = f"""SELECT v.species_id, s.scientific_name, s.common_name_ua, s.common_name_en, COUNT(*) AS observation_count
    FROM verified v JOIN species s ON s.id = v.species_id WHERE s.id > 0
        AND CAST(v.series_start_time AS DATE) BETWEEN DATE '{FIRST}' AND DATE '{LAST}' AND v.location_id IN (SELECT id FROM lenient_locations)
    GROUP BY ALL ORDER BY observation_count DESC, scientific_name LIMIT 15"""


@query("a8_top_species", TOP_SQL)
def top_species(s):
    placed = S.at_valid_locations(L.started_between(s.observations, FIRST, LAST), s.locations)
    return R.top_species(C.verified_series(placed, s.identifications, s.photos), s.species)


@query(
    "a9_photos_per_location",
    f"""SELECT o.location_id, l.name, CAST(l.latitude AS DOUBLE) AS lat, CAST(l.longitude AS DOUBLE) AS lon, COUNT(*) AS photo_count
    FROM photos p JOIN observations o ON o.id = p.observation_id JOIN strict_locations l ON l.id = o.location_id
    WHERE p.captured_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY ALL""",
)
def photos_per_location(s):
    return R.photos_per_location(L.captured_between(s.photos, FIRST, LAST), s.observations, _strict(s))


@query(
    "a10_dashboard_kpis",
    """SELECT 'photos' AS metric, COUNT(*) AS value FROM shown
    UNION ALL SELECT 'locations', COUNT(DISTINCT location_id) FROM shown
    UNION ALL SELECT 'capture_days', COUNT(DISTINCT CAST(captured_at AS DATE)) FROM shown
    UNION ALL SELECT 'observations', COUNT(DISTINCT h.observation_id) FROM shown h JOIN identifications i ON i.photo_id = h.id WHERE i.species_id > 0
    UNION ALL SELECT 'species', COUNT(DISTINCT i.species_id) FROM shown h JOIN identifications i ON i.photo_id = h.id
        WHERE i.species_id > 0 AND h.status IN ('completed', 'archived')
    UNION ALL SELECT 'unvoted_series', COUNT(*) FROM observations o WHERE o.location_id IN (SELECT id FROM strict_locations)
        AND o.series_start_time BETWEEN DATE '1996-02-01' AND DATE '2000-08-16'
        AND o.id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id)""",
    shown=f"""SELECT p.id, p.observation_id, p.captured_at, o.location_id, o.status FROM photos p JOIN observations o ON o.id = p.observation_id
        WHERE o.location_id IN (SELECT id FROM strict_locations) AND p.captured_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}'""",
)
def dashboard_kpis(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.dashboard_kpis(s.photos, s.identifications, placed, FIRST, LAST)


@query(
    "a11_top_contributors",
    f"""SELECT t.user_id, u.username, t.observation_count FROM (
        SELECT i.user_id, COUNT(DISTINCT p.observation_id) AS observation_count FROM identifications i JOIN photos p ON p.id = i.photo_id
        JOIN observations o ON o.id = p.observation_id WHERE o.location_id IN (SELECT id FROM strict_locations)
        AND p.captured_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}' GROUP BY i.user_id) t
    LEFT JOIN users u ON u.id = t.user_id ORDER BY t.observation_count DESC, t.user_id LIMIT 10""",
)
def top_contributors(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.top_contributors(s.photos, s.identifications, placed, s.users, FIRST, LAST)


WINDOWS_SQL = """COUNT(DISTINCT CASE WHEN i.created_at >= DATE '2001-08-02' THEN p.observation_id END) AS d_today,
    COUNT(DISTINCT CASE WHEN i.created_at >= DATE '2001-07-27' THEN p.observation_id END) AS d_week,
    COUNT(DISTINCT CASE WHEN i.created_at >= DATE '2001-07-02' THEN p.observation_id END) AS d_month,
    COUNT(DISTINCT CASE WHEN i.created_at >= DATE '2000-08-02' THEN p.observation_id END) AS d_year,
    COUNT(DISTINCT p.observation_id) AS total"""
VOTED_SQL = """FROM identifications i JOIN photos p ON p.id = i.photo_id JOIN observations o ON o.id = p.observation_id"""


@query(
    "a12_contributor_stats",
    f"SELECT i.user_id, {WINDOWS_SQL} {VOTED_SQL} WHERE o.location_id IN (SELECT id FROM strict_locations) GROUP BY i.user_id",
)
def contributor_stats(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.contributor_stats(s.identifications, s.photos, placed, TODAY)


@query(
    "a12_contributor_stats_one_species",
    f"""SELECT i.user_id, {WINDOWS_SQL} {VOTED_SQL}
    WHERE o.location_id IN (SELECT id FROM strict_locations) AND i.species_id = 4 GROUP BY i.user_id""",
)
def contributor_stats_one_species(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.contributor_stats(s.identifications, s.photos, placed, TODAY, species_id=4)


@query(
    "a13_institution_stats",
    f"""SELECT li.institution_id, {WINDOWS_SQL} {VOTED_SQL} JOIN location_institutions li ON li.location_id = o.location_id
    WHERE o.location_id IN (SELECT id FROM strict_locations) GROUP BY li.institution_id""",
)
def institution_stats(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.institution_stats(s.identifications, s.photos, placed, s.location_institutions, TODAY)


@query(
    "a14_series_progress",
    """SELECT *, ROUND_EVEN(100.0::DOUBLE - pct_verified - pct_pending, 1) AS pct_in_progress FROM (
        SELECT *, ROUND_EVEN(completed * 100.0::DOUBLE / total, 1) AS pct_verified, ROUND_EVEN(pending * 100.0::DOUBLE / total, 1) AS pct_pending
        FROM (SELECT li.institution_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE o.status IN ('completed', 'archived')) AS completed,
                COUNT(*) FILTER (WHERE o.id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id)) AS pending
            FROM observations o JOIN location_institutions li ON li.location_id = o.location_id
            WHERE o.location_id IN (SELECT id FROM strict_locations) GROUP BY li.institution_id) a) b""",
)
def series_progress(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.series_progress(placed, s.photos, s.identifications, s.location_institutions)


@query(
    "a14_system_totals",
    """SELECT 'photos' AS metric, (SELECT COUNT(*) FROM photos p JOIN placed o ON o.id = p.observation_id) AS value
    UNION ALL SELECT 'series', (SELECT COUNT(*) FROM placed)
    UNION ALL SELECT 'completed', (SELECT COUNT(*) FROM placed WHERE status IN ('completed', 'archived'))
    UNION ALL SELECT 'pending', (SELECT COUNT(*) FROM placed WHERE id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id))
    UNION ALL SELECT 'in_progress', (SELECT COUNT(*) FROM placed WHERE status NOT IN ('completed', 'archived'))
        - (SELECT COUNT(*) FROM placed WHERE id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id))""",
    placed="SELECT * FROM observations WHERE location_id IN (SELECT id FROM strict_locations)",
)
def system_totals(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.system_totals(placed, s.photos, s.identifications)


UPLOADED_SQL = """SELECT COALESCE(b.uploaded_by_id, o.uploaded_by_id) AS user_id, COALESCE(b.created_at, o.created_at) AS uploaded_at
    FROM photos p JOIN observations o ON o.id = p.observation_id LEFT JOIN upload_batches b ON b.id = p.upload_batch_id
    WHERE o.location_id IN (SELECT id FROM strict_locations)"""
UPLOAD_DAY = date(2024, 1, 1)


def _uploads(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.upload_events(s.photos, placed, s.upload_batches)


@query(
    "a15_upload_stats",
    """SELECT user_id, COUNT(*) FILTER (WHERE uploaded_at >= DATE '2024-01-01') AS d_today,
    COUNT(*) FILTER (WHERE uploaded_at >= DATE '2023-12-26') AS d_week, COUNT(*) FILTER (WHERE uploaded_at >= DATE '2023-12-01') AS d_month,
    COUNT(*) FILTER (WHERE uploaded_at >= DATE '2023-01-01') AS d_year, COUNT(*) AS total FROM uploaded GROUP BY user_id""",
    uploaded=UPLOADED_SQL,
)
def upload_stats(s):
    return R.upload_stats(_uploads(s), UPLOAD_DAY)


@query(
    "a16_upload_daily",
    """SELECT CAST(d.day AS DATE) AS day, COUNT(u.user_id) AS photos FROM (SELECT UNNEST(GENERATE_SERIES(DATE '2023-10-04', DATE '2024-01-01', INTERVAL 1 DAY)) AS day) d
    LEFT JOIN uploaded u ON CAST(u.uploaded_at AS DATE) = CAST(d.day AS DATE) GROUP BY d.day""",
    uploaded=UPLOADED_SQL,
)
def upload_daily(s):
    return R.upload_daily(_uploads(s), UPLOAD_DAY, 90)


@query(
    "a17_seasonality",
    """SELECT year, month, CAST(SUM(detection_count) AS BIGINT) AS observation_count FROM activity
    WHERE species_id = 2 AND year BETWEEN 1996 AND 1999 GROUP BY year, month""",
    **ACTIVITY,
)
def seasonality(s):
    return R.seasonality(activity(s), 2, 1996, 1999)


@query(
    "a17_seasonality_wide",
    "SELECT year, "
    + ", ".join(f"CAST(SUM(detection_count) FILTER (WHERE month = {m}) AS BIGINT) AS m{m:02d}" for m in range(1, 13))
    + " FROM activity WHERE species_id = 2 AND year BETWEEN 1996 AND 2001 GROUP BY year",
    **ACTIVITY,
)
def seasonality_wide(s):
    return R.seasonality_wide(R.seasonality(activity(s), 2, 1996, 2001))


HEATMAP_SQL = """SELECT CAST(h.v AS INT) AS hour, CAST(m.v AS INT) AS month, COUNT(c.id) AS n
    FROM (SELECT UNNEST(RANGE(24)) AS v) h CROSS JOIN (SELECT UNNEST(RANGE(1, 13)) AS v) m
    LEFT JOIN (SELECT id, series_start_time FROM verified WHERE species_id = 5 AND location_id IN (SELECT id FROM lenient_locations)) c
        ON HOUR(c.series_start_time) = h.v AND MONTH(c.series_start_time) = m.v GROUP BY 1, 2"""


@query("a18_activity_heatmap", HEATMAP_SQL)
def activity_heatmap(s):
    return R.activity_heatmap(S.at_valid_locations(verified(s), s.locations), 5)


@query("a18_heatmap_totals", "SELECT MAX(n) AS max_count, CAST(SUM(n) AS BIGINT) AS total FROM heat", heat=HEATMAP_SQL)
def heatmap_totals(s):
    return R.heatmap_totals(R.activity_heatmap(S.at_valid_locations(verified(s), s.locations), 5))


@query(
    "a19_verified_range",
    """SELECT MIN(CAST(series_start_time AS DATE)) AS first_day, MAX(CAST(series_start_time AS DATE)) AS last_day FROM observations
    WHERE status IN ('completed', 'archived') AND location_id IN (SELECT id FROM lenient_locations)""",
)
def verified_range(s):
    return R.verified_range(S.at_valid_locations(s.observations, s.locations))


@query(
    "a20_frequent_species",
    """SELECT species_id, COUNT(*) AS series FROM verified WHERE species_id > 0 AND location_id IN (SELECT id FROM lenient_locations)
    GROUP BY species_id HAVING COUNT(*) >= 30""",
)
def frequent_species(s):
    return R.frequent_species(S.at_valid_locations(verified(s), s.locations))


RANKING_SQL = """SELECT i.species_id, COUNT(DISTINCT o.id) AS series FROM identifications i JOIN photos p ON p.id = i.photo_id
    JOIN observations o ON o.id = p.observation_id WHERE i.species_id > 0 AND o.status IN ('completed', 'archived') GROUP BY i.species_id"""


@query("a20_often_voted_species", "SELECT * FROM ranking WHERE series >= 30", ranking=RANKING_SQL)
def often_voted_species(s):
    return A.species_ranking(s.identifications, s.photos, s.observations).where("series >= 30")


@query("a21_species_ranking", RANKING_SQL)
def species_ranking(s):
    return A.species_ranking(s.identifications, s.photos, s.observations)


@query(
    "a21_behaviour_ranking",
    """SELECT t.behavior_type_id, COUNT(DISTINCT o.id) AS series FROM identification_behaviors t JOIN identifications i ON i.id = t.identification_id
    JOIN photos p ON p.id = i.photo_id JOIN observations o ON o.id = p.observation_id WHERE o.status IN ('completed', 'archived')
    GROUP BY t.behavior_type_id""",
)
def behaviour_ranking(s):
    return A.behaviour_ranking(s.identifications, s.identification_behaviors, s.photos, s.observations)


BASE_SQL = f"""SELECT i.id AS identification_id, i.quantity, p.observation_id, p.captured_at {VOTED_SQL}
    WHERE i.species_id = 6 AND o.status IN ('completed', 'archived') AND o.location_id IN (SELECT id FROM strict_locations)
    AND p.captured_at BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"""


def _behaviour_base(s):
    placed = S.at_valid_locations(s.observations, s.locations, strict=True)
    return R.behaviour_base(s.identifications, s.photos, placed, 6, FIRST, LAST)


@query(
    "a22_behaviour_distribution",
    """SELECT t.behavior_type_id, COUNT(DISTINCT b.observation_id) AS series FROM base b
    JOIN identification_behaviors t ON t.identification_id = b.identification_id GROUP BY t.behavior_type_id""",
    base=BASE_SQL,
)
def behaviour_distribution(s):
    return R.behaviour_distribution(_behaviour_base(s), s.identification_behaviors)


@query(
    "a22_behaviour_seasons",
    """SELECT CAST(MONTH(b.captured_at) AS INT) AS month, t.behavior_type_id, COUNT(DISTINCT b.observation_id) AS series FROM base b
    JOIN identification_behaviors t ON t.identification_id = b.identification_id GROUP BY 1, 2""",
    base=BASE_SQL,
)
def behaviour_seasons(s):
    return R.behaviour_seasons(_behaviour_base(s), s.identification_behaviors)


@query(
    "a22_group_sizes",
    """SELECT quantity, COUNT(*) AS frequency FROM (SELECT observation_id, MAX(quantity) AS quantity FROM base WHERE quantity > 0
    GROUP BY observation_id) t GROUP BY quantity""",
    base=BASE_SQL,
)
def group_sizes(s):
    return R.group_sizes(_behaviour_base(s))


@query(
    "a22_untagged_votes",
    """SELECT COUNT(*) AS total_identifications,
    COUNT(*) FILTER (WHERE identification_id NOT IN (SELECT identification_id FROM identification_behaviors)) AS untagged FROM base""",
    base=BASE_SQL,
)
def untagged_votes(s):
    return R.untagged_votes(_behaviour_base(s), s.identification_behaviors)


@query(
    "a23_species_with_behaviours",
    """SELECT id, scientific_name FROM species WHERE id IN (SELECT i.species_id FROM identifications i
    JOIN identification_behaviors t ON t.identification_id = i.id)""",
)
def species_with_behaviours(s):
    return R.species_with_behaviours(s.identifications, s.identification_behaviors, s.species).select("id", "scientific_name")


@query(
    "a24_user_stats",
    """SELECT i.user_id, COUNT(*) AS identifications, COUNT(DISTINCT p.observation_id) AS series,
    COUNT(DISTINCT CASE WHEN i.species_id > 0 THEN i.species_id END) AS species
    FROM identifications i JOIN photos p ON p.id = i.photo_id GROUP BY i.user_id""",
)
def user_stats(s):
    return R.user_stats(s.identifications, s.photos)


@query(
    "a24_user_top_species",
    """SELECT user_id, species_id, series, CAST(place AS INT) AS place FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY series DESC, species_id) AS place FROM (
            SELECT i.user_id, i.species_id, COUNT(DISTINCT p.observation_id) AS series FROM identifications i JOIN photos p ON p.id = i.photo_id
            WHERE i.species_id > 0 GROUP BY 1, 2) a) b WHERE place <= 5""",
)
def user_top_species(s):
    return R.user_top_species(s.identifications, s.photos)


@query(
    "a25_picker_groups",
    """SELECT id, picker_group, series, CAST(ROW_NUMBER() OVER (PARTITION BY picker_group ORDER BY series DESC, id) AS INT) AS place FROM (
        SELECT s.id, CASE WHEN s.id = -1 THEN 'empty' WHEN s.id IN (8, 39, -19, -11, -10, -7) THEN 'domestic'
            WHEN s.category IN ('mammals', 'domestic', 'birds', 'other') THEN s.category ELSE 'other' END AS picker_group,
            COALESCE(r.series, 0) AS series FROM species s LEFT JOIN ranking r ON r.species_id = s.id) t""",
    ranking=RANKING_SQL,
)
def picker_groups(s):
    return R.picker_groups(s.species, A.species_ranking(s.identifications, s.photos, s.observations))


COVERED = {
    "counts": """SELECT o.location_id, CAST(p.captured_at AS DATE) AS day, COUNT(*) AS photos FROM photos p JOIN observations o ON o.id = p.observation_id
        WHERE YEAR(p.captured_at) >= 1996 GROUP BY 1, 2""",
    "stepped": "SELECT location_id, day, LEAD(day) OVER (PARTITION BY location_id ORDER BY day) AS following FROM counts",
    "filled": """SELECT location_id, CAST(UNNEST(GENERATE_SERIES(day, CASE WHEN following - day BETWEEN 2 AND 3 THEN following - 1 ELSE day END,
        INTERVAL 1 DAY)) AS DATE) AS day FROM stepped""",
    "deployed": """SELECT location_id, CAST(UNNEST(GENERATE_SERIES(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
        FROM deployments WHERE location_id IS NOT NULL AND start_date <= end_date""",
    "covered_days": "SELECT location_id, day FROM filled UNION SELECT location_id, day FROM deployed",
    "coverage": """SELECT COALESCE(c.location_id, n.location_id) AS location_id, COALESCE(c.day, n.day) AS day, c.day IS NOT NULL AS covered,
        COALESCE(n.photos, 0) AS photos FROM covered_days c FULL JOIN counts n ON n.location_id = c.location_id AND n.day = c.day""",
    "calendar": """SELECT g.location_id, CAST(g.day AS DATE) AS day, COALESCE(c.covered, FALSE) AS covered, COALESCE(c.photos, 0) AS photos FROM (
            SELECT location_id, UNNEST(GENERATE_SERIES(DATE_TRUNC('month', MIN(day)), LAST_DAY(MAX(day)), INTERVAL 1 DAY)) AS day
            FROM coverage GROUP BY location_id) g
        LEFT JOIN coverage c ON c.location_id = g.location_id AND c.day = CAST(g.day AS DATE)""",
}
GRADE_SQL = """CASE WHEN NOT covered THEN 'missing' WHEN photos >= 2 THEN 'good' ELSE 'partial' END AS level,
    CASE WHEN covered THEN (photos - MIN(photos) FILTER (WHERE covered) OVER (PARTITION BY location_id))::DOUBLE
        / COALESCE(NULLIF(MAX(photos) FILTER (WHERE covered) OVER (PARTITION BY location_id)
            - MIN(photos) FILTER (WHERE covered) OVER (PARTITION BY location_id), 0), 1) END AS intensity"""


def _coverage(s):
    return A.coverage_days(s.photos, s.observations, s.deployments, max_gap=2, first_year=1996)


@query("a26_coverage_calendar", f"SELECT location_id, day, covered, photos, {GRADE_SQL} FROM calendar", **COVERED)
def coverage_calendar(s):
    return A.coverage_calendar(_coverage(s), good_photos=2)


@query(
    "a26_coverage_folded",
    f"SELECT location_id, month, day_of_month, covered, photos, years, {GRADE_SQL} FROM folded",
    folded="""SELECT g.location_id, g.month, g.day_of_month, COALESCE(BOOL_OR(c.covered), FALSE) AS covered,
        CAST(COALESCE(SUM(c.photos), 0) AS BIGINT) AS photos, COUNT(DISTINCT YEAR(c.day)) AS years
        FROM (SELECT l.location_id, CAST(MONTH(d.day) AS INT) AS month, CAST(DAY(d.day) AS INT) AS day_of_month
            FROM (SELECT DISTINCT location_id FROM coverage) l
            CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(DATE '2000-01-01', DATE '2000-12-31', INTERVAL 1 DAY)) AS day) d) g
        LEFT JOIN coverage c ON c.location_id = g.location_id AND MONTH(c.day) = g.month AND DAY(c.day) = g.day_of_month GROUP BY 1, 2, 3""",
    **COVERED,
)
def coverage_folded(s):
    return A.coverage_folded(_coverage(s), good_photos=2)


@query(
    "a26_coverage_totals",
    """SELECT location_id, CAST(SUM(photos) AS BIGINT) AS total_photos, COUNT(*) FILTER (WHERE covered) AS active_camera_days,
    COUNT(*) FILTER (WHERE photos > 0) AS days_with_photos, MIN(day) AS first_day, MAX(day) AS last_day FROM coverage GROUP BY location_id""",
    **COVERED,
)
def coverage_totals(s):
    return A.coverage_totals(_coverage(s))


@query(
    "a27_batch_statistics",
    """SELECT 'status' AS metric, status AS name, COUNT(*)::DOUBLE AS value FROM upload_batches GROUP BY status
    UNION ALL SELECT 'orphaned_photos', '', (SELECT COUNT(*) FROM raw_photos)::DOUBLE
    UNION ALL (SELECT 'oldest_open_hours', id, (EPOCH_US(TIMESTAMP '2024-01-10') - EPOCH_US(created_at)) / 1e6 / 3600 FROM upload_batches
        WHERE status IN ('uploading', 'processing') ORDER BY created_at, id LIMIT 1)""",
)
def batch_statistics(s):
    loose = s.raw_photos.select("id", F.lit(None).cast("bigint").alias("observation_id"), F.lit("uploaded").alias("status"))
    return R.batch_statistics(loose, s.upload_batches, "2024-01-10")


@query(
    "a28_needs_recompute",
    """SELECT COUNT(*) AS current_count, (SELECT COUNT(*) FROM observations WHERE flagged) AS last_count,
    COUNT(*) <> (SELECT COUNT(*) FROM observations WHERE flagged) AS changed FROM observations WHERE status IN ('completed', 'archived')""",
)
def needs_recompute(s):
    log = s.observations.where("flagged").agg(F.count(F.lit(1)).alias("last_count"))
    return A.needs_recompute(s.observations, log.withColumn("source_name", F.lit("completed_observations")))


@query(
    "a29_deployment_photo_counts",
    """SELECT d.id, d.location_id, COUNT(p.id) AS photo_count FROM deployments d
    LEFT JOIN (SELECT p.id, o.location_id, CAST(p.captured_at AS DATE) AS day FROM photos p JOIN observations o ON o.id = p.observation_id) p
        ON p.location_id = d.location_id AND (d.start_date IS NULL OR p.day >= d.start_date) AND (d.end_date IS NULL OR p.day <= d.end_date)
    GROUP BY d.id, d.location_id""",
)
def deployment_photo_counts(s):
    return R.deployment_photo_counts(s.deployments, s.photos, s.observations)


@query("a30_deployments_per_location", "SELECT location_id, COUNT(*) AS deployment_count FROM deployments GROUP BY location_id")
def deployments_per_location(s):
    return R.deployments_per_location(s.deployments)
