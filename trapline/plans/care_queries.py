"""Named queries for deployment quality, service, archiving, cleanup, the gallery and the identification queue."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from trapline.operators import lifecycle as Y
from trapline.operators import predictions as P
from trapline.operators import quality as Q
from trapline.operators import reports as R
from trapline.operators import scope as S
from trapline.operators.scope import Viewer
from trapline.plans.filter_queries import MEMBER, MEMBER_SITES
from trapline.plans.registry import query
from trapline.plans.report_queries import LOCATION_STATS_SQL
from trapline.sources.starschema import QC_BOOLEAN_FLAGS

TODAY = date(2001, 8, 2)
NOW = "2001-08-02 12:00:00"


# --- quality --------------------------------------------------------------------------------------------------------------
FIRST_SQL = """SELECT li.location_id, i.code AS study_area_id, i.name AS study_area, i.ecoregion AS region FROM
    (SELECT location_id, MIN(institution_id) AS institution_id FROM location_institutions GROUP BY location_id) li
    LEFT JOIN institutions i ON i.id = li.institution_id"""
ASSESSED = {
    "first_institution": FIRST_SQL,
    "usable": """SELECT d.* EXCLUDE (n_days_working, qc_no_gps_coordinates, qc_data_not_usable), f.study_area_id, f.study_area, f.region,
        end_date - start_date AS n_days_working, l.id IS NULL AS qc_no_gps_coordinates,
        d.qc_data_not_usable OR l.id IS NULL OR d.qc_feeding_location OR d.qc_hardware_issue OR (d.qc_installation_incorrect AND d.qc_no_species_captured)
            OR (d.qc_placement_incorrect AND d.qc_no_species_captured) OR (d.qc_poor_placement AND d.qc_no_species_captured) AS qc_data_not_usable
        FROM deployments d LEFT JOIN locations l ON l.id = d.location_id LEFT JOIN first_institution f ON f.location_id = d.location_id""",
    "summed": """SELECT *, qc_data_not_usable OR qc_no_data_uploaded_by_pa OR qc_sd_issue OR qc_stolen OR qc_non_functional AS qc_summary,
        CASE study_season WHEN 'Winter' THEN n_days_working < 100 WHEN 'Summer' THEN n_days_working < 60 END AS qc_min_days_not_reached FROM usable""",
    "assessed": """SELECT *, CASE WHEN qc_summary THEN 'issue' WHEN study_season = 'Summer' THEN 'normal_summer' ELSE 'normal_winter' END AS status FROM summed""",
}
ASSESSED_COLUMNS = "id, location_id, status, n_days_working, qc_no_gps_coordinates, qc_data_not_usable, qc_summary, qc_min_days_not_reached"


def _assessed(s):
    return Q.assess(s.deployments, s.locations, Q.first_institutions(s.location_institutions, s.institutions))


@query("q1_assessed_deployments", f"SELECT {ASSESSED_COLUMNS.replace('n_days_working', 'CAST(n_days_working AS INT) AS n_days_working')} FROM assessed", **ASSESSED)
def assessed_deployments(s):
    return _assessed(s).select(*ASSESSED_COLUMNS.split(", "))


@query(
    "q2_quality_filter",
    "SELECT id FROM assessed WHERE study_season = 'Winter' AND region = 'lowland' AND (qc_stolen IS TRUE OR qc_min_days_not_reached IS TRUE)",
    **ASSESSED,
)
def quality_filter(s):
    chosen = {"study_season": "Winter", "region": "lowland"}
    return Q.quality_filter(_assessed(s), chosen, ["qc_stolen", "qc_min_days_not_reached"]).select("id")


@query(
    "q3_quality_kpis",
    """SELECT COUNT(*) AS total, CAST(ROUND(100 * COUNT(*) FILTER (WHERE qc_data_not_usable IS NOT TRUE) / COUNT(*)) AS BIGINT) AS usable_percent,
    COUNT(*) FILTER (WHERE qc_summary) AS issues, COUNT(*) FILTER (WHERE qc_min_days_not_reached) AS short_deployments,
    CAST(COALESCE(SUM(n_photos), 0) AS BIGINT) AS photos, CAST(ROUND(AVG(n_days_working)) AS BIGINT) AS mean_days FROM assessed""",
    **ASSESSED,
)
def quality_kpis(s):
    return Q.quality_kpis(_assessed(s))


ALL_FLAGS = list(dict.fromkeys([*QC_BOOLEAN_FLAGS, *Q.DERIVED_FLAGS]))


@query(
    "q4_flag_counts",
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, COUNT(*) FILTER (WHERE {f}) AS raised, COUNT(*) FILTER (WHERE NOT {f}) AS clear, COUNT(*) FILTER (WHERE {f} IS NULL) AS unknown FROM assessed"
        for f in ALL_FLAGS
    ),
    **ASSESSED,
)
def flag_counts(s):
    return Q.flag_counts(_assessed(s))


@query(
    "q5_status_counts",
    """SELECT 'status' AS kind, status AS value, COUNT(*) AS deployments FROM assessed GROUP BY status
    UNION ALL SELECT 'study_year', CAST(study_year AS STRING), COUNT(*) FROM assessed GROUP BY study_year""",
    **ASSESSED,
)
def status_counts(s):
    return Q.status_counts(_assessed(s))


@query(
    "q5_filter_options",
    """SELECT DISTINCT 'region' AS field, region AS value FROM assessed WHERE region IS NOT NULL
    UNION ALL SELECT DISTINCT 'study_area', study_area FROM assessed WHERE study_area IS NOT NULL
    UNION ALL SELECT DISTINCT 'study_year', CAST(study_year AS STRING) FROM assessed
    UNION ALL SELECT DISTINCT 'study_season', study_season FROM assessed WHERE study_season IS NOT NULL""",
    **ASSESSED,
)
def filter_options(s):
    return Q.filter_options(_assessed(s))


@query(
    "s5_deployment_export",
    """SELECT f.study_area_id, f.study_area AS "study_area_name_EN", f.region AS "region_name_EN", d.study_year, d.study_season, CAST(NULL AS STRING) AS study_design,
    d.camera_id, CAST(l.latitude AS DOUBLE) AS latitude, CAST(l.longitude AS DOUBLE) AS longitude, STRFTIME(d.start_date, '%Y-%m-%d') AS start_date,
    CAST(NULL AS STRING) AS start_time, STRFTIME(d.end_date, '%Y-%m-%d') AS end_date, CAST(NULL AS STRING) AS end_time, d.n_days_working, d.n_photos,
    CAST(NULL AS STRING) AS camera_model, CAST(NULL AS STRING) AS serial_number, d.name AS deployment_id, """
    + ", ".join(
        f'{f} AS "{ {"qc_no_data_uploaded_by_pa": "qc_no_data_uploaded_by_PA", "qc_no_gps_coordinates": "qc_no_GPS_coordinates"}.get(f, f)}"'
        for f in [*QC_BOOLEAN_FLAGS, "qc_local_datetime_issue"]
    )
    + """, CAST(NULL AS STRING) AS qc_comment FROM deployments d JOIN locations l ON l.id = d.location_id
    LEFT JOIN first_institution f ON f.location_id = d.location_id WHERE d.study_year = 1997
        AND d.location_id IN (SELECT location_id FROM location_institutions WHERE institution_id IN (1, 3))""",
    first_institution=FIRST_SQL,
)
def deployment_export(s):
    mine = S.member_locations(s.location_institutions, MEMBER.institution_ids)
    first = Q.first_institutions(s.location_institutions, s.institutions)
    return Q.export_deployments(s.deployments, s.locations, first, mine, 1997)


# --- service -----------------------------------------------------------------------------------------------------------------
@query(
    "q6_service_forecast",
    """SELECT location_id, name, CASE WHEN visit_datetime IS NULL THEN 'unknown' WHEN off THEN 'inactive' ELSE ['ok', 'warning', 'critical'][GREATEST(a, b) + 1] END AS status,
    CASE WHEN visit_datetime IS NULL THEN 'no visits' WHEN off THEN 'purpose' WHEN b > a THEN 'photos' ELSE 'days' END AS reason, visit_datetime,
    CAST(days AS INT) AS days_since_visit, CAST(predicted AS BIGINT) AS predicted_photos FROM (
        SELECT *, CASE WHEN days >= 300 THEN 2 WHEN days >= 180 THEN 1 ELSE 0 END AS a, CASE WHEN predicted >= 10000 THEN 2 WHEN predicted >= 5000 THEN 1 ELSE 0 END AS b
        FROM (SELECT l.id AS location_id, l.name, v.visit_datetime, v.visit_purpose_id IN (3, 4) AS off, DATE '2001-08-02' - CAST(v.visit_datetime AS DATE) AS days,
                CASE WHEN v.visit_purpose_id NOT IN (3, 4) AND t.avg_photos_per_day > 0 THEN FLOOR((DATE '2001-08-02' - CAST(v.visit_datetime AS DATE)) * t.avg_photos_per_day) END AS predicted
            FROM locations l LEFT JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY visit_datetime DESC, id DESC) AS k FROM service_visits) v
                ON v.location_id = l.id AND v.k = 1 LEFT JOIN stats t ON t.location_id = l.id) x) y""",
    stats=LOCATION_STATS_SQL,
)
def service_forecast(s):
    stats = R.location_stats(s.photos, s.observations, s.identifications, s.species)
    return Y.service_forecast(s.locations, s.service_visits, stats, TODAY)


@query(
    "q7_visit_history",
    """SELECT v.location_id, CAST(v.k AS INT) AS place, v.id, v.visit_datetime, p.name AS purpose, COALESCE(b.name, 'not replaced') AS battery,
    COALESCE(u.username, 'User ' || CAST(v.user_id AS STRING)) AS visitor, v.is_camera_operational
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY visit_datetime DESC, id DESC) AS k FROM service_visits) v
    LEFT JOIN visit_purposes p ON p.id = v.visit_purpose_id LEFT JOIN battery_types b ON b.id = v.battery_type_id LEFT JOIN users u ON u.id = v.user_id
    WHERE v.k <= 20""",
)
def visit_history(s):
    return Y.visit_history(s.service_visits, s.visit_purposes, s.battery_types, s.users)


# --- archiving ---------------------------------------------------------------------------------------------------------------
READY = """SELECT o.id AS observation_id, MAX(i.created_at) AS newest FROM observations o JOIN photos p ON p.observation_id = o.id
    JOIN identifications i ON i.photo_id = p.id WHERE o.status = 'completed'
        AND NOT EXISTS (SELECT 1 FROM photos q JOIN identifications j ON j.photo_id = q.id WHERE q.observation_id = o.id AND j.species_id = -2)
        AND EXISTS (SELECT 1 FROM photos q WHERE q.observation_id = o.id AND q.status = 'completed' AND NOT q.is_favorite)
    GROUP BY o.id HAVING MAX(i.created_at) < TIMESTAMP '2001-07-03 12:00:00'"""


def _ready(s):
    return Y.archivable_series(s.observations, s.photos, s.identifications, NOW, 30)


@query("q8_archivable_series", READY)
def archivable_series(s):
    return _ready(s)


ARCHIVED = """SELECT p.id, p.observation_id, p.is_favorite, CASE WHEN r.observation_id IS NOT NULL AND p.status = 'completed' AND NOT p.is_favorite THEN 'archived'
    ELSE p.status END AS status FROM photos p LEFT JOIN ready r ON r.observation_id = p.observation_id"""


@query("q9_archived_photos", "SELECT id, status FROM archived", ready=READY, archived=ARCHIVED)
def archived_photos(s):
    return Y.archive_photos(s.photos, _ready(s)).select("id", "status")


@query(
    "q9_archived_series",
    """SELECT o.id, CASE WHEN a.done THEN 'archived' ELSE o.status END AS status FROM observations o LEFT JOIN (
        SELECT observation_id, BOOL_AND(status = 'archived' OR is_favorite) AS done FROM archived
        WHERE observation_id IN (SELECT observation_id FROM ready) GROUP BY observation_id) a ON a.observation_id = o.id""",
    ready=READY,
    archived=ARCHIVED,
)
def archived_series(s):
    ready = _ready(s)
    return Y.archive_series(s.observations, Y.archive_photos(s.photos, ready), ready).select("id", "status")


# Two stored copies of most photos, and files of photos nobody knows.
FILES = """SELECT 'raw/' || system_filename AS path, system_filename AS name, id % 5000 + 100000 AS length, captured_at AS modificationTime FROM {photos} WHERE id % 7 <> 0
    UNION ALL SELECT 'thumbnails/' || system_filename AS path, system_filename AS name, id % 50 + 1000 AS length, captured_at AS modificationTime FROM {photos}
    UNION ALL SELECT 'raw/lost_' || CAST(id AS STRING) AS path, 'lost_' || CAST(id AS STRING) AS name, id % 900 AS length, captured_at AS modificationTime
        FROM {photos} WHERE is_favorite"""
FILES_SQL = FILES.replace("{", "").replace("}", "")


def _files(s):
    return s.spark.sql(FILES, photos=s.photos)


@query(
    "q10_archive_estimate",
    """SELECT COUNT(DISTINCT p.observation_id) AS observations_count, COUNT(*) AS photos_count, ROUND_EVEN(SUM(f.bytes) / (1024 * 1024), 1) AS estimated_size_mb
    FROM photos p JOIN ready r ON r.observation_id = p.observation_id LEFT JOIN (SELECT name, SUM(length) AS bytes FROM files GROUP BY name) f ON f.name = p.system_filename
    WHERE p.status = 'completed' AND NOT p.is_favorite""",
    ready=READY,
    files=FILES_SQL,
)
def archive_estimate(s):
    return Y.archive_estimate(s.photos, _ready(s), _files(s))


# --- cleanup -----------------------------------------------------------------------------------------------------------------
CLEAN_NOW = "2023-12-20 00:00:00"
EARLIER = "SELECT id, status, created_at, processed_files - CAST(CAST(id AS BIGINT) % 3 AS INT) % 2 AS processed_files FROM {upload_batches}"
RAW_PHOTOS = """SELECT id, upload_batch_id, 'cam_' || CAST(id AS STRING) || '.jpg' AS system_filename, 'uploaded' AS status, CAST(NULL AS BIGINT) AS observation_id,
    id % 6 = 0 AS is_favorite FROM (SELECT event_id AS id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS upload_batch_id FROM {events}) t"""
CLEAN = {
    "earlier": EARLIER.replace("{", "").replace("}", ""),
    "open_batches": "SELECT * FROM upload_batches WHERE status IN ('uploading', 'processing', 'ready_to_group', 'grouping')",
    "active": """SELECT b.id FROM open_batches b JOIN earlier e ON e.id = b.id WHERE b.processed_files <> e.processed_files
        UNION SELECT id FROM open_batches WHERE status IN ('ready_to_group', 'grouping') AND created_at > TIMESTAMP '2023-12-19 23:00:00'""",
    "stale": """SELECT * FROM upload_batches WHERE status IN ('uploading', 'processing', 'ready_to_group', 'grouping', 'failed')
        AND created_at <= TIMESTAMP '2023-12-18 00:00:00' AND id NOT IN (SELECT id FROM active)""",
    "raw_rows": RAW_PHOTOS.replace("{", "").replace("}", ""),
    "stranded": """SELECT p.* FROM raw_rows p LEFT JOIN upload_batches b ON b.id = p.upload_batch_id WHERE NOT p.is_favorite
        AND (p.upload_batch_id IS NULL OR b.status IN ('completed', 'failed') OR p.upload_batch_id IN (SELECT id FROM stale))
        AND (p.upload_batch_id IS NULL OR p.upload_batch_id NOT IN (SELECT id FROM active))""",
    "files": FILES_SQL,
    "orphans": """SELECT * FROM files WHERE modificationTime <= TIMESTAMP '2000-06-14 23:55:00' AND name NOT IN (SELECT system_filename FROM photos)""",
}


def _cleanup(s):
    before = s.spark.sql(EARLIER, upload_batches=s.upload_batches)
    active = Y.active_batches(before, s.upload_batches, CLEAN_NOW)
    stale = Y.stale_batches(s.upload_batches, active, CLEAN_NOW, hours=48)
    raw = s.spark.sql(RAW_PHOTOS, events=s.events)
    return active, stale, Y.stranded_photos(raw, s.upload_batches, stale, active)


@query("q11_stale_batches", "SELECT id, status FROM stale", **CLEAN)
def stale_batches(s):
    return _cleanup(s)[1].select("id", "status")


@query("q12_active_batches", "SELECT id FROM active", **CLEAN)
def active_batches(s):
    return _cleanup(s)[0]


@query("q13_stranded_photos", "SELECT id, system_filename, upload_batch_id FROM stranded", **CLEAN)
def stranded_photos(s):
    return _cleanup(s)[2].select("id", "system_filename", "upload_batch_id")


def _orphans(s):
    return Y.orphan_files(_files(s).withColumn("modificationTime", F.col("modificationTime").cast("timestamp")), s.photos, "2000-06-15")


@query("q14_orphan_files", "SELECT path, name, length FROM orphans", **CLEAN)
def orphan_files(s):
    return _orphans(s).select("path", "name", "length")


@query(
    "q15_cleanup_totals",
    """SELECT *, FROM (SELECT 'active_protected' AS metric, COUNT(*) AS value FROM active UNION ALL SELECT 'stale_batches', COUNT(*) FROM stale
    UNION ALL SELECT 'stranded_photos', COUNT(*) FROM stranded
    UNION ALL SELECT 'stranded_files', COUNT(*) FROM files WHERE name IN (SELECT system_filename FROM stranded)
    UNION ALL SELECT 'stranded_bytes', CAST(COALESCE(SUM(length), 0) AS BIGINT) FROM files WHERE name IN (SELECT system_filename FROM stranded)
    UNION ALL SELECT 'orphan_files', COUNT(*) FROM orphans UNION ALL SELECT 'orphan_bytes', CAST(COALESCE(SUM(length), 0) AS BIGINT) FROM orphans
    UNION ALL SELECT 'freed_bytes', CAST((SELECT COALESCE(SUM(length), 0) FROM orphans)
        + (SELECT COALESCE(SUM(length), 0) FROM files WHERE name IN (SELECT system_filename FROM stranded)) AS BIGINT)) t""",
    **CLEAN,
)
def cleanup_totals(s):
    active, stale, stranded = _cleanup(s)
    return Y.cleanup_totals(active, stale, stranded, _files(s), _orphans(s))


@query("q15_cleanup_sample", "SELECT id, system_filename, upload_batch_id FROM stranded ORDER BY id LIMIT 100", **CLEAN)
def cleanup_sample(s):
    return Y.sample(_cleanup(s)[2].select("id", "system_filename", "upload_batch_id"), "id")


@query(
    "q16_flagged_series",
    """SELECT o.id, COALESCE(l.name, '') AS location_name, o.series_start_time, o.flag_note,
    (SELECT system_filename FROM photos p WHERE p.observation_id = o.id ORDER BY p.captured_at, p.id LIMIT 1) AS thumb
    FROM observations o LEFT JOIN locations l ON l.id = o.location_id WHERE o.flagged""",
)
def flagged_series(s):
    return Y.flagged_series(s.observations, s.locations, s.photos)


GALLERY_SQL = """SELECT p.id AS photo_id, p.observation_id, w.species_id, COALESCE(s.common_name_ua, s.scientific_name) AS species_name, l.name AS location_name,
    p.system_filename, p.captured_at, {added} AS added_by FROM photos p JOIN observations o ON o.id = p.observation_id JOIN locations l ON l.id = o.location_id
    JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id ORDER BY vote_count DESC, COALESCE(max_quantity, 0) DESC, species_id) AS k
        FROM votes WHERE species_id IS NOT NULL) w ON w.observation_id = p.observation_id AND w.k = 1 JOIN species s ON s.id = w.species_id
    WHERE p.is_favorite AND p.status IN ('completed', 'pending', 'archived') AND l.id IN (SELECT id FROM {sites}) {more}"""


@query(
    "q17_gallery_member",
    GALLERY_SQL.format(added="CAST(NULL AS STRING)", sites="member_sites", more="AND w.species_id > 0"),
    member_sites=MEMBER_SITES,
)
def gallery_member(s):
    return Y.gallery(s.photos, s.observations, s.locations, s.location_institutions, s.identifications, s.species, s.users, MEMBER)


@query(
    "q17_gallery_manager",
    GALLERY_SQL.format(
        added="""(SELECT u.username FROM identifications i LEFT JOIN users u ON u.id = i.user_id WHERE i.photo_id = p.id ORDER BY i.created_at, i.id LIMIT 1)""",
        sites="locations",
        more="",
    ),
)
def gallery_manager(s):
    return Y.gallery(
        s.photos, s.observations, s.locations, s.location_institutions, s.identifications, s.species, s.users,
        Viewer(admin=True), manager=True,
    )


@query("q18_unfavoured_photos", "SELECT id, system_filename FROM photos WHERE NOT is_favorite")
def unfavoured_photos(s):
    return Y.unfavoured_photos(s.photos).select("id", "system_filename")


# --- identification queue -------------------------------------------------------------------------------------------------------
PEOPLE = "SELECT id, id = 0 AS is_admin FROM {users}"
MEMBERSHIPS = """SELECT id AS user_id, CAST(id % 5 AS INT) AS institution_id FROM {users} WHERE id <> 4
    UNION ALL SELECT id AS user_id, CAST((id + 2) % 5 AS INT) AS institution_id FROM {users} WHERE id = 2"""
REMAINING_SQL = """SELECT u.id AS user_id, COUNT(o.id) AS remaining_count, COUNT(v.observation_id) AS already_identified_count FROM people u
        LEFT JOIN (SELECT a.* FROM {pairs} a LEFT JOIN voted_pairs w ON w.observation_id = a.id AND w.user_id = a.user_id WHERE w.user_id IS NULL) o ON o.user_id = u.id
        LEFT JOIN (SELECT DISTINCT observation_id FROM voted_pairs) v ON v.observation_id = o.id GROUP BY u.id"""
REMAINING = {
    "people": PEOPLE.replace("{", "").replace("}", ""),
    "memberships": MEMBERSHIPS.replace("{", "").replace("}", ""),
    "open_pairs": """SELECT u.id AS user_id, o.id FROM people u CROSS JOIN observations o JOIN locations l ON l.id = o.location_id WHERE o.status = 'pending'
        AND (u.is_admin OR l.visibility_level = 0 OR EXISTS (SELECT 1 FROM memberships m JOIN location_institutions li ON li.institution_id = m.institution_id
            WHERE m.user_id = u.id AND li.location_id = l.id))""",
    "voted_pairs": "SELECT DISTINCT p.observation_id, i.user_id FROM identifications i JOIN photos p ON p.id = i.photo_id",
    "remaining": REMAINING_SQL.format(pairs="open_pairs"),
}


def _remaining(s):
    return Y.remaining_series(
        s.observations, s.photos, s.identifications, s.locations, s.location_institutions,
        s.spark.sql(PEOPLE, users=s.users), s.spark.sql(MEMBERSHIPS, users=s.users),
    )


@query("w1_remaining_series", "SELECT * FROM remaining", **REMAINING)
def remaining_series(s):
    return _remaining(s)


def _selected(condition: str) -> dict[str, str]:
    """SQL of the queue inside the institutions of a condition."""
    return {
        **REMAINING,
        "chosen_pairs": f"""SELECT u.id AS user_id, i.id AS institution_id FROM people u JOIN institutions i ON {condition}
            AND (u.is_admin OR EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = u.id AND m.institution_id = i.id))""",
        "chosen_sites": "SELECT DISTINCT c.user_id, li.location_id FROM chosen_pairs c JOIN location_institutions li ON li.institution_id = c.institution_id",
        "scoped_pairs": """SELECT a.user_id, a.id FROM open_pairs a JOIN observations o ON o.id = a.id
            LEFT JOIN chosen_sites c ON c.user_id = a.user_id AND c.location_id = o.location_id
            WHERE c.user_id IS NOT NULL OR a.user_id NOT IN (SELECT user_id FROM chosen_pairs)""",
    }


def _remaining_inside(s, condition: str):
    return Y.remaining_in_scope(
        s.observations, s.photos, s.identifications, s.locations, s.location_institutions,
        s.spark.sql(PEOPLE, users=s.users), s.spark.sql(MEMBERSHIPS, users=s.users),
        s.institutions.where(condition).select(F.col("id").alias("institution_id")),
    )


@query("w1_remaining_in_institution", REMAINING_SQL.format(pairs="scoped_pairs"), **_selected("i.id = 1"))
def remaining_in_institution(s):
    return _remaining_inside(s, "id = 1")


@query("w1_remaining_in_ecoregion", REMAINING_SQL.format(pairs="scoped_pairs"), **_selected("i.ecoregion = 'mountain'"))
def remaining_in_ecoregion(s):
    return _remaining_inside(s, "ecoregion = 'mountain'")


@query(
    "w1_reminders",
    """SELECT user_id, remaining_count, CASE WHEN remaining_count % 100 BETWEEN 11 AND 19 THEN 'серій' WHEN remaining_count % 10 = 1 THEN 'серія'
    WHEN remaining_count % 10 BETWEEN 2 AND 4 THEN 'серії' ELSE 'серій' END AS series_word FROM remaining WHERE remaining_count >= 10""",
    **REMAINING,
)
def reminders(s):
    return Y.reminders(_remaining(s)).select("user_id", "remaining_count", "series_word")


OFFERED = """SELECT o.id, o.series_start_time, COUNT(p.id) AS size FROM observations o LEFT JOIN photos p ON p.observation_id = o.id WHERE o.status = 'pending'
    AND o.id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id WHERE i.user_id = 3) GROUP BY 1, 2"""


def _offered(s):
    return Y.untouched_series(s.observations.where("status = 'pending'"), s.photos, s.identifications, 3)


@query(
    "w2_next_series",
    """SELECT * FROM (SELECT 'date_desc' AS sort, id FROM offered ORDER BY series_start_time DESC, id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'date_asc', id FROM offered ORDER BY series_start_time, id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'photo_count_desc', id FROM offered ORDER BY size DESC, id LIMIT 1)
    UNION ALL SELECT * FROM (SELECT 'photo_count_asc', id FROM offered ORDER BY size, id LIMIT 1)""",
    offered=OFFERED,
)
def next_series(s):
    result = None
    for sort in ("date_desc", "date_asc", "photo_count_desc", "photo_count_asc"):
        first = Y.next_series(Y.queue_order(_offered(s), s.photos, s.identifications, sort)).select(F.lit(sort).alias("sort"), "id")
        result = first if result is None else result.unionByName(first)
    return result


@query(
    "w2_priority_series",
    """SELECT v.votes, o.size FROM offered o JOIN (SELECT p.observation_id, COUNT(DISTINCT i.user_id) AS votes FROM identifications i
    JOIN photos p ON p.id = i.photo_id GROUP BY 1) v ON v.observation_id = o.id ORDER BY v.votes DESC, o.size DESC LIMIT 1""",
    offered=OFFERED,
)
def priority_series(s):
    return Y.next_series(Y.queue_order(_offered(s), s.photos, s.identifications)).select("votes", "size")


@query(
    "w3_review_series",
    """SELECT id FROM observations WHERE status IN ('pending', 'completed')
    AND id IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id WHERE i.user_id = 2)
    AND id IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id WHERE i.species_id = 5)""",
)
def review_series(s):
    return Y.review_series(s.observations, s.photos, s.identifications, user_id=2, species_id=5).select("id")


@query(
    "w4_earliest_votes",
    """SELECT t.observation_id, t.user_id, COALESCE(u.username, 'User ' || CAST(t.user_id AS STRING)) AS username,
    COALESCE(s.common_name_ua, s.scientific_name, 'Unknown') AS species_name, t.quantity, t.created_at FROM (
        SELECT p.observation_id, i.user_id, i.species_id, i.quantity, i.created_at, ROW_NUMBER() OVER (PARTITION BY p.observation_id, i.user_id ORDER BY p.captured_at, p.id) AS k
        FROM identifications i JOIN photos p ON p.id = i.photo_id) t LEFT JOIN users u ON u.id = t.user_id LEFT JOIN species s ON s.id = t.species_id WHERE t.k = 1""",
)
def earliest_votes(s):
    return Y.earliest_votes(s.identifications, s.photos, s.species, s.users)


# --- predictions -----------------------------------------------------------------------------------------------------------------
MODELS_SQL = """SELECT m.id AS model_id, COALESCE(v.accuracy_rank, 0) AS rank FROM ai_models m LEFT JOIN ai_model_levels v ON v.id = m.level_id"""
WON_SQL = """SELECT observation_id, species_id FROM (SELECT a.observation_id, a.prediction_species_id AS species_id, ROW_NUMBER() OVER (PARTITION BY a.observation_id
    ORDER BY g.rank DESC, a.model_id DESC, a.id) AS k FROM ai_predictions a JOIN graded g ON g.model_id = a.model_id) t WHERE k = 1"""


def _models(s):
    return P.ranked_models(s.ai_models, s.ai_model_levels)


@query(
    "p1_pending_by_species",
    """SELECT s.id, COUNT(*) AS pending_count, COALESCE(s.common_name_ua, s.common_name_en, s.scientific_name)
        || CASE WHEN s.id > 0 THEN ' (' || s.scientific_name || ')' ELSE '' END || ' (' || CAST(COUNT(*) AS STRING) || ')' AS label
    FROM won w JOIN species s ON s.id = w.species_id JOIN observations o ON o.id = w.observation_id WHERE o.status = 'pending'
        AND o.location_id IN (SELECT id FROM member_sites)
        AND o.id NOT IN (SELECT p.observation_id FROM photos p JOIN identifications i ON i.photo_id = p.id WHERE i.user_id = 3)
    GROUP BY s.id, s.common_name_ua, s.common_name_en, s.scientific_name""",
    graded=MODELS_SQL,
    won=WON_SQL,
    member_sites=MEMBER_SITES,
)
def pending_by_species(s):
    visible = S.accessible(s.observations, s.locations, s.location_institutions, MEMBER)
    return P.pending_by_species(s.ai_predictions, _models(s), visible, s.species, s.photos, s.identifications, user_id=3)


@query(
    "p2_best_predictions",
    """SELECT t.observation_id, t.species_id, COALESCE(s.common_name_ua, s.common_name_en, s.scientific_name, t.base_label) AS species_label, t.score,
    COALESCE(t.most, t.animal_count) AS animal_count FROM (
        SELECT a.observation_id, a.prediction_species_id AS species_id, a.base_label, a.prediction_score AS score, a.animal_count,
            MAX(a.animal_count) OVER (PARTITION BY a.observation_id, a.model_id) AS most,
            ROW_NUMBER() OVER (PARTITION BY a.observation_id ORDER BY g.rank DESC, a.prediction_score DESC NULLS LAST, a.id) AS k
        FROM ai_predictions a JOIN graded g ON g.model_id = a.model_id) t LEFT JOIN species s ON s.id = t.species_id WHERE t.k = 1""",
    graded=MODELS_SQL,
)
def best_predictions(s):
    return P.best_predictions(s.ai_predictions, _models(s), s.species)


@query("p3_series_predicted_as", "SELECT observation_id FROM won WHERE species_id = 4", graded=MODELS_SQL, won=WON_SQL)
def series_predicted_as(s):
    return P.series_predicted_as(s.ai_predictions, _models(s), 4)


@query(
    "w1_remaining_predicted",
    REMAINING_SQL.format(pairs="predicted_pairs"),
    predicted_pairs="SELECT * FROM open_pairs WHERE id IN (SELECT observation_id FROM won WHERE species_id = 4)",
    graded=MODELS_SQL,
    won=WON_SQL,
    **REMAINING,
)
def remaining_predicted(s):
    chosen = P.series_predicted_as(s.ai_predictions, _models(s), 4).select(F.col("observation_id").alias("id"))
    return Y.remaining_series(
        s.observations.join(chosen, "id", "left_semi"), s.photos, s.identifications, s.locations, s.location_institutions,
        s.spark.sql(PEOPLE, users=s.users), s.spark.sql(MEMBERSHIPS, users=s.users),
    )


@query(
    "p4_backlog",
    """SELECT (SELECT COUNT(DISTINCT observation_id) FROM ai_predictions WHERE model_id = 2) AS classified, COUNT(*) AS remaining FROM observations o
    WHERE o.status = 'pending' AND o.id NOT IN (SELECT observation_id FROM ai_predictions WHERE model_id = 2)
        AND NOT EXISTS (SELECT 1 FROM ai_predictions a JOIN graded g ON g.model_id = a.model_id
            WHERE a.observation_id = o.id AND g.rank >= (SELECT rank FROM graded WHERE model_id = 2))
        AND EXISTS (SELECT 1 FROM photos p WHERE p.observation_id = o.id AND p.status IN ('grouped', 'pending', 'completed'))""",
    graded=MODELS_SQL,
)
def backlog(s):
    return P.backlog(s.ai_predictions, _models(s), s.observations, s.photos, 2)


@query("p5_import_levels", "SELECT id, code FROM ai_model_levels WHERE id NOT IN (SELECT level_id FROM ai_models WHERE is_active AND level_id IS NOT NULL)")
def import_levels(s):
    return P.import_levels(s.ai_model_levels, s.ai_models).select("id", "code")


@query(
    "t17_calibration",
    """SELECT a.prediction_species_id AS species_id, s.scientific_name, COUNT(*) AS total, COUNT(*) FILTER (WHERE a.was_correct) AS correct,
    ROUND_EVEN(COUNT(*) FILTER (WHERE a.was_correct) / COUNT(*) * 100, 1) AS accuracy,
    ROUND_EVEN(AVG(a.prediction_score) FILTER (WHERE a.was_correct), 3) AS mean_score_correct,
    ROUND_EVEN(AVG(a.prediction_score) FILTER (WHERE NOT a.was_correct), 3) AS mean_score_wrong
    FROM ai_predictions a JOIN species s ON s.id = a.prediction_species_id WHERE a.was_correct IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) >= 50""",
)
def calibration(s):
    return P.calibration(s.ai_predictions, s.species, least=50)
