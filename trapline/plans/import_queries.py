"""Named queries for classifier files, verified files, deployment sheets and landcover."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import imports as I
from trapline.plans.registry import query
from trapline.session import cut_lineage, shared_folder
from trapline.sources import detections as N
from trapline.sources import sheets as H
from trapline.sources import tables as W


def bare(text: str) -> str:
    return text.replace("{", "").replace("}", "")


# Text rows as a classifier would write them for the photos of every site: paths of two kinds, blank names, unreadable
# times, mixed-case labels, missing and unreadable scores, a repeated row for some photos and rows of unknown files.
RAW = """SELECT o.location_id, p.id AS line_no,
        CASE WHEN p.id % 13 = 0 THEN '  ' WHEN p.id % 3 = 0 THEN 'D:' || CHR(92) || 'cards' || CHR(92) || p.original_filename
             WHEN p.id % 3 = 1 THEN '/cards/' || LOWER(p.original_filename) ELSE p.original_filename END AS filename,
        CASE WHEN p.id % 17 = 0 THEN '31.12.1999' ELSE ' ' || REPLACE(SUBSTR(CAST(p.captured_at AS STRING), 1, 19), '-', ':') END AS date,
        CASE p.id % 7 WHEN 0 THEN 'Empty' WHEN 1 THEN ' HUMAN ' WHEN 2 THEN 'vehicle' WHEN 3 THEN '' ELSE 'Label' || CAST(p.id % 12 AS STRING) END AS predictionbase,
        CASE WHEN p.id % 19 = 0 THEN 'n/a' WHEN p.id % 5 = 0 THEN '' ELSE '0.' || CAST(p.id % 90 + 10 AS STRING) END AS scorebase,
        'Label' || CAST(p.id % 5 AS STRING) AS top1, CASE WHEN p.id % 4 = 0 THEN '' ELSE CAST(p.id % 4 AS STRING) || '.0' END AS count, 'x' AS humancount
    FROM {photos} p JOIN {observations} o ON o.id = p.observation_id
    UNION ALL SELECT o.location_id, p.id + 10000000000 AS line_no, p.original_filename AS filename,
        REPLACE(SUBSTR(CAST(p.captured_at AS STRING), 1, 19), '-', ':') AS date, 'label7' AS predictionbase, '0.' || CAST(p.id % 80 + 15 AS STRING) AS scorebase,
        CAST(NULL AS STRING) AS top1, '2' AS count, '1' AS humancount
    FROM {photos} p JOIN {observations} o ON o.id = p.observation_id WHERE p.id % 21 = 0
    UNION ALL SELECT o.location_id, p.id + 20000000000 AS line_no, 'lost.JPG' AS filename,
        REPLACE(SUBSTR(CAST(p.captured_at AS STRING), 1, 19), '-', ':') AS date, 'label8' AS predictionbase, '0.5' AS scorebase,
        CAST(NULL AS STRING) AS top1, CAST(NULL AS STRING) AS count, CAST(NULL AS STRING) AS humancount
    FROM {photos} p JOIN {observations} o ON o.id = p.observation_id WHERE p.id % 31 = 0"""
PARSED = """SELECT location_id, line_no, REGEXP_EXTRACT(REPLACE(TRIM(filename), CHR(92), '/'), '[^/]*$') AS original_filename,
    TRY_STRPTIME(TRIM(date), '%Y:%m:%d %H:%M:%S') AS captured_at, NULLIF(LOWER(TRIM(predictionbase)), '') AS base_label,
    TRY_CAST(NULLIF(TRIM(scorebase), '') AS DOUBLE) AS base_score, NULLIF(LOWER(TRIM(top1)), '') AS top1_label,
    CAST(TRUNC(TRY_CAST(NULLIF(TRIM(count), '') AS DOUBLE)) AS INT) AS animal_count, CAST(TRUNC(TRY_CAST(NULLIF(TRIM(humancount), '') AS DOUBLE)) AS INT) AS human_count
    FROM raw_rows WHERE TRIM(filename) <> '' AND TRY_STRPTIME(TRIM(date), '%Y:%m:%d %H:%M:%S') IS NOT NULL"""
INDEX = """SELECT o.location_id, LOWER(TRIM(p.original_filename)) AS file_key, DATE_TRUNC('second', p.captured_at) AS second, MAX(p.id) AS photo_id,
    ARG_MAX(p.observation_id, p.id) AS observation_id FROM photos p JOIN observations o ON o.id = p.observation_id GROUP BY 1, 2, 3"""
FILE = {
    "raw_rows": bare(RAW),
    "parsed": PARSED,
    "known_files": INDEX,
    "matched_rows": """SELECT r.*, k.photo_id, k.observation_id FROM parsed r JOIN known_files k ON k.location_id = r.location_id
        AND k.file_key = LOWER(TRIM(r.original_filename)) AND k.second = DATE_TRUNC('second', r.captured_at)""",
    "last_rows": """SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY photo_id ORDER BY line_no DESC) AS k FROM matched_rows) t WHERE k = 1""",
    "labelled": """SELECT photo_id, observation_id, base_label, base_score FROM last_rows""",
}


def _raw(s):
    return s.spark.sql(RAW, photos=s.photos, observations=s.observations)


def _matched(s):
    return I.match_detections(N.parse_detections(_raw(s)), I.photo_index(s.photos, s.observations))


@query("s2_parsed_detections", "SELECT * FROM parsed", **FILE)
def parsed_detections(s):
    return N.parse_detections(_raw(s))


def _written(s, rows, name: str) -> str:
    """Rows as text files with a header, blanks kept."""
    path = W.fresh_folder(shared_folder(s.spark), name)
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "quoteAll": True, "escape": '"'}
    rows.write.options(header=True, **kept).csv(path)
    return path


@query("s2_file_detections", "SELECT * EXCLUDE (location_id, line_no) FROM parsed", **FILE)
def file_detections(s):
    path = _written(s, _raw(s).drop("location_id", "line_no"), "detections")
    return N.parse_detections(N.read_raw_detections(s.spark, path)).drop("file", "line_no")


@query(
    "s2_rejected_detections",
    """SELECT location_id, line_no, TRIM(date) AS bad_date FROM raw_rows WHERE TRIM(filename) <> ''
    AND TRY_STRPTIME(TRIM(date), '%Y:%m:%d %H:%M:%S') IS NULL""",
    **FILE,
)
def rejected_detections(s):
    return N.rejected_detections(_raw(s))


@query(
    "m1_matched_rows",
    "SELECT photo_id, observation_id, base_label, base_score, top1_label, animal_count, human_count FROM last_rows",
    **FILE,
)
def matched_rows(s):
    return I.last_per_photo(_matched(s))


@query(
    "m1_match_preview",
    """SELECT k.location_id, CAST(SUM(n) AS BIGINT) AS csv_rows, COUNT(*) FILTER (WHERE known) AS location_photos,
    COUNT(*) FILTER (WHERE known AND n > 0) AS matched, CAST(SUM(CASE WHEN NOT known THEN n ELSE 0 END) AS BIGINT) AS csv_unmatched,
    CAST(SUM(CASE WHEN known AND n > 0 THEN n - 1 ELSE 0 END) AS BIGINT) AS csv_duplicate_keys, COUNT(*) FILTER (WHERE known AND n = 0) AS db_without_prediction,
    COUNT(*) FILTER (WHERE known AND YEAR(second) = 1900) AS location_placeholder_photos
    FROM (SELECT COALESCE(f.location_id, r.location_id) AS location_id, COALESCE(f.second, r.second) AS second, f.photo_id IS NOT NULL AS known, COALESCE(r.n, 0) AS n
        FROM known_files f FULL JOIN (SELECT location_id, LOWER(TRIM(original_filename)) AS file_key, DATE_TRUNC('second', captured_at) AS second, COUNT(*) AS n
            FROM parsed GROUP BY 1, 2, 3) r ON r.location_id = f.location_id AND r.file_key = f.file_key AND r.second = f.second) k GROUP BY k.location_id""",
    **FILE,
)
def match_preview(s):
    return I.match_preview(N.parse_detections(_raw(s)), I.photo_index(s.photos, s.observations))


MERGED = {
    **FILE,
    "stored": """SELECT photo_id, CAST(model_id AS INT) AS model_id, observation_id, base_label, base_score, CAST(NULL AS STRING) AS top1_label, animal_count,
        CAST(NULL AS INT) AS human_count FROM ai_predictions""",
    "merged": """SELECT COALESCE(a.photo_id, b.photo_id) AS photo_id, COALESCE(a.model_id, 2) AS model_id,
        CASE WHEN c THEN b.observation_id ELSE a.observation_id END AS observation_id, CASE WHEN c THEN b.base_label ELSE a.base_label END AS base_label,
        CASE WHEN c THEN b.base_score ELSE a.base_score END AS base_score, CASE WHEN c THEN b.top1_label ELSE a.top1_label END AS top1_label,
        CASE WHEN c THEN b.animal_count ELSE a.animal_count END AS animal_count, CASE WHEN c THEN b.human_count ELSE a.human_count END AS human_count,
        CASE WHEN a.photo_id IS NULL THEN 'added' WHEN b.photo_id IS NULL THEN 'kept' WHEN c THEN 'updated' ELSE 'skipped' END AS change
        FROM (SELECT x.*, y.photo_id AS new_id, x.photo_id IS NULL OR (y.photo_id IS NOT NULL AND (x.base_score IS NULL OR COALESCE(y.base_score > x.base_score, FALSE))) AS c,
                COALESCE(x.photo_id, y.photo_id) AS any_id FROM stored x FULL JOIN last_rows y ON y.photo_id = x.photo_id AND x.model_id = 2) a
        LEFT JOIN last_rows b ON b.photo_id = a.new_id""",
}


def _merged(s):
    unknown = {"top1_label": F.lit(None).cast("string"), "human_count": F.lit(None).cast("int")}
    stored = s.ai_predictions.withColumns(unknown).withColumn("model_id", F.col("model_id").cast("int"))
    incoming = I.last_per_photo(_matched(s)).withColumn("model_id", F.lit(2))
    return I.upsert_predictions(stored, incoming)


MERGED_COLUMNS = "photo_id, model_id, observation_id, base_label, base_score, top1_label, animal_count, human_count, change"


@query("m2_merged_predictions", f"SELECT {MERGED_COLUMNS} FROM merged", **MERGED)
def merged_predictions(s):
    return _merged(s)


@query("m2_change_counts", "SELECT change, COUNT(*) AS rows FROM merged WHERE change <> 'kept' GROUP BY change", **MERGED)
def change_counts(s):
    return I.change_counts(_merged(s))


LABELS = {
    **MERGED,
    "best_label": """SELECT observation_id, model_id, ARG_MIN(base_label, (-COALESCE(base_score, 0), base_label)) FILTER (WHERE base_label NOT IN ('empty', 'human', 'vehicle')) AS animal,
        MAX(COALESCE(base_score, 0)) FILTER (WHERE base_label NOT IN ('empty', 'human', 'vehicle')) AS animal_score,
        BOOL_OR(COALESCE(base_label = 'human', FALSE)) AS human, MAX(base_score) FILTER (WHERE base_label = 'human') AS human_score,
        BOOL_OR(COALESCE(base_label = 'vehicle', FALSE)) AS vehicle FROM merged GROUP BY 1, 2""",
    "series_label": """SELECT t.*, m.species_id AS prediction_species_id FROM (SELECT observation_id, model_id,
        CASE WHEN animal IS NOT NULL THEN animal WHEN human THEN 'human' WHEN vehicle THEN 'vehicle' ELSE 'empty' END AS prediction_label,
        CASE WHEN animal IS NOT NULL THEN animal_score WHEN human THEN COALESCE(human_score, 1.0) ELSE 1.0 END AS prediction_score FROM best_label) t
        LEFT JOIN ai_label_map m ON m.label = t.prediction_label""",
}


@query(
    "m3_series_labels",
    "SELECT observation_id, model_id, prediction_label, prediction_score, prediction_species_id FROM series_label",
    **LABELS,
)
def series_labels(s):
    return I.series_labels(_merged(s), s.ai_label_map)


@query(
    "m3_labelled_predictions",
    """SELECT m.photo_id, m.model_id, l.prediction_label, l.prediction_score, l.prediction_species_id FROM merged m
    LEFT JOIN series_label l ON l.observation_id = m.observation_id AND l.model_id = m.model_id""",
    **LABELS,
)
def labelled_predictions(s):
    merged = _merged(s)
    rows = I.write_series_labels(merged, I.series_labels(merged, s.ai_label_map))
    return rows.select("photo_id", "model_id", "prediction_label", "prediction_score", "prediction_species_id")


VERIFIED = {
    **FILE,
    "counted": """SELECT r.observation_id, m.species_id, COUNT(*) AS n, SUM(COALESCE(r.base_score, 0)) AS score FROM matched_rows r
        JOIN observations o ON o.id = r.observation_id LEFT JOIN ai_label_map m ON m.label = r.base_label
        WHERE o.status NOT IN ('completed', 'archived') GROUP BY 1, 2""",
    "modal": """SELECT c.observation_id, c.species_id, COALESCE(t.ties > 1, FALSE) AS ambiguous FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id ORDER BY species_id IS NULL, n DESC, species_id <= 0, ROUND(score, 9) DESC, species_id) AS k FROM counted) c
        LEFT JOIN (SELECT observation_id, COUNT(*) AS ties FROM (SELECT *, MAX(n) OVER (PARTITION BY observation_id) AS top FROM counted WHERE species_id IS NOT NULL) a
            WHERE n = top GROUP BY 1) t ON t.observation_id = c.observation_id WHERE c.k = 1""",
    "imported": """SELECT p.id AS photo_id, p.observation_id, CAST(3 AS BIGINT) AS user_id, m.species_id, i.quantity,
        CASE WHEN i.id IS NULL THEN 'added' WHEN i.species_id IS NOT DISTINCT FROM m.species_id THEN 'same' ELSE 'updated' END AS change
        FROM photos p JOIN modal m ON m.observation_id = p.observation_id AND m.species_id IS NOT NULL LEFT JOIN identifications i ON i.photo_id = p.id AND i.user_id = 3""",
    "new_votes": """SELECT photo_id, user_id, species_id FROM imported
        UNION ALL SELECT i.photo_id, i.user_id, i.species_id FROM identifications i WHERE NOT EXISTS (SELECT 1 FROM imported m WHERE m.photo_id = i.photo_id AND m.user_id = i.user_id)""",
}


def _modal(s):
    return I.modal_species(_matched(s), s.ai_label_map, s.observations)


@query("m4_modal_species", "SELECT * FROM modal", **VERIFIED)
def modal_species(s):
    return _modal(s)


@query(
    "m4_verification_preview",
    """SELECT 'matched_photos' AS metric, COUNT(*) AS value FROM matched_rows
    UNION ALL SELECT 'matched_photos_pending', COUNT(*) FROM matched_rows r JOIN observations o ON o.id = r.observation_id WHERE o.status = 'pending'
    UNION ALL SELECT 'pending_series', COUNT(DISTINCT o.id) FROM matched_rows r JOIN observations o ON o.id = r.observation_id WHERE o.status = 'pending'
    UNION ALL SELECT 'skipped_consensus_series', COUNT(DISTINCT o.id) FROM matched_rows r JOIN observations o ON o.id = r.observation_id WHERE o.status <> 'pending'
    UNION ALL SELECT 'ambiguous_series', COUNT(*) FROM modal WHERE ambiguous
    UNION ALL SELECT 'no_species_series', COUNT(*) FROM modal WHERE species_id IS NULL""",
    **VERIFIED,
)
def verification_preview(s):
    matched = _matched(s)
    return I.verification_preview(matched, I.modal_species(matched, s.ai_label_map, s.observations), s.observations)


@query("m4_imported_votes", "SELECT * FROM imported", **VERIFIED)
def imported_votes(s):
    return I.import_verified(s.identifications, s.photos, _modal(s), 3)


@query(
    "m4_verified_decisions",
    """SELECT t.observation_id, t.species_id AS winner_species_id, t.n AS winner_votes, t.total_votes FROM (
        SELECT observation_id, species_id, n, CAST(SUM(n) OVER (PARTITION BY observation_id) AS BIGINT) AS total_votes FROM (
            SELECT observation_id, species_id, COUNT(*) AS n FROM (SELECT DISTINCT p.observation_id, v.user_id, v.species_id FROM new_votes v JOIN photos p ON p.id = v.photo_id
                WHERE p.observation_id IN (SELECT observation_id FROM imported)) d GROUP BY 1, 2) c) t WHERE t.total_votes >= 3 AND t.n * 2 > t.total_votes""",
    **VERIFIED,
)
def verified_decisions(s):
    return I.verified_decisions(
        s.observations, s.identifications, s.photos, I.import_verified(s.identifications, s.photos, _modal(s), 3)
    )


# --- deployment sheets ------------------------------------------------------------------------------------------------------------
WORDS = "CASE c_custkey % {m} WHEN 0 THEN 'Так' WHEN 1 THEN 'no' WHEN 2 THEN ' X ' WHEN 3 THEN 'maybe' WHEN 4 THEN '0.0' END"
SHEET_A = f"""SELECT c_custkey AS row_no, CASE WHEN c_custkey % 41 = 0 THEN '  ' WHEN c_custkey % 10 = 7 THEN 'NATION_' || CAST(c_custkey % 25 AS STRING)
        WHEN c_custkey % 3 = 0 THEN 'NEW-' || CAST(c_custkey AS STRING) ELSE 'DEP-' || CAST(c_custkey AS STRING) END AS dep,
    CASE WHEN c_custkey % 6 = 0 THEN '2023-2024' WHEN c_custkey % 6 = 1 THEN 'soon' ELSE CAST(2000 + c_custkey % 20 AS STRING) END AS yr,
    CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey % 1000 AS STRING) || '.0' WHEN c_custkey % 4 = 1 THEN 'CAM-' || CAST(c_custkey AS STRING) ELSE CAST(c_custkey AS STRING) END AS cam,
    CASE WHEN c_custkey % 8 = 0 THEN 'tomorrow' ELSE SUBSTR(CAST(DATE '1999-01-01' + INTERVAL '1' DAY * CAST(c_custkey % 700 AS INT) AS STRING), 1, 10) END AS beg,
    {WORDS.format(m=6)} AS usable, {WORDS.format(m=7)} AS stolen, CASE WHEN c_custkey % 9 = 0 THEN 'many' WHEN c_custkey % 9 = 1 THEN '1,250' ELSE CAST(c_custkey % 400 AS STRING) END AS pics,
    CASE WHEN c_custkey % 43 = 0 THEN 'unreadable' WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(CAST(44 + c_custkey % 30 * 0.25 AS DECIMAL(10,2)) AS STRING) END AS lat,
    CASE WHEN c_custkey % 11 = 5 THEN '' ELSE CAST(CAST(22 + c_custkey % 30 * 0.5 AS DECIMAL(10,2)) AS STRING) END AS lon,
    CASE WHEN c_custkey % 5 = 0 THEN 'Africa ' WHEN c_custkey % 5 = 1 THEN 'ASIA' WHEN c_custkey % 5 = 2 THEN 'Nowhere' END AS park, CASE WHEN c_custkey % 3 = 1 THEN ' note ' END AS note,
    CASE WHEN c_custkey % 7 = 0 THEN '9:05' WHEN c_custkey % 7 = 1 THEN 'noon' END AS tm FROM {{customer}}"""
SHEET_B = f"""SELECT c_custkey AS row_no, CASE WHEN c_custkey % 2 = 0 THEN 'DEP-' ELSE 'NEW-' END || CAST(c_custkey % 1000 AS STRING) AS dep,
    CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(2010 + c_custkey % 10 AS STRING) END AS yr, {WORDS.format(m=5)} AS stolen, {WORDS.format(m=9)} AS damaged,
    CAST(CAST(44 + c_custkey % 26 * 0.25 AS DECIMAL(10,2)) AS STRING) AS lat, CAST(CAST(22 + c_custkey % 26 * 0.5 AS DECIMAL(10,2)) AS STRING) AS lon,
    CASE WHEN c_custkey % 4 = 0 THEN 'second' END AS note, CASE WHEN c_custkey % 4 <= 1 THEN 'third' END AS more, 'x' AS mystery FROM {{customer}}"""
HEADERS_A = (
    "row_no", "Deployment_ID", " Study_Year", "CAMERA_ID", "start_date", "Data_Usable", "qc_stolen", "n_photos", "latitude", "Longitude",
    "study_area_name_EN", "Comment", "start_time",
)
HEADERS_B = (
    "row_no", "deployment_id", "study_year", "qc_camera_stolen", "qc_SD_ damaged", "latitude", "longitude", "comment", "problem_comment", "mystery",
)
YES, NO = "('1', '1.0', 'true', 'yes', 'y', 'x', 'так', '+', 'так.')", "('0', '0.0', 'false', 'no', 'n', 'ні', '-', 'none')"


def _flag(column: str) -> str:
    return f"CASE WHEN LOWER(TRIM({column})) IN {YES} THEN TRUE WHEN LOWER(TRIM({column})) IN {NO} THEN FALSE END"


SITES = """SELECT id, name, latitude, longitude FROM {locations}
    UNION ALL SELECT id + 100 AS id, name || ' B' AS name, latitude, longitude FROM {locations} WHERE id % 9 = 4"""
SHEETS = {
    "sheet_a": bare(SHEET_A),
    "sheet_b": bare(SHEET_B),
    "sites": bare(SITES),
    "sheet_rows": f"""SELECT 0 AS sheet_no, row_no, NULLIF(TRIM(dep), '') AS name, CAST(NULLIF(REGEXP_EXTRACT(yr, '[0-9]{{4}}'), '') AS INT) AS study_year,
        SUBSTR(CASE WHEN REGEXP_FULL_MATCH(c, '[0-9]{{1,3}}') THEN LPAD(c, 4, '0') ELSE c END, 1, 10) AS camera_id, TRY_CAST(beg AS DATE) AS start_date, NOT {_flag("usable")} AS qc_data_not_usable,
        {_flag("stolen")} AS qc_stolen, CAST(NULL AS BOOLEAN) AS qc_sd_issue, TRY_CAST(REPLACE(pics, ',', '') AS INT) AS n_photos, NULLIF(lat, '') AS lat, NULLIF(lon, '') AS lon,
        NULLIF(TRIM(park), '') AS park, TRIM(note) AS qc_comment, CASE WHEN tm = '9:05' THEN '09:05:00' END AS start_time FROM (SELECT *, REGEXP_REPLACE(cam, '^([0-9]+)[.]0$', '\\1') AS c FROM sheet_a) a
        UNION ALL SELECT 1, row_no, dep, CAST(yr AS INT), NULL, NULL, NULL, {_flag("stolen")}, {_flag("damaged")}, NULL, lat, lon, NULL, NULLIF(CONCAT_WS('; ', note, more), ''), NULL FROM sheet_b""",
    "by_name": "SELECT name, MAX(id) AS named FROM sites GROUP BY name",
    "by_point": "SELECT latitude, longitude, MIN(id) AS site_at, COUNT(*) AS n FROM sites GROUP BY 1, 2",
    "placed_rows": """SELECT r.*, b.named, p.site_at, p.n, TRY_CAST(r.lat AS DOUBLE) IS NOT NULL AND TRY_CAST(r.lon AS DOUBLE) IS NOT NULL AS finite,
        r.lat IS NOT NULL AND r.lon IS NOT NULL AND (TRY_CAST(r.lat AS DOUBLE) IS NULL OR TRY_CAST(r.lon AS DOUBLE) IS NULL) AS unreadable
        FROM sheet_rows r LEFT JOIN by_name b ON b.name = r.name LEFT JOIN by_point p ON p.latitude = TRY_CAST(r.lat AS DECIMAL(10,5)) AND p.longitude = TRY_CAST(r.lon AS DECIMAL(10,5))""",
    "resolved": """SELECT *, CASE WHEN unreadable THEN 'bad_coordinates' WHEN named IS NULL AND finite AND n > 1 THEN 'ambiguous_location'
        WHEN named IS NULL AND finite AND site_at IS NULL THEN 'no_location' WHEN name IS NULL THEN 'no_name' ELSE 'accepted' END AS outcome,
        COALESCE(named, CASE WHEN finite THEN site_at END) AS location_id FROM placed_rows""",
}


def _sheets(s):
    first = s.spark.sql(SHEET_A, customer=s.customer).toDF(*HEADERS_A).withColumn("sheet", F.lit("A"))
    second = s.spark.sql(SHEET_B, customer=s.customer).toDF(*HEADERS_B).withColumn("sheet", F.lit("B"))
    rows = [H.parse_sheet(sheet).withColumn("sheet_no", F.lit(n)) for n, sheet in enumerate((first, second))]
    return rows[0].unionByName(rows[1])


def _sites(s):
    return s.spark.sql(SITES, locations=s.locations)


@query(
    "s3_sheet_rows",
    """SELECT sheet_no, row_no, name, study_year, camera_id, start_date, qc_data_not_usable, qc_stolen, qc_sd_issue, n_photos, qc_comment, start_time, park FROM sheet_rows""",
    **SHEETS,
)
def sheet_rows(s):
    return _sheets(s).select(
        "sheet_no", "row_no", "name", "study_year", "camera_id", "start_date", "qc_data_not_usable", "qc_stolen", "qc_sd_issue", "n_photos",
        "qc_comment", "start_time", "park",
    )


@query(
    "s3_file_sheet_rows",
    "SELECT sheet_no, name, study_year, camera_id, start_date, qc_data_not_usable, qc_stolen, qc_sd_issue, n_photos, qc_comment, start_time, park FROM sheet_rows",
    **SHEETS,
)
def file_sheet_rows(s):
    sheets = {"A": s.spark.sql(SHEET_A, customer=s.customer).toDF(*HEADERS_A), "B": s.spark.sql(SHEET_B, customer=s.customer).toDF(*HEADERS_B)}
    paths = {name: _written(s, sheet.drop("row_no"), f"sheet-{name}") for name, sheet in sheets.items()}
    return H.read_sheets(s.spark, paths).select(
        "sheet_no", "name", "study_year", "camera_id", "start_date", "qc_data_not_usable", "qc_stolen", "qc_sd_issue", "n_photos",
        "qc_comment", "start_time", "park",
    )


@query(
    "m5_sheet_warnings",
    f"""SELECT 'A' AS sheet, row_no, 'study_year' AS field, yr AS raw_value FROM sheet_a WHERE yr = 'soon'
    UNION ALL SELECT 'A', row_no, 'start_date', beg FROM sheet_a WHERE beg = 'tomorrow'
    UNION ALL SELECT 'A', row_no, 'qc_data_not_usable', usable FROM sheet_a WHERE usable IS NOT NULL AND {_flag("usable")} IS NULL
    UNION ALL SELECT 'A', row_no, 'qc_stolen', stolen FROM sheet_a WHERE stolen IS NOT NULL AND {_flag("stolen")} IS NULL
    UNION ALL SELECT 'A', row_no, 'n_photos', pics FROM sheet_a WHERE pics = 'many' UNION ALL SELECT 'A', row_no, 'start_time', tm FROM sheet_a WHERE tm = 'noon'
    UNION ALL SELECT 'B', row_no, 'qc_stolen', stolen FROM sheet_b WHERE stolen IS NOT NULL AND {_flag("stolen")} IS NULL
    UNION ALL SELECT 'B', row_no, 'qc_sd_issue', damaged FROM sheet_b WHERE damaged IS NOT NULL AND {_flag("damaged")} IS NULL""",
    **SHEETS,
)
def sheet_warnings(s):
    return H.sheet_warnings(_sheets(s))


@query("m6_resolved_rows", "SELECT sheet_no, row_no, name, outcome, location_id FROM resolved", **SHEETS)
def resolved_rows(s):
    return I.resolve_deployments(_sheets(s), _sites(s)).select("sheet_no", "row_no", "name", "outcome", "location_id")


@query(
    "m6_new_sites",
    """SELECT t.name, ROUND(CAST(t.lat AS DOUBLE), 5) AS latitude, ROUND(CAST(t.lon AS DOUBLE), 5) AS longitude, i.id AS institution_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY sheet_no, row_no) AS k FROM placed_rows WHERE named IS NULL AND finite AND name IS NOT NULL) t
    LEFT JOIN institutions i ON LOWER(TRIM(i.name)) = LOWER(TRIM(t.park)) WHERE t.k = 1""",
    **SHEETS,
)
def new_sites(s):
    return I.new_sites(I.resolve_deployments(_sheets(s), _sites(s), create_missing=True), s.institutions)


def _latest(column: str) -> str:
    return f"ARG_MAX({column}, sheet_no * 1000000000000 + row_no) FILTER (WHERE {column} IS NOT NULL) AS {column}"


@query(
    "m6_merged_register",
    f"""SELECT COALESCE(d.name, n.name) AS name, CASE WHEN n.name IS NOT NULL THEN n.location_id ELSE d.location_id END AS location_id,
    COALESCE(n.study_year, d.study_year) AS study_year, COALESCE(n.camera_id, d.camera_id) AS camera_id, COALESCE(n.start_date, d.start_date) AS start_date,
    COALESCE(n.qc_data_not_usable, d.qc_data_not_usable) AS qc_data_not_usable, COALESCE(n.qc_stolen, d.qc_stolen) AS qc_stolen,
    COALESCE(n.qc_sd_issue, d.qc_sd_issue) AS qc_sd_issue, COALESCE(n.n_photos, d.n_photos) AS n_photos, n.qc_comment, n.start_time,
    CASE WHEN n.name IS NULL THEN 'kept' WHEN d.name IS NULL THEN 'added' ELSE 'updated' END AS change FROM deployments d FULL JOIN (
        SELECT name, {", ".join(_latest(c) for c in ("study_year", "camera_id", "start_date", "qc_data_not_usable", "qc_stolen", "qc_sd_issue", "n_photos", "qc_comment", "start_time"))},
            ARG_MAX(COALESCE(location_id, -1), sheet_no * 1000000000000 + row_no) AS site_or_none, CASE WHEN site_or_none >= 0 THEN site_or_none END AS location_id
        FROM resolved WHERE outcome = 'accepted' GROUP BY name) n ON n.name = d.name""",
    **SHEETS,
)
def merged_register(s):
    merged = I.upsert_deployments(s.deployments, I.resolve_deployments(_sheets(s), _sites(s)))
    return merged.select(
        "name", "location_id", "study_year", "camera_id", "start_date", "qc_data_not_usable", "qc_stolen", "qc_sd_issue", "n_photos", "qc_comment",
        "start_time", "change",
    )


CREATED = {
    **SHEETS,
    "created": "SELECT DISTINCT name FROM placed_rows WHERE named IS NULL AND finite AND name IS NOT NULL",
    "linked": """SELECT t.name, i.id AS institution_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY name ORDER BY sheet_no, row_no) AS k FROM placed_rows
        WHERE named IS NULL AND finite AND name IS NOT NULL) t JOIN institutions i ON LOWER(TRIM(i.name)) = LOWER(TRIM(t.park)) WHERE t.k = 1""",
}


def _created(s):
    """Sites to create, and all sites with them."""
    sites = _sites(s)
    new = cut_lineage(I.new_sites(I.resolve_deployments(_sheets(s), sites, create_missing=True), s.institutions))
    return new, I.with_new_sites(sites, new)


@query(
    "m6_register_with_new_sites",
    """SELECT COALESCE(d.name, n.name) AS name, CASE WHEN n.name IS NULL THEN l.name ELSE n.site END AS site,
    CASE WHEN n.name IS NULL THEN 'kept' WHEN d.name IS NULL THEN 'added' ELSE 'updated' END AS change FROM deployments d FULL JOIN (
        SELECT name, MAX(CASE WHEN named IS NOT NULL OR name IN (SELECT name FROM created) THEN name END) AS site
        FROM placed_rows WHERE NOT unreadable AND name IS NOT NULL GROUP BY name) n ON n.name = d.name LEFT JOIN sites l ON l.id = d.location_id""",
    **CREATED,
)
def register_with_new_sites(s):
    _, sites = _created(s)
    merged = I.upsert_deployments(s.deployments, I.resolve_deployments(_sheets(s), sites, create_missing=True))
    named = sites.select(F.col("id").alias("location_id"), F.col("name").alias("site"))
    return merged.select("name", "location_id", "change").join(named, "location_id", "left").select("name", "site", "change")


@query(
    "m6_links_of_new_sites",
    """SELECT l.name, li.institution_id FROM location_institutions li JOIN sites l ON l.id = li.location_id UNION SELECT name, institution_id FROM linked""",
    **CREATED,
)
def links_of_new_sites(s):
    new, sites = _created(s)
    links = I.with_new_links(s.location_institutions, new)
    return links.join(sites.select(F.col("id").alias("location_id"), "name"), "location_id").select("name", "institution_id")


@query(
    "m6_counters",
    """SELECT outcome AS metric, COUNT(*) AS value FROM resolved WHERE outcome <> 'accepted' GROUP BY outcome
    UNION ALL SELECT 'inserted', COUNT(DISTINCT name) FROM resolved WHERE outcome = 'accepted' AND name NOT IN (SELECT name FROM deployments)
    UNION ALL SELECT 'updated', (SELECT COUNT(*) FROM resolved WHERE outcome = 'accepted')
        - (SELECT COUNT(DISTINCT name) FROM resolved WHERE outcome = 'accepted' AND name NOT IN (SELECT name FROM deployments))
    UNION ALL SELECT 'without_site', COUNT(*) FROM resolved WHERE outcome IN ('accepted', 'no_name') AND location_id IS NULL""",
    **SHEETS,
)
def counters(s):
    return I.deployment_counters(I.resolve_deployments(_sheets(s), _sites(s)), s.deployments)


# --- landcover ---------------------------------------------------------------------------------------------------------------------
PIXELS = """SELECT CAST(c_custkey % 7 * 10 + 10 AS INT) AS class, 44 + c_nationkey * 0.25 + (c_custkey % 101 - 50) * 0.0001 AS lat,
    22 + c_nationkey * 0.5 + (c_custkey % 89 - 44) * 0.0002 AS lon FROM {customer}"""
CLASS_MAP = "SELECT CAST((r_regionkey + 1) * 10 AS INT) AS landcover_class, CASE r_regionkey WHEN 3 THEN 1 ELSE r_regionkey END AS biotope_id FROM {region}"
COVER = {
    "pixels": bare(PIXELS),
    "class_map": bare(CLASS_MAP),
    "histogram": """SELECT l.id AS location_id, p.class, COUNT(*) AS pixels FROM locations l JOIN pixels p ON ABS(p.lat - l.latitude) < 0.01
        AND 2 * 6371008.8 * ASIN(SQRT(LEAST(1.0, POWER(SIN(RADIANS(p.lat - l.latitude) / 2), 2)
            + COS(RADIANS(l.latitude)) * COS(RADIANS(p.lat)) * POWER(SIN(RADIANS(p.lon - l.longitude) / 2), 2)))) <= 500 GROUP BY 1, 2""",
    "chosen": """SELECT location_id, biotope_id, CAST(ROW_NUMBER() OVER (PARTITION BY location_id ORDER BY pixels DESC, class, biotope_id) AS INT) AS place FROM (
        SELECT h.location_id, m.biotope_id, h.pixels, h.class, ROW_NUMBER() OVER (PARTITION BY h.location_id, m.biotope_id ORDER BY h.pixels DESC, h.class) AS k
        FROM histogram h JOIN class_map m ON m.landcover_class = h.class) t WHERE k = 1 QUALIFY place <= 2""",
    "added_links": """SELECT location_id, biotope_id FROM chosen WHERE (location_id, biotope_id) NOT IN (SELECT (location_id, biotope_id) FROM location_biotopes)""",
}


def _histogram(s):
    return I.landcover_histogram(s.locations, s.spark.sql(PIXELS, customer=s.customer), 500)


def _chosen(s):
    return I.choose_biotopes(_histogram(s), s.spark.sql(CLASS_MAP, region=s.region), 2)


@query("m7_chosen_biotopes", "SELECT * FROM chosen", **COVER)
def chosen_biotopes(s):
    return _chosen(s)


@query("m8_added_links", "SELECT * FROM added_links", **COVER)
def added_links(s):
    return I.add_biotopes(s.location_biotopes, _chosen(s), s.locations)


@query(
    "m8_added_links_untagged",
    "SELECT location_id, biotope_id FROM chosen WHERE location_id NOT IN (SELECT location_id FROM location_biotopes)",
    **COVER,
)
def added_links_untagged(s):
    return I.add_biotopes(s.location_biotopes, _chosen(s), s.locations, only_untagged=True)


@query(
    "m8_assignment_counters",
    """SELECT 'locations_processed' AS metric, COUNT(*) AS value FROM locations UNION ALL SELECT 'locations_updated', COUNT(DISTINCT location_id) FROM added_links
    UNION ALL SELECT 'links_added', COUNT(*) FROM added_links
    UNION ALL SELECT 'locations_no_data', COUNT(*) FROM locations WHERE id NOT IN (SELECT location_id FROM chosen)""",
    **COVER,
)
def assignment_counters(s):
    chosen = _chosen(s)
    return I.assignment_counters(s.locations, chosen, I.add_biotopes(s.location_biotopes, chosen, s.locations))


@query("m9_landcover_histogram", "SELECT location_id, class, pixels FROM histogram", **COVER)
def landcover_histogram(s):
    return _histogram(s)


MAP_CHANGES = "SELECT CAST((r_regionkey + 3) * 10 AS INT) AS landcover_class, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_regionkey END AS biotope_id FROM {region}"


@query(
    "m10_class_map",
    """SELECT landcover_class, biotope_id FROM class_map WHERE landcover_class NOT IN (SELECT landcover_class FROM map_changes)
    UNION ALL SELECT landcover_class, biotope_id FROM map_changes WHERE biotope_id IS NOT NULL""",
    map_changes=bare(MAP_CHANGES),
    **COVER,
)
def class_map(s):
    return I.upsert_class_map(s.spark.sql(CLASS_MAP, region=s.region), s.spark.sql(MAP_CHANGES, region=s.region))
