"""Named queries for consensus, voting and sessionisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import consensus as C
from trapline.operators import sessions as G
from trapline.plans.registry import query


@query("c1_ranked_consensus", "SELECT observation_id, species_id, vote_count, max_quantity, CAST(rn AS INT) AS rn FROM ranked")
def ranked_consensus(s):
    return C.consensus(s.identifications, s.photos)


@query(
    "c2_candidate_voters",
    """SELECT p.observation_id, i.species_id,
        STRING_AGG(DISTINCT CAST(i.user_id AS STRING), '|' ORDER BY CAST(i.user_id AS STRING)) AS voter_ids
    FROM identifications i JOIN photos p ON p.id = i.photo_id GROUP BY p.observation_id, i.species_id""",
)
def candidate_voters(s):
    return C.voters(s.identifications, s.photos)


QUORUM_SQL = """SELECT t.observation_id, t.species_id AS winner_species_id, t.n AS winner_votes, t.total_votes FROM (
    SELECT observation_id, species_id, n, CAST(SUM(n) OVER (PARTITION BY observation_id) AS BIGINT) AS total_votes FROM (
        SELECT observation_id, species_id, COUNT(*) AS n FROM (
            SELECT DISTINCT p.observation_id, i.user_id, i.species_id
            FROM identifications i JOIN photos p ON p.id = i.photo_id JOIN observations o ON o.id = p.observation_id
            WHERE o.status = 'pending') d
        GROUP BY observation_id, species_id) c) t
    WHERE t.total_votes >= 3 AND t.n * 2 > t.total_votes"""


@query("c3_quorum_decision", QUORUM_SQL)
def quorum_decision(s):
    return C.quorum(s.observations, s.identifications, s.photos)


REDECIDE_SQL = """SELECT observation_id, species_id AS winner_species_id, vote_count AS winner_votes FROM (
    SELECT v.*, ROW_NUMBER() OVER (PARTITION BY v.observation_id ORDER BY v.vote_count DESC, v.species_id) AS k
    FROM votes v JOIN observations o ON o.id = v.observation_id
    WHERE o.status = 'pending' AND v.species_id IS NOT NULL AND v.vote_count >= 2) t WHERE k = 1"""


@query("c4_bulk_redecision", REDECIDE_SQL)
def bulk_redecision(s):
    return C.redecide(s.observations, s.identifications, s.photos, min_votes=2)


def _decisions(s):
    return C.quorum(s.observations, s.identifications, s.photos)


@query(
    "c5_completed_series",
    """SELECT o.id, CASE WHEN d.observation_id IS NOT NULL THEN 'completed' ELSE o.status END AS status
    FROM observations o LEFT JOIN quorum d ON d.observation_id = o.id""",
    quorum=QUORUM_SQL,
)
def completed_series(s):
    return C.complete_series(s.observations, _decisions(s)).select("id", "status")


@query(
    "c5_completed_photos",
    """SELECT p.id, CASE WHEN d.observation_id IS NOT NULL THEN 'completed' ELSE p.status END AS status
    FROM photos p LEFT JOIN quorum d ON d.observation_id = p.observation_id""",
    quorum=QUORUM_SQL,
)
def completed_photos(s):
    return C.complete_photos(s.photos, _decisions(s)).select("id", "status")


@query(
    "c5_graded_predictions",
    """SELECT a.id, CASE WHEN d.winner_species_id IS NULL THEN a.was_correct
        WHEN a.prediction_species_id IS NULL THEN NULL ELSE a.prediction_species_id = d.winner_species_id END AS was_correct
    FROM ai_predictions a LEFT JOIN quorum d ON d.observation_id = a.observation_id""",
    quorum=QUORUM_SQL,
)
def graded_predictions(s):
    return C.grade_predictions(s.ai_predictions, _decisions(s)).select("id", "was_correct")


@query(
    "c6_reopened_series",
    """SELECT id, CASE WHEN status = 'completed' AND flagged THEN 'pending' ELSE status END AS status FROM observations""",
)
def reopened_series(s):
    wanted = s.observations.where("flagged").select(F.col("id").alias("observation_id"))
    return C.reopen(s.observations, s.observations, wanted).select("id", "status")


@query(
    "c6_reopened_photos",
    """SELECT p.id, CASE WHEN o.status = 'completed' AND o.flagged THEN 'pending' ELSE p.status END AS status
    FROM photos p LEFT JOIN observations o ON o.id = p.observation_id""",
)
def reopened_photos(s):
    wanted = s.observations.where("flagged").select(F.col("id").alias("observation_id"))
    return C.reopen(s.photos, s.observations, wanted, key="observation_id").select("id", "status")


@query(
    "c7_votes_only_winner",
    """SELECT observation_id, species_id, vote_count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id
    ORDER BY vote_count DESC, species_id ASC NULLS LAST) AS k FROM votes) t WHERE k = 1""",
)
def votes_only_winner(s):
    return C.winners(s.identifications, s.photos, quantity="ignored").drop("max_quantity")


@query(
    "c8_gallery_winner",
    """SELECT observation_id, species_id, vote_count FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id
    ORDER BY vote_count DESC, COALESCE(max_quantity, 0) DESC, species_id) AS k FROM votes WHERE species_id IS NOT NULL) t
    WHERE k = 1""",
)
def gallery_winner(s):
    return C.winners(s.identifications, s.photos, null_species=False, quantity="unknown_zero").drop("max_quantity")


NEW_VOTES = """SELECT id AS vote_id, id AS observation_id, id % 7 AS user_id, CAST(id % 9 + 1 AS INT) AS species_id, 1 AS quantity,
    CASE WHEN id % 4 = 0 THEN '   ' ELSE '  seen by ' || CAST(id AS STRING) END AS comment, CAST(id % 6 AS INT) AS photo_index,
    id % 2 = 0 AS is_favorite FROM {observations}
    UNION ALL SELECT id + 100000000 AS vote_id, id AS observation_id, id % 7 AS user_id, 2 AS species_id, 4 AS quantity,
    'later' AS comment, CAST(id % 3 AS INT) AS photo_index, id % 3 = 0 AS is_favorite FROM {observations} WHERE id % 5 = 0"""
NEW_VOTES_SQL = NEW_VOTES.replace("{", "").replace("}", "")


@query(
    "c9_appended_votes",
    """SELECT p.id AS photo_id, v.user_id, v.species_id, v.quantity, NULLIF(SUBSTR(TRIM(v.comment), 1, 200), '') AS comment
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY observation_id, user_id ORDER BY vote_id) AS k FROM new_votes) v
    JOIN photos p ON p.observation_id = v.observation_id
    WHERE v.k = 1 AND NOT EXISTS (SELECT 1 FROM identifications i WHERE i.photo_id = p.id AND i.user_id = v.user_id)""",
    new_votes=NEW_VOTES_SQL,
)
def appended_votes(s):
    return C.append_votes(s.spark.sql(NEW_VOTES, observations=s.observations), s.photos, s.identifications)


@query(
    "c9_marked_favourites",
    """SELECT p.id, COALESCE(v.is_favorite, p.is_favorite) AS is_favorite
    FROM (SELECT id, observation_id, is_favorite, ROW_NUMBER() OVER (PARTITION BY observation_id ORDER BY captured_at, id) AS k,
            COUNT(*) OVER (PARTITION BY observation_id) AS size FROM photos) p
    LEFT JOIN (SELECT t.observation_id, t.k, ARG_MAX(t.is_favorite, t.vote_id) AS is_favorite FROM (
            SELECT n.observation_id, n.vote_id, n.is_favorite, CASE WHEN n.photo_index < z.size THEN n.photo_index ELSE 0 END + 1 AS k
            FROM new_votes n JOIN (SELECT observation_id, COUNT(*) AS size FROM photos GROUP BY observation_id) z
              ON z.observation_id = n.observation_id) t GROUP BY t.observation_id, t.k) v
      ON v.observation_id = p.observation_id AND v.k = p.k""",
    new_votes=NEW_VOTES_SQL,
)
def marked_favourites(s):
    return C.mark_favourites(s.spark.sql(NEW_VOTES, observations=s.observations), s.photos).select("id", "is_favorite")


# --- sessionisation ---------------------------------------------------------------------------------------------------
GAP_SQL = """SELECT *, CAST(SUM(b) OVER (PARTITION BY upload_batch_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS series_idx
    FROM (SELECT *, CASE WHEN prev IS NULL OR captured_at - prev > INTERVAL '300' SECOND THEN 1 ELSE 0 END AS b
        FROM (SELECT *, LAG(captured_at) OVER (PARTITION BY upload_batch_id ORDER BY captured_at, id) AS prev FROM raw_photos) x) y"""


@query(
    "g1_sessionise",
    """SELECT id, upload_batch_id, series_idx,
    ROW_NUMBER() OVER (PARTITION BY upload_batch_id, series_idx ORDER BY captured_at, id) AS sequence_number FROM gap_groups""",
    gap_groups=GAP_SQL,
)
def sessionise(s):
    return G.sessionise(s.raw_photos, gap_seconds=300).select("id", "upload_batch_id", "series_idx", "sequence_number")


@query(
    "g2_series_table",
    """SELECT upload_batch_id, series_idx, MIN(captured_at) AS series_start_time, MAX(captured_at) AS series_end_time,
    COUNT(*) AS photo_count FROM gap_groups GROUP BY upload_batch_id, series_idx""",
    gap_groups=GAP_SQL,
)
def series_table(s):
    return G.series_table(s.raw_photos, gap_seconds=300)


@query(
    "g3_location_sessions",
    """SELECT location_id, series_idx, MIN(captured_at) AS series_start_time, MAX(captured_at) AS series_end_time,
    COUNT(*) AS photo_count FROM (
        SELECT *, CAST(SUM(b) OVER (PARTITION BY location_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS series_idx
        FROM (SELECT *, CASE WHEN captured_at - LAG(captured_at) OVER (PARTITION BY location_id ORDER BY captured_at, id)
                <= INTERVAL '3600' SECOND THEN 0 ELSE 1 END AS b
            FROM (SELECT p.id, p.captured_at, o.location_id FROM photos p JOIN observations o ON o.id = p.observation_id) x) y) z
    GROUP BY location_id, series_idx""",
)
def location_sessions(s):
    placed = s.photos.select("id", "observation_id", "captured_at").join(
        s.observations.select(F.col("id").alias("observation_id"), "location_id"), "observation_id"
    )
    return G.series_table(placed, ["location_id"], 3600)


@query(
    "g4_photos_to_regroup",
    """SELECT p.id, p.upload_batch_id, CAST(NULL AS BIGINT) AS observation_id, 'uploaded' AS status FROM photos p
    JOIN upload_batches b ON b.id = p.upload_batch_id WHERE b.status <> 'completed'""",
)
def photos_to_regroup(s):
    return G.ungrouped_batches(s.photos, s.upload_batches).select("id", "upload_batch_id", "observation_id", "status")


@query(
    "g4_emptied_series",
    """SELECT p.observation_id FROM photos p LEFT JOIN upload_batches b ON b.id = p.upload_batch_id AND b.status <> 'completed'
    WHERE p.observation_id IS NOT NULL GROUP BY p.observation_id HAVING COUNT(*) = COUNT(b.id)""",
)
def emptied_series(s):
    return G.emptied_series(s.photos, s.upload_batches)


@query(
    "g5_location_photo_counts",
    """SELECT o.location_id, COUNT(*) AS photo_count FROM photos p JOIN observations o ON o.id = p.observation_id
    WHERE p.status IN ('pending', 'completed', 'needs_review') GROUP BY o.location_id""",
)
def location_photo_counts(s):
    return G.location_photo_counts(s.photos, s.observations)


UPLOADS = """SELECT id, location_id, 'IMG_' || CAST(id % 3 + 1 AS STRING) || '.JPG' AS original_filename, series_start_time AS captured_at,
    CAST(id % 50 AS STRING) AS upload_batch_id FROM {observations}
    UNION ALL SELECT id + 100000000 AS id, location_id, 'IMG_' || CAST(id % 2 + 1 AS STRING) || '.JPG' AS original_filename,
    series_start_time AS captured_at, CAST(id % 50 AS STRING) AS upload_batch_id FROM {observations}"""
UPLOADS_SQL = UPLOADS.replace("{", "").replace("}", "")


@query(
    "g6_deduplicated_uploads",
    """SELECT u.id, u.location_id, u.original_filename, u.captured_at FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY location_id, original_filename, captured_at ORDER BY id) AS k FROM uploads) u
    WHERE u.k = 1 AND NOT EXISTS (SELECT 1 FROM photos p JOIN observations o ON o.id = p.observation_id
            WHERE o.location_id = u.location_id AND p.original_filename = u.original_filename AND p.captured_at = u.captured_at)
      AND NOT EXISTS (SELECT 1 FROM photos p JOIN upload_batches b ON b.id = p.upload_batch_id
            WHERE b.location_id = u.location_id AND p.original_filename = u.original_filename AND p.captured_at = u.captured_at)""",
    uploads=UPLOADS_SQL,
)
def deduplicated_uploads(s):
    incoming = s.spark.sql(UPLOADS, observations=s.observations)
    stored = G.stored_photo_keys(s.photos, s.observations, s.upload_batches)
    return G.dedupe_uploads(incoming, stored).select("id", "location_id", "original_filename", "captured_at")


@query(
    "g7_system_filenames",
    """SELECT id, stem || '_' || LPAD(CAST(ROW_NUMBER() OVER (PARTITION BY stem ORDER BY id) AS STRING), 2, '0') || '.JPG' AS system_filename
    FROM (SELECT u.id, REPLACE(CAST(l.latitude AS STRING), '.', '_') || '_' || REPLACE(CAST(l.longitude AS STRING), '.', '_') || '_'
            || STRFTIME(u.captured_at, '%Y%m%d_%H%M%S_%f') || '_' || SUBSTR(u.upload_batch_id, 1, 8) AS stem
        FROM uploads u JOIN locations l ON l.id = u.location_id) t""",
    uploads=UPLOADS_SQL,
)
def system_filenames(s):
    return G.system_filenames(s.spark.sql(UPLOADS, observations=s.observations), s.locations).select("id", "system_filename")


@query(
    "g8_uploaded_files",
    "SELECT upload_batch_id, original_filename, captured_at FROM photos WHERE upload_batch_id IS NOT NULL",
)
def uploaded_files(s):
    return G.uploaded_files(s.photos)


@query(
    "g9_batch_accounting",
    """SELECT b.id, b.total_files, COUNT(p.id) AS received, b.total_files - COUNT(p.id) AS missing
    FROM upload_batches b LEFT JOIN photos p ON p.upload_batch_id = b.id GROUP BY b.id, b.total_files""",
)
def batch_accounting(s):
    return G.batch_accounting(s.photos, s.upload_batches)
