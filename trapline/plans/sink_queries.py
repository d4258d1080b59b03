"""Named queries that write to the shared folder and read back, and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from trapline.operators import occurrences as X
from trapline.plans.occurrence_queries import FIRST, LAST, SHAPE_SQL, _sql, tables
from trapline.plans.registry import query
from trapline.plans.report_queries import ACTIVITY, activity
from trapline.session import shared_folder
from trapline.sources import tables as W
from trapline.streaming import streams as Z


def _folder(s, name: str) -> str:
    return W.fresh_folder(shared_folder(s.spark), name)


@query("s1_table_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def table_scan(s):
    columns = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ"
    return W.scan(s.spark, f"{s.folder}/orders.parquet", columns)


@query(
    "s4_occurrence_csv",
    "SELECT NULLIF(CAST(COLUMNS(*) AS VARCHAR), '') FROM ("
    + SHAPE_SQL.replace("(SELECT * FROM agreed UNION ALL SELECT * FROM disputed UNION ALL SELECT * FROM guessed)", "(SELECT * FROM agreed)")
    + ") s",
    **_sql(),
)
def occurrence_csv(s):
    path = _folder(s, "occurrences")
    W.write_csv(X.shape(X.in_time_order(X.occurrences(tables(s), X.OccurrenceSpec(FIRST, LAST)))), path)
    return s.spark.read.option("header", True).csv(path)


@query(
    "s8_replaced_activity",
    "SELECT * REPLACE (CASE WHEN year >= 1999 THEN trap_days + 1 ELSE trap_days END AS trap_days) FROM activity",
    **ACTIVITY,
)
def replaced_activity(s):
    path = _folder(s, "activity")
    facts = activity(s)
    W.replace_table(facts, path, "year")
    W.replace_table(facts.where("year >= 1999").withColumn("trap_days", F.col("trap_days") + 1), path, "year")  # other values for some years
    return s.spark.read.parquet(path).select("species_id", "location_id", "year", "month", "detection_count", "trap_days")


GAP = """SELECT *, CAST(SUM(b) OVER (PARTITION BY upload_batch_id ORDER BY captured_at, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS series_idx
    FROM (SELECT *, CASE WHEN captured_at - LAG(captured_at) OVER (PARTITION BY upload_batch_id ORDER BY captured_at, id) <= INTERVAL '300' SECOND
        THEN 0 ELSE 1 END AS b FROM raw_photos) x"""


@query(
    "s8_committed_activity",
    "SELECT * REPLACE (CASE WHEN year >= 1999 THEN trap_days + 1 ELSE trap_days END AS trap_days) FROM activity",
    **ACTIVITY,
)
def committed_activity(s):
    path = _folder(s, "activity-versions")
    facts = activity(s)
    W.commit_table(facts, path, "year")
    W.commit_table(facts.where("year >= 1999").withColumn("trap_days", F.col("trap_days") + 1), path, "year")
    return W.committed_table(s.spark, path, facts.schema)


@query(
    "z1_series_stream",
    """SELECT upload_batch_id, MIN(captured_at) AS series_start_time, MAX(captured_at) AS series_end_time, COUNT(*) AS photo_count FROM gap_groups
    GROUP BY upload_batch_id, series_idx""",
    gap_groups=GAP,
)
def series_stream(s):
    events = Z.stream_table(s.spark, f"{s.folder}/events.parquet")
    photos = events.select(F.expr("CAST(user_id % 5 AS STRING)").alias("upload_batch_id"), F.col("ts").alias("captured_at"))
    path = _folder(s, "series")
    with Z.keyed_state(s.spark):
        Z.run_updates(Z.series_stream(photos, 300), path, _folder(s, "series-state"))
    return Z.series_of(s.spark.read.parquet(path))


@query(
    "z2_unique_uploads_stream",
    """SELECT DISTINCT CAST(user_id % 5 AS INT) AS location_id, 'F' || CAST(event_id % 9 AS STRING) AS original_filename, DATE_TRUNC('hour', ts) AS captured_at FROM events""",
)
def unique_uploads_stream(s):
    events = Z.stream_table(s.spark, f"{s.folder}/events.parquet")
    uploads = events.select(
        F.expr("CAST(user_id % 5 AS INT)").alias("location_id"),
        F.expr("'F' || CAST(event_id % 9 AS STRING)").alias("original_filename"),
        F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("captured_at"),
    )
    path = _folder(s, "uploads")
    Z.run_available(Z.unique_uploads_stream(uploads, "100 days"), path, _folder(s, "uploads-state"))
    return s.spark.read.parquet(path).withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@query(
    "z2_uploads_beside_stored",
    """SELECT DISTINCT CAST(user_id % 5 AS INT) AS location_id, 'F' || CAST(event_id % 9 AS STRING) AS original_filename, DATE_TRUNC('hour', ts) AS captured_at FROM events
    EXCEPT SELECT CAST(user_id % 5 AS INT), 'F' || CAST(event_id % 9 AS STRING), DATE_TRUNC('hour', ts) FROM events WHERE event_id % 4 = 0""",
)
def uploads_beside_stored(s):
    key = {
        "location_id": F.expr("CAST(user_id % 5 AS INT)"),
        "original_filename": F.expr("'F' || CAST(event_id % 9 AS STRING)"),
        "captured_at": F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"),
    }
    columns = [c.alias(n) for n, c in key.items()]
    events, path = Z.stream_table(s.spark, f"{s.folder}/events.parquet"), _folder(s, "accepted")
    Z.accept_uploads(events.select(columns), s.events.where("event_id % 4 = 0").select(columns), path, _folder(s, "accepted-state"))
    return s.spark.read.parquet(path).drop("batch")


@query(
    "z3_daily_uploads_stream",
    "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS photos FROM events GROUP BY 1",
)
def daily_uploads_stream(s):
    events = Z.stream_table(s.spark, f"{s.folder}/events.parquet").select(F.col("ts").alias("uploaded_at"))
    path = _folder(s, "daily")
    Z.run_updates(Z.daily_uploads_stream(events, "1 hour"), path, _folder(s, "daily-state"))
    return Z.latest(s.spark.read.parquet(path), "day", "photos")


@query(
    "z4_quorum_stream",
    """SELECT t.observation_id, t.species_id AS winner_species_id, t.n AS winner_votes, t.total_votes FROM (
        SELECT observation_id, species_id, n, CAST(SUM(n) OVER (PARTITION BY observation_id) AS BIGINT) AS total_votes FROM (
            SELECT observation_id, species_id, COUNT(*) AS n FROM (SELECT DISTINCT l_orderkey AS observation_id, l_suppkey % 7 AS user_id,
                CASE WHEN l_partkey % 12 = 0 THEN NULL WHEN l_partkey % 12 <= 2 THEN -(l_partkey % 12) ELSE l_partkey % 12 - 2 END AS species_id FROM lineitem) d
            GROUP BY 1, 2) c) t WHERE t.total_votes >= 3 AND t.n * 2 > t.total_votes""",
)
def quorum_stream(s):
    lines = Z.stream_table(s.spark, f"{s.folder}/lineitem.parquet")
    species = "CASE WHEN l_partkey % 12 = 0 THEN NULL WHEN l_partkey % 12 <= 2 THEN -(l_partkey % 12) ELSE l_partkey % 12 - 2 END"
    votes = lines.select(
        F.col("l_orderkey").alias("observation_id"), F.expr("l_suppkey % 7").alias("user_id"), F.expr(species).alias("species_id")
    )
    path = _folder(s, "quorum")
    with Z.keyed_state(s.spark):
        Z.run_available(Z.quorum_stream(votes), path, _folder(s, "quorum-state"))
    return s.spark.read.parquet(path)
