"""Streams over several files give what the batch form gives."""

import datetime as dt

from pyspark.sql import functions as F

from trapline.operators import sessions as G
from trapline.streaming import streams as Z


def _files(spark, survey, folder, parts=3):
    """Events in time order over several files, and one far-future row that closes all windows."""
    events = survey.events.select("event_id", "ts", "user_id")
    cut = events.select(F.expr(f"ntile({parts}) OVER (ORDER BY ts)").alias("part"), "*")
    for part in range(1, parts + 1):
        cut.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(folder))
    late = spark.createDataFrame([(-1, dt.datetime(2090, 1, 1), 0)], "event_id long, ts timestamp_ntz, user_id long")
    late.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


COLUMNS = ["upload_batch_id", "series_start_time", "series_end_time", "photo_count"]


def test_series_stream_equals_batch(spark, survey, tmp_path):
    stream = _files(spark, survey, tmp_path / "in")
    photos = stream.select(F.expr("CAST(user_id % 5 AS STRING)").alias("upload_batch_id"), F.col("ts").alias("captured_at"))
    with Z.keyed_state(spark):
        Z.run_updates(Z.series_stream(photos, 300), str(tmp_path / "out"), str(tmp_path / "state"))
    updates = spark.read.parquet(str(tmp_path / "out"))
    streamed = sorted(Z.series_of(updates).where("series_start_time < '2080-01-01'").select(*COLUMNS).collect())
    assert streamed == sorted(G.series_table(survey.raw_photos, gap_seconds=300).select(*COLUMNS).collect())
    assert updates.where("closed").count() > 0.9 * len(streamed)  # closed by timers when later files came


def test_late_photos_join_their_series(spark, tmp_path):
    """Rows arrive out of order over several batches, bridge series that are still open, and the last ones stay open."""
    schema = "id long, upload_batch_id string, captured_at timestamp_ntz"
    at = lambda minute, second=0: dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=minute, seconds=second)
    batches = [
        [("a", at(0)), ("a", at(8)), ("b", at(1)), (None, at(1))],
        [("a", at(4)), ("a", at(4)), ("b", at(6, 1)), ("b", at(1))],  # bridges 0 and 8 of a; one second too far for b
        [("a", at(14)), ("c", at(30)), ("b", at(3))],  # 3 joins b's first and second series
        [("a", at(33)), ("c", at(29))],
        [("d", at(90))],
        [("a", at(95)), ("d", at(90, 30))],
    ]
    rows = [(n, key, t) for n, (key, t) in enumerate(r for batch in batches for r in batch)]
    numbers = iter(rows)
    for n, batch in enumerate(batches):
        own = [next(numbers) for _ in batch]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with Z.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            Z.run_updates(Z.series_stream(stream, 300), str(tmp_path / "out"), str(tmp_path / "state"))
        so_far = spark.createDataFrame(rows[: sum(map(len, batches[: n + 1]))], schema).where("upload_batch_id IS NOT NULL")
        streamed = sorted(Z.series_of(spark.read.parquet(str(tmp_path / "out"))).select(*COLUMNS).collect())
        assert streamed == sorted(G.series_table(so_far, gap_seconds=300).select(*COLUMNS).collect())


def test_daily_stream_equals_batch(spark, survey, tmp_path):
    stream = _files(spark, survey, tmp_path / "in")
    daily = Z.daily_uploads_stream(stream.select(F.col("ts").alias("uploaded_at")))
    Z.run_available(daily, str(tmp_path / "out"), str(tmp_path / "state"))
    streamed = {r.day: r.photos for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.day: r["count"] for r in survey.events.groupBy(F.to_date("ts").alias("day")).count().collect()}
    assert streamed == batch


def test_unique_stream(spark, tmp_path):
    row = (1, "a.jpg", dt.datetime(2024, 1, 1))
    schema = "location_id int, original_filename string, captured_at timestamp_ntz"
    for rows in ([row, row], [row, (2, *row[1:])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    Z.run_available(Z.unique_uploads_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r.location_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_uploads_beside_stored_ones(spark, tmp_path):
    schema = "location_id int, original_filename string, captured_at timestamp_ntz"
    row = lambda n, name=None: (n, name, dt.datetime(2024, 1, 1))
    stored = spark.createDataFrame([row(1, "old.jpg"), row(9)], schema)
    for rows in ([row(1, "old.jpg"), row(1, "new.jpg"), row(1, "new.jpg"), row(9)], [row(1, "new.jpg"), row(2, "new.jpg"), row(8), row(8)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda state: Z.accept_uploads(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), stored, str(tmp_path / "out"), str(tmp_path / state))
    read = lambda: sorted((r.location_id, r.original_filename or "") for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run("state")
    assert read() == [(1, "new.jpg"), (2, "new.jpg"), (8, "")]
    run("state anew")  # all batches come again under their old numbers
    assert read() == [(1, "new.jpg"), (2, "new.jpg"), (8, "")]


def test_quorum_over_several_batches(spark, tmp_path):
    schema = "observation_id long, user_id long, species_id long"
    for rows in ([(1, 1, 4), (2, 1, None)], [(1, 1, 4), (1, 2, 4), (2, 2, None)], [(1, 3, 5), (2, 3, 7), (3, 1, 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with Z.keyed_state(spark):
        Z.run_available(Z.quorum_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {r.observation_id: (r.winner_species_id, r.winner_votes, r.total_votes) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: (4, 2, 3), 2: (None, 2, 3)}


def test_state_of_the_quorum_stays_flat(spark, tmp_path):
    """Every day brings new series; ten days after their last vote nothing of them is left."""
    schema = "observation_id long, user_id long, species_id long, voted_at timestamp_ntz"
    for n in range(4):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * n)
        rows = [(100 * n + k, user, 4 if k % 2 else user, at) for k in range(20) for user in (1, 2, 3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with Z.keyed_state(spark):
        Z.run_available(Z.quorum_stream(stream, at="voted_at", keep_days=10), str(tmp_path / "out"), str(tmp_path / "state"))
        left = [spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", name).load().count() for name in ("until", "decided")]
    assert left == [20, 10] and spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_quorum_keeps_many_series_in_a_bucket(spark, tmp_path):
    """All series share two buckets, votes of a series come in several batches, and each open series is one item of the state."""
    schema = "observation_id long, user_id long, species_id long"
    first = [(n, user, 3) for n in range(40) for user in (1, 2, 1)]  # two pairs, one of them twice
    second = [(n, 3, 3 if n % 2 else 9) for n in range(30)] + [(n, 4, 9) for n in range(30)]  # odd: 3 of 4, even: 2 of 4
    third = [(n, 5, 3) for n in range(30)]  # odd: decided before; even: 3 of 5
    for rows in (first, second, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with Z.keyed_state(spark):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            Z.run_available(Z.quorum_stream(stream, buckets=2), str(tmp_path / "out"), str(tmp_path / "state"))
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {(n, 3, 3, 4) if n % 2 else (n, 3, 3, 5) for n in range(30)}
    with Z.keyed_state(spark):
        left = [spark.read.format("statestore").option("path", str(tmp_path / "state")).option("stateVarName", v).load().count() for v in ("open", "decided")]
    assert left == [10, 30]
