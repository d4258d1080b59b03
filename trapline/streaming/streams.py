"""Stream forms of series grouping, upload de-duplication, daily counts and the quorum."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ListState, StatefulProcessor, StatefulProcessorHandle

from trapline.operators.sessions import DUPLICATE_KEY


def event_time(stream: DataFrame, column: str = "captured_at") -> DataFrame:
    """Watermarks need a zoned timestamp; survey times are wall-clock times of the session time zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp"))


class SeriesProcessor(StatefulProcessor):
    """Series of one key that may still grow, as (start, end, photos) in microseconds. Photos join or bridge them in any order of arrival;
    a timer closes a series once the watermark has passed its end and the gap, and nothing is kept of it then."""

    def __init__(self, key: str, gap_seconds: int):
        self.key, self.gap = key, gap_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ("start", "end", "photos")
        self.handle, self.open = handle, handle.getListState("open", T.StructType([T.StructField(n, T.LongType()) for n in names]))

    def due(self, run: tuple) -> int:
        """First millisecond after which no photo can join a series."""
        return (run[1] + self.gap) // 1000 + 1

    def shown(self, key: Any, runs: list[tuple], closed: bool, phase: int) -> pd.DataFrame:
        columns = zip(*runs)
        return pd.DataFrame({self.key: key[0], **dict(zip(("start", "end", "photo_count"), map(list, columns))), "closed": closed, "phase": phase})

    def keep(self, before: list[tuple], after: list[tuple]) -> None:
        old, new = {self.due(r) for r in before}, {self.due(r) for r in after}
        for ms in old - new:
            self.handle.deleteTimer(ms)
        for ms in new - old:
            self.handle.registerTimer(ms)
        if after:
            self.open.put(after)
        else:
            self.open.clear()

    def held(self) -> list[tuple]:
        return [tuple(map(int, r)) for r in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = runs = self.held()
        for batch in rows:
            times, counts = np.unique(batch.iloc[:, -1].to_numpy(), return_counts=True)  # names of computed columns do not arrive
            runs = merged([*runs, *zip(times.tolist(), times.tolist(), counts.tolist())], self.gap)
        self.keep(before, runs)
        yield self.shown(key, runs, False, 0)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, now = self.held(), timerValues.getCurrentWatermarkInMs()
        ended = [r for r in held if self.due(r) <= now]
        if not ended:
            return
        rest = [r for r in held if self.due(r) > now]
        self.keep(held, rest)
        phase = expiredTimerInfo.getExpiryTimeInMs()
        yield self.shown(key, ended, True, phase)
        if rest:
            yield self.shown(key, rest, False, phase)

    def close(self) -> None:
        pass


def merged(runs: list[tuple], gap: int) -> list[tuple]:
    """Runs joined where the next begins at most ``gap`` after the end of those before."""
    out: list[list] = []
    for start, end, n in sorted(runs):
        if out and start - out[-1][1] <= gap:
            out[-1][1], out[-1][2] = max(out[-1][1], end), out[-1][2] + n
        else:
            out.append([start, end, n])
    return [tuple(r) for r in out]


def series_stream(photos: DataFrame, gap_seconds: int, delay: str = "10 minutes", key: str = "upload_batch_id") -> DataFrame:
    """Series per key for ``run_updates``: a row when a series closes, and with each batch the open ones of the keys that it touched.
    ``series_of`` reads them. A gap of exactly ``gap_seconds`` still belongs to the series, as in the batch form. Needs ``keyed_state``."""
    timed = event_time(photos.where(F.col(key).isNotNull() & F.col("captured_at").isNotNull())).withWatermark("captured_at", delay)
    kind = photos.schema[key].dataType.simpleString()
    changes = (
        timed.select(key, "captured_at", F.unix_micros("captured_at").alias("_at"))
        .groupBy(key)
        .transformWithStateInPandas(
            statefulProcessor=SeriesProcessor(key, gap_seconds),
            outputStructType=f"{key} {kind}, start bigint, end bigint, photo_count bigint, closed boolean, phase bigint",
            outputMode="Update",
            timeMode="EventTime",
        )
    )
    times = {name: F.timestamp_micros(at).cast("timestamp_ntz").alias(name) for name, at in (("series_start_time", "start"), ("series_end_time", "end"))}
    return changes.select(key, *times.values(), "photo_count", "closed", "phase")


def series_of(updates: DataFrame, key: str = "upload_batch_id") -> DataFrame:
    """All series that a stream has seen: the closed ones, and those that its last word on each key left open."""
    columns = [key, "series_start_time", "series_end_time", "photo_count"]
    last = updates.groupBy(F.col(key).alias("_of")).agg(F.max(F.struct("_batch", "phase")).alias("_last"))
    left_open = updates.where("NOT closed").join(last, (F.col(key) == F.col("_of")) & (F.struct("_batch", "phase") == F.col("_last")))
    return updates.where("closed").select(columns).distinct().unionByName(left_open.select(columns).distinct())


def unique_uploads_stream(uploads: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """First arrival of each (location, filename, time)."""
    return event_time(uploads).withWatermark("captured_at", delay).dropDuplicatesWithinWatermark(DUPLICATE_KEY)


def accept_uploads(uploads: DataFrame, stored: DataFrame, path: str, checkpoint: str) -> None:
    """Write the arriving uploads that are neither among the ``stored`` keys nor accepted before to ``path``, and stop at the end of the
    input. Each batch has a folder of its own number, which a repeated batch writes anew from the batches before it, so it adds nothing.
    Nothing is held in state, however old a known upload is."""
    spark = uploads.sparkSession
    same = lambda left, right: reduce(and_, [left[c].eqNullSafe(right[c]) for c in DUPLICATE_KEY])
    written = T.StructType([*uploads.schema.fields, T.StructField("batch", T.LongType())])
    spark.createDataFrame([], uploads.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def add(rows: DataFrame, number: int) -> None:
        known = spark.read.schema(written).parquet(path).where(F.col("batch") < number).select(*DUPLICATE_KEY).unionByName(stored.select(*DUPLICATE_KEY))
        once = rows.dropDuplicates(DUPLICATE_KEY)
        once.join(known, same(once, known), "left_anti").write.mode("overwrite").parquet(f"{path}/batch={number}")

    uploads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_uploads_stream(events: DataFrame, delay: str = "1 day", column: str = "uploaded_at") -> DataFrame:
    """Photos per day; use update or append mode."""
    return (
        event_time(events, column)
        .withWatermark(column, delay)
        .groupBy(F.window(column, "1 day"))
        .agg(F.count(F.lit(1)).alias("photos"))
        .select(F.to_date("window.start").alias("day"), "photos")
    )


class QuorumProcessor(StatefulProcessor):
    """Distinct (user, species) pairs of the series of one bucket; a row for a series when a species holds more than half of enough pairs.
    A call to the store costs about as much as working out a hundred votes, so the open series of a bucket are read and written at once,
    one item for each. With ``keep_ms`` a timer forgets a series so long after its last vote, decided or not; the time of a vote is the last
    column then, in milliseconds, and the bucket's timer is that of the series which is forgotten next."""

    def __init__(self, min_votes: int = 3, keep_ms: int = 0):
        self.min_votes, self.keep_ms = min_votes, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = T.LongType()
        item = lambda **more: T.StructType([T.StructField(n, k) for n, k in {"observation_id": long, **more}.items()])
        self.handle = handle
        self.open = handle.getListState("open", item(users=T.ArrayType(long), species=T.ArrayType(long)))
        self.decided = handle.getListState("decided", item())
        self.until = handle.getListState("until", item(ms=long))

    def write(self, state: ListState, items: list[tuple]) -> None:
        if items:
            state.put(items)
        else:
            state.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        arrived: dict[Any, dict] = {}  # pairs of each series in order of arrival
        newest: dict[Any, int] = {}
        for row in rows:
            series = row["observation_id"]
            arrived.setdefault(series, {})[row["user_id"], row["species_id"]] = None
            if self.keep_ms:
                newest[series] = max(newest.get(series, 0), row[-1])
        if self.keep_ms:
            self.prolong(newest)
        decided = {series for (series,) in self.decided.get()}
        held = {series: dict.fromkeys(zip(users, species)) for series, users, species in self.open.get()}
        ready, changed = [], False
        for series, new in arrived.items():
            if series in decided:  # no votes are kept for a series after its decision
                continue
            pairs = held.setdefault(series, {})
            before = len(pairs)
            pairs.update(new)
            if len(pairs) == before:
                continue
            changed = True
            species, votes = Counter(of for _, of in pairs).most_common(1)[0]
            if len(pairs) >= self.min_votes and votes * 2 > len(pairs):
                del held[series]
                ready.append((series,))
                yield Row(observation_id=series, winner_species_id=species, winner_votes=votes, total_votes=len(pairs))
        if ready:
            self.decided.appendList(ready)
        if changed:
            self.write(self.open, [(series, *map(list, zip(*pairs))) for series, pairs in held.items()])

    def prolong(self, newest: dict[Any, int]) -> None:
        """Forget the series so long after these votes, if that is later than before."""
        held = dict(self.until.get())
        after = held | {series: max(held.get(series, 0), ms + self.keep_ms) for series, ms in newest.items()}
        if after != held:
            self.set_timer(min(held.values(), default=None), min(after.values()))
            self.write(self.until, list(after.items()))

    def set_timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        held = dict(self.until.get())
        kept = {series: ms for series, ms in held.items() if ms >= now and ms > fired}
        self.set_timer(None, min(kept.values(), default=None))
        self.write(self.until, list(kept.items()))
        self.write(self.open, [item for item in self.open.get() if item[0] in kept])
        self.write(self.decided, [item for item in self.decided.get() if item[0] in kept])
        return iter(())

    def close(self) -> None:
        pass


def quorum_stream(
    votes: DataFrame, min_votes: int = 3, at: str | None = None, delay: str = "1 day", keep_days: int = 90, buckets: int = 4096
) -> DataFrame:
    """Decision of each series as soon as it is reached. ``votes``: observation_id, user_id, species_id (NULL is a candidate of its own).
    With ``at``, the time of a vote, a series without votes for ``keep_days`` is forgotten, decided or not, so the state holds the series
    of that time only; votes that come later begin a new count. Without it all series are held. Series are kept in ``buckets`` by their id,
    which must stay as they are for a checkpoint; a batch reads the buckets it has votes for, so many held series want more of them."""
    columns = [F.pmod(F.xxhash64("observation_id"), F.lit(buckets)).alias("bucket"), "observation_id", "user_id", "species_id"]
    if at:
        timed = event_time(votes, at).withWatermark(at, delay)
        rows = timed.select(*columns, at, F.unix_millis(at))
    else:
        rows = votes.select(*columns)
    return rows.groupBy("bucket").transformWithState(
        statefulProcessor=QuorumProcessor(min_votes, keep_days * 86_400_000 if at else 0),
        outputStructType="observation_id bigint, winner_species_id bigint, winner_votes bigint, total_votes bigint",
        outputMode="Append",
        timeMode="EventTime" if at else "None",
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Custom state needs the store with several column families; the session setting is put back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into Parquet files and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now in update mode: every batch adds its changed rows under its number, and a repeated batch adds
    the same rows again. ``latest`` reads them."""

    def add(rows: DataFrame, number: int) -> None:
        rows.withColumn("_batch", F.lit(number)).write.mode("append").parquet(path)

    query = stream.writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest(updates: DataFrame, key: str, value: str) -> DataFrame:
    """The value of each key in its last batch."""
    return updates.groupBy(key).agg(F.max_by(value, "_batch").alias(value))


def stream_table(spark: SparkSession, path: str) -> DataFrame:
    """File stream over a Parquet table (a folder or a single file) with the schema of its present files.

    A plain path must be a folder for the stream source; the one-letter class makes it a pattern that matches either.
    """
    schema = spark.read.parquet(path).schema
    parent, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{parent}/[{name[0]}]{name[1:]}")
