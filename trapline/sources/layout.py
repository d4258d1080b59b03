"""Facts stored by series: tables bucketed by a join key, which later joins and aggregates read without an exchange."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.operators.consensus import series_ballots


def store_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` with one file for each bucket of ``key``, and read it so that Spark knows the layout. The catalogue
    holds an external table under a new name; the files lie where ``path`` says."""
    rows = df.repartition(buckets, F.col(key))  # the buckets' own hash, so every task writes one file
    rows.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(name := f"facts_{uuid.uuid4().hex}")
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int) -> DataFrame:
    """A table that another session stored with ``store_bucketed`` by the same key and number of buckets."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    name = f"facts_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(name)


@dataclass(frozen=True)
class SeriesFacts:
    """Series and their ballots, both laid out by series. ``ballots`` go where an operator takes votes, with None for the photos."""

    observations: DataFrame
    ballots: DataFrame


def store_facts(observations: DataFrame, identifications: DataFrame, photos: DataFrame, path: str, buckets: int | None = None) -> SeriesFacts:
    """Write both facts below ``path``. Votes are counted together before they are dealt by series, so a series with a large share
    of the votes is one row for each of its voters and species in its bucket. ``buckets`` is the number of shuffle partitions
    unless given; choose it so that a bucket fits a task."""
    n = buckets or int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return SeriesFacts(
        store_bucketed(observations, f"{path}/observations", "id", n),
        store_bucketed(series_ballots(identifications, photos), f"{path}/ballots", "observation_id", n),
    )
