"""Keyed replacement for a cross join where the result itself is every combination."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_every(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each left row beside each right row, where the result itself is every combination and the right side is a list of the
    survey (its species, say): it is put into every row as one array and unrolled there, so nothing is shuffled."""
    listed = right.agg(F.collect_list(F.struct(*right.columns)).alias("_list")).scalar()
    unrolled = left.withColumn("_list", listed).select(*left.columns, F.explode("_list").alias("_row"))
    return unrolled.select(*left.columns, "_row.*")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitioned by ``keys`` over all shuffle partitions. Few small rows that grow much later on (an unrolled grid, a
    resampling task) would otherwise be merged into one partition by their present size."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)
