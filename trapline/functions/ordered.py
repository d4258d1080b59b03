"""Ordered scans that never put a very large key into one task.

The rows of a key are first collapsed to one unit per second, units are scanned inside one day of the key (at most 86,400
units), and the days are stitched together through one summary row each, so a batch or series holding a large share of the
table is spread over its days and seconds. Rows whose key is NULL belong to no key and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trapline.session import cut_lineage

UNIT = "_second"
DAY = "_day"


def with_unit(rows: DataFrame, ts: str) -> DataFrame:
    return rows.withColumn(UNIT, F.date_trunc("second", F.col(ts)).cast("timestamp_ntz"))


def collapse(rows: DataFrame, keys: Sequence[str], ts: str, *extra: Column) -> DataFrame:
    """One unit per (key, second): first and last time, row count and any extra aggregates."""
    return (
        with_unit(rows, ts)
        .groupBy(*keys, UNIT)
        .agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(F.lit(1)).alias("_n"), *extra)
        .withColumn(DAY, F.to_date(UNIT))
    )


def number_gaps(units: DataFrame, keys: Sequence[str], gap_seconds: int, group: str) -> DataFrame:
    """Add ``group`` (1-based run number per key; a step longer than the gap opens a run), ``_before`` (rows of the key in
    earlier seconds) and ``_start`` (the same count at the first second of the run)."""
    if gap_seconds < 1:
        raise ValueError("gap_seconds must be at least 1")
    gap = F.expr(f"make_dt_interval(0, 0, 0, {int(gap_seconds)})")
    inside = Window.partitionBy(*keys, DAY).orderBy(UNIT)
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = (
        units.withColumn("_break", F.when(F.col("_first") - F.lag("_last").over(inside) > gap, 1).otherwise(0))
        .withColumn("_run", F.sum("_break").over(so_far))
        .withColumn("_inside", F.sum("_n").over(so_far) - F.col("_n"))
        .withColumn("_opened", F.max(F.when(F.col("_break") == 1, F.col("_inside"))).over(so_far))
    )
    days = Window.partitionBy(*keys).orderBy(DAY)
    up_to = days.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = days.rowsBetween(Window.unboundedPreceding, -1)
    previous = F.lag("_d_last").over(days)
    own_start = F.when(F.col("_opens") == 1, F.col("_d_before"))
    last_start = F.coalesce(F.col("_d_before") + F.col("_d_opened"), own_start)
    stitched = (
        marked.groupBy(*keys, DAY)
        .agg(
            F.min("_first").alias("_d_first"),
            F.max("_last").alias("_d_last"),
            F.max("_run").alias("_d_runs"),
            F.sum("_n").alias("_d_n"),
            F.max("_opened").alias("_d_opened"),
        )
        .withColumn("_opens", F.when(previous.isNull() | (F.col("_d_first") - previous > gap), 1).otherwise(0))
        .withColumn("_base", F.sum("_opens").over(up_to) + F.coalesce(F.sum("_d_runs").over(earlier), F.lit(0)))
        .withColumn("_d_before", F.coalesce(F.sum("_d_n").over(earlier), F.lit(0)))
        .withColumn("_d_start", F.coalesce(own_start, F.max(last_start).over(earlier)))
        .select(*keys, DAY, "_base", "_d_before", "_d_start")
    )
    return (
        marked.join(stitched, [*keys, DAY])
        .withColumn(group, F.col("_base") + F.col("_run"))
        .withColumn("_before", F.col("_d_before") + F.col("_inside"))
        .withColumn("_start", F.coalesce(F.col("_d_before") + F.col("_opened"), F.col("_d_start")))
        .drop("_break", "_run", "_inside", "_opened", "_base", "_d_before", "_d_start")
    )


def keyed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows that have every key."""
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows


def positions(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str = "position") -> DataFrame:
    """1-based chronological position of every row inside its key, ties broken by ``tie``. Rows without a key are left out."""
    rows = keyed(rows, keys)
    units = collapse(rows, keys, ts)
    inside = Window.partitionBy(*keys, DAY).orderBy(UNIT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
    days = (
        units.groupBy(*keys, DAY)
        .agg(F.sum("_n").alias("_d_n"))
        .withColumn("_d_before", F.coalesce(F.sum("_d_n").over(earlier), F.lit(0)))
        .drop("_d_n")
    )
    before = (
        units.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
        .join(days, [*keys, DAY])
        .select(*keys, UNIT, (F.col("_inside") + F.col("_d_before")).alias("_before"))
    )
    return attach(with_unit(rows, ts), before, keys, ts, tie, name)


def neighbours(rows: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Rows with ``position`` (1-based), ``previous`` and ``next``: the chronological place of every row inside its key and the
    ``tie`` values, which tell its rows apart, of the rows beside it. One scan: a row's neighbours come from its own second, at
    the second's edges from the seconds beside it that day, and at the day's edges from the days beside it. Rows without a key
    or a time are left out."""
    in_second = Window.partitionBy(*keys, UNIT).orderBy(ts, tie)
    seconds = Window.partitionBy(*keys, DAY).orderBy(UNIT)
    days = Window.partitionBy(*keys).orderBy(DAY)
    opens, closes = F.col("previous").isNull(), F.col("next").isNull()

    def edges(units: DataFrame, of: list[str], first: str, last: str, n: Column) -> DataFrame:
        ends = (F.max(F.when(opens, F.col(first))).alias("_first"), F.max(F.when(closes, F.col(last))).alias("_last"))
        return units.groupBy(*of).agg(n.alias("_n"), *ends)

    def linked(units: DataFrame, order) -> DataFrame:
        earlier = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
        beside = {"previous": F.lag("_last").over(order), "next": F.lead("_first").over(order)}
        return units.withColumns({"_before": F.coalesce(earlier, F.lit(0)), **beside})

    placed = with_unit(keyed(rows, [*keys, ts]), ts).withColumns(
        {"position": F.row_number().over(in_second), "previous": F.lag(tie).over(in_second), "next": F.lead(tie).over(in_second)}
    )
    units = linked(edges(placed, [*keys, UNIT], tie, tie, F.count(F.lit(1))).withColumn(DAY, F.to_date(UNIT)), seconds)
    by_day = linked(edges(units, [*keys, DAY], "_first", "_last", F.sum("_n")), days)
    names = {"_before": "_d_before", "previous": "_d_previous", "next": "_d_next"}
    settled = units.join(by_day.select(*keys, DAY, *[F.col(c).alias(n) for c, n in names.items()]), [*keys, DAY]).select(
        *keys,
        UNIT,
        (F.col("_before") + F.col("_d_before")).alias("_before"),
        F.coalesce("previous", "_d_previous").alias("_previous"),
        F.coalesce("next", "_d_next").alias("_next"),
    )
    return (
        placed.join(settled, [*keys, UNIT])
        .withColumns(
            {
                "position": F.col("_before") + F.col("position"),
                "previous": F.coalesce("previous", "_previous"),
                "next": F.coalesce("next", "_next"),
            }
        )
        .drop("_before", "_previous", "_next", UNIT)
    )


def attach(rows: DataFrame, before: DataFrame, keys: Sequence[str], ts: str, tie: str, name: str) -> DataFrame:
    """Join the per-second counts back to the rows and number the rows of each second."""
    within = Window.partitionBy(*keys, UNIT).orderBy(ts, tie)
    return (
        rows.join(before, [*keys, UNIT])
        .withColumn(name, F.col("_before") + F.row_number().over(within))
        .drop("_before", UNIT)
    )


def ranked(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, total: str | None = None) -> DataFrame:
    """1-based position of every row inside its key by ``order``, which must tell the rows of a key apart; ``total`` adds the key's rows.
    NULL is a key like any other and comes first in an order. The rows are range partitioned by quantiles of (key, order) that Spark
    samples, counted in each range and numbered from the counts before it, so a key with most of the rows lies in most of the tasks,
    whatever its numbers look like. The partitioned rows are checkpointed, because counts and numbers must come from the same ranges."""
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))  # the id is the partition, then 33 bits of the place in it
    renamed = [F.col(k).alias(f"_key{n}") for n, k in enumerate(keys)]
    sized = placed.groupBy(*renamed, F.col("_part").alias("_in")).agg(F.min("_place").alias("_from"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*[f"_key{n}" for n in range(len(keys))])
    earlier = own.orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    counts = {"_base": F.coalesce(F.sum("_n").over(earlier), F.lit(0))} | ({"_total": F.sum("_n").over(own)} if total else {})
    same = F.col("_part") == F.col("_in")
    for n, key in enumerate(keys):
        same &= F.col(key).eqNullSafe(F.col(f"_key{n}"))
    joined = placed.join(sized.withColumns(counts).drop("_n"), same)
    numbers = {name: F.col("_base") + F.col("_place") - F.col("_from") + 1} | ({total: F.col("_total")} if total else {})
    return joined.withColumns(numbers).select(*rows.columns, *numbers)
