"""Classifier result files: one CSV row per photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the file and the format of its times.
REQUIRED = ("filename", "date", "predictionbase", "scorebase")
OPTIONAL = ("top1", "count", "humancount")
TIME_FORMAT = "yyyy:MM:dd HH:mm:ss"
TIME_SHAPE = r"^\d{1,4}:\d{1,2}:\d{1,2} +\d{1,2}:\d{1,2}:\d{1,2}$"


def read_raw_detections(spark: SparkSession, path: str) -> DataFrame:
    """Text rows of all files under ``path``, which share one header. ``file`` and ``line_no`` keep the order of the rows inside a file: rows are
    numbered inside the block they were read from, and blocks are ordered by their offset."""
    header = spark.read.option("header", True).option("enforceSchema", False).option("encoding", "UTF-8").csv(path)
    named = header.toDF(*[c.lstrip("﻿").strip() for c in header.columns])
    missing = [c for c in REQUIRED if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    absent = {c: F.lit(None).cast("string") for c in OPTIONAL if c not in named.columns}
    meta = header.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(header.columns, named.columns)],
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"),
    )
    return meta.withColumns(absent).select("file", "line_no", *REQUIRED, *OPTIONAL)


def _number(column: str) -> Column:
    return F.nullif(F.trim(column), F.lit("")).try_cast("double")


def _label(column: str) -> Column:
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def _taken() -> Column:
    text = F.trim("date")
    return F.when(text.rlike(TIME_SHAPE), F.try_to_timestamp(text, F.lit(TIME_FORMAT))).cast("timestamp_ntz")


def parse_detections(raw: DataFrame) -> DataFrame:
    """Accepted rows: base name of the path, time to the second, lower-case labels, lenient numbers. Rows without a file
    name are skipped, rows with a bad time are left to ``rejected_detections``."""
    path = F.regexp_replace(F.trim("filename"), r"\\", "/")
    extra = [c for c in raw.columns if c not in (*REQUIRED, *OPTIONAL)]
    return raw.where(F.trim("filename") != "").select(
        *extra,
        F.substring_index(path, "/", -1).alias("original_filename"),
        _taken().alias("captured_at"),
        _label("predictionbase").alias("base_label"),
        _number("scorebase").alias("base_score"),
        _label("top1").alias("top1_label"),
        _number("count").try_cast("int").alias("animal_count"),
        _number("humancount").try_cast("int").alias("human_count"),
    ).where("captured_at IS NOT NULL")


def rejected_detections(raw: DataFrame) -> DataFrame:
    """Named rows whose time cannot be read."""
    extra = [c for c in raw.columns if c not in (*REQUIRED, *OPTIONAL)]
    bad = raw.where((F.trim("filename") != "") & _taken().isNull())
    return bad.select(*extra, F.coalesce(F.trim("date"), F.lit("")).alias("bad_date"))
