"""Session helpers shared by the bench, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trapline", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on; cluster settings that are already present win."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("TRAPLINE_DRIVER_MEMORY", "16g"))
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.getOrCreate()
    apply_adaptive(spark)
    return spark


# Adaptive settings the operators count on: merged small partitions and split hot ones, also before an aggregation. Survey rows shrink
# to some ten bytes in a shuffle or file and grow to hundreds in the joins, sorts and windows that one task holds at a time, so a task
# gets a few megabytes of them.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": "32m",
}

# Partitions of an exchange before small ones are merged, unless the session asks for more.
INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITIONS = 1000


def set_where_unset(spark: SparkSession, settings: dict[str, str]) -> None:
    """Settings that nobody has chosen yet, by the cluster or in the session."""
    chosen = {row["key"] for row in spark.sql("SET").collect()}
    for name, value in settings.items():
        if name not in chosen:
            spark.conf.set(name, value)


def apply_adaptive(spark: SparkSession) -> None:
    partitions = max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    set_where_unset(spark, {**ADAPTIVE, INITIAL: str(partitions)})


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local master may go without: it gets a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="trapline-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for results that several later plans read."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
