"""Stored survey tables: explicit schemas, reading, and replacing derived tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trapline.sources.starschema import QC_BOOLEAN_FLAGS


def _schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(" ".join(text.split()))


# Columns of the survey tables, as DDL.
TABLES = {
    "species": """id INT, scientific_name STRING, common_name_ua STRING, common_name_en STRING, category STRING, kingdom STRING,
        phylum STRING, class_name STRING, order_rank STRING, family STRING, genus STRING, establishment_means STRING""",
    "locations": """id INT, name STRING, latitude DECIMAL(10,5), longitude DECIMAL(10,5), state_province STRING, visibility_level INT,
        is_valid BOOLEAN, invalid_note STRING""",
    "location_institutions": "location_id INT, institution_id INT",
    "location_biotopes": "location_id INT, biotope_id INT",
    "biotopes": "id INT, name STRING",
    "institutions": "id INT, code STRING, name STRING, ecoregion STRING",
    "users": "id INT, username STRING, full_name STRING",
    "deployments": """id INT, location_id INT, name STRING, start_date DATE, end_date DATE, start_time STRING, end_time STRING,
        study_year INT, study_season STRING, study_design STRING, camera_id STRING, n_days_working INT, n_photos INT,
        camera_model STRING, serial_number STRING, """
    + ", ".join(f"{flag} BOOLEAN" for flag in QC_BOOLEAN_FLAGS)
    + ", qc_local_datetime_issue STRING, qc_comment STRING",
    "observations": """id BIGINT, location_id INT, series_start_time TIMESTAMP_NTZ, series_end_time TIMESTAMP_NTZ, photo_count INT,
        status STRING, uploaded_by_id INT, created_at TIMESTAMP_NTZ, flagged BOOLEAN, flag_note STRING""",
    "upload_batches": """id STRING, location_id INT, uploaded_by_id INT, status STRING, total_files INT, processed_files INT,
        created_at TIMESTAMP_NTZ""",
    "photos": """id BIGINT, observation_id BIGINT, upload_batch_id STRING, original_filename STRING, system_filename STRING,
        sequence_number INT, captured_at TIMESTAMP_NTZ, status STRING, is_favorite BOOLEAN""",
    "identifications": """id BIGINT, photo_id BIGINT, user_id INT, species_id INT, quantity INT, comment STRING,
        created_at TIMESTAMP_NTZ""",
    "identification_behaviors": "identification_id BIGINT, behavior_type_id INT",
    "behavior_types": "id INT, name STRING",
    "service_visits": """id INT, location_id INT, user_id INT, visit_datetime TIMESTAMP_NTZ, visit_purpose_id INT,
        battery_type_id INT, is_camera_operational BOOLEAN, photos_on_card INT, comments STRING""",
    "ai_models": "id INT, name STRING, version STRING, is_active BOOLEAN, level_id INT",
    "ai_model_levels": "id INT, code STRING, accuracy_rank INT",
    "ai_predictions": """id BIGINT, photo_id BIGINT, observation_id BIGINT, model_id INT, prediction_label STRING,
        prediction_species_id INT, prediction_score DOUBLE, base_label STRING, base_score DOUBLE, top1_label STRING,
        animal_count INT, human_count INT, was_correct BOOLEAN""",
    "ai_label_map": "label STRING, species_id INT",
    "location_monthly_activity": "species_id INT, location_id INT, year INT, month INT, detection_count BIGINT, trap_days BIGINT",
}


def table_schema(name: str) -> T.StructType:
    return _schema(TABLES[name])


def scan(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Parquet files read with a declared schema (DDL); nothing is inferred, and only these columns are read."""
    return spark.read.schema(_schema(columns)).parquet(path)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored survey table with its declared schema."""
    return scan(spark, f"{folder.rstrip('/')}/{name}", TABLES[name])


def read_jdbc_table(spark: SparkSession, name: str, url: str, key: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """The same table from a database, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load().select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table_schema(name)])


def replace_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a derived table over its former content. With a partition column only the partitions present are replaced, so a
    re-run of some years leaves the others alone."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


COMMITS = "commits"


def _files(spark: SparkSession, path: str):
    """Hadoop's view of a folder: its file system, its file context and the class of its paths."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    own, settings = paths(path), spark._jsc.hadoopConfiguration()
    system = own.getFileSystem(settings)
    return system, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), settings), paths


def committed_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a table's versions, ascending."""
    system, _, paths = _files(spark, path)
    folder = paths(f"{path}/{COMMITS}")
    if not system.exists(folder):
        return []
    return sorted(int(f.getPath().getName()) for f in system.listStatus(folder) if f.getPath().getName().isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    return json.loads(spark.read.text(f"{path}/{COMMITS}/{version:012d}", wholetext=True).first()[0])


def commit_table(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Write ``df`` as the next version of the table at ``path`` and return its number. The rows go to a folder of their own first; a
    version begins when its commit file, which names the folder of each partition, gets its name. Until then, and after a run that was
    stopped, readers see the former version whole. With a partition column only the partitions present are replaced, and the others'
    files stay as they are. Of two writers at once the second fails."""
    spark, folder = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{folder}")
    versions = committed_versions(spark, path)
    held = _manifest(spark, path, versions[-1]) if versions and partition_by else {}
    system, context, paths = _files(spark, path)
    parts = [f.getPath().getName() for f in system.listStatus(paths(f"{path}/{folder}")) if f.isDirectory() and "=" in f.getPath().getName()]
    manifest = held | (dict.fromkeys(parts, folder) if partition_by else {"": folder})
    version = versions[-1] + 1 if versions else 0
    draft = paths(f"{path}/{COMMITS}/draft-{folder}")
    out = system.create(draft, True)
    out.write(json.dumps(manifest).encode())
    out.close()
    never = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no overwriting
    context.rename(draft, paths(f"{path}/{COMMITS}/{version:012d}"), never)
    return version


def committed_table(spark: SparkSession, path: str, columns: str | T.StructType, version: int | None = None) -> DataFrame:
    """The last version of a table, or an earlier one that is still there, with its columns (a schema or DDL)."""
    versions = committed_versions(spark, path)
    schema = _schema(columns) if isinstance(columns, str) else columns
    if not versions:
        return spark.createDataFrame([], schema)
    folders: dict[str, list[str]] = {}
    for part, folder in _manifest(spark, path, versions[-1] if version is None else version).items():
        folders.setdefault(folder, []).append(f"{path}/{folder}/{part}".rstrip("/"))
    read = [spark.read.schema(schema).option("basePath", f"{path}/{folder}").parquet(*parts) for folder, parts in sorted(folders.items())]
    rows = read[0]
    for more in read[1:]:
        rows = rows.unionByName(more)
    return rows.select([f.name for f in schema])


def drop_old_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Forget all but the last ``keep`` versions and delete the folders that none of them names. Not beside a writer."""
    system, _, paths = _files(spark, path)
    versions = committed_versions(spark, path)
    kept, gone = versions[-keep:], versions[:-keep]
    named = {folder for v in kept for folder in _manifest(spark, path, v).values()}
    for v in gone:
        system.delete(paths(f"{path}/{COMMITS}/{v:012d}"), False)
    for f in system.listStatus(paths(path)):
        if f.getPath().getName().startswith("rows-") and f.getPath().getName() not in named:
            system.delete(f.getPath(), True)


def fresh_folder(parent: str, name: str) -> str:
    """A new path below a shared folder, one per run."""
    return f"{parent.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_csv(df: DataFrame, path: str) -> None:
    """Export rows as CSV files with a header, one per partition."""
    df.write.mode("overwrite").option("header", True).csv(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, length, modificationTime) of the files below a folder; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length", "modificationTime")
