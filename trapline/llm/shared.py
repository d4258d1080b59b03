"""Small helpers of the text operators: stored intermediate tables, batch numbers and free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trapline.session import shared_folder

#: Bytes of text that one batch of documents holds on average.
BATCH_BYTES = 6_000_000


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again, which cuts the lineage for later passes."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/text-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo ``divisor``; a null id gives null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor


def batch_count(df: DataFrame, text: str, batch_bytes: int = BATCH_BYTES) -> int:
    """How many batches the documents are dealt into: about ``batch_bytes`` of text each, a batch for each shuffle partition at least."""
    total = df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // batch_bytes), 1)


def with_batch(df: DataFrame, doc_id: str, text: str, batches: int, *more: str) -> DataFrame:
    """(doc_id, text, batch) and ``more`` columns: rows are dealt out by a hash of the id, so a batch is the same whenever it is built again."""
    return df.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.pmod(F.xxhash64(F.col(doc_id).cast("long"), F.lit(11)), F.lit(batches)).cast("int").alias("batch"),
        *more,
    )


def salted_join(rows: DataFrame, groups: DataFrame, key: str, spread_by: str, slots: int = 16) -> DataFrame:
    """Inner join of many ``rows`` with one row for each ``key`` in ``groups``. The rows of a key are dealt into ``slots`` parts by a hash of
    another column and each group is sent to every part, so that a key with a large share of the rows is no task of its own."""
    salt = free_name(rows, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(spread_by), F.lit(slots)))
    sent = groups.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return dealt.join(sent, [key, salt]).drop(salt)
