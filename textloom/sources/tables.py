"""Reading the tables of a folder, and idempotent writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The table, or some of its columns; pruning and filters reach the Parquet scan."""
    rows = ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return rows.select(*columns) if columns else rows


def replace_documents(existing: DataFrame, fresh: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clear what was derived for the documents of ``fresh``, then add their new rows: running it twice changes nothing."""
    return existing.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def write_partitioned(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Overwrite only the hash buckets of key that rows touch; each is one directory, written by its own tasks."""
    rows = rows.withColumn("key_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    rows.repartition("key_bucket").write.option("partitionOverwriteMode", "dynamic").partitionBy("key_bucket").mode("overwrite").parquet(path)


def rewrite_documents(spark: SparkSession, path: str, fresh: DataFrame, key: str = "doc_id", buckets: int = 64) -> None:
    """Replace the rows of fresh's documents in a table of ``write_partitioned``, which this reads and writes bucket by bucket: buckets of other documents are
    neither read nor touched, and a second run leaves the same rows. The new files take the old ones' place when the job commits.

    At most ``buckets`` numbers reach the driver. fresh has the table's columns, key_bucket left out.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets))
    touched = [r[0] for r in fresh.select(bucket).distinct().collect()]
    if touched:
        existing = spark.read.parquet(path).where(F.col("key_bucket").isin(touched)).select(*fresh.columns)
        write_partitioned(replace_documents(existing, fresh, key), path, key, buckets)
