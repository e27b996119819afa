"""The shared folder for what jobs keep between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it. Where it names none, a temporary folder, but only if driver and executors are one process: a
    cluster's machines would not see each other's files there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-checkpoint-"))
    return sc.getCheckpointDir()


def scratch_table(rows: DataFrame, name: str) -> DataFrame:
    """rows, written to the shared folder and read back: what is above is not computed again, and no executor's loss takes it."""
    path = f"{folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
