"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local run gets a temporary folder, and a cluster an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="granary-"))
    return f"file://{_local[0]}"


def materialize(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes df as Parquet and reads it again, so that what follows computes it once, and lost executors don't matter."""
    path, schema = f"{folder(df.sparkSession)}/granary/{name}-{uuid.uuid4().hex}", df.schema
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
