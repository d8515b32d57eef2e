"""Intermediate tables that a query reads more than once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from glyphwood.config import EngineError


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a temporary folder of this machine
    serves a local session; on a cluster executors wouldn't see each other's files there, so it is refused."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise EngineError("no_shared_folder", "spark.checkpoint.dir is not set")
    at = "file://" + tempfile.mkdtemp(prefix="glyphwood-")
    sc.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet and read back: computed once, however often it is read, and there if an executor is lost."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stage(name: str, df: DataFrame) -> DataFrame:
    return written(df, name)
