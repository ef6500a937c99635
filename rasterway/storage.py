"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from rasterway.errors import ConfigError


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ConfigError("spark.checkpoint.dir must name a folder that the driver and all executors reach")
        base = tempfile.mkdtemp(prefix="rasterway-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/rasterway-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder for a table that every executor can reach."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; frames that were returned can't be read afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
