"""Parquet tables, and intermediate ones in the cluster's shared folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share. Where that is unset, a local master has a temporary folder; any
    other master is an error, as its machines would not see each other's files."""
    context = spark.sparkContext
    top = context.getConf().get("spark.checkpoint.dir")
    if not top:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = getattr(spark, "_gristmill_folder", "") or tempfile.mkdtemp(prefix="gristmill-")
        spark._gristmill_folder = top
    return top.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = shared_folder(df.sparkSession)
        context.setCheckpointDir(folder)
    return df.checkpoint()
