"""Reading tables, writing intermediate ones to shared storage, checking the size of what is broadcast."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While a table is stored: shuffle files are deleted as soon as the SQL execution that made them ends, as what the table was
#: made of is not read again; and Python workers get texts in smaller batches.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, which driver and executors share. It is deleted when the JVM ends.

    Where the setting is unset, a temporary folder serves a local master, as in tests; any other master is an error, as
    machines would not see each other's files.
    """
    found = getattr(spark, "_gristmill_shared", "")
    if not found:
        top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not top:
            if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        found = spark._gristmill_shared = f"{top.rstrip('/')}/gristmill-{spark.sparkContext.applicationId}"
        path, fs = _file(spark, found)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return found


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: lineage ends there and a lost executor loses nothing."""
    return _written(df, new_path(df.sparkSession, label))


class Scratch:
    """Stores tables as `stored` does and owns them: what is stored is deleted by `drop`, or in the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        path = new_path(self.spark, label)
        out = _written(df, path)
        self.paths[id(out)] = out, path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            delete_path(self.spark, self.paths.pop(id(df))[1])

    def close(self) -> None:
        self.drop(*(df for df, _ in list(self.paths.values())))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables for the time of a block; frames that read them must not leave it."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        own.close()


def delete_path(spark: SparkSession, path: str) -> None:
    p, fs = _file(spark, path)
    fs.delete(p, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df` with a broadcast hint if it has at most `rows` rows by count; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df
