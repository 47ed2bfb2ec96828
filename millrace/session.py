"""Session helpers: a local session for tests and benches, and the shared folder of a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_PATHS = "__cut_at"


def local_session(cores: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named in spark.checkpoint.dir.

    Only where that setting is missing and all tasks run in the driver's own process, as in tests, a local temporary
    folder is taken; on a cluster each executor would write to its own disk, so the setting is asked for.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor loses nothing.

    The folder is Spark's checkpoint folder; its files are columnar and compressed, unlike an RDD checkpoint. A table is
    removed by release(), the others when the driver's process ends.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/millrace-{spark.sparkContext.applicationId}"
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file_system(spark, folder)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PATHS, path)
    return out


def stored(df: DataFrame) -> DataFrame:
    """df itself if cut() has written it, else written so."""
    return df if hasattr(df, _PATHS) else cut(df)


def folder_of(df: DataFrame) -> str:
    """Where cut() has written df."""
    return getattr(df, _PATHS)


def release(*tables: DataFrame) -> None:
    """Removes tables that cut() wrote, once nothing that is still to be computed reads them."""
    for df in tables:
        fs, at = _file_system(df.sparkSession, getattr(df, _PATHS))
        fs.delete(at, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells whether a table's files are still the same: the latest change, the bytes and the number of files."""
    fs, at = _file_system(spark, path)
    whole = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), whole.getLength(), whole.getFileCount()


def broadcast_value(spark: SparkSession, value):
    """A broadcast variable of a value whose size the caller has bounded."""
    return spark.sparkContext.broadcast(value)
