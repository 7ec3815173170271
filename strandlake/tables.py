"""Access to the input tables and to the shared folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths in the shared folder that this process has asked for.
_FOLDERS: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; Catalyst prunes its columns and pushes filters down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only in a local session without that setting (tests) a temporary folder is chosen and set; on a
    cluster its absence is an error, as a folder of one machine isn't shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/strandlake-{uuid.uuid4().hex}"
    _FOLDERS.append(path)
    return path


def discard(spark: SparkSession) -> None:
    """Deletes the tables that this process wrote to the shared folder; results that read them must be done."""
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """The same rows, cut from their lineage by a table in the shared folder.

    Survives the loss of executors, as the files are on storage that all of them share.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_count(spark: SparkSession) -> int:
    """The number of reduce tasks of the session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
