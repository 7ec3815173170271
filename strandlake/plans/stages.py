"""Stages of a workflow as tables: each is built once, and a run can start from any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Named tables below a folder that all executors share.

    A stage that is complete (its table was committed) is read instead of built, so a run that broke off
    goes on where it stopped. ``rewind`` drops a stage and all that were built after it.
    """

    def __init__(self, spark: SparkSession, folder: str, names: list[str]) -> None:
        self.spark, self.folder, self.names = spark, folder.rstrip("/"), names

    def _files(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def done(self, name: str) -> bool:
        fs, path = self._files(name)
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage, built and written if it isn't there."""
        if name not in self.names:
            raise ValueError(f"{name} is no stage; there are {', '.join(self.names)}")
        if not self.done(name):
            build().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def rewind(self, name: str) -> None:
        """Forgets a stage and the later ones."""
        for later in self.names[self.names.index(name) :]:
            fs, path = self._files(later)
            fs.delete(path, True)
