"""Tables that a job writes once and finds again: a killed run goes on where it stopped, and nothing is computed twice."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where none is set, a temporary one in local mode and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Stages:
    """A folder of written stages; one that Spark has marked as complete is read, not made again. Without a folder, a new
    one in the shared directory."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/beatspark/stages-{uuid.uuid4().hex}").rstrip("/")

    def _path(self, name: str, *more: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, name, *more)))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        path, fs = self._path(name, "_SUCCESS")
        return fs.exists(path)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; `make` is only called where it is not there yet."""
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def discard(self) -> None:
        """Deletes the folder."""
        path, fs = self._path("")
        fs.delete(path, True)
