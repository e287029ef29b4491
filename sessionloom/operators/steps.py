"""Tables that a long plan makes one after the other in a shared folder, each made once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local session gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="loom-steps-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        found = _own[0]
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Steps:
    """Tables in a folder: one that was finished before, by this run or one that was killed, is read and not made again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = spark, folder.rstrip("/"), 0

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        mark, files = self._path(f"{name}/_SUCCESS")
        if not files.exists(mark):
            make().write.mode("overwrite").parquet(f"{self.folder}/{name}")
            self.made += 1
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)
