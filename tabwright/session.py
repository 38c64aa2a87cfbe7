"""Runtime settings the semantics depend on, and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

# All runtime settings, so they can be applied to a session somebody else built.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.caseSensitive": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or else spark.tabwright.scratch.dir.

    Only where driver and executors are one process may both be missing: then a temporary folder serves.
    """
    for option in ("spark.checkpoint.dir", "spark.tabwright.scratch.dir"):
        folder = spark.conf.get(option, None)
        if folder:
            return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir or spark.tabwright.scratch.dir to a folder that all executors share")
    return _process_folder()


@cache
def _process_folder() -> str:
    return tempfile.mkdtemp(prefix="tabwright-")


class Scratch:
    """Intermediate tables written to the shared folder.

    A written table survives lost executors, cuts the lineage behind a shuffle, and can be read back
    with column pruning, so later statistics touch only the columns they need.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = None
        self._targets: dict[int, str] = {}

    def path(self, name: str = "part") -> str:
        if self._root is None:
            self._root = f"{shared_folder(self._spark).rstrip('/')}/run-{uuid.uuid4().hex}"
        return f"{self._root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame) -> DataFrame:
        target = self.path("table")
        df.write.parquet(target)
        frame = self._spark.read.schema(df.schema).parquet(target)
        self._targets[id(frame)] = target
        return frame

    def drop(self, frame: DataFrame) -> None:
        """Delete one table that nothing reads any more."""
        if target := self._targets.pop(id(frame), None):
            self._delete(target)

    def close(self) -> None:
        """Delete what this object wrote; frames read from it become unusable."""
        if self._root is None:
            return
        self._delete(self._root)
        self._root = None

    def _delete(self, target: str) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(target)
        path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)
