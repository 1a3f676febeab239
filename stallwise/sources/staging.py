"""Stage tables in shared storage: a frame that several later ones read is written once and read back.

A lost executor costs a read and not the whole lineage, and plans stay as small as one stage. Tables that nothing
reads any more are deleted; those that a returned frame still reads go when the session ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import shuffles_deleted

def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where there is none and everything runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stages-"))
    return spark.sparkContext.getCheckpointDir()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _release(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, path)


class Stages:
    """A folder of stage tables of one job."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/stages-{uuid.uuid4().hex}"
        atexit.register(_release, spark, self.root)

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        """Writes ``frame`` and returns it as read back. What was shuffled for it is deleted at once."""
        path = f"{self.root}/{name}"
        with shuffles_deleted(self.spark):
            frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
