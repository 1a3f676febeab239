"""Session and column helpers of the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, so that a worker's memory doesn't follow the length of texts; a setting of the session's own stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Leaves a configured shared folder alone; sets a temporary one only where there is none and everything runs on one machine, as in tests."""
    if not spark.conf.get("spark.checkpoint.dir", "") and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared checkpoint folder, so that it survives lost executors and isn't computed again."""
    with_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def sample_below(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows of ``df`` at most, chosen by a hash of ``key`` alike on every run; all of them if there are fewer."""
    n = df.count()
    if n <= most:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * (most / n)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, folds: int = 5) -> DataFrame:
    """(doc_id, text, label) of at most about ``most`` labelled documents outside the held-out fold; materialised.

    Rows without an id or a label are left out; of repeated labels the larger counts. The bound makes
    the ids safe to broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (fold(F.col("doc_id"), folds) != 0)).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))
    known = cut(sample_below(cut(known), "doc_id", most))
    return cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
