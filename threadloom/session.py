"""Spark session and shared-folder helpers."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where that setting is unset and the master is a local one (tests) is a
    temporary folder made; a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(found)
    return found


def run_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; ``clear`` removes it."""
    return f"{shared_dir(spark).rstrip('/')}/threadloom-{spark.sparkContext.applicationId}"


#: folders made in the application's, in order
made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the application's folder."""
    made.append(f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return made[-1]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders that no frame still in use reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that ``written`` has kept for this application. Frames that read from it end with it."""
    delete(spark, [run_dir(spark)])


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with the rows of equal ``keys`` in one task, for Python that streams over them.

    It is dealt by a hash of the keys: a repartition by the keys themselves is dropped where a join or a group has dealt the rows
    so already, and as Python asks for no distribution, a skewed or broadcast join may then split a key between tasks.
    """
    return df.repartition(F.xxhash64(*keys))


#: bytes of a batch that goes to Python while a table is written: executor and worker each hold the texts of a batch, so 10,000 long ones are too many
BATCH_BYTES = 2 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, batches for Python end at ``BATCH_BYTES``; the rows stay the same."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = folder(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
