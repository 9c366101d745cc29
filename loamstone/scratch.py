"""The folder that driver and executors share: intermediate tables with an end to their lineage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch on its way to or from a Python worker during a write.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    On one machine the system's folder for temporary files will do where the setting is
    missing; on a cluster nothing else is shared, so the setting must be there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="loamstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def own_folder(spark: SparkSession):
    """This application's part of the shared folder, as Hadoop's file system and path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/loamstone/{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fixed(spark: SparkSession, name: str) -> str:
    """A path of that name in this application's own part of the shared folder, which goes when the application ends."""
    files, path = own_folder(spark)
    if files.mkdirs(path):
        files.deleteOnExit(path)
    return f"{path.toString()}/{name}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path there."""
    return fixed(spark, f"{name}-{uuid.uuid4().hex}")


def clean_scratch(spark: SparkSession) -> bool:
    """Deletes what this application's operators have left in the shared folder, and nobody else's; only once no
    result that reads it is in use."""
    files, path = own_folder(spark)
    return files.delete(path, True)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for as long as one write takes; then they are what they were."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def save(df: DataFrame, path: str, codec: str = "zstd", *partitions: str) -> None:
    """Writes ``df``; batches on their way to Python are small, and shuffle files go when it is done."""
    with settings(df.sparkSession, **{
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }):
        writer = df.write.option("compression", codec)
        (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends here."""
    path = scratch(df.sparkSession, name)
    save(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
