"""Session helpers: the shared scratch folder and reliable lineage cuts."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the session names none, one machine may use a folder in its warehouse; a cluster must name a folder
    that all executors share.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return folder.rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there. Only a missing path counts as missing; any other failure is raised."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """The content of a small file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a job wrote for itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/catloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps survive lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


class Shelf:
    """Frames that are written down for a while: what is not kept can be removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes everything that was put here. Frames made from it must have been written elsewhere or be done."""
        for path in self.paths:
            remove(self.spark, path)
        self.paths = []


def ship_with_tasks(module_name: str) -> None:
    """Send a module's classes and functions with the tasks that use them.

    Executors then need no copy of this package on their Python path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
