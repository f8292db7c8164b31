"""Files and tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

from hearthline.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``; each run gets its own."""
    root = checkpoint_dir(spark).rstrip("/")
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:"):]
    return f"{root}/llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, folder: str) -> DataFrame:
    """Write a table once and go on from its files, which survive the loss of executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def saved(df: DataFrame, name: str) -> DataFrame:
    return save(df, scratch(df.sparkSession, name))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, for tasks that write or read binary files."""
    return pafs.FileSystem.from_uri(uri)


class NewFile:
    """A binary file under a name of its own, so that repeated task attempts never meet.

    Readers learn the name from the rows that the successful attempt returned.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        self.store, self.path = open_store(self.uri)
        self.store.create_dir(open_store(folder)[1], recursive=True)
        self.stream = self.store.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset of the data."""
        at = self.size
        self.stream.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.stream.close()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder whose results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
