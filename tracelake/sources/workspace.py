"""The folder every executor sees, and tables saved there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_DIR = "file:///tmp/checkpoints/tracelake"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local master may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return found.rstrip("/")


class Workspace:
    """Tables that cut lineage: written once to the shared folder and read from there, so a lost executor costs nothing.

    Results read them lazily, so they stay until the driver ends, and go then, unless `keep` (for files that are the result).
    """

    def __init__(self, spark: SparkSession, label: str, keep: bool = False):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tracelake/{label}-{uuid.uuid4().hex}"
        if not keep:
            root = spark._jvm.org.apache.hadoop.fs.Path(self.root)
            store = root.getFileSystem(spark._jsc.hadoopConfiguration())
            store.mkdirs(root)
            store.deleteOnExit(root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, name: str, df: DataFrame, compression: str = "zstd", partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
