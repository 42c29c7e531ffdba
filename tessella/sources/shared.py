"""Tables in the folder that driver and executors share, which cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset and the master is local (tests on one machine) a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or f"file://{tempfile.gettempdir()}/scratch-tables").rstrip("/")


def ready_for_checkpoints(spark: SparkSession) -> None:
    """Lets checkpoint() write to the shared folder where no folder is set yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


class Tables:
    """Intermediate tables of one job under the shared folder; as a context manager it deletes them at its end."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, **options: object) -> DataFrame:
        """Writes df, with the writer's options, and reads it again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self, first: int = 0, start: int = 1) -> None:
        """Deletes all tables, or only those before the first-th, from the start-th on."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [f"{self.root}/{k}" for k in range(max(start, 1), first)] if first else [self.root]
        for n in names:
            path(n).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path(n), True)

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()
