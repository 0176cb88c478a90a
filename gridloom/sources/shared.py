"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; with a local master, a folder of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that later plans and lost executors start there."""
    return _written(df)[0]


class Rounds:
    """The table of a loop: each step's is written to the shared folder, and the one before it, which that was made from, deleted."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self._path = _written(df)

    def step(self, df: DataFrame) -> None:
        new, path = _written(df)
        self.done()
        self.df, self._path = new, path

    def done(self) -> None:
        """Delete the table, once nothing is to be read from it."""
        spark = self.df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(self._path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
