"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder, set once, only where one machine is all there is."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """A job's own folder; ``path`` may also hold models."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def written(self, df: DataFrame) -> DataFrame:
        """``df`` written once and read again: what follows, in any number of uses, starts from files."""
        path = self.new("table")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def new(self, name: str) -> str:
        """A path that nothing has been written to."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def delete(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A ``Scratch`` that is deleted at the end, also after a failure. What leaves it must be ``settled``."""
    area = Scratch(spark)
    try:
        yield area
    finally:
        area.delete()


def settled(df: DataFrame) -> DataFrame:
    """A result of few rows (of features, bins, models), worked out now: it reads no table any more."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)
