"""Written tables between the stages of a conversion, so that none of them runs twice."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Staging:
    """Keeps relations as tables of a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.root = spark, f"{folder.rstrip('/')}/_stages-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def staging(spark: SparkSession, fallback: str) -> Iterator[Staging]:
    """A ``Staging`` in the folder of spark.checkpoint.dir, else in ``fallback``; removed at the end."""
    out = Staging(spark, spark.conf.get("spark.checkpoint.dir", None) or fallback)
    try:
        yield out
    finally:
        out.remove()
