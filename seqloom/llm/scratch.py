"""Intermediate tables in the folder that driver and executors share."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_owners: list[list["Scratch"]] = []


class Scratch:
    """Tables written once, so lost executors and lazy plans never recompute or change them.

    They go with the driver's JVM, or when `drop` says so: a lazy result may still need them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch_path(spark, name)
        if _owners:
            _owners[-1].append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes these tables, or everything if none is named."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for target in [self.path(n) for n in names] or [self.root]:
            path = jvm.org.apache.hadoop.fs.Path(target)
            path.getFileSystem(conf).delete(path, True)


@contextmanager
def dropped() -> Iterator[None]:
    """Deletes the scratch folders made inside it at its end; what needs them must be written by then."""
    _owners.append([])
    try:
        yield
    finally:
        for scratch in _owners.pop():
            scratch.drop()
