"""Keyed state between micro-batches: a table per state, a folder per batch.

A batch writes the rows it changed, every FULL-th batch all rows, so reading the state opens FULL folders at most
and writing it follows the batch, not the state.  A batch only reads folders of earlier batches and overwrites its own: run
again after a failure it does the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Every so many batches all rows are written.
FULL = 16


def batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches that have a folder at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in (fs.listStatus(at) if fs.exists(at) else [])]
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


class BatchLog:
    """Rows of a folder per batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def put(self, rows: DataFrame, number: int) -> DataFrame:
        """Write a batch's rows; what was written, read back."""
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")
        return self.of([number])

    def of(self, numbers: list[int]) -> DataFrame:
        if not numbers:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/batch={n}" for n in numbers))

    def all(self) -> DataFrame:
        return self.of(batches(self.spark, self.path))

    def last_before(self, number: int) -> DataFrame:
        return self.of([n for n in batches(self.spark, self.path) if n < number][-1:])


class StateTable(BatchLog):
    """One row per key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], full: int = FULL):
        super().__init__(spark, path, schema)
        self.keys, self.full = keys, full

    def before(self, number: int | None = None) -> DataFrame:
        """The state before a batch (none: after all of them): each key's row of the newest batch that wrote it."""
        there = [n for n in batches(self.spark, self.path) if number is None or n < number]
        whole = [n for n in there if n % self.full == 0]
        there = [n for n in there if not whole or n >= whole[-1]]
        if len(there) < 2:
            return self.of(there)
        rows = self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", self.path).parquet(*(f"{self.path}/batch={n}" for n in there))
        values = [c for c in self.schema.names if c not in self.keys]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
        return newest.select(*self.keys, "_row.*").select(*self.schema.names)

    def put(self, rows: DataFrame, number: int) -> DataFrame:
        """Write the rows that a batch changed, one per key; where the batch's turn is, all others too."""
        if number and number % self.full == 0:
            rows = rows.select(*self.schema.names)
            rows = rows.unionByName(self.before(number).join(rows.select(*self.keys), self.keys, "left_anti"))
        return super().put(rows, number)
