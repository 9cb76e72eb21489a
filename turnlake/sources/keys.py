"""The keys of a table beside it, so that what is new can be told without reading the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that keys are kept in, by their hash.
BUCKETS = 64


class Keys:
    """Keys below a folder, in buckets: a batch reads those buckets alone that its own keys fall into."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def add(self, rows: DataFrame) -> None:
        rows.select(self.key, self._bucket()).repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def near(self, rows: DataFrame) -> DataFrame:
        """The stored keys that could be those of rows, which should be a written table."""
        found = [r[0] for r in rows.select(self._bucket()).distinct().collect()]  # at most BUCKETS
        kind = rows.schema[self.key].dataType.simpleString()
        stored = self.spark.read.schema(f"`{self.key}` {kind}, bucket int").parquet(self.path)
        return stored.where(F.col("bucket").isin(found)).select(self.key)

    def fresh(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not stored."""
        return rows.join(self.near(rows), self.key, "left_anti")
