"""Append-only Parquet store of turns and chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.schemas import CHUNKS, ROLES, TURNS
from turnlake.sources.keys import Keys
from turnlake.sources.shared import exists, written


def turn_id(conv_id: Column, turn: Column) -> Column:
    """A turn's own number: the same input gets the same one, so a repeated append can be seen."""
    return F.sha2(F.concat_ws("|", conv_id.cast("string"), turn.cast("string")), 256)


def validated(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns that meet the constraints, the others)."""
    good = F.coalesce(F.col("role").isin(*ROLES) & F.col("text").isNotNull(), F.lit(False))
    return turns.where(good), turns.where(~good)


def referenced(chunks: DataFrame, turns: DataFrame, key: str = "turn_id") -> tuple[DataFrame, DataFrame]:
    """(chunks whose turn is stored, the others)."""
    return chunks.join(turns.select(key), key, "left_semi"), chunks.join(turns.select(key), key, "left_anti")


class Store:
    """Turns and chunks below a folder; appends only, nothing is changed or deleted.

    Each append writes a folder of its own. Beside each table lie its keys by a hash
    of theirs, so that an append reads the keys that could be its own and not the table.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        for name, key, schema in (("turns", "turn_id", TURNS), ("chunks", "chunk_id", CHUNKS)):
            # an empty part makes the table readable before its first row
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")
            if not exists(spark, f"{self.path}/{name}_keys"):
                self._keys(name, key).add(self._table(name, schema))

    def _table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")

    def _keys(self, name: str, key: str) -> Keys:
        return Keys(self.spark, f"{self.path}/{name}_keys", key)

    @property
    def turns(self) -> DataFrame:
        return self._table("turns", TURNS)

    @property
    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def append_turns(self, turns: DataFrame) -> DataFrame:
        """Appends valid turns (conv_id, turn, role, text and maybe created_at) that are not there yet; returns them."""
        if "created_at" not in turns.columns:
            turns = turns.withColumn("created_at", F.current_timestamp())
        turns = turns.withColumn("turn_id", turn_id(F.col("conv_id"), F.col("turn"))).select(*TURNS.fieldNames())
        return self._append(validated(turns)[0], "turns", "turn_id", TURNS)

    def append_chunks(self, chunks: DataFrame) -> DataFrame:
        """Appends chunks that are not there yet and whose turn is; returns them."""
        chunks = written(chunks.select(*CHUNKS.fieldNames()))
        turns = self._keys("turns", "turn_id").near(chunks)
        return self._append(referenced(chunks, turns)[0], "chunks", "chunk_id", CHUNKS)

    def _append(self, rows: DataFrame, name: str, key: str, schema) -> DataFrame:
        rows = written(rows.dropDuplicates([key]).select(*schema.fieldNames()))
        keys = self._keys(name, key)
        path = f"{self.path}/{name}/batch-{uuid.uuid4().hex}"
        keys.fresh(rows).select(*schema.fieldNames()).write.parquet(path)
        added = self.spark.read.schema(schema).parquet(path)
        keys.add(added)
        return added

    def sql(self, text: str, **args) -> DataFrame:
        """Any SQL over the views turns and chunks, with named parameters."""
        self.turns.createOrReplaceTempView("turns")
        self.chunks.createOrReplaceTempView("chunks")
        return self.spark.sql(text, args=args)


def get_turn(turns: DataFrame, number: str) -> DataFrame:
    return turns.where(F.col("turn_id") == number)


def in_order(turns: DataFrame, time: str = "created_at", tie: str = "turn") -> DataFrame:
    return turns.orderBy(time, tie)


def recent(turns: DataFrame, n: int = 20, time: str = "created_at", tie: str = "turn") -> DataFrame:
    """The newest n rows, the oldest of them first."""
    return turns.orderBy(F.desc(time), F.desc(tie)).limit(n).orderBy(time, tie)


def counted(turns: DataFrame) -> DataFrame:
    return turns.agg(F.count("*").alias("n_turns"))
