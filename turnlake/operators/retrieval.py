"""Nearest vectors by cosine, and the tables around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnlake.functions.vectors import norm
from turnlake.sources.shared import written

#: Rows of a block of vectors and of queries: a task holds one of each.
VECTOR_BLOCK, QUERY_BLOCK = 20_000, 20_000
#: Scores that a task holds at once, unless a single query needs more.
AT_ONCE = 2_000_000


def embed(chunks: DataFrame, vectors_of, dim: int, text: str = "text") -> DataFrame:
    """chunks with embedding: vectors_of makes an array (texts x dim) of a list of texts and is built once for each task.

    vectors_of: a function without arguments that returns the model's encoder.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = vectors_of()
        for batch in batches:
            out = np.asarray(encode([t or "" for t in batch]), np.float32)
            if out.shape != (len(batch), dim):
                raise ValueError(f"expected vectors of {dim}, got {out.shape}")
            yield pd.Series(list(out))

    return chunks.withColumn("embedding", run(F.col(text)))


def new_chunks(batch: DataFrame, stored: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows of the batch with a vector and an unseen key, each key once."""
    return batch.where(F.col("embedding").isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def labelled(fresh: DataFrame, stored: DataFrame, key: str, label: str = "label") -> DataFrame:
    """fresh with labels from the greatest stored one on, in key order.

    Keys are ranked within ranges of a sort; the ranges' sizes come from one
    count for each partition, so the order is never gathered in one task.
    """
    top = stored.agg((F.coalesce(F.max(label), F.lit(-1)) + 1).alias("next"))
    # written, so that both uses see the same ranges
    ranged = written(fresh.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("n"))
    starts = sizes.select("_p", F.coalesce(F.sum("n").over(W.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("_p").orderBy(key)) - 1
    return ranged.withColumn("_r", rank).join(starts, "_p").join(top).withColumn(label, F.col("next") + F.col("start") + F.col("_r")).drop("_p", "_r", "start", "next")


def top_k(queries: DataFrame, vectors: DataFrame, k: int, by: str | None = None, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rk (from 1), vec_id and score: the k nearest vectors of each query, ties to the smaller vec_id.

    Both tables have vec_id, of any type that can be sorted, and embedding, and by if the search stays within its
    values. Queries and vectors are dealt into blocks, each pair of blocks is one
    matrix product, and the best of all blocks are ranked once more. Zero
    vectors score 0; null vectors take no part; k beyond the number of vectors
    gives them all.
    """
    there = "embedding IS NOT NULL AND vec_id IS NOT NULL"
    return _in_blocks(queries.where(there), vectors.where(there), k, [by] if by else [], [], vector_block, query_block)


def _unit(arrays) -> np.ndarray:
    out = np.stack([np.asarray(a, np.float64) for a in arrays])
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, size, out=np.zeros_like(out), where=size > 0)


def _nearest(asks: np.ndarray, others: np.ndarray, k: int, met) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of a query, places and scores of its k nearest of those that it meets, the first of equal ones) of unit vectors; met: which others a slice of queries meets, None for all."""
    step = max(1, AT_ONCE // len(others))
    for at in range(0, len(asks), step):
        some = slice(at, at + step)
        # rounded, so that equal vectors tie wherever they stand in the product
        scores = asks[some] @ others.T
        np.round(scores, 12, out=scores)
        there = met(some) if met else None
        for i, score in enumerate(scores):
            among = np.flatnonzero(there[i]) if met else None
            score = score[among] if met else score
            # all that reach the kth score, so that ties go by number
            floor = np.partition(score, -k)[-k] if len(score) > k else -np.inf
            near = np.flatnonzero(score >= floor)
            near = near[np.argsort(-score[near], kind="stable")][:k]
            yield at + i, among[near] if met else near, score[near]


def _in_blocks(queries: DataFrame, vectors: DataFrame, k: int, scope: list[str], buckets: list[str], vector_block: int, query_block: int) -> DataFrame:
    """top_k(); with buckets, a column with an array of numbers, among vectors that have one of them at the same place as the query, repeated rows once."""
    rows, cols = max(1, -(-vectors.count() // vector_block)), max(1, -(-queries.count() // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = vectors.select(*scope, "vec_id", "embedding", *buckets, F.pmod(F.xxhash64("vec_id"), F.lit(rows)).alias("v"), each(cols).alias("q"))
    asked = queries.select(*scope, "vec_id", "embedding", *buckets, each(rows).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(cols)).alias("q"))
    kinds = [df.schema["vec_id"].dataType.simpleString() for df in (queries, vectors)]

    def once(rows: pd.DataFrame) -> pd.DataFrame:
        """One of the rows with the same vec_id and vector."""
        return rows[~pd.DataFrame({"id": rows["vec_id"], "v": [np.asarray(a, np.float64).tobytes() for a in rows["embedding"]]}).duplicated().to_numpy()]

    def search(others: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        mine, theirs, found, met = asks["vec_id"].to_numpy(), others["vec_id"].to_numpy(), [], None
        if len(asks) and len(others):
            if buckets:
                others, asks = once(others), once(asks)
                own, held = (np.stack(df[buckets[0]]) for df in (asks, others))
            order = np.argsort(others["vec_id"].to_numpy(), kind="stable")
            mine, theirs = asks["vec_id"].to_numpy(), others["vec_id"].to_numpy()[order]
            if buckets:
                held = held[order]

                def met(some: slice) -> np.ndarray:
                    out = np.zeros((len(own[some]), len(held)), bool)
                    for i in range(held.shape[1]):
                        out |= own[some, i, None] == held[None, :, i]
                    return out

            found = list(_nearest(_unit(asks["embedding"]), _unit(others["embedding"].to_numpy()[order]), k, met))
        at = np.repeat(np.array([i for i, _, _ in found], np.int64), [len(near) for _, near, _ in found])
        near, score = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in ((1, np.int64), (2, float)))
        return pd.DataFrame({"query_id": mine[at], "vec_id": theirs[near], "score": score})

    groups = [df.groupBy(*scope, "v", "q") for df in (dealt, asked)]
    found = groups[0].cogroup(groups[1]).applyInPandas(search, f"query_id {kinds[0]}, vec_id {kinds[1]}, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rk", F.row_number().over(order)).where(F.col("rk") <= k).select("query_id", "rk", "vec_id", "score")


def hydrated(hits: DataFrame, chunks: DataFrame, turns: DataFrame | None = None, key: str = "vec_id", turn_key: str = "turn_id") -> DataFrame:
    """Hits with their chunks' columns; hits without a chunk are dropped, chunks without a turn are kept."""
    out = hits.join(chunks, key)
    return out if turns is None else out.join(turns, turn_key, "left")


class ApproximateIndex:
    """Random projections in buckets; more tables and wider buckets find more and read more.

    Vectors without a bucket in common with a query are not found, so there may be
    fewer hits than asked for; exact search is top_k().
    """

    def __init__(self, vectors: DataFrame, tables: int = 8, width: float = 1.0, seed: int = 7):
        self.rows = self._unit(vectors)
        self.model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", numHashTables=tables, bucketLength=width, seed=seed).fit(self.rows)

    @staticmethod
    def _unit(vectors: DataFrame) -> DataFrame:
        size = norm(F.col("embedding"))
        unit = F.transform("embedding", lambda x: x.cast("double") / F.col("_size"))
        rows = vectors.where("embedding IS NOT NULL").withColumn("_size", size).where("_size > 0")
        return rows.select("vec_id", array_to_vector(unit).alias("unit"))

    def top_k(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rk, vec_id, score of the nearest of all vectors that share a bucket with a query.

        Blocks of queries meet blocks of vectors with their buckets beside them, so no
        pairs are shuffled, however many share one. Rows without a vec_id and vectors
        with components that are not finite take no part.
        """
        return _in_blocks(self._bucketed(self._unit(queries)), self._bucketed(self.rows), k, [], ["buckets"], VECTOR_BLOCK, QUERY_BLOCK)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        tables = range(self.model.getNumHashTables())
        buckets = F.array(*(F.get(vector_to_array(F.get("hashes", i)), 0) for i in tables))
        return self.model.transform(rows.where("vec_id IS NOT NULL")).select("vec_id", vector_to_array("unit").alias("embedding"), buckets.alias("buckets"))

    def save(self, path: str) -> None:
        """Writes the projections and the vectors; load() in any session reads them."""
        self.model.write().overwrite().save(f"{path}/model")
        self.rows.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ApproximateIndex:
        index = cls.__new__(cls)
        index.model, index.rows = BucketedRandomProjectionLSHModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vectors")
        return index
