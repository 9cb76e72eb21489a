"""Exact top-k search over vector-approximation files.

The file of approximations holds a cell of one byte for each component: its place
in a grid of equal steps between the least and greatest value of the dimension.
A scan of these cells alone bounds every inner product with a query from above
and below. What the scan hands on for a query are the vectors of a block that
reach the kth lower bound there. Exact vectors are then read in the order of their
bounds: first those with the k best ones; their kth exact score closes the search
for all whose upper bound does not reach it, and only the others are read too.

The grid is one row for each dimension and is all that comes to the driver. Cells
and queries are dealt into blocks of bounded size, and each pair of blocks is one
group. Of vectors that are there very often, k + 1 numbers are enough, as equal
scores go to the smaller one.

Defined results: vectors that are null, or hold a null or non-finite component,
and rows without vec_id take no part; vectors of unequal length are padded with
zeros; a query whose vec_id is there more than once is asked once, with its
smallest vector, and meets none of those rows; such rows are candidates of their
own for other queries; equal scores go to the smaller vec_id; a query without
candidates has no rows; an empty table gives an empty result; scores beyond a long
are held at its ends; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, small, table, written

#: Cells in a block and queries in a block; what a task holds at once.
VECTOR_BLOCK, QUERY_BLOCK = 32_768, 8192
#: Bits of a cell, at most 8: what is scanned is coarser than the components, of which some 200 values occur.
BITS = 6
#: Queries scanned in one step.
SCAN = 128
LONG = np.iinfo(np.int64)
SCORED = "query_id long, vec_id long, score long"


def scaled(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vec, the components as floor(scale * x), of the rows that take part."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("vec"))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(0), width - F.size("vec")))))


def _few_equal(vectors: DataFrame, k: int) -> DataFrame:
    """vectors less those that k others with the same components and smaller numbers stand before, whoever asks."""
    ids = W.partitionBy("vec").orderBy("vec_id")
    own = W.partitionBy("vec", "vec_id").orderBy("vec_id")
    rows = vectors.withColumn("_place", F.dense_rank().over(ids)).where(F.col("_place") <= k + 1)
    return rows.withColumn("_place", F.row_number().over(own)).where(F.col("_place") <= k).drop("_place")


class Grid:
    """Lowest value and step of each dimension, and whether all sums of products stay exact in doubles."""

    def __init__(self, ends: list[tuple[int, int]], largest: int, bits: int):
        self.width = len(ends)
        most = max((max(abs(lo), abs(hi)) for lo, hi in ends), default=0) * largest * max(1, self.width) * 4
        kind = np.int64 if most < 2**53 else object  # beyond it, whole numbers of any size
        self.low = np.array([lo for lo, _ in ends], kind)
        self.step = np.array([max(1, -(-(hi - lo + 1) // 2**bits)) for lo, hi in ends], kind)

    def matrix(self, vectors) -> np.ndarray:
        return np.array([np.asarray(v) for v in vectors]).reshape(len(vectors), self.width).astype(self.low.dtype)

    def cells(self, vectors) -> list[bytes]:
        return [x.tobytes() for x in ((self.matrix(vectors) - self.low) // self.step).astype(np.uint8)]

    def bounds(self, queries: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds (queries x cells), and how far each query's lower bounds lie below them."""
        sums = np.float64 if self.low.dtype == np.int64 else object
        upper = (queries * self.step).astype(sums) @ cells.astype(sums).T + (queries @ self.low + np.maximum(queries, 0) @ (self.step - 1))[:, None]
        return upper, np.abs(queries) @ (self.step - 1)


def _longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers held at the ends of a long."""
    return (values if values.dtype != object else np.minimum(np.maximum(values, LONG.min), LONG.max)).astype(np.int64)


def scanned(grid: Grid, k: int, cells: pd.DataFrame, asks: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each query its number, the rows of cells that reach the kth lower bound, and their upper and lower bounds."""
    ids = cells["vec_id"].to_numpy()
    data = np.frombuffer(b"".join(cells["cell"]), np.uint8).reshape(len(cells), grid.width)
    own, queries = asks["vec_id"].to_numpy(), grid.matrix(asks["vec"].tolist())
    for start in range(0, len(asks), SCAN):
        uppers, slacks = grid.bounds(queries[start : start + SCAN], data)
        for query, upper, slack in zip(own[start : start + SCAN], uppers, slacks, strict=True):
            rows = np.flatnonzero(ids != query)
            upper, lower = _longs(upper[rows]), _longs(upper[rows] - slack)
            near = np.flatnonzero(upper >= np.partition(lower, -k)[-k]) if len(rows) > k else np.arange(len(rows))
            yield int(query), rows[near], upper[near], lower[near]


def candidates(queries: DataFrame, cells: DataFrame, grid: Grid, k: int, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, row, upper, lower and place (by falling upper bound) of all vectors that the scan of cells cannot rule out; a written table."""
    rows, cols = max(1, -(-cells.count() // vector_block)), max(1, -(-queries.count() // query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    dealt = cells.select("vec_id", "row", "cell", F.pmod(F.xxhash64("row"), F.lit(rows)).alias("v"), each(cols).alias("q"))
    asked = queries.select("vec_id", "vec", each(rows).alias("v"), F.pmod(F.xxhash64("vec_id"), F.lit(cols)).alias("q"))

    def scan(cells: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"query_id": query, "vec_id": cells["vec_id"].to_numpy()[at], "row": cells["row"].to_numpy()[at], "upper": upper, "lower": lower}) for query, at, upper, lower in scanned(grid, k, cells, asks)] if len(cells) and len(asks) else []
        return pd.concat(parts).astype("int64") if parts else pd.DataFrame(columns=["query_id", "vec_id", "row", "upper", "lower"]).astype("int64")

    found = dealt.groupBy("v", "q").cogroup(asked.groupBy("v", "q")).applyInPandas(scan, "query_id long, vec_id long, row long, upper long, lower long")
    return written(found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id", "row"))))


def _scores(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, grid: Grid) -> DataFrame:
    """query_id, vec_id and score of pairs (query_id, row), a written table; reads the exact vectors of these rows alone."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            products = (grid.matrix(batch["vec"].tolist()) * grid.matrix(batch["asked"].tolist())).sum(1)
            yield batch[["query_id", "vec_id"]].assign(score=_longs(products))

    met = vectors.join(small(pairs.select("query_id", "row")), "row").join(small(queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("asked")), 10_000), "query_id")
    return written(met.select("query_id", "vec_id", "vec", "asked").mapInPandas(score, SCORED))


def search(queries: DataFrame, vectors: DataFrame, k: int, bits: int = BITS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exact scores of the k vectors with the best bounds, exact scores of the others that may still enter, all candidates); vectors and queries hold vec_id and vec."""
    width = vectors.select(F.size("vec").alias("n")).unionByName(queries.select(F.size("vec").alias("n"))).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    asked = written(_padded(queries.groupBy("vec_id").agg(F.min("vec").alias("vec")), width))
    # the number of a row has to stay the same from here on
    held = written(_padded(_few_equal(vectors, k), width).withColumn("row", F.monotonically_increasing_id()))
    ends = {r["at"]: (r["lo"], r["hi"]) for r in held.select(F.posexplode("vec").alias("at", "x")).groupBy("at").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    largest = asked.agg(F.max(F.greatest(F.abs(F.array_max("vec").cast("decimal(20)")), F.abs(F.array_min("vec").cast("decimal(20)"))))).first()[0]
    grid = Grid([ends.get(i, (0, 0)) for i in range(width)], int(largest or 0), bits)

    def approximate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["vec_id", "row"]].assign(cell=grid.cells(batch["vec"].tolist()))

    cells = written(held.mapInPandas(approximate, "vec_id long, row long, cell binary"))
    found = candidates(asked, cells, grid, k, vector_block, query_block)
    drop(cells)
    first = _scores(written(found.where(F.col("place") <= k)), asked, held, grid)
    sure = first.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k)
    open_ = written(found.where(F.col("place") > k).join(sure.select("query_id", "least"), "query_id").where(F.col("upper") >= F.col("least")))
    return first, _scores(open_, asked, held, grid), found


def top_k(queries: DataFrame, vectors: DataFrame, k: int, bits: int = BITS, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k vectors with the highest inner products; both tables hold vec_id and vec."""
    first, more, _ = search(queries, vectors, k, bits, vector_block, query_block)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("vec_id % 50 = 0"), vectors, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
